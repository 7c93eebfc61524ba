"""Figures that describe a scene: reductions, utilisation, status lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.functions.scalar import percent, texture_dims


def reduction(before: Column, after: Column) -> Column:
    """Per cent removed, at least 0; 0 of nothing."""
    return F.when(before > 0, F.greatest(F.lit(0.0), (1 - after / before) * 100)).otherwise(0.0)


def reductions(scenes: DataFrame) -> DataFrame:
    """Adds merge, cull and total reductions to rows with source, merged and visible counts."""
    c = F.col
    return scenes.withColumns({
        "merge_pct": reduction(c("source"), c("merged")), "cull_pct": reduction(c("merged"), c("visible")), "total_pct": reduction(c("source"), c("visible")),
    })


def utilisation(n: Column, most: int) -> Column:
    """Per cent of the largest texture that n texels take; over 100 where they don't fit."""
    d = texture_dims(n, most, checked=False)
    return d["width"] * d["height"] / (float(most) * most) * 100


def status(scenes: DataFrame) -> DataFrame:
    """A readable line for each scene, or that there is nothing to show."""
    c = F.col
    empty = (c("visible") == 0) & (c("texts") == 0) & (c("fills") == 0) & (c("layers") == 0)
    line = F.concat_ws(
        ", ", F.concat(F.format_number("visible", 0), F.lit(" segments")), F.concat(F.format_number("fills", 0), F.lit(" fills")), F.concat(F.format_number("texts", 0), F.lit(" texts")),
        F.concat(F.format_number("layers", 0), F.lit(" images")), F.concat(percent(reduction(c("source"), c("visible"))), F.lit(" removed")),
    )
    return scenes.withColumn("status", F.when(empty, "nothing to show").otherwise(line))
