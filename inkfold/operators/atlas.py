"""Glyph atlas: tile sizes, shelf packing in power-of-two squares, quality ladder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkfold.functions.scalar import power_of_two
from inkfold.plans.session import written

#: Fixed values.
BASE, INNER_LOW, INNER_HIGH, PAD = 96.0, 8, 256, 8
LADDER = [1.0, 0.85, 0.7, 0.58, 0.46, 0.36]
MOST_SIDE = 8192
JOINED = 1e-3


def tiles(glyphs: DataFrame, target: float = BASE) -> DataFrame:
    """(glyph_id, scale, tile_w, tile_h): the longer side becomes ``target``; glyphs without extent are left out."""
    c = F.col
    g = glyphs.withColumn("w", c("max_x") - c("min_x")).withColumn("h", c("max_y") - c("min_y")).where("w > 1e-6 and h > 1e-6")
    g = g.withColumn("scale", target / F.greatest("w", "h"))
    inner = lambda v: F.least(F.lit(INNER_HIGH), F.greatest(F.lit(INNER_LOW), F.ceil(c(v) * c("scale")).cast("int")))
    return g.select("glyph_id", "scale", (inner("w") + 2 * PAD).alias("tile_w"), (inner("h") + 2 * PAD).alias("tile_h"))


def pack(rows: list[tuple[int, int, int]], most: int = MOST_SIDE) -> tuple[int, int, dict[int, tuple[int, int]]] | None:
    """Shelves in the order high, wide, id: (width, height, places), or None where ``most`` isn't enough."""
    if not rows:
        return None
    order = sorted(rows, key=lambda r: (-r[2], -r[1], r[0]))
    area = sum(w * h for _, w, h in rows)
    side = max(max(max(w, h) for _, w, h in rows), int(area**0.5))
    width = 1 << max(0, side - 1).bit_length()
    while width <= most:
        x = y = shelf = 0
        at = {}
        for i, w, h in order:
            if x + w > width:
                x, y, shelf = 0, y + shelf, 0
            if w > width or y + h > most:
                at = None
                break
            at[i] = (x, y)
            x, shelf = x + w, max(shelf, h)
        if at is not None and y + shelf <= max(width, 1):
            return width, 1 << max(0, y + shelf - 1).bit_length(), at
        width *= 2
    return None


def placements(glyphs: DataFrame, most: int = MOST_SIDE) -> DataFrame:
    """(glyph_id, x, y, tile_w, tile_h, u0, v0, u1, v1, atlas_w, atlas_h) at the best quality that fits.

    Wrapping depends on all earlier tiles, so the distinct glyphs (bounded by the atlas' own
    area) are packed on the driver; the first scale of the ladder that fits is taken.
    """
    spark = glyphs.sparkSession
    glyphs = written(glyphs.select("glyph_id", "min_x", "min_y", "max_x", "max_y"), "glyphs")  # every scale reads them
    schema = "glyph_id long, x int, y int, tile_w int, tile_h int, u0 double, v0 double, u1 double, v1 double, atlas_w int, atlas_h int"
    limit = most * most // (INNER_LOW + 2 * PAD) ** 2
    for share in LADDER:
        rows = [(r["glyph_id"], r["tile_w"], r["tile_h"]) for r in tiles(glyphs, BASE * share).limit(limit + 1).collect()]
        if not rows:
            return spark.createDataFrame([], schema)
        done = pack(rows, most) if len(rows) <= limit else None
        if done:
            w, h, at = done
            out = [(i, *at[i], tw, th, (at[i][0] + PAD) / w, (at[i][1] + PAD) / h, (at[i][0] + tw - PAD) / w, (at[i][1] + th - PAD) / h, w, h) for i, tw, th in rows]
            return spark.createDataFrame(out, schema)
    raise ValueError("the glyphs fit no atlas")


def area(tiles_df: DataFrame) -> DataFrame:
    """Total area, the largest sides and the first width to try."""
    a = tiles_df.agg(F.sum(F.col("tile_w").cast("long") * F.col("tile_h")).alias("area"), F.max(F.greatest("tile_w", "tile_h")).alias("largest"))
    return a.withColumn("first_width", power_of_two(F.greatest(F.col("largest").cast("long"), F.floor(F.sqrt(F.col("area").cast("double"))))))


def subpaths(segments: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``subpath``: a new one starts where a segment doesn't begin at its predecessor's end."""
    w = Window.partitionBy(*by).orderBy("pos")
    joined = (F.abs(F.col("x0") - F.lag("x1").over(w)) <= JOINED) & (F.abs(F.col("y0") - F.lag("y1").over(w)) <= JOINED)
    new = F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)
    return segments.withColumn("_new", new).withColumn("subpath", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_new")
