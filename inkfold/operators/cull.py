"""Removal of strokes that can't be seen, in four stages, each counted once.

transparent, degenerate, duplicate, contained: a row's reason is the first stage that
drops it. Duplicates and containment are decided inside a page. Coordinates are rounded
to float32 first, as stored cells are.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkfold.functions.scalar import FLAG_HAIRLINE, FLAG_ROUND_CAP, INVISIBLE_ALPHA, OPAQUE_ALPHA, f32, quantize
from inkfold.plans.session import ship, written

#: Fixed values.
POSITION, STYLE, KIND = 1000, 10000, 10
DIRECTION, OFFSET = 2000, 200
INTERVAL_EPS, WIDTH_EPS = 0.05, 1e-4
SHORTEST = 1e-5

GEOMETRY = ["x0", "y0", "cx", "cy", "x1", "y1", "half_width", "r", "g", "b", "alpha"]


def stored(strokes: DataFrame) -> DataFrame:
    return strokes.withColumns({c: f32(F.col(c)) for c in GEOMETRY})


def _length(x0, y0, x1, y1) -> Column:
    return F.hypot(x1 - x0, y1 - y0)


def curve_length() -> Column:
    """Of a line, or of a quadratic's two legs."""
    c = F.col
    line = _length(c("x0"), c("y0"), c("x1"), c("y1"))
    legs = _length(c("x0"), c("y0"), c("cx"), c("cy")) + _length(c("cx"), c("cy"), c("x1"), c("y1"))
    return F.when(c("prim_type") == 0, line).otherwise(legs)


def transparent() -> Column:
    return F.col("alpha") <= INVISIBLE_ALPHA


def degenerate() -> Column:
    flag = lambda bit: F.col("flags").bitwiseAND(bit) != 0
    point = (F.col("prim_type") == 0) & flag(FLAG_ROUND_CAP) & (flag(FLAG_HAIRLINE) | (F.col("half_width") > 1e-6))
    return (curve_length() < SHORTEST) & ~point


def duplicate_key() -> list[Column]:
    """Quantised style and shape; lines run from their smaller end."""
    c = F.col
    p = {n: quantize(c(n), POSITION) for n in ("x0", "y0", "cx", "cy", "x1", "y1")}
    back = (c("prim_type") == 0) & ((c("x1") < c("x0")) | ((c("x1") == c("x0")) & (c("y1") < c("y0"))))
    turn = lambda a, b: F.when(back, p[b]).otherwise(p[a])
    control = lambda k, a: F.when(c("prim_type") == 0, F.lit(0)).otherwise(p[k])
    style = [quantize(c(n), STYLE) for n in ("half_width", "r", "g", "b", "alpha")]
    keys = [quantize(c("prim_type"), KIND), turn("x0", "x1"), turn("y0", "y1"), control("cx", 0), control("cy", 0), turn("x1", "x0"), turn("y1", "y0"), *style, c("flags")]
    return [k.alias(f"k{i}") for i, k in enumerate(keys)]


def _reasoned(strokes: DataFrame) -> DataFrame:
    """With ``reason`` transparent, degenerate, duplicate or null.

    The first row of a key is found by an aggregate that combines on the map side, so a stroke that
    is drawn a million times is no hot key; rows then meet the first ones by their id,
    (doc_id, page_no, seg_id), which spreads evenly.
    """
    s = strokes.withColumn("reason", F.when(transparent(), "transparent").when(degenerate(), "degenerate"))
    s = s.select("*", *duplicate_key())
    keys = ["doc_id", "page_no", *[f"k{i}" for i in range(13)]]
    first = s.where("reason is null").groupBy(*keys).agg(F.min("seg_id").alias("first"))
    first = first.select("doc_id", "page_no", F.col("first").alias("seg_id"), F.lit(True).alias("is_first"))
    s = s.drop(*[f"k{i}" for i in range(13)]).join(first, ["doc_id", "page_no", "seg_id"], "left")
    return s.withColumn("reason", F.when(F.col("reason").isNull() & F.col("is_first").isNull(), "duplicate").otherwise(F.col("reason"))).drop("is_first")


def cover_key(strokes: DataFrame) -> DataFrame:
    """Lines of some length with the bucket of their carrier line and their interval on it."""
    c = F.col
    line = strokes.where(c("prim_type") == 0).withColumn("len", _length(c("x0"), c("y0"), c("x1"), c("y1"))).where(c("len") >= SHORTEST)
    line = line.withColumn("ux", (c("x1") - c("x0")) / c("len")).withColumn("uy", (c("y1") - c("y0")) / c("len"))
    back = (c("ux") < -1e-10) | ((F.abs(c("ux")) <= 1e-10) & (c("uy") < 0))
    line = line.withColumn("sign", F.when(back, -1.0).otherwise(1.0))
    line = line.withColumn("ux", c("ux") * c("sign") + 0.0).withColumn("uy", c("uy") * c("sign") + 0.0)
    along = lambda x, y: c(x) * c("ux") + c(y) * c("uy")
    off = -c("uy") * c("x0") + c("ux") * c("y0")
    keys = [quantize(c("ux"), DIRECTION), quantize(c("uy"), DIRECTION), quantize(off, OFFSET), *[quantize(c(n), STYLE) for n in "rgb"], c("flags").cast("long")]
    start, end = along("x0", "y0"), along("x1", "y1")
    return line.select(
        "doc_id", "page_no", "seg_id", "half_width", "alpha", "len", *[k.alias(f"b{i}") for i, k in enumerate(keys)],
        F.least(start, end).alias("start"), F.greatest(start, end).alias("end"),
    )


BUCKET = ["doc_id", "page_no", *[f"b{i}" for i in range(7)]]


def _covered(batches):
    """Of lines sorted by bucket, island and rank, the ids of those inside an earlier kept, opaque one.

    Widths fall within an island, so every earlier line is wide enough. The covers kept are a staircase
    of starts and ends that both rise, so a bisection finds whether one spans the line.
    """
    last, starts, ends = None, [], []
    for batch in batches:
        keys = np.stack([batch.column(i).to_numpy() for i in range(len(BUCKET) + 1)])
        fresh = np.ones(batch.num_rows, bool)
        fresh[1:] = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
        if batch.num_rows and last is not None:
            fresh[0] = (keys[:, 0] != last).any()
        last = keys[:, -1] if batch.num_rows else last
        low, high, alpha = (batch.column(n).to_pylist() for n in ("start", "end", "alpha"))
        out = np.zeros(batch.num_rows, bool)
        for i, new in enumerate(fresh.tolist()):
            if new:
                starts, ends = [], []
            s, e = low[i], high[i]
            k = bisect_right(starts, s + INTERVAL_EPS)  # the cover that ends last of those that start early enough is the one before
            if k and ends[k - 1] >= e - INTERVAL_EPS:
                out[i] = True
            elif alpha[i] >= OPAQUE_ALPHA:
                k = bisect_left(starts, s)
                if not k or ends[k - 1] < e:
                    j = bisect_right(ends, e, k)
                    starts[k:j], ends[k:j] = [s], [e]
        yield pa.RecordBatch.from_arrays([batch.column(n).filter(pa.array(out)) for n in ("doc_id", "page_no", "seg_id")], ["doc_id", "page_no", "seg_id"])


def contained(strokes: DataFrame) -> DataFrame:
    """(doc_id, page_no, seg_id) of lines inside an earlier kept, opaque, wider line of their bucket.

    A bucket is taken in the order widest, longest, first start, id: a total order. Lines on one carrier
    fall into islands that don't touch; each is independent of the others, and a task takes whole
    islands, not whole buckets. They stream through one pass, sorted, in O(n log n); only an
    island's covers are held.
    """
    ship(strokes.sparkSession)
    c = F.col
    lines = cover_key(strokes).withColumn("doc_id", c("doc_id").cast("long")).withColumn("page_no", c("page_no").cast("int"))
    along = Window.partitionBy(*BUCKET).orderBy("start", "seg_id")
    reach = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    lines = lines.withColumn("_new", F.when(c("start") <= reach + 2 * INTERVAL_EPS, 0).otherwise(1))
    lines = lines.withColumn("island", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    place = [*BUCKET, "island"]
    some = lines.select(*place, "seg_id", "half_width", "len", "start", "end", "alpha").repartition(*place)
    return some.sortWithinPartitions(*place, F.desc("half_width"), F.desc("len"), "start", "seg_id").mapInArrow(_covered, "doc_id long, page_no int, seg_id long")


def cull(strokes: DataFrame, *, stages: int = 4) -> DataFrame:
    """All strokes with the column ``reason``: null for visible ones, else the stage that drops them."""
    s = _reasoned(stored(strokes))
    if stages < 4:
        return s
    out = contained(s.where("reason is null")).withColumn("inside", F.lit(True))
    s = s.join(out, ["doc_id", "page_no", "seg_id"], "left")
    return s.withColumn("reason", F.when(F.col("inside"), "contained").otherwise(F.col("reason"))).drop("inside")


def visible(strokes: DataFrame, *, stages: int = 4) -> DataFrame:
    """What is left, original order of ids kept: the rows of ``cull`` without a reason, none else being carried along.

    The first ids of keys are written, so that the planner knows how few they are and broadcasts them where it can: then
    no stroke is moved for them, and only first strokes are tested for containment.
    """
    s = stored(strokes).where(~F.coalesce(transparent(), F.lit(False)) & ~F.coalesce(degenerate(), F.lit(False)))
    keys = ["doc_id", "page_no", *[f"k{i}" for i in range(13)]]
    row = ["doc_id", "page_no", "seg_id"]
    first = s.select(*row, *duplicate_key()).groupBy(*keys).agg(F.min("seg_id").alias("seg_id"))
    s = s.join(written(first.select(*row), "first"), row, "left_semi")
    if stages < 4:
        return s
    s = written(s, "distinct")
    return s.join(contained(s), row, "left_anti")


def stage_counts(culled: DataFrame) -> DataFrame:
    return culled.groupBy("page_no", F.coalesce("reason", F.lit("visible")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def reduction(culled: DataFrame) -> DataFrame:
    """Rows before and after and the share removed in per cent; 0 where there are none."""
    counts = culled.groupBy("page_no").agg(F.count(F.lit(1)).alias("source"), F.count_if(F.col("reason").isNull()).alias("visible"))
    return counts.withColumn("pct", F.when(F.col("source") > 0, F.greatest(F.lit(0.0), (1 - F.col("visible") / F.col("source")) * 100)).otherwise(0.0))


def bounds(strokes: DataFrame, by: list[str]) -> DataFrame:
    """Boxes of the primitives' points, without their width; also the largest half width."""
    c = F.col
    low = lambda *n: F.min(F.least(*map(c, n)))
    high = lambda *n: F.max(F.greatest(*map(c, n)))
    return strokes.groupBy(*by).agg(
        low("x0", "cx", "x1").alias("min_x"), low("y0", "cy", "y1").alias("min_y"), high("x0", "cx", "x1").alias("max_x"), high("y0", "cy", "y1").alias("max_y"), F.max("half_width").alias("max_half_width")
    )


def first_of_key(strokes: DataFrame) -> DataFrame:
    """Duplicate removal alone: the first row of each key."""
    s = stored(strokes).select("*", *duplicate_key())
    rank = F.row_number().over(Window.partitionBy("doc_id", "page_no", *[f"k{i}" for i in range(13)]).orderBy("seg_id"))
    return s.withColumn("rank", rank).where("rank = 1").drop("rank", *[f"k{i}" for i in range(13)])
