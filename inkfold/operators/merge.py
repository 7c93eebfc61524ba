"""Merging of collinear neighbours: consecutive lines of a subpath become one where they go straight on."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from inkfold.plans.session import ship

#: Fixed values.
JOIN, COSINE, AWAY = 1e-3, 0.999995, 0.05
LEAST_SQ = 1e-10


def islands(lines: DataFrame, by: list[str], order: str) -> DataFrame:
    """Adds ``island``: a new one starts where a line doesn't touch its predecessor or one of the two is a point.

    These tests look at neighbours only; a chain never crosses an island's border, so the
    pass below can deal islands out.
    """
    c = F.col
    w = Window.partitionBy(*by).orderBy(order)
    lag = lambda n: F.lag(n).over(w)
    size = lambda x0, y0, x1, y1: (x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)
    gap = size(lag("x1"), lag("y1"), c("x0"), c("y0"))
    point = (size(c("x0"), c("y0"), c("x1"), c("y1")) < LEAST_SQ) | (size(lag("x0"), lag("y0"), lag("x1"), lag("y1")) < LEAST_SQ)
    starts = F.coalesce((gap > JOIN * JOIN) | point, F.lit(True))
    return lines.withColumn("_new", starts.cast("int")).withColumn("island", (F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("long")).drop("_new")


def goes_on(p, q) -> bool:
    """Whether line q (x0, y0, x1, y1) carries line p on."""
    dx, dy, ex, ey = p[2] - p[0], p[3] - p[1], q[2] - q[0], q[3] - q[1]
    pp, qq = dx * dx + dy * dy, ex * ex + ey * ey
    gx, gy = q[0] - p[2], q[1] - p[3]
    if pp < LEAST_SQ or qq < LEAST_SQ or gx * gx + gy * gy > JOIN * JOIN or dx * ex + dy * ey < COSINE * math.sqrt(pp * qq):
        return False
    cross = dx * (q[3] - p[1]) - dy * (q[2] - p[0])
    return cross * cross / pp <= AWAY * AWAY


def _chained(keys: int, schema):
    """Of lines sorted by island and order, the merged ones; only the chain that grows is held, across batches."""

    def run(batches):
        key = line = None
        chain = n = 0
        for batch in batches:
            out = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(keys + 4)), strict=True):
                own, next_line = row[:keys], row[keys:]
                if own == key and goes_on(line, next_line):
                    line, n = (*line[:2], *next_line[2:]), n + 1
                    continue
                if key is not None:
                    out.append((*key, chain, *line, n))
                chain = chain + 1 if own == key else 0
                key, line, n = own, next_line, 1
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*key, chain, *line, n), schema, strict=True)], schema=schema)

    return run


def chains(lines: DataFrame, by: list[str], order: str) -> DataFrame:
    """(by..., island, chain, x0, y0, x1, y1, n): the merged lines; each test is against the chain so far.

    Islands are dealt out and sorted, and stream through one pass: time is linear and memory constant,
    however long an island is.
    """
    ship(lines.sparkSession)
    keys, ends = [*by, "island"], ["x0", "y0", "x1", "y1"]
    dealt = islands(lines, by, order).select(*keys, order, *(F.col(n).cast("double").alias(n) for n in ends)).repartition(*keys).sortWithinPartitions(*keys, order)
    rows = dealt.select(*keys, *ends)
    out = StructType([*(rows.schema[k] for k in keys), StructField("chain", LongType()), *(StructField(n, DoubleType()) for n in ends), StructField("n", LongType())])
    return rows.mapInArrow(_chained(len(keys), to_arrow_schema(out)), out)
