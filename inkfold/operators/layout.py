"""Pages on a grid: placement, translation of every coordinate, ids and totals of the whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values.
GAP_SHARE, GAP_LEAST, LEAST_SIDE = 0.08, 24.0, 1e-3
PER_ROW, MOST_PER_ROW = 10, 100


def pages_up_to(pages: DataFrame, most: int) -> DataFrame:
    """The page limit, as a predicate that reaches the scan."""
    return pages.where(F.col("page_no") <= max(1, most))


def layout(pages: DataFrame, per_row: int = PER_ROW) -> DataFrame:
    """(doc_id, page_no, tx, ty): where each page of a document goes.

    Rows of ``per_row`` pages, top aligned, a gap between them that follows from the mean page
    size. A document's single page stays where it is. Windows run over one document's pages.
    """
    c = F.col
    per_row = min(max(int(per_row), 1), MOST_PER_ROW)
    doc = Window.partitionBy("doc_id")
    p = pages.select("doc_id", "page_no", "min_x", "max_y", F.greatest(c("max_x") - c("min_x"), F.lit(LEAST_SIDE)).alias("w"), F.greatest(c("max_y") - c("min_y"), F.lit(LEAST_SIDE)).alias("h"))
    p = p.withColumn("i", F.row_number().over(doc.orderBy("page_no")) - 1).withColumn("row", F.floor(c("i") / per_row))
    p = p.withColumn("gap", F.greatest(F.avg(F.greatest("w", "h")).over(doc) * GAP_SHARE, F.lit(GAP_LEAST))).withColumn("n", F.count(F.lit(1)).over(doc))
    before = Window.partitionBy("doc_id", "row").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("left", F.coalesce(F.sum(c("w") + c("gap")).over(before), F.lit(0.0)))
    rows = p.groupBy("doc_id", "row").agg((F.max("h") + F.max("gap")).alias("step"))
    above = Window.partitionBy("doc_id").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("top", -F.coalesce(F.sum("step").over(above), F.lit(0.0))).drop("step")
    p = p.join(rows, ["doc_id", "row"])
    alone = c("n") == 1
    return p.select(
        "doc_id", "page_no", F.when(alone, 0.0).otherwise(c("left") - c("min_x")).alias("tx"), F.when(alone, 0.0).otherwise(c("top") - c("max_y")).alias("ty"),
    )


def translate(rows: DataFrame, places: DataFrame, xs: list[str], ys: list[str]) -> DataFrame:
    """Moves the coordinates of any table of a page: one equi-join on the page, then arithmetic."""
    moved = rows.join(places, ["doc_id", "page_no"])
    moved = moved.withColumns({x: F.col(x) + F.col("tx") for x in xs} | {y: F.col(y) + F.col("ty") for y in ys})
    return moved.drop("tx", "ty")


def compose_strokes(strokes: DataFrame, places: DataFrame) -> DataFrame:
    return translate(strokes, places, ["x0", "cx", "x1"], ["y0", "cy", "y1"])


def compose_pages(pages: DataFrame, places: DataFrame) -> DataFrame:
    return translate(pages, places, ["min_x", "max_x"], ["min_y", "max_y"])


def totals(strokes: DataFrame) -> DataFrame:
    """One row a document: counts, bounds of points and the largest half width."""
    low = lambda *n: F.min(F.least(*n))
    high = lambda *n: F.max(F.greatest(*n))
    return strokes.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("segments"), low("x0", "cx", "x1").alias("min_x"), low("y0", "cy", "y1").alias("min_y"),
        high("x0", "cx", "x1").alias("max_x"), high("y0", "cy", "y1").alias("max_y"), F.max("half_width").alias("max_half_width"),
    )


def rebase(counts: DataFrame) -> DataFrame:
    """(doc_id, page_no, offset): how far a page's ids move when pages are put one after the other.

    ``counts``: (doc_id, page_no, n). Only needed for exports; (page_no, id) is a key as well.
    """
    before = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("doc_id", "page_no", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("offset"))


def union_bounds(*tables: DataFrame) -> DataFrame:
    """Boxes (doc_id, min_x, min_y, max_x, max_y) of several tables as one box a document."""
    every = None
    for t in tables:
        t = t.select("doc_id", "min_x", "min_y", "max_x", "max_y")
        every = t if every is None else every.union(t)
    return every.groupBy("doc_id").agg(F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"))


def combined_bounds(pages: DataFrame, *tables: DataFrame) -> DataFrame:
    """The box of all that is drawn; of the pages for a document where nothing is."""
    page = union_bounds(pages).select("doc_id", *(F.col(n).alias(f"p_{n}") for n in ("min_x", "min_y", "max_x", "max_y")))
    drawn = union_bounds(*tables)
    return page.join(drawn, "doc_id", "left").select("doc_id", *(F.coalesce(n, f"p_{n}").alias(n) for n in ("min_x", "min_y", "max_x", "max_y")))
