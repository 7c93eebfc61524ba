"""Model tables derived from the star-schema test tables, row by row.

They give the queries drawings, texts, pages and event streams whose values are integers
or halves, exact in float32. The rules are those of ``FIXTURES.md`` section C.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Order keys that are numbered together.
BLOCK = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows that each make much work, on all cores even if their file gives a few tasks only; else as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line for each order item; a page for each line number."""
    c = F.col
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")
    # Ids count up within a page, and a page holds a seventh of all rows: blocks of orders are numbered apart, and their sizes are summed up before.
    items = items.withColumn("block", F.floor(c("l_orderkey") / BLOCK))
    sizes = items.groupBy("l_linenumber", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("l_linenumber").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("l_linenumber", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    order = Window.partitionBy("l_linenumber", "block").orderBy("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    items = items.withColumn("k", F.row_number().over(order)).join(sizes, ["l_linenumber", "block"])
    ax, ay = (c("l_partkey") % 20).cast("double"), (c("l_suppkey") % 10).cast("double")
    step = F.when(c("l_quantity") == 1, 0.0).otherwise(F.ceil(c("l_quantity") / 10) * 10.0)
    bx = ax + F.when(c("l_returnflag").isin("A", "R"), step).otherwise(0.0)
    by = ay + F.when(c("l_returnflag").isin("N", "R"), step).otherwise(0.0)
    odd = c("l_orderkey") % 2 == 1
    x0, y0 = F.when(odd, bx).otherwise(ax), F.when(odd, by).otherwise(ay)
    x1, y1 = F.when(odd, ax).otherwise(bx), F.when(odd, ay).otherwise(by)
    alpha = F.when(c("l_orderkey") % 20 == 0, 0.0).when(c("l_linestatus") == "F", 1.0).otherwise(0.5)
    zero = F.lit(0.0)
    return items.select(
        F.lit(0).cast("long").alias("doc_id"), c("l_linenumber").alias("page_no"), (c("before") + c("k") - 1).cast("long").alias("seg_id"),
        x0.alias("x0"), y0.alias("y0"), x1.alias("cx"), y1.alias("cy"), x1.alias("x1"), y1.alias("y1"), F.lit(0).alias("prim_type"),
        ((c("l_orderkey") % 3 + 1) / 2.0).alias("half_width"), zero.alias("r"), zero.alias("g"), zero.alias("b"), alpha.alias("alpha"),
        F.when(c("l_partkey") % 10 == 0, 2).otherwise(0).alias("flags"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.lit(0).cast("long").alias("doc_id"), F.col("s_suppkey").cast("int").alias("page_no"), F.lit(0.0).alias("min_x"), F.lit(0.0).alias("min_y"),
        (F.col("s_nationkey") * 4 + 100).cast("double").alias("max_x"), (F.col("s_suppkey") % 50 + 150).cast("double").alias("max_y"),
    )


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as one line of text, a glyph token for each character."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("font"), F.col("text").alias("line")).where("line <> ''")
    return spread(docs)


def glyph_widths(codes):
    """Widths of an array of code points."""
    return (codes % 10 * 50 + 250).astype(float)


def operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An operator stream for each user."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    fn = F.when(F.col("event_type") == "click", "save").when(F.col("event_type") == "view", "restore").when(F.col("event_type") == "purchase", "transform").when(F.col("event_type") == "signup", "setLineWidth")
    args = F.when(F.col("event_type") == "purchase", F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.floor("value").cast("double"), F.lit(0.0))).when(
        F.col("event_type") == "signup", F.array(F.col("value"))
    )
    return e.select("user_id", "event_id", F.coalesce(fn, F.lit("ignored")).alias("fn"), F.coalesce(args, F.array().cast("array<double>")).alias("args"))


def path_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A polyline for each user: x grows by the event's whole value, y is 1 at views."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.floor("value").cast("long").alias("dx"))
    run = Window.partitionBy("user_id").orderBy("event_id")
    x = F.sum("dx").over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return e.select("user_id", "event_id", x.cast("double").alias("x"), F.when(F.col("event_type") == "view", 1.0).otherwise(0.0).alias("y"))


def catalog(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Names on the left, names on the right; both repeat."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    left = p.select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(".pdf")).alias("name"))
    right = p.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("id"), F.concat(F.translate("p_name", " ", "_"), F.lit("-parsed-data.zip")).alias("name"))
    return left, right


def pixels(spark: SparkSession, side: int = 64) -> DataFrame:
    i = F.col("id")
    return spark.range(side * side).select((i % side).alias("x"), F.floor(i / side).alias("y")).withColumn("v", (F.col("x") * 7 + F.col("y") * 13) % 256)


def points(spark: SparkSession) -> DataFrame:
    i = F.col("id")
    return spark.range(900).select(i.alias("point_id"), (i % 30 + 0.5).cast("double").alias("px"), (F.floor(i / 30) + 0.5).cast("double").alias("py"))


def rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed rectangles (four edges each) from slanted strokes, one for each distinct box of a page."""
    s = strokes(spark, sf_dir).where("x0 <> x1 and y0 <> y1")
    box = s.select("page_no", F.least("x0", "x1").alias("bx0"), F.least("y0", "y1").alias("by0"), F.greatest("x0", "x1").alias("bx1"), F.greatest("y0", "y1").alias("by1")).distinct()
    box = box.withColumn("fill_id", (F.col("bx0") * 1000000 + F.col("by0") * 10000 + F.col("bx1") - F.col("bx0")).cast("long"))
    edge = lambda i, *names: F.struct(F.lit(i).alias("pos"), *(F.col(n).alias(m) for n, m in zip(names, ("x0", "y0", "x1", "y1"), strict=True)))
    edges = F.array(edge(0, "bx0", "by0", "bx1", "by0"), edge(1, "bx1", "by0", "bx1", "by1"), edge(2, "bx1", "by1", "bx0", "by1"), edge(3, "bx0", "by1", "bx0", "by0"))
    return box.select("page_no", "fill_id", F.explode(edges).alias("e")).select("page_no", "fill_id", "e.*")
