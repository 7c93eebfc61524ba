"""Operator tables, file listings and catalogs as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkfold.functions.scalar import file_kind, id_stem, non_empty, stem

OPERATORS = (
    "doc_id long, page_no int, op_seq long, fn string, paint string, args array<double>, path array<float>, gstate array<struct<key: string, value: string>>, "
    "text array<struct<adjust: double, font_char: string, unicode: string, width: double, is_space: boolean>>"
)


def read_operators(spark: SparkSession, path: str, *, max_pages: int | None = None, fmt: str = "parquet") -> DataFrame:
    """Operator lists; a page limit is a predicate that reaches the scan."""
    ops = spark.read.schema(OPERATORS).format(fmt).load(path)
    return ops if max_pages is None else ops.where(F.col("page_no") <= max(1, max_pages))


def list_files(spark: SparkSession, path: str, extension: str) -> DataFrame:
    """(name, path, size) of regular files with an extension, by name without regard to case; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{{{extension.lower()},{extension.upper()}}}").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("name"), "path", F.col("length").alias("size")).orderBy(F.lower("name"), "name")


CATALOG = "generatedAt string, examples array<struct<id: string, name: string, pdf: struct<path: string, sizeBytes: double>, parsedZip: struct<path: string, sizeBytes: double>>>"


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(pos, id, name, pdf_path, pdf_size, zip_path, zip_size); entries without name or either path are dropped."""
    rows = spark.read.schema(CATALOG).option("multiLine", "true").json(path).select(F.posexplode("examples").alias("pos", "e"))
    size = lambda c: F.when(F.isnan(c) | c.isNull() | (c < 0), 0).otherwise(F.floor(c)).cast("long")
    flat = rows.select(
        "pos", F.coalesce(non_empty(F.col("e.id")), F.concat(F.lit("example-"), (F.col("pos") + 1).cast("string"))).alias("id"), non_empty(F.col("e.name")).alias("name"),
        non_empty(F.col("e.pdf.path")).alias("pdf_path"), size(F.col("e.pdf.sizeBytes")).alias("pdf_size"),
        non_empty(F.col("e.parsedZip.path")).alias("zip_path"), size(F.col("e.parsedZip.sizeBytes")).alias("zip_size"),
    )
    return flat.where("name is not null and pdf_path is not null and zip_path is not null")


def select_example(catalog: DataFrame, key: str) -> DataFrame:
    """The file that ``id:pdf`` or ``id:zip`` names: (id, kind, path, size)."""
    own, _, kind = key.rpartition(":")
    if kind not in ("pdf", "zip"):
        return catalog.where("false").select("id", F.lit(kind).alias("kind"), F.col("pdf_path").alias("path"), F.col("pdf_size").alias("size"))
    return catalog.where(F.col("id") == own).select("id", F.lit(kind).alias("kind"), F.col(f"{kind}_path").alias("path"), F.col(f"{kind}_size").alias("size"))


def first_supported(files: DataFrame) -> DataFrame:
    """Of (pos, path, mime) the first PDF or ZIP."""
    return files.withColumn("kind", file_kind(F.col("path"), F.col("mime"))).where("kind is not null").agg(F.min_by(F.struct("path", "kind"), "pos").alias("f")).select("f.*")


def with_default_ids(names: DataFrame) -> DataFrame:
    """(name, id): ids from stems, numbered within equal stems."""
    s = id_stem(stem(F.col("name")))
    k = F.row_number().over(Window.partitionBy("stem").orderBy(F.lower("name"), "name"))
    return names.withColumn("stem", s).withColumn("k", k).select("name", F.when(F.col("k") == 1, F.col("stem")).otherwise(F.concat("stem", F.lit("-"), F.col("k").cast("string"))).alias("id"))
