"""Matching two lists of files by their normalised names, and the catalog made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkfold.functions.scalar import comparable_stem, id_stem, iso_time, stem, without_parsed_suffix, zip_score


def keyed(names: DataFrame, kind: str) -> DataFrame:
    """(id, name, key, score): the part of a name by which files belong together."""
    s = stem(F.col("name"))
    key = comparable_stem(without_parsed_suffix(s)) if kind == "zip" else comparable_stem(s)
    score = zip_score(F.col("name")) if kind == "zip" else F.lit(0)
    return names.select("id", "name", key.alias("key"), score.cast("int").alias("score"))


def match(left: DataFrame, right: DataFrame) -> DataFrame:
    """(key, left_name, right_name): the k-th on the left takes the k-th on the right of its key.

    Both sides are (id, name); names order the left, score and name the right, ids break
    ties. Unmatched rows of either side have a null on the other.
    """
    w = lambda *o: Window.partitionBy("key").orderBy(*o)
    lo = keyed(left, "pdf").withColumn("k", F.row_number().over(w(F.lower("name"), "name", "id")))
    ro = keyed(right, "zip").withColumn("k", F.row_number().over(w("score", F.lower("name"), "name", "id")))
    lo = lo.select("key", "k", F.col("id").alias("left_id"), F.col("name").alias("left_name"))
    ro = ro.select("key", "k", F.col("id").alias("right_id"), F.col("name").alias("right_name"))
    return lo.join(ro, ["key", "k"], "full").drop("k")


def unused(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of the right whose key has no row on the left."""
    return keyed(right, "zip").join(keyed(left, "pdf").select("key").distinct(), "key", "left_anti")


def unique_ids(names: DataFrame, order: list[str]) -> DataFrame:
    """(name, uid): the name's stem, then stem-2, stem-3 ... whichever is first free, in order.

    Stems hold no hyphen (``id_stem`` leaves letters, digits and underscores), so a numbered id never
    equals another name's stem, and the number is the rank among equal stems.
    """
    named = names.withColumn("_stem", F.coalesce(F.nullif(id_stem(stem(F.col("name"))), F.lit("")), F.lit("example")))
    k = F.row_number().over(Window.partitionBy("_stem").orderBy(*order))
    return named.withColumn("_k", k).select("name", F.when(F.col("_k") == 1, F.col("_stem")).otherwise(F.concat("_stem", F.lit("-"), F.col("_k").cast("string"))).alias("uid"))


def catalog(left: DataFrame, right: DataFrame) -> DataFrame:
    """Matched pairs in the catalog's order."""
    return match(left, right).where("left_name is not null and right_name is not null").orderBy(F.lower("left_name"), "left_name", "right_name")


def manifest_json(entries: DataFrame, generated_at: str | None = None) -> DataFrame:
    """One JSON text from (id, name, pdf_path, pdf_size, zip_path, zip_size); the time is now, if not given."""
    when = F.lit(generated_at) if generated_at else iso_time(F.current_timestamp())
    entry = F.struct(
        "id", "name", F.struct(F.col("pdf_path").alias("path"), F.col("pdf_size").alias("sizeBytes")).alias("pdf"),
        F.struct(F.col("zip_path").alias("path"), F.col("zip_size").alias("sizeBytes")).alias("parsedZip"),
    )
    order = F.struct(F.lower("name").alias("o"), F.col("id").alias("i"), entry.alias("e"))
    listed = entries.agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["e"]).alias("examples"))
    return listed.select(F.to_json(F.struct(when.alias("generatedAt"), F.col("examples"))).alias("manifest"))
