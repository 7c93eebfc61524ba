"""What the training-data operators share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from inkfold.plans.session import scratch, shared_dir, ship, written

__all__ = ["Bounded", "columns", "fields", "fresh", "map_whole", "prepare", "scratch", "shared_dir", "sieve", "table", "written"]


def prepare(spark: SparkSession) -> SparkSession:
    """Ships this package to the executors once per application and bounds Arrow batches.

    The batch limits keep memory flat for tables with very long texts: a batch ends
    at 512 rows or 8 MB, whichever comes first.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return ship(spark)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, each with underscores before it until no column of ``df`` is called so (names don't differ by case alone)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def columns(names) -> list[Column]:
    """Columns of exactly these names, whatever characters they hold."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def fields(df: DataFrame, names) -> list[StructField]:
    return [df.schema[n] for n in names]


#: Bits of a sieve at most: half a million 64-bit words, about 20 MB where they are broadcast.
SIEVE_BITS = 1 << 25


def sieve(df: DataFrame, key: Column, keys: DataFrame, bits: int = SIEVE_BITS) -> tuple[DataFrame, DataFrame]:
    """Splits ``df`` into (maybe, others): rows whose ``key`` may be in ``keys``, and rows whose key is not.

    ``keys`` (one column of the key's type, a written table) is hashed into a bitmap of about
    16 bits a key and ``bits`` at most, so what is broadcast has a fixed bound at any size; past
    it more rows count as maybe. No row moves here: an exact join after it moves few of them.
    """
    p, word, held = fresh(df, "_sieve_p", "_sieve_word", "_sieve_bits")
    width = 1 << min(max(keys.count() * 16, 1 << 15).bit_length(), bits.bit_length() - 1)
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(width))
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(c, F.lit(64)).cast("int"))
    place = keys.select(at(F.col(keys.columns[0])).alias(p))
    words = place.groupBy(F.shiftright(p, 6).alias(word)).agg(F.bit_or(bit(F.col(p))).alias(held))
    met = df.withColumn(p, at(key)).join(F.broadcast(words), F.shiftright(p, 6) == F.col(word), "left")
    hit = F.coalesce(F.col(held), F.lit(0)).bitwiseAND(bit(F.col(p))) != 0
    own = columns(df.columns)
    return met.where(hit).select(*own), met.where(~hit).select(*own)


def map_whole(df: DataFrame, run, schema: StructType) -> DataFrame:
    """``mapInArrow`` over all columns, whatever their names: Spark's own fails where a name holds a dot."""
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    out = StructType([StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(schema.fields)])

    def renamed(batches):
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, out_names)

    out_names = out.names
    return plain.mapInArrow(renamed, out).toDF(*schema.names)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Bounded(dict):
    """A memo of a pure function: two generations of at most ``limit`` entries.

    Entries that were used since the last turn of the generations stay, so frequent
    keys survive while the many rare ones go. Keys longer than ``longest`` aren't kept, so
    memory is bounded whatever the input.
    """

    __slots__ = ("make", "limit", "longest", "old")

    def __init__(self, make, limit: int, longest: int = 48):
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}

    def __missing__(self, key):
        if len(key) > self.longest:
            return self.make(key)
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
