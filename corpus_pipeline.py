"""From raw documents to packed training sequences, in four stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept:

* language: documents without a letter, and those in which no language holds the majority of the letters, go;
* near_dedup: one document of each group of near copies stays (five-word shingles, 0.8);
* secrets: spans that hold secrets are masked, the documents stay;
* packing: one row per piece of the packed sequences.

``run`` writes each stage's result to the shared folder and reads it again. Four stages
hold models, MinHash links and tokenizers, which SQL can't express, so ORACLE_SQL is None;
a test holds the whole against a brute-force version (full Viterbi, all pairs, plain loops, the tokenizer's library).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from inkfold.llm import dedup, langid, packing, secrets
from inkfold.llm.common import table, written

ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.confident(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup.keep_one(docs, ngram=5)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("language", language), ("near_dedup", near_dedup), ("secrets", secret_scan), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
