"""A corpus pipeline of five stages, each one an operator of quiremill.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result, written and read again, is the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiremill.llm import langid, lines, mixing, neardup, queries
from quiremill.llm.common import SPACE, materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language: no text without letters, none unlike every profile."""
    return langid.keep_identified(docs.select(*COLUMNS))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document holds; n_chars follows the text. One that loses all its words so goes."""
    done = lines.dedup_lines(docs, carry=["lang", "source"])
    done = done.filter((F.col("n_dropped") == 0) | (F.btrim("text", F.lit(SPACE)) != ""))
    return done.select("doc_id", "text", "carried.lang", "carried.source", F.length("text").cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return neardup.drop_near_duplicates(docs.select(*COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to their sources' target weights."""
    return mixing.mix(docs.select(*COLUMNS))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and their decoding of each document, as digests."""
    return queries.op2_digests(docs)


STAGES = [
    ("language_id", language),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing_stage),
    ("bpe", encoding),
]

#: Language profiles and BPE are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
