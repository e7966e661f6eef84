"""Queries by name: what each computes on the driver's tables, the inventory rows it stands for, and its SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


#: Tables whose rows cost far more to work on than to move.
TEXT_TABLES = ("documents", "pages", "conversations")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores: a table that scans in fewer tasks than there are cores is dealt out. A large one never is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


class Tables:
    """The tables of a folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return spread(df) if name in TEXT_TABLES else df


@dataclass
class Query:
    name: str
    rows: str
    run: Callable[[Tables], DataFrame]
    sql: str | None


ALL: dict[str, Query] = {}


def query(name: str, rows: str, sql: str | None = None):
    """Register a function of Tables under `name`; `rows`: the inventory rows."""

    def keep(run: Callable[[Tables], DataFrame]):
        ALL[name] = Query(name, rows, run, sql)
        return run

    return keep


#: Lines and words of documents, for the SQL side.
LINES = """L AS (
  SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"""
WORDS = r"""W AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM documents)"""
