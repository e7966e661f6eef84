"""Shared pieces: the shared scratch folder, row identity, and a join that survives hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one only where that is unset on a local master (tests).

    On a cluster a machine's own folder is not seen by the others, so there an unset one is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"{tempfile.gettempdir()}/quiremill-checkpoints"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> str:
    """The path in the shared folder that df has been written to."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, survives lost executors."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df, name))


#: Plans of these alone give the same rows in the same order each time they are read.
_STEADY = {"Project", "Filter", "Relation", "RelationV2", "LocalRelation", "LogicalRDD", "SubqueryAlias", "LocalLimit"}


def reread(df: DataFrame, name: str) -> DataFrame:
    """df for operators that read it twice and need the same rows in the same order: as it is where it is columns and filters of a file, else written first.

    After a shuffle the order of rows is that in which blocks arrive, which may differ between two readings on a cluster.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    nodes = {line.lstrip(" +-:").split(" ")[0].split("[")[0] for line in plan.toString().splitlines() if line.strip()}
    return df if nodes <= _STEADY and plan.deterministic() else materialize(df, name)


def raw_texts(column):
    """The UTF-8 bytes of an Arrow string column's values, one by one, null as empty: no second copy of the column."""
    for x in column:
        yield x.as_buffer().to_pybytes() if x.is_valid else b""


def release_memory() -> None:
    """Give what Arrow has freed back to the system: a worker's idle memory counts against its executor."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def null_safe_on(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    cond = F.lit(True)
    for n in names:
        cond = cond & left[n].eqNullSafe(right[n])
    return cond


def attach_by_hash(rows: DataFrame, table: DataFrame, spread: Column, value: str, count: str, hot_keys: int = 1000) -> DataFrame:
    """Left-join `table` (unique h1, h2; `value`; `count` = how many rows carry the key) to `rows`.

    A key with more than 1/hot_keys of all counted rows is hot. There can be at most
    `hot_keys` of them whatever the input, so those few are broadcast; the hot rows
    are then dealt evenly by `spread`, and only keys under that share meet in a shuffle.
    `table` should be materialized: it is read three times.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    limit = max(1000, total // hot_keys)
    hot = table.filter(F.col(count) > limit).select("h1", "h2", F.col(value).alias("_hot"))
    cold = table.filter(F.col(count) <= limit).select(F.col("h1").alias("_c1"), F.col("h2").alias("_c2"), F.col(value).alias("_cold")).hint("merge")
    marked = rows.join(F.broadcast(hot), ["h1", "h2"], "left").withColumn("_key", F.when(F.col("_hot").isNull(), F.col("h1")).otherwise(spread))
    joined = marked.join(cold, (F.col("_key") == F.col("_c1")) & (F.col("h2") == F.col("_c2")), "left")
    return joined.withColumn(value, F.coalesce("_hot", "_cold")).drop("_hot", "_cold", "_c1", "_c2", "_key")
