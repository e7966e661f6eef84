"""Mixing sources to target weights, by DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiremill.llm.common import attach_by_hash, materialize

WEIGHTS = (3.0, 1.0, 2.0)
VOLUME = 1.5
MAX_RATE = 2.0
SEED = "mix-1"
#: A table of so many sources is broadcast (under 10 MB); a larger one is joined by shuffle, with the largest sources' rows dealt evenly.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _before(rows: DataFrame, order: list[Column], names: list[str], label: str) -> DataFrame:
    """rows with _at (place in the order, from 1) and before_<name> (sum of name over earlier rows).

    Rows are dealt by ranges of the order; what a range starts with is the sum of the ranges before it, one row for each. So no task
    holds all rows, and time is linear in them.
    """
    dealt = materialize(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), label)
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    sums = dealt.groupBy("_range").agg(F.count("*").alias("_n"), *(F.sum(x).alias(f"_sum_{x}") for x in names))
    start = sums.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"), *(F.coalesce(F.sum(f"_sum_{x}").over(earlier), F.lit(0.0)).alias(f"_0_{x}") for x in names))
    within = Window.partitionBy("_range").orderBy(*order)
    running = within.rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.join(F.broadcast(start), "_range").withColumn("_at", F.col("_n0") + F.row_number().over(within))
    for x in names:
        placed = placed.withColumn(f"before_{x}", F.col(f"_0_{x}") + F.coalesce(F.sum(x).over(running), F.lit(0.0)))
    return placed.drop("_range", "_n0", *(f"_0_{x}" for x in names))


def source_rates(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, volume: float = VOLUME, max_rate: float = MAX_RATE) -> DataFrame:
    """source, source_size, target, rate, n_docs: one row per source (null is a source, last in order).

    Sources in code-point order take the weights in turn and share volume * (all sizes).
    A target stops at max_rate * size and the excess is shared again by weight: target =
    min(cap, level * weight), with the level found by one pass over the sources ordered
    by cap / weight. A source of size 0 has target 0 and rate 0. Empty input: empty result.
    """
    sizes = docs.select("source", word_count(F.col("text")).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by_name = [F.col("source").isNull(), F.col("source")]
    n = len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("_at") - 1) % n + 1).cast("int"))
    w = _before(sizes, by_name, [], "source_sizes").withColumn("weight", weight).withColumn("cap", max_rate * F.col("source_size")).drop("_at")
    w = materialize(_before(w, [F.col("cap") / F.col("weight"), *by_name], ["cap", "weight"], "source_order"), "source_levels")
    total = w.agg(F.sum("source_size").alias("size"), F.sum("cap").alias("cap"), F.sum("weight").alias("weight")).first()
    budget = min(volume * (total["size"] or 0), total["cap"] or 0.0)
    from_here = F.greatest(F.col("weight"), F.lit(total["weight"] or 0.0) - F.col("before_weight"))
    level = (F.lit(float(budget)) - F.col("before_cap")) / from_here
    # The first source, in this order, that its level doesn't fill sets the level of all; where all are filled, none does.
    first = w.withColumn("level", level).filter(F.col("level") * F.col("weight") <= F.col("cap")).agg(F.min_by("level", "_at")).first()[0]
    target = F.col("cap") if first is None else F.least(F.col("cap"), F.lit(first) * F.col("weight"))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(max_rate), target / F.col("source_size"))).otherwise(0.0)
    return w.select("source", "source_size", target.alias("target"), rate.alias("rate"), "n_docs")


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A uniform number in [0, 1) of the document and the seed alone."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") / float(16**13)


def with_copies(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, volume: float = VOLUME, max_rate: float = MAX_RATE, seed: str = SEED) -> DataFrame:
    """docs with source_size, target, rate and n_copies: floor(rate) plus a Bernoulli copy.

    Copies never exceed max_rate (2): rate is at most that. Rows that repeat a doc_id draw alike;
    null ids draw as the empty id; null text has size 0; extra columns are kept, ones of the
    result's names are replaced. Empty input: empty result.
    """
    rates = source_rates(docs, weights, volume, max_rate)
    left = docs.drop("source_size", "target", "rate", "n_copies")
    told = F.struct("source_size", "target", "rate")
    if rates.count() <= BROADCAST_SOURCES:
        right = rates.select(F.col("source").alias("_source"), told.alias("_told"))
        joined = left.join(F.broadcast(right), left["source"].eqNullSafe(right["_source"]), "left").drop("_source")
    else:
        h1, h2 = F.xxhash64("source"), F.xxhash64(F.lit(7), "source")
        packed = left.select(F.struct(*left.columns).alias("_row"), h1.alias("h1"), h2.alias("h2"))
        right = materialize(rates.select(h1.alias("h1"), h2.alias("h2"), told.alias("_told"), "n_docs"), "source_rates")
        placed = attach_by_hash(packed, right, F.xxhash64("_row.doc_id", "_row.text"), "_told", "n_docs")
        joined = placed.select("_row.*", "_told")
    joined = joined.select(*left.columns, "_told.*")
    whole = F.floor("rate")
    return joined.withColumn("n_copies", (whole + F.when(draw(F.col("doc_id"), seed) < F.col("rate") - whole, 1).otherwise(0)).cast("long"))


def mix(docs: DataFrame, **params) -> DataFrame:
    """The mixed corpus: each document's rows, n_copies times, in the columns of docs (all of them as they were)."""
    packed = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("_row"))
    copies = F.sequence(F.lit(1), F.col("n_copies").cast("int"))
    return with_copies(packed, **params).filter("n_copies > 0").withColumn("_copy", F.explode(copies)).select("_row.*")


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size)::DOUBLE AS cap,
         [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM d GROUP BY source),
fill(round, lvl, filled) AS (
  SELECT 0, (1.5 * (SELECT sum(source_size) FROM s))::DOUBLE / (SELECT sum(weight) FROM s), 0::BIGINT
  UNION ALL
  SELECT round + 1,
         ((1.5 * (SELECT sum(source_size) FROM s))::DOUBLE - coalesce((SELECT sum(cap) FROM s WHERE cap < lvl * weight), 0)) /
           (SELECT sum(weight) FROM s WHERE cap >= lvl * weight),
         (SELECT count(*) FROM s WHERE cap < lvl * weight)
  FROM fill WHERE round < 60 AND (SELECT count(*) FROM s WHERE cap < lvl * weight) > filled),
level AS (SELECT lvl FROM fill ORDER BY round DESC LIMIT 1),
t AS (SELECT source, source_size, least(cap, (SELECT lvl FROM level) * weight) AS target FROM s),
r AS (SELECT *, CASE WHEN source_size > 0 THEN least(2.0::DOUBLE, target / source_size) ELSE 0 END AS rate FROM t)
SELECT d.doc_id, d.size, r.source_size, r.target,
       (d.size * (floor(r.rate) + CASE WHEN
          (('0x' || substr(md5('mix-1|' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT)::DOUBLE / 4503599627370496.0
          < r.rate - floor(r.rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""
