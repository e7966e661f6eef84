"""Quotas, rates, quiet periods and per-key state over timed calls."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(at: str) -> Column:
    """Microseconds of a time, with or without a zone (then UTC is the session's)."""
    return F.unix_micros(F.col(at).cast("timestamp"))


def quota_day(calls: DataFrame, key: str, at: str, zone: str = "America/Los_Angeles", limit: int = 490) -> DataFrame:
    """Calls of each key on each local day of `zone`, and whether they use the quota up."""
    day = F.to_date(F.from_utc_timestamp(at, zone))
    return calls.groupBy(key, day.cast("string").alias("day")).agg(F.count("*").alias("n")).withColumn("exhausted", F.col("n") >= limit)


def trailing(calls: DataFrame, key: str, at: str, tie: str, seconds: int = 60, limit: int = 12) -> DataFrame:
    """calls with n, how many of the key fell in the seconds up to each, and over. (Batch: a range window.)"""
    w = Window.partitionBy(key).orderBy(micros(at)).rangeBetween(-seconds * 1_000_000, 0)
    return calls.withColumn("n", F.count("*").over(w)).withColumn("over", F.col("n") > limit)


def tumbling(calls: DataFrame, keys: list[str], at: str, width: str, *aggs: Column) -> DataFrame:
    return calls.groupBy(F.window(at, width), *keys).agg(*aggs)


def sliding(calls: DataFrame, keys: list[str], at: str, width: str, step: str, *aggs: Column) -> DataFrame:
    return calls.groupBy(F.window(at, width, step), *keys).agg(*aggs)


def debounce(edits: DataFrame, keys: list[str], at: str, quiet: str = "120 seconds") -> DataFrame:
    """One row for each burst of edits of a key that `quiet` follows: its first and last time and size.

    In a stream, give edits a watermark: a burst comes out when the watermark has passed its end.
    """
    return edits.groupBy(F.session_window(at, quiet).alias("w"), *keys).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")).drop("w")


def late(calls: DataFrame, at: str, arrival: str, delay_seconds: int) -> DataFrame:
    """calls with `late`: more than the delay behind the greatest time that has arrived before. (Batch view of a watermark.)

    One pass over arrival minutes, then within a minute: no single task orders all rows.
    """
    minute = F.floor(F.col(arrival) / 60)
    tops = calls.groupBy(minute.alias("_minute")).agg(F.max(micros(at)).alias("_top"))
    w = Window.orderBy("_minute").rowsBetween(Window.unboundedPreceding, -1)
    before = tops.withColumn("_before", F.max("_top").over(w)).select("_minute", "_before")
    inside = Window.partitionBy("_minute").orderBy(arrival, at).rowsBetween(Window.unboundedPreceding, -1)
    rows = calls.withColumn("_minute", minute).join(before, "_minute").withColumn("_seen", F.greatest("_before", F.max(micros(at)).over(inside)))
    return rows.withColumn("late", F.coalesce(micros(at) < F.col("_seen") - delay_seconds * 1_000_000, F.lit(False))).drop("_minute", "_before", "_seen")


def fallback(calls: DataFrame, models: list[str], refused: Column, seq: list[str]) -> DataFrame:
    """Which model answers each call: the first in the list that isn't used up by the refusals before it on that day.

    calls: day plus what `refused` and `seq` name. Every refusal moves the day to the next model.
    """
    w = Window.partitionBy("day").orderBy(*seq).rowsBetween(Window.unboundedPreceding, -1)
    moved = F.coalesce(F.sum(refused.cast("int")).over(w), F.lit(0)).cast("int")
    return calls.withColumn("model", F.when(moved < len(models), F.element_at(F.array(*map(F.lit, models)), moved + 1)))


def lanes(events: DataFrame, timeout: str = "ProcessingTimeTimeout") -> DataFrame:
    """Streaming only: per document a state of (generation, done), fed by 'start', 'cancel' and 'done' events; gives what each batch changed.

    A cancel raises the generation, so a 'done' of an earlier one is stale.
    """

    def step(key, rows: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        generation, done = state.get if state.exists else (0, 0)
        stale = 0
        for pdf in rows:
            for kind, g in pdf.sort_values("ts")[["kind", "generation"]].itertuples(index=False):
                if kind == "cancel":
                    generation += 1
                elif kind == "done":
                    done, stale = (done + 1, stale) if g == generation else (done, stale + 1)
        state.update((generation, done))
        yield pd.DataFrame([(key[0], generation, done, stale)], columns=["doc_id", "generation", "done", "stale"])

    return events.groupBy("doc_id").applyInPandasWithState(step, "doc_id long, generation int, done int, stale int", "generation int, done int", "update", timeout)
