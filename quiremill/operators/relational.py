"""Joins and set operations: as-of, range, fuzzy, memo, snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], at: str, values: list[str]) -> DataFrame:
    """For each left row the values of the last right row of its keys at or before it.

    One union and one window instead of a range join: rows of both sides are sorted once by key and time.
    """
    tagged = left.select(*keys, at, F.struct(*left.columns).alias("_l"), *(F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values), F.lit(1).alias("_side"))
    other = right.select(*keys, at, F.lit(None).cast(tagged.schema["_l"].dataType).alias("_l"), *values, F.lit(0).alias("_side"))
    w = Window.partitionBy(*keys).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = tagged.unionByName(other)
    packed = F.last(F.when(F.col("_side") == 0, F.struct(*values)), ignorenulls=True).over(w)
    return both.withColumn("_v", packed).filter("_side = 1").select("_l.*", *(F.col(f"_v.{v}").alias(v) for v in values))


def range_join(points: DataFrame, spans: DataFrame, keys: list[str], at: str, lo: str, hi: str, width: int) -> DataFrame:
    """Points within spans (lo to hi, inclusive) of the same keys, by equality on buckets of `width`: no nested loop."""
    p = points.withColumn("_bucket", F.floor(F.col(at) / width))
    s = spans.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    return p.join(s, [*keys, "_bucket"]).filter(F.col(at).between(F.col(lo), F.col(hi))).drop("_bucket")


def _cut(size: Column, most: int) -> Column:
    """Starts (from 0) and lengths of the most + 1 even segments of a string of `size` characters, with their numbers."""
    parts = most + 1
    start = lambda i: F.floor(size * i / F.lit(parts)).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(most)), lambda i: F.struct(i.alias("part"), start(i).alias("start"), (start(i + 1) - start(i)).alias("size")))


def fuzzy_match(left: DataFrame, right: DataFrame, block: list[str], a: str, b: str, most: int) -> DataFrame:
    """block, a, b, distance: for each a of a block the b of the least edit distance, up to `most`; ties to the first in order.

    Of most + 1 segments of b one at least stands unchanged in any a within `most` edits, moved by `most` at the furthest. So pairs meet by
    equality on (block, length of b, segment): no all-pairs join in a large block. Distances are then exact. Nulls match nothing.
    """
    x = left.select(*block, a).filter(F.col(a).isNotNull()).distinct()
    y = right.select(*block, b).filter(F.col(b).isNotNull()).distinct()
    size = F.length(b)
    cut = y.withColumn("_n", size).withColumn("_s", F.explode(_cut(size, most)))
    cut = cut.select(*block, b, "_n", F.col("_s.part").alias("_part"), F.substr(F.col(b), F.col("_s.start") + 1, F.col("_s.size")).alias("_seg"))
    lengths = F.sequence(F.greatest(F.lit(0), F.length(a) - most), F.length(a) + most)
    tried = x.withColumn("_n", F.explode(lengths)).withColumn("_s", F.explode(_cut(F.col("_n"), most))).withColumn("_move", F.explode(F.sequence(F.lit(-most), F.lit(most))))
    at = F.col("_s.start") + F.col("_move")
    tried = tried.filter((at >= 0) & (at + F.col("_s.size") <= F.length(a)))
    tried = tried.select(*block, a, "_n", F.col("_s.part").alias("_part"), F.substr(F.col(a), at + 1, F.col("_s.size")).alias("_seg")).distinct()
    pairs = tried.join(cut, [*block, "_n", "_part", "_seg"]).select(*block, a, b).distinct()
    pairs = pairs.withColumn("distance", F.levenshtein(a, b, most).cast("long")).filter("distance >= 0")
    best = pairs.groupBy(*block, a).agg(F.min(F.struct("distance", b)).alias("_best"))
    return best.select(*block, a, F.col(f"_best.{b}").alias(b), F.col("_best.distance").alias("distance"))


def orphans(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


def memo_key(*parts: Column) -> Column:
    """Content address of a question: 16 hex digits of a SHA-1 of its parts."""
    return F.substring(F.sha1(F.concat_ws("\x1f", *parts)), 1, 16)


def memo_missing(asked: DataFrame, answered: DataFrame, batch: int) -> DataFrame:
    """Questions without an answer (by key), each once, numbered into batches."""
    new = asked.dropDuplicates(["key"]).join(answered.select("key"), "key", "left_anti")
    # A total order over the misses alone; ranks within a slice of the key plus the slices' offsets need no single task.
    part = F.substring("key", 1, 2)
    counts = new.groupBy(part.alias("slice")).agg(F.count("*").alias("n"))
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("slice", "before")
    ranked = new.withColumn("slice", part).withColumn("r", F.row_number().over(Window.partitionBy("slice").orderBy("key")))
    placed = ranked.join(F.broadcast(offsets), "slice")  # 256 slices at most
    return placed.withColumn("batch", F.floor((F.col("before") + F.col("r") - 1) / batch).cast("long")).drop("slice", "before", "r")


def snapshot_compare(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """key and its state: same, changed, missing, new."""
    o, n = old.select(key, F.col(value).alias("_o"), F.lit(1).alias("_a")), new.select(key, F.col(value).alias("_n"), F.lit(1).alias("_b"))
    state = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "new").when(F.col("_o").eqNullSafe(F.col("_n")), "same").otherwise("changed")
    return o.join(n, key, "full_outer").select(key, state.alias("state"))


def islands(rows: DataFrame, keys: list[str], at: str, gap: float, tie: list[str] | None = None) -> DataFrame:
    """rows with `island`: a new one where the step from the row before is over `gap`."""
    w = Window.partitionBy(*keys).orderBy(at, *(tie or []))
    step = F.coalesce((F.col(at) - F.lag(at).over(w) > gap).cast("long"), F.lit(1))
    return rows.withColumn("_step", step).withColumn("island", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def missing_numbers(rows: DataFrame, keys: list[str], number: str, width: int = 16384) -> DataFrame:
    """keys, missing and first_missing: how many whole numbers between the least and the largest of a series it lacks, and the least
    of them. Series that lack none have no row; null keys are a series, null numbers belong to none.

    Counted from the step to the next number, so a wide span costs no more rows than a narrow one. A series may hold any share of
    all rows: only a block's rows (`width` numbers, with their repeats) are sorted together, and each block's ends meet the next block's.
    """
    marked = rows.select(*keys, F.col(number).alias("_no"), F.floor(F.col(number) / width).alias("_block")).filter("_no IS NOT NULL")
    step = F.lead("_no").over(Window.partitionBy(*keys, "_block").orderBy("_no")) - F.col("_no") - 1
    lack = marked.withColumn("_lack", F.when(step > 0, step))
    lost = F.sum("_lack").alias("_in"), F.min(F.when(F.col("_lack") > 0, F.col("_no") + 1)).alias("_first")
    inside = lack.groupBy(*keys, "_block").agg(F.min("_no").alias("_lo"), F.max("_no").alias("_hi"), *lost)
    after = F.lead("_lo").over(Window.partitionBy(*keys).orderBy("_block")) - F.col("_hi") - 1
    ends = inside.withColumn("_after", F.coalesce(after, F.lit(0)))
    first = F.coalesce("_first", F.when(F.col("_after") > 0, F.col("_hi") + 1))
    return ends.groupBy(*keys).agg(F.sum(F.coalesce("_in", F.lit(0)) + F.col("_after")).alias("missing"), F.min(first).alias("first_missing")).filter("missing > 0")


def top_k(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).filter(F.col("rank") <= k)


def rank_by_bucket(rows: DataFrame, keys: list[str], bucket: Column, order: list[str], name: str = "rank") -> DataFrame:
    """rows with their place (from 1) in their keys' order, where `bucket` rises with the order.

    A key may hold any share of all rows: only a bucket's rows are sorted together, and the buckets' counts, a small
    table, give each its offset.
    """
    marked = rows.withColumn("_bucket", bucket)
    w = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = marked.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    return marked.withColumn("_in", inside).join(counts, [*keys, "_bucket"]).withColumn(name, (F.col("_before") + F.col("_in")).cast("long")).drop("_bucket", "_before", "_in")


def middle_pair(rows: DataFrame, keys: list[str], value: str, width: float) -> DataFrame:
    """keys, lower and upper: the two middle values of each group (equal if its size is odd), by counts of buckets of `width`: only
    the rows of the buckets that hold them are sorted."""
    bucket = F.floor(F.col(value) / width)
    counts = rows.groupBy(*keys, bucket.alias("_bucket")).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.sum("_n").over(Window.partitionBy(*keys))
    placed = counts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).withColumn("_total", whole)
    lo, hi = F.floor((F.col("_total") - 1) / 2), F.floor(F.col("_total") / 2)

    def holds(p: Column) -> Column:
        return (F.col("_before") <= p) & (p < F.col("_before") + F.col("_n"))

    picked = placed.filter(holds(lo) | holds(hi)).select(*keys, "_bucket", "_before", lo.alias("_lo"), hi.alias("_hi"))
    inside = rows.select(*keys, value).withColumn("_bucket", bucket).join(picked, [*keys, "_bucket"])
    at = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(value)) - 1 + F.col("_before")
    two = inside.withColumn("_at", at).filter((F.col("_at") == F.col("_lo")) | (F.col("_at") == F.col("_hi")))
    return two.groupBy(*keys).agg(F.min(value).alias("lower"), F.max(value).alias("upper"))
