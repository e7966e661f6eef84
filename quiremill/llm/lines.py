"""Line dedup, native: explode, hash, find lines of several documents, drop, reassemble by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiremill.llm.common import SPACE, ascii_lower, attach_by_hash, materialize

MIN_KEY_CHARS = 10


def dedup_lines(docs: DataFrame, min_chars: int = MIN_KEY_CHARS, carry: list[str] | None = None) -> DataFrame:
    """Each document without the lines that a smaller doc_id holds too.

    Texts are split at \\n. A line's key is the line stripped of `[ \\t-\\r]` with A-Z
    lower-cased; keys of at least `min_chars` code points that two documents hold
    are dropped from all but the smallest doc_id. Returns doc_id, text_hash (of the
    original text), n_lines, n_dropped, text (kept lines joined by \\n), one row per input row, and in
    `carried` a struct of the columns named in `carry`.

    Null or empty text: one empty line, kept, text ''. Null doc_id: the row takes no part
    and keeps all lines. Rows that repeat a doc_id count as one document. Other columns are
    ignored, so clashing names do no harm. Empty input: empty result.
    """
    carried = [F.struct(*carry).alias("carried")] if carry else []
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *carried).withColumn("text_hash", F.xxhash64("text"))
    exploded = base.drop("carried").filter("doc_id IS NOT NULL").select("doc_id", "text_hash", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = exploded.withColumn("key", F.btrim(ascii_lower(F.col("line")), F.lit(SPACE)))
    eligible = F.length("key") >= min_chars
    lines = keyed.select("doc_id", "text_hash", "pos", F.when(eligible, F.xxhash64("key")).alias("h1"), F.when(eligible, F.xxhash64(F.lit(7), "key")).alias("h2"))
    lines = lines.filter("h1 IS NOT NULL")
    shared = lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count("*").alias("n")).filter("first_doc < last_doc")
    shared = materialize(shared.select("h1", "h2", "first_doc", "n"), "shared_lines")
    found = attach_by_hash(lines, shared, F.xxhash64("doc_id", "pos"), "first_doc", "n")
    # A bit for each position of a document that loses lines; documents that lose none send nothing.
    lost = found.filter("first_doc < doc_id").groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("pos")).alias("lost"))
    lost = lost.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t"), "lost")
    joined = base.join(lost.hint("merge"), (F.col("doc_id") == F.col("_d")) & (F.col("text_hash") == F.col("_t")), "left").drop("_d", "_t")
    split = F.split("text", "\n", -1)
    # The runs of kept lines lie between neighbouring lost positions, so the cut is linear in the lines.
    starts = F.concat(F.array(F.lit(0)), F.transform("lost", lambda p: p + 1))
    ends = F.concat(F.col("lost"), F.array(F.col("n_lines").cast("int")))
    runs = F.zip_with(starts, ends, lambda a, b: F.slice("_lines", a + 1, b - a))
    kept = F.when(F.col("lost").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(runs), "\n"))
    return (
        joined.withColumn("_lines", split)
        .withColumn("n_lines", F.size("_lines").cast("long"))
        .select("doc_id", "text_hash", "n_lines", F.when(F.col("lost").isNull(), 0).otherwise(F.size("lost")).cast("long").alias("n_dropped"), kept.alias("text"), *(["carried"] if carry else []))
    )


ORACLE_SQL = r"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM base)),
keyed AS (
  SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k
  FROM lines),
firsts AS (
  SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10
  GROUP BY k HAVING min(doc_id) < max(doc_id)),
flagged AS (
  SELECT a.doc_id, a.pos, a.line, f.first_doc IS NOT NULL AND f.first_doc < a.doc_id AS lost
  FROM keyed a LEFT JOIN firsts f ON a.k = f.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""
