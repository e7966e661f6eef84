"""Queries over readers and writers: what is rendered is read back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiremill.functions.text import fold_key
from quiremill.plans.registry import query
from quiremill.plans.text_queries import fold_sql
from quiremill.sinks.books import check_epub, render
from quiremill.sources import files


def _parts(t):
    return t.conversations.select(F.col("conv_id").alias("job_id"), F.col("turn").alias("idx"), F.concat(F.lit("Conversation "), "conv_id").alias("title"), "text")


@query("book_round_trip", "O001, O003, O025", r"""
WITH l AS (SELECT conv_id, unnest(string_split(text, chr(10))) AS line FROM conversations)
SELECT conv_id AS job_id, count(*) AS paras, sum(length(regexp_replace(line, '[ \t]+', '', 'g')))::BIGINT AS chars FROM l WHERE regexp_matches(line, '\S') GROUP BY conv_id""")
def book_round_trip(t):
    """Conversations written as DOCX and read back: every non-empty line is a paragraph again."""
    made = render(_parts(t), ("docx",)).select(F.col("job_id").cast("string").alias("path"), F.col("format").alias("ext"), F.col("bytes").alias("content"))
    items = files.parse_files(made).filter("kind = 'p'")
    return items.groupBy(F.col("path").cast("long").alias("job_id")).agg(F.count("*").alias("paras"), F.sum(F.length(F.regexp_replace("text", " +", ""))).alias("chars"))


def _read_back(t, ext: str):
    made = render(_parts(t), (ext,)).select(F.col("job_id").cast("string").alias("path"), F.col("format").alias("ext"), F.col("bytes").alias("content"))
    return files.parse_files(made)


@query("epub_round_trip", "O004", r"""
WITH l AS (SELECT conv_id, unnest(string_split(text, chr(10))) AS line FROM conversations)
SELECT conv_id AS job_id, count(*) AS paras, sum(length(regexp_replace(line, '\s+', '', 'g')))::BIGINT AS chars FROM l WHERE regexp_matches(line, '\S') GROUP BY conv_id""")
def epub_round_trip(t):
    """Conversations written as EPUB and read back from the packed file: every non-empty line is a block again, a part's first perhaps a heading."""
    items = _read_back(t, "epub")
    return items.groupBy(F.col("path").cast("long").alias("job_id")).agg(F.count("*").alias("paras"), F.sum(F.length(F.regexp_replace("text", " +", ""))).alias("chars"))


@query("txt_round_trip", "O002", r"""
WITH p AS (SELECT conv_id, unnest(string_split_regex(text, '\n\s*\n')) AS para FROM conversations),
k AS (SELECT conv_id, trim(regexp_replace(para, '\s+', ' ', 'g'), ' ') AS para FROM p)
SELECT conv_id AS job_id, count(*) AS paras, sum(length(replace(para, ' ', '')))::BIGINT AS chars FROM k WHERE para <> '' AND NOT regexp_full_match(para, '[-–\s]*\d{1,4}[-–\s]*') GROUP BY conv_id""")
def txt_round_trip(t):
    """Conversations written as plain text and read back: paragraphs are what stands between blank lines; numbers alone go."""
    items = _read_back(t, "txt").filter(F.col("text") != F.concat(F.lit("Conversation "), "path"))
    return items.groupBy(F.col("path").cast("long").alias("job_id")).agg(F.count("*").alias("paras"), F.sum(F.length(F.regexp_replace("text", " +", ""))).alias("chars"))


@query("epub_check", "O018, O022", "SELECT DISTINCT conv_id AS job_id, 0::BIGINT AS faults FROM conversations")
def epub_check(t):
    """Faults that the structure check finds in the EPUB of each conversation."""

    @F.pandas_udf(T.LongType())
    def faults(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: len(check_epub(b)))

    return render(_parts(t), ("epub",)).select("job_id", faults("bytes").alias("faults"))


@query("tagged_scan", "O011, O098", """
SELECT conv_id, count(*) AS items, count(*) FILTER (WHERE role = 'user') AS headings FROM conversations GROUP BY conv_id""")
def tagged_scan(t):
    """Conversations as tagged markdown (turns of users are headings), parsed again."""
    flat = F.trim(F.regexp_replace("text", r"\\s+", " "))
    line = F.when(F.col("role") == "user", F.concat(F.lit("### | "), flat)).otherwise(F.concat(F.lit("# "), flat))
    rows = F.array_sort(F.collect_list(F.struct("turn", line.alias("x"))))
    made = t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda r: r["x"]), "\n").alias("x"))
    items = files.parse_files(made.select(F.col("conv_id").cast("string").alias("path"), F.lit("md").alias("ext"), F.encode("x", "UTF-8").alias("content")))
    return items.groupBy(F.col("path").cast("long").alias("conv_id")).agg(F.count("*").alias("items"), F.count_if(F.col("kind") == "heading").alias("headings"))


@query("shelf_group", "O014, O013", """
WITH f AS (SELECT p_brand AS work, CASE p_size % 3 WHEN 0 THEN 'epub' WHEN 1 THEN 'txt' ELSE 'mp3' END AS ext FROM part)
SELECT lower(work) AS work, list_aggregate(list_sort(list(DISTINCT ext)), 'string_agg', '+') AS formats, count(*) AS files FROM f GROUP BY work""")
def shelf_group(t):
    """Files of one work together: names with a part number at the end."""
    ext = F.when(F.col("p_size") % 3 == 0, "epub").when(F.col("p_size") % 3 == 1, "txt").otherwise("mp3")
    f = t.part.select(F.concat("p_brand", F.lit(" - "), "p_partkey").alias("name"), ext.alias("ext"), F.concat(F.lit("/shelf/"), "p_partkey").alias("path"))
    return files.shelf(f).select("work", "formats", "files")


@query("state_upsert", "O015, O016", """
WITH n AS (SELECT c_custkey, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT -c_custkey, c_acctbal FROM customer WHERE c_custkey % 9 = 0)
SELECT c_custkey, c_acctbal FROM n UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM n)""")
def state_upsert(t):
    old = t.customer.select("c_custkey", "c_acctbal")
    new = old.filter("c_custkey % 4 = 0").select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal")).union(old.filter("c_custkey % 9 = 0").select(-F.col("c_custkey"), "c_acctbal"))
    return files.upsert(old, new, ["c_custkey"])


_KEY = fold_sql("p_name || ' ' || p_type")


@query("catalogue_fold_search", "O012, O028, O070, O103", f"""
WITH k AS (SELECT p_partkey AS id, p_size::BIGINT AS tok_length, {_KEY} AS key FROM part)
SELECT id, tok_length FROM k WHERE contains(key, 'acunumi') AND contains(key, 'ring')
ORDER BY contains(key, ' acunumi ')::INT + contains(key, ' ring ')::INT DESC, least(coalesce(tok_length, 0), 2000000) DESC, id LIMIT 200""")
def catalogue_fold_search(t):
    """A catalogue of parts by folded key: spelling variants of the query find the same rows."""
    rows = t.part.select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("tok_length"), fold_key(F.concat_ws(" ", "p_name", "p_type")).alias("key"))
    return files.search_catalogue(rows, "Economi Ring").select("id", "tok_length")
