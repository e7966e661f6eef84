"""Audit, report and repair-driver queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiremill.functions import text as tx
from quiremill.functions.lang import STOPWORDS
from quiremill.operators import audit
from quiremill.operators import documents as D
from quiremill.operators import links
from quiremill.plans.registry import LINES, WORDS, query
from quiremill.plans.text_queries import refs_sql, space_sql
from quiremill.sinks.covers import make_cover

_EN = ", ".join(f"'{w}'" for w in STOPWORDS["en"])


@query("foreign_cues", "O062", f"""
WITH {LINES}, c AS (SELECT doc_id, line_no, len(list_filter(regexp_extract_all(lower(line), '\\p{{L}}+'), lambda w: w IN ({_EN}))) AS cues, len(regexp_extract_all(line, '\\p{{L}}+')) AS words FROM L)
SELECT doc_id, count(*) FILTER (WHERE cues >= 2) AS foreign_lines, count(*) AS n_lines, sum(cues)::BIGINT AS cues, sum(words)::BIGINT AS words FROM c GROUP BY doc_id""")
def foreign_cues(t):
    """Lines with two English function words or more."""
    cues = F.size(F.filter(tx.words(F.col("line")), lambda w: w.isin(*STOPWORDS["en"])))
    c = D.lines(t.documents).select("doc_id", cues.alias("cues"), tx.count_of(F.col("line"), tx.WORD).alias("words"))
    return c.groupBy("doc_id").agg(F.count_if(F.col("cues") >= 2).alias("foreign_lines"), F.count("*").alias("n_lines"), F.sum("cues").alias("cues"), F.sum("words").alias("words"))


@query("unspoken_sections", "O052", """
WITH s AS (SELECT o_custkey, o_orderpriority AS section, count(*) AS n, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS share FROM orders GROUP BY ALL),
m AS (SELECT *, n >= 5 AND share >= 0.7 AS own FROM s),
b AS (SELECT *, lag(own) OVER w AS p, lead(own) OVER w AS q FROM m WINDOW w AS (PARTITION BY o_custkey ORDER BY section))
SELECT o_custkey, section, n, own OR (n <= 6 AND coalesce(p, FALSE) AND coalesce(q, FALSE)) AS unspoken FROM b""")
def unspoken_sections(t):
    """Sections (here: a customer's orders of a priority) of notes, and short ones between two such."""
    s = t.orders.groupBy("o_custkey", F.col("o_orderpriority").alias("section")).agg(F.count("*").alias("n"), F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)).alias("share"))
    return audit.unspoken(s, ["o_custkey"], "section", "share", "n").select("o_custkey", "section", "n", "unspoken")


@query("page_numbers", "O095, O061", """
WITH r AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity, row_number() OVER w AS lo, row_number() OVER v AS hi FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_quantity), v AS (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_suppkey DESC, l_quantity DESC)),
c AS (SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_quantity < 10 THEN 2 ELSE 1 END AS sure FROM r WHERE (lo = 1 OR hi = 1) AND l_quantity < 40)
SELECT l_orderkey AS page, max(sure)::BIGINT AS sure, max_by(l_quantity, (sure, -l_linenumber, l_quantity)) AS no FROM c GROUP BY l_orderkey""")
def page_numbers(t):
    """A page's number: from its first or last line, certain readings before guesses."""
    sure = F.when(F.col("l_quantity") < 10, 2).when(F.col("l_quantity") < 40, 1).cast("long")
    li = t.lineitem.select(F.col("l_orderkey").alias("page"), "l_linenumber", "l_suppkey", "l_quantity")
    return D.page_number(li, ["page"], ["l_linenumber", "l_suppkey", "l_quantity"], "l_quantity", sure)


@query("toc_parse", "O097", r"""
WITH e AS (SELECT p_brand, p_partkey, p_name || CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE ' ..... ' END || p_size AS line FROM part),
x AS (SELECT p_brand, p_partkey, regexp_extract(line, '^\s*(.*?)\s*\.{3,}\s*(\d{1,4})\s*$', 1) AS title, try_cast(regexp_extract(line, '^\s*(.*?)\s*\.{3,}\s*(\d{1,4})\s*$', 2) AS BIGINT) AS no FROM e WHERE regexp_matches(line, '^\s*(.*?)\s*\.{3,}\s*(\d{1,4})\s*$')),
y AS (SELECT *, lag(no) OVER w AS a, lead(no) OVER w AS b FROM x WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey))
SELECT p_partkey, title, CASE WHEN no < a AND b >= a THEN NULL ELSE no END AS no FROM y""")
def toc_parse(t):
    """Contents lines with dotted leaders; a number that falls while the next goes on is dropped."""
    line = F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, " ").otherwise(" ..... "), F.col("p_size").cast("string"))
    e = audit.contents_entries(t.part.select("p_brand", "p_partkey", line.alias("line")))
    return audit.falling_to_null(e, ["p_brand"], "p_partkey", "no").select("p_partkey", "title", "no")


_JOINED = r"regexp_replace(regexp_replace(text, '(\p{L})-\n(\p{Ll})', '\1\2', 'g'), '\n+', ' ', 'g')"


@query("paragraph_repair", "O041, O039, O040", rf"""
WITH r AS (SELECT doc_id, {refs_sql(_JOINED)} AS t FROM documents)
SELECT doc_id, md5({space_sql('t')}) AS digest FROM r WHERE NOT (length(t) <= 6 AND NOT regexp_matches(t, '\p{{L}}'))""")
def paragraph_repair(t):
    """The repair rules in their fixed order; short texts of symbols alone are dropped."""
    out = F.col("text")
    for rule in (tx.join_hyphens, tx.strip_refs):
        out = rule(out)
    r = t.documents.select("doc_id", out.alias("t")).filter(~((F.length("t") <= 6) & ~F.col("t").rlike(r"\p{L}")))
    return r.select("doc_id", F.md5(tx.space_punctuation(F.col("t"))).alias("digest"))


@query("audit_apply", "O117, O042", r"""
SELECT doc_id, md5(regexp_replace(text, '(\d+)', '<\1>', 'g')) AS digest, len(regexp_extract_all(text, '\d+'))::BIGINT AS spans FROM documents""")
def audit_apply(t):
    """Spans (here: numbers) wrapped in marks by their offsets."""
    parts, marks = F.split("text", r"\d+", -1), F.regexp_extract_all("text", F.lit(r"(\d+)"), 1)
    d = t.documents.select("doc_id", "text", parts.alias("parts"), marks.alias("marks"))
    zero = F.struct(F.array().cast("array<struct<start:int,size:int>>").alias("out"), F.lit(0).alias("at"))
    pairs = F.arrays_zip(F.slice("parts", F.lit(1), F.size("marks")).alias("p"), F.col("marks").alias("m"))
    spans = F.aggregate(pairs, zero, lambda a, x: F.struct(F.array_append(a["out"], F.struct((a["at"] + F.length(x["p"])).alias("start"), F.length(x["m"]).alias("size"))).alias("out"), (a["at"] + F.length(x["p"]) + F.length(x["m"])).alias("at")), lambda a: a["out"])
    return d.select("doc_id", "text", spans.alias("spans")).select("doc_id", F.md5(audit.wrap_spans(F.col("text"), F.col("spans"), "<", ">")).alias("digest"), F.size("spans").cast("long").alias("spans"))


@query("hyphen_lexicon", "O033", rf"""
WITH {WORDS}, lex AS (SELECT word FROM W GROUP BY word HAVING count(DISTINCT doc_id) >= 3),
s AS (SELECT doc_id, string_split(regexp_replace(text, '([^\n]{{45}}\p{{L}}{{2}})(\p{{Ll}}{{2}})', '\1-' || chr(10) || '\2', 'g'), chr(10)) AS l FROM documents),
u AS (SELECT doc_id, unnest(range(len(l))) AS line_no, l FROM s),
h AS (SELECT doc_id, line_no, lower(regexp_extract(l[line_no + 1], '(\p{{L}}{{2,}})[-‐]\s*$', 1)) AS a, regexp_extract(l[line_no + 2], '^\s*(\p{{Ll}}{{2,}})', 1) AS b
  FROM u WHERE regexp_matches(l[line_no + 1], '\p{{L}}{{2,}}[-‐]\s*$') AND regexp_matches(l[line_no + 2], '^\s*\p{{Ll}}{{2,}}'))
SELECT h.doc_id, h.line_no, a AS "left", b AS "right", CASE WHEN x.word IS NOT NULL AND y.word IS NOT NULL AND z.word IS NULL THEN 'keep' ELSE 'join' END AS verdict
FROM h LEFT JOIN lex x ON x.word = a LEFT JOIN lex y ON y.word = b LEFT JOIN lex z ON z.word = a || b""")
def hyphen_lexicon(t):
    """Words divided at line ends. The texts are first set in lines of about fifty characters, as print does; the lexicon, of the texts
    as they are, then tells where the halves belong together."""
    set_ = F.regexp_replace("text", r"([^\n]{45}\p{L}{2})(\p{Ll}{2})", "$1-\n$2")
    return links.divided_words(D.lines(t.documents.select("doc_id", set_.alias("text"))), D.lexicon(t.documents))


@query("doc_report", "O083, O088, O024", f"""
WITH {LINES}, a AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE regexp_matches(line, '^\\d')) AS note_like, count(*) FILTER (WHERE length(regexp_replace(line, '\\s', '', 'g')) >= 8 AND len(regexp_extract_all(line, '\\p{{L}}')) < 0.6 * length(regexp_replace(line, '\\s', '', 'g'))) AS suspicious,
  max(length(line)) AS longest, count(*) FILTER (WHERE length(line) <= 60 AND regexp_matches(line, '^\\p{{Lu}}')) AS heading_like FROM L GROUP BY doc_id)
SELECT a.doc_id, d.lang, n_lines, note_like, suspicious, longest, heading_like FROM a JOIN documents d ON a.doc_id = d.doc_id""")
def doc_report(t):
    c = F.col("line")
    solid = F.length(F.regexp_replace(c, r"\s", ""))
    a = D.lines(t.documents).groupBy("doc_id").agg(
        F.count("*").alias("n_lines"), F.count_if(c.rlike(r"^\d")).alias("note_like"), F.count_if((solid >= 8) & (tx.letters(c) < 0.6 * solid)).alias("suspicious"),
        F.max(F.length(c)).cast("long").alias("longest"), F.count_if((F.length(c) <= 60) & c.rlike(r"^\p{Lu}")).alias("heading_like"))
    return a.join(t.documents.select("doc_id", "lang"), "doc_id").select("doc_id", "lang", "n_lines", "note_like", "suspicious", "longest", "heading_like")


@query("ruled_lines", "O009, O093", """
WITH p AS (SELECT l_suppkey, l_quantity, avg(CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END) AS ink FROM lineitem GROUP BY ALL),
n AS (SELECT *, coalesce(lag(ink) OVER w, 0) AS a, coalesce(lead(ink) OVER w, 0) AS b FROM p WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_quantity))
SELECT l_suppkey, l_quantity, round(ink, 6) AS ink FROM n WHERE ink >= 0.6 AND a < 0.5 AND b < 0.5""")
def ruled_lines(t):
    p = t.lineitem.groupBy("l_suppkey", "l_quantity").agg(F.avg(F.when(F.col("l_returnflag") == "N", 1.0).otherwise(0.0)).alias("ink"))
    return audit.ruled_lines(p, ["l_suppkey"], "l_quantity", "ink", 0.6).withColumn("ink", F.round("ink", 6))


@query("stage_pipeline", "O109, O122", """
WITH j AS (SELECT conv_id, count(*) AS parts, count(*) FILTER (WHERE role = 'assistant') AS made, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id)
SELECT conv_id, parts, made, chars, CASE WHEN NOT chars > 200 THEN 'detect' WHEN NOT made * 2 >= parts THEN 'produce' WHEN NOT parts >= 4 THEN 'publish' ELSE 'done' END AS stage FROM j""")
def stage_pipeline(t):
    j = t.conversations.groupBy("conv_id").agg(F.count("*").alias("parts"), F.count_if(F.col("role") == "assistant").alias("made"), F.sum(F.length("text")).alias("chars"))
    return audit.stages(j, [("detect", F.col("chars") > 200), ("produce", F.col("made") * 2 >= F.col("parts")), ("publish", F.col("parts") >= 4)])


@query("covers", "O010")
def covers(t):
    """A made cover for each part: size and digest of its bytes."""
    @F.pandas_udf(T.BinaryType())
    def made(title: pd.Series, author: pd.Series) -> pd.Series:
        return pd.Series([make_cover(a or "", b or "") for a, b in zip(title, author, strict=True)])

    return t.part.select("p_partkey", made("p_name", "p_brand").alias("png")).select("p_partkey", F.octet_length("png").cast("long").alias("size"), F.md5("png").alias("digest"))
