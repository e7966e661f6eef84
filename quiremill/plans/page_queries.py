"""Queries over web pages and rendered works. Parsing is beyond SQL; tests compare with small pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quiremill.operators import documents as D
from quiremill.operators import links
from quiremill.plans.registry import LINES, query
from quiremill.sinks.books import render
from quiremill.sources.html import html_blocks as blocks_of
from quiremill.sources.html import html_links as links_of


@query("html_blocks", "O004, O005, O001")
def html_blocks(t):
    return blocks_of(t.pages)


@query("html_links", "O005")
def html_links(t):
    return links_of(t.pages)


@query("html_headings", "O005, O098, O018")
def html_headings(t):
    """Headings with their depth by nesting."""
    h = blocks_of(t.pages).filter(F.col("tag").rlike("^h[1-6]$"))
    return links.heading_levels(h.select(F.col("page_id").alias("doc_id"), F.col("block_no").alias("pos"), F.substring("tag", 2, 1).cast("int").alias("rank")))


@query("html_clean", "O002, O030, O041")
def html_clean(t):
    """The text of each page without navigation and advertisements."""
    b = blocks_of(t.pages).filter("NOT aside AND tag <> 'title'")
    rows = F.array_sort(F.collect_list(F.struct("block_no", "text")))
    return b.groupBy("page_id").agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("text"), F.count("*").alias("blocks"))


@query("page_links_domain", "O005, O068", r"""
SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, count(*) AS pages, count(DISTINCT regexp_extract(html, '<html lang="([a-z]+)"', 1)) AS langs FROM pages GROUP BY 1""")
def page_links_domain(t):
    return t.pages.groupBy(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host")).agg(F.count("*").alias("pages"), F.countDistinct(F.regexp_extract("html", '<html lang="([a-z]+)"', 1)).alias("langs"))


@query("render_books", "O018, O019, O020, O021, O024")
def render_books(t):
    """Each conversation as a text and an EPUB file: sizes and digests of the bytes."""
    parts = t.conversations.select(F.col("conv_id").alias("job_id"), F.col("turn").alias("idx"), F.concat(F.lit("Conversation "), "conv_id").alias("title"), "text")
    made = render(parts, ("txt", "html", "docx", "epub"))
    return made.select("job_id", "format", F.octet_length("bytes").cast("long").alias("size"), F.md5("bytes").alias("digest"))


@query("footnote_split", "O093", f"""
WITH {LINES}, P AS (SELECT *, line_no // 5 AS page_no FROM L),
f AS (SELECT *, min(CASE WHEN regexp_matches(line, '^\\d{{1,3}}[.)]? \\p{{L}}') THEN line_no END) OVER (PARTITION BY doc_id, page_no) AS first FROM P)
SELECT doc_id, page_no, count(*) FILTER (WHERE line_no >= first) AS notes, count(*) FILTER (WHERE first IS NULL OR line_no < first) AS body FROM f GROUP BY doc_id, page_no""")
def footnote_split(t):
    """Lines of a page from its first numbered line on are notes; the rest is the body."""
    s = D.split_notes(D.pages(t.documents))
    return s.groupBy("doc_id", "page_no").agg(F.count_if("is_note").alias("notes"), F.count_if(~F.col("is_note")).alias("body"))


@query("gutter_split", "O096", """
WITH x AS (SELECT l_suppkey, unnest(range(15, 36)) AS x FROM (SELECT DISTINCT l_suppkey FROM lineitem)), hit AS (SELECT DISTINCT l_suppkey, floor(l_quantity)::BIGINT AS x FROM lineitem WHERE l_discount = 0.05),
free AS (SELECT x.l_suppkey, x.x FROM x LEFT JOIN hit ON x.l_suppkey = hit.l_suppkey AND x.x = hit.x WHERE hit.x IS NULL)
SELECT l_suppkey, count(*) AS free, min(x) AS first_free FROM free GROUP BY l_suppkey""")
def gutter_split(t):
    """Positions in the middle that nothing covers, by an anti-join on positions."""
    covered = t.lineitem.select("l_suppkey", F.when(F.col("l_discount") == 0.05, F.floor("l_quantity")).alias("x"))
    return D.free_positions(covered, ["l_suppkey"], "x", 15, 35)
