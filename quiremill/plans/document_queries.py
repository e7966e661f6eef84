"""Layout, frequency, filter and window queries over documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quiremill.functions import text as tx
from quiremill.operators import documents as D
from quiremill.operators.relational import islands, top_k
from quiremill.plans.registry import LINES, WORDS, query

PAGES = LINES + ", P AS (SELECT *, line_no // 5 AS page_no FROM L)"


@query("doc_stats", "O088, O059", r"""
SELECT doc_id, len(string_split(text, chr(10)))::BIGINT AS n_lines, len(regexp_extract_all(text, '\p{L}+'))::BIGINT AS n_words,
  len(regexp_extract_all(text, '\p{L}'))::BIGINT AS letters, len(regexp_extract_all(text, '[0-9]'))::BIGINT AS digits,
  round(len(regexp_extract_all(text, '[^\p{L}\p{N}\s]')) / greatest(length(text), 1), 6) AS symbol_ratio FROM documents""")
def doc_stats(t):
    c = F.col("text")
    return t.documents.select(
        "doc_id", F.size(F.split(c, "\n", -1)).cast("long").alias("n_lines"), tx.count_of(c, r"\p{L}+").alias("n_words"), tx.letters(c).alias("letters"),
        tx.count_of(c, "[0-9]").alias("digits"), F.round(tx.count_of(c, r"[^\p{L}\p{N}\s]") / F.greatest(F.length(c), F.lit(1)), 6).alias("symbol_ratio"),
    )


@query("word_freq", "O076", f"WITH {WORDS} SELECT word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM W GROUP BY word")
def word_freq(t):
    per = D.tokens(t.documents).groupBy("word", "doc_id").agg(F.count("*").alias("c"))
    return per.groupBy("word").agg(F.sum("c").alias("n"), F.count("*").alias("docs"))


@query("letter_freq", "O076", r"SELECT c AS letter, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '\p{L}')) AS c FROM documents) GROUP BY c")
def letter_freq(t):
    return t.documents.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L})"), 1)).alias("letter")).groupBy("letter").agg(F.count("*").alias("n"))


@query("top_words_per_lang", "O103, O083", r"""
WITH c AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM documents) GROUP BY lang, word)
SELECT lang, word, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rank FROM c) WHERE rank <= 20""")
def top_words_per_lang(t):
    w = t.documents.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    return top_k(w, ["lang"], [F.desc("n"), F.col("word")], 20)


@query("repeated_edge_lines", "O080", f"""
WITH {PAGES}, e AS (SELECT *, min(line_no) OVER w AS lo, max(line_no) OVER w AS hi FROM P WINDOW w AS (PARTITION BY doc_id, page_no)),
k AS (SELECT doc_id, trim(regexp_replace(line, '[0-9]+', '', 'g'), ' ') AS key FROM e WHERE (line_no = lo OR line_no = hi) AND length(line) < 80),
c AS (SELECT doc_id, key, count(*) AS n FROM k WHERE key <> '' GROUP BY doc_id, key), g AS (SELECT doc_id, count(DISTINCT page_no) AS pages FROM P GROUP BY doc_id)
SELECT c.doc_id, key, n, pages FROM c JOIN g ON c.doc_id = g.doc_id WHERE n >= greatest(3, floor(0.3 * pages))""")
def repeated_edge_lines(t):
    return D.repeated_edges(D.pages(t.documents))


_FIRST, _LAST = (p.replace("'", "''") for p in (D.NUMBER_FIRST, D.NUMBER_LAST))
_HEADED = rf"""{LINES}, H AS (SELECT doc_id, line_no, CASE WHEN line_no % 4 = 1 THEN (line_no + 10)::VARCHAR || ' THE ' || upper(lang) || ' READER ' || line
  WHEN line_no % 4 = 3 THEN line || ' THE ' || upper(lang) || ' READER ' || (line_no + 10)::VARCHAR ELSE line END AS line FROM L JOIN documents USING (doc_id)),
m AS (SELECT doc_id, line_no, unnest(list_concat(regexp_extract_all(line, '{_FIRST}', 1), regexp_extract_all(line, '{_LAST}', 1))) AS mark FROM H),
s AS (SELECT *, regexp_extract(mark, '(\d+)', 1) AS number, regexp_replace(mark, '^\d+\s+|\s+\d+$', '', 'g') AS phrase FROM m),
b AS (SELECT doc_id, phrase, number, count(*) AS n FROM s GROUP BY ALL), p AS (SELECT doc_id, phrase, count(*) AS numbers, max(n) AS most FROM b GROUP BY ALL),
h2 AS (SELECT doc_id, phrase, count(DISTINCT line_no) AS paras FROM s GROUP BY ALL),
heads AS (SELECT doc_id, phrase, numbers, paras FROM p JOIN h2 USING (doc_id, phrase) WHERE numbers >= 3 AND paras >= 3 AND most <= 2)"""


def _headed(t):
    """Lines of the documents, some of which a page number and a running title have got into, before or after the text."""
    ls = D.lines(t.documents).join(t.documents.select("doc_id", "lang"), "doc_id")
    no, title = (F.col("line_no") + 10).cast("string"), F.concat(F.lit("THE "), F.upper("lang"), F.lit(" READER"))
    line = F.when(F.col("line_no") % 4 == 1, F.concat_ws(" ", no, title, "line")).when(F.col("line_no") % 4 == 3, F.concat_ws(" ", "line", title, no)).otherwise(F.col("line"))
    return ls.select("doc_id", "line_no", line.alias("line"))


@query("running_headers", "O077", f"WITH {_HEADED} SELECT doc_id, phrase, numbers, paras FROM heads")
def running_headers(t):
    return D.running_headers(D.header_marks(_headed(t)))


@query("inline_header_removal", "O045", f"""
WITH {_HEADED}, c AS (SELECT s.doc_id, s.line_no, list_sort(list(DISTINCT s.mark)) AS ms FROM s JOIN heads USING (doc_id, phrase) GROUP BY ALL)
SELECT H.doc_id, H.line_no, md5(CASE WHEN ms IS NULL THEN H.line ELSE trim(regexp_replace(list_reduce(list_prepend(H.line, ms), lambda a, x: replace(a, x, '')), ' +', ' ', 'g'), ' ') END) AS digest FROM H LEFT JOIN c ON c.doc_id = H.doc_id AND c.line_no = H.line_no""")
def inline_header_removal(t):
    """Running titles leave the text with their numbers."""
    return D.drop_running_headers(_headed(t)).select("doc_id", "line_no", F.md5("line").alias("digest"))


@query("short_line_repeats", "O053", f"""
WITH {LINES}, s AS (SELECT doc_id, lower(trim(line, ' ')) AS k FROM L WHERE len(regexp_extract_all(line, '\\S+')) BETWEEN 1 AND 5)
SELECT doc_id, k AS line, count(*) AS n FROM s GROUP BY doc_id, k HAVING count(*) >= 3""")
def short_line_repeats(t):
    ls = D.lines(t.documents).filter(tx.count_of(F.col("line"), r"\S+").between(1, 5))
    return ls.groupBy("doc_id", F.lower(F.trim("line")).alias("line")).agg(F.count("*").alias("n")).filter("n >= 3")


@query("page_type", "O048", f"""
WITH {PAGES}, a AS (SELECT doc_id, page_no, sum(len(regexp_extract_all(line, '\\p{{L}}')))::BIGINT AS letters,
  sum(CASE WHEN regexp_matches(line, '\\.{{3,}} *\\d+ *$') THEN 1 ELSE 0 END) AS leaders,
  sum(len(regexp_extract_all(lower(line), 'isbn|copyright|licensed|all rights reserved|version')))::BIGINT AS cues FROM P GROUP BY doc_id, page_no)
SELECT doc_id, page_no, letters, CASE WHEN leaders >= 3 THEN 'toc' WHEN letters < 250 THEN 'empty' WHEN cues >= 2 AND letters < 1500 THEN 'imprint' ELSE 'text' END AS kind FROM a""")
def page_type(t):
    c = F.col("line")
    a = D.pages(t.documents).groupBy("doc_id", "page_no").agg(
        F.sum(tx.letters(c)).alias("letters"), F.sum(c.rlike(r"\.{3,} *\d+ *$").cast("int")).alias("leaders"), F.sum(tx.count_of(F.lower(c), "isbn|copyright|licensed|all rights reserved|version")).alias("cues"))
    kind = F.when(F.col("leaders") >= 3, "toc").when(F.col("letters") < 250, "empty").when((F.col("cues") >= 2) & (F.col("letters") < 1500), "imprint").otherwise("text")
    return a.select("doc_id", "page_no", "letters", kind.alias("kind"))


@query("front_matter_trim", "O049", f"""
WITH {PAGES}, a AS (SELECT doc_id, page_no, sum(len(regexp_extract_all(line, '\\p{{L}}')))::BIGINT AS letters FROM P GROUP BY doc_id, page_no),
b AS (SELECT doc_id, min(page_no) FILTER (WHERE letters >= 250) AS first_page, max(page_no) FILTER (WHERE letters >= 250) AS last_page, count(*) AS pages FROM a GROUP BY doc_id)
SELECT doc_id, pages, coalesce(first_page, 0) AS first_page, coalesce(last_page, pages - 1) AS last_page FROM b""")
def front_matter_trim(t):
    """First and last page with a body; a document without one keeps all its pages."""
    a = D.pages(t.documents).groupBy("doc_id", "page_no").agg(F.sum(tx.letters(F.col("line"))).alias("letters"))
    body = F.when(F.col("letters") >= 250, F.col("page_no"))
    b = a.groupBy("doc_id").agg(F.min(body).alias("f"), F.max(body).alias("l"), F.count("*").alias("pages"))
    return b.select("doc_id", "pages", F.coalesce("f", F.lit(0)).alias("first_page"), F.coalesce("l", F.col("pages") - 1).alias("last_page"))


@query("heading_lines", "O050", f"""
WITH {LINES}, s AS (SELECT *, len(regexp_extract_all(line, '\\p{{L}}')) AS letters, len(regexp_extract_all(line, '\\p{{L}}+')) AS words FROM L)
SELECT doc_id, line_no, line FROM s WHERE length(line) BETWEEN 1 AND 90 AND letters >= 0.7 * length(replace(line, ' ', '')) AND words > 0 AND letters / words >= 3.5
  AND regexp_matches(line, '^\\p{{Lu}}') AND NOT regexp_matches(line, '[.!?:;,]\\s*$')""")
def heading_lines(t):
    c = F.col("line")
    s = D.lines(t.documents).withColumn("letters", tx.letters(c)).withColumn("words", tx.count_of(c, tx.WORD))
    ok = F.length(c).between(1, 90) & (F.col("letters") >= 0.7 * F.length(F.replace(c, F.lit(" "), F.lit("")))) & (F.col("words") > 0) & (F.col("letters") / F.col("words") >= 3.5)
    return s.filter(ok & c.rlike(r"^\p{Lu}") & ~c.rlike(r"[.!?:;,]\s*$")).select("doc_id", "line_no", "line")


_LEX = "lex AS (SELECT word, count(DISTINCT doc_id) AS n FROM W GROUP BY word HAVING count(DISTINCT doc_id) >= 3)"


@query("junk_score", "O051", f"""
WITH {LINES}, {WORDS}, {_LEX},
lw AS (SELECT doc_id, line_no, unnest(regexp_extract_all(lower(line), '\\p{{L}}+')) AS word FROM L WHERE length(line) <= 200),
a AS (SELECT lw.doc_id, lw.line_no, count(*) AS n, count(lex.word) AS valid, avg(length(lw.word)) AS mean FROM lw LEFT JOIN lex ON lw.word = lex.word GROUP BY ALL)
SELECT L.doc_id, L.line_no, coalesce(n, 0)::BIGINT AS words, coalesce(valid, 0)::BIGINT AS valid,
  CASE WHEN n IS NULL THEN TRUE WHEN valid >= 0.5 * n THEN FALSE ELSE mean < 4 OR len(regexp_extract_all(line, '[^\\p{{L}}\\p{{N}}\\s.,;:!?''"()-]')) > 0.03 * length(line) END AS junk
FROM L LEFT JOIN a ON L.doc_id = a.doc_id AND L.line_no = a.line_no WHERE length(line) BETWEEN 1 AND 200""")
def junk_score(t):
    """Short lines with few valid words that are too short or full of symbols. Words are looked up once per line, by a join."""
    ls = D.lines(t.documents).filter(F.length("line").between(1, 200))
    w = ls.select("doc_id", "line_no", F.explode(F.regexp_extract_all(F.lower("line"), F.lit(r"(\p{L}+)"), 1)).alias("word"))
    lex = D.lexicon(t.documents).select("word", F.lit(1).alias("ok"))
    a = w.join(lex, "word", "left").groupBy("doc_id", "line_no").agg(F.count("*").alias("n"), F.count("ok").alias("valid"), F.avg(F.length("word")).alias("mean"))
    j = D.junk_parts(F.col("line"))
    junk = F.when(F.col("n").isNull(), True).when(F.col("valid") >= 0.5 * F.col("n"), False).otherwise((F.col("mean") < 4) | (j["symbols"] > 0.03 * j["chars"]))
    return ls.join(a, ["doc_id", "line_no"], "left").select("doc_id", "line_no", F.coalesce("n", F.lit(0)).alias("words"), F.coalesce("valid", F.lit(0)).alias("valid"), junk.alias("junk"))


@query("invalid_ratio", "O071, O058", f"""
WITH {WORDS}, {_LEX}
SELECT W.doc_id, count(*) AS words, round(avg(CASE WHEN lex.word IS NULL THEN 1.0 ELSE 0.0 END), 6) AS invalid FROM W LEFT JOIN lex ON W.word = lex.word GROUP BY W.doc_id""")
def invalid_ratio(t):
    """Share of words outside the lexicon: each document's words are counted before the join."""
    per = D.tokens(t.documents).groupBy("doc_id", "word").agg(F.count("*").alias("c"))
    lex = D.lexicon(t.documents).select("word", F.lit(1).alias("ok"))
    return per.join(lex, "word", "left").groupBy("doc_id").agg(F.sum("c").alias("words"), F.round(F.sum(F.when(F.col("ok").isNull(), F.col("c")).otherwise(0)) / F.sum("c"), 6).alias("invalid"))


@query("quality_plan", "O082", r"""
WITH q AS (SELECT doc_id, greatest(1, len(regexp_extract_all(text, '\p{L}+'))) AS n, len(regexp_extract_all(text, '\p{L}- \p{Ll}')) AS breaks,
  len(regexp_extract_all(lower(text), '(?:^|[^\p{L}])ğ\p{L}')) AS frags, len(regexp_extract_all(text, '[|~^%&$#*]{2,}')) AS junk FROM documents)
SELECT doc_id, round(breaks * 10000.0 / n, 4) AS breaks_10k, round(frags * 10000.0 / n, 4) AS frags_10k, round(junk * 1.0 / n, 6) AS junk_per_word,
  breaks * 10000.0 / n >= 50 AS fix_hyphens, frags * 10000.0 / n >= 3 AS fix_splits, junk > 0.03 * n AS broken FROM q""")
def quality_plan(t):
    c = F.col("text")
    q = t.documents.select("doc_id", F.greatest(F.lit(1), tx.count_of(c, tx.WORD)).alias("n"), tx.count_of(c, r"\p{L}- \p{Ll}").alias("breaks"), tx.count_of(F.lower(c), r"(?:^|[^\p{L}])ğ\p{L}").alias("frags"), tx.count_of(c, r"[|~^%&$#*]{2,}").alias("junk"))
    b, f = F.col("breaks") * 10000.0 / F.col("n"), F.col("frags") * 10000.0 / F.col("n")
    return q.select("doc_id", F.round(b, 4).alias("breaks_10k"), F.round(f, 4).alias("frags_10k"), F.round(F.col("junk") / F.col("n"), 6).alias("junk_per_word"), (b >= 50).alias("fix_hyphens"), (f >= 3).alias("fix_splits"), (F.col("junk") > 0.03 * F.col("n")).alias("broken"))


@query("layer_quality", "O007, O059", f"""
WITH {PAGES} SELECT doc_id, page_no, sum(length(line))::BIGINT AS chars, sum(len(regexp_extract_all(line, '\\p{{L}}')))::BIGINT AS letters,
  sum(len(regexp_extract_all(line, '\\p{{L}}'))) < 40 OR (sum(length(line)) >= 100 AND sum(len(regexp_extract_all(line, '\\p{{L}}'))) < 0.5 * sum(length(line))) AS reread FROM P GROUP BY doc_id, page_no""")
def layer_quality(t):
    a = D.pages(t.documents).groupBy("doc_id", "page_no").agg(F.sum(F.length("line")).alias("chars"), F.sum(tx.letters(F.col("line"))).alias("letters"))
    return a.withColumn("reread", (F.col("letters") < 40) | ((F.col("chars") >= 100) & (F.col("letters") < 0.5 * F.col("chars"))))


@query("source_parens", "O054", r"""
WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\(\["][^()\[\]"\n]{1,300}[\)\]"]')) AS m FROM documents)
SELECT doc_id, m AS paren, regexp_matches(m, '\d') AND NOT regexp_matches(m, '^.(19|20)\d\d.$') AS source, count(*) AS n FROM m GROUP BY ALL""")
def source_parens(t):
    """Bracketed or quoted spans, and whether they look like a source: they hold a number other than a year alone."""
    m = t.documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r'([\(\["][^()\[\]"\n]{1,300}[\)\]"])'), 1)).alias("paren"))
    return m.withColumn("source", F.col("paren").rlike(r"\d") & ~F.col("paren").rlike(r"^.(19|20)\d\d.$")).groupBy("doc_id", "paren", "source").agg(F.count("*").alias("n"))


@query("stray_numbers", "O055", r"""
SELECT doc_id, number, count(*) AS n FROM (SELECT doc_id, regexp_extract(unnest(regexp_extract_all(text, '\p{L}\d{1,3}(?:[^\d\p{L}]|$)')), '(\d+)', 1)::BIGINT AS number FROM documents) GROUP BY ALL""")
def stray_numbers(t):
    m = t.documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(\p{L}\d{1,3}(?:[^\d\p{L}]|$))"), 1)).alias("m"))
    return m.groupBy("doc_id", F.regexp_extract("m", r"(\d+)", 1).cast("long").alias("number")).agg(F.count("*").alias("n"))


@query("source_lines", "O056", f"""
WITH {LINES} SELECT doc_id, line_no, len(regexp_extract_all(line, '\\S+'))::BIGINT AS words,
  regexp_matches(line, '^\\d+[.)]? ') OR len(regexp_extract_all(line, '\\S+')) <= 15 AS source
FROM L WHERE regexp_matches(lower(line), 'license|copyright|version|http|@') AND len(regexp_extract_all(line, '\\S+')) <= 45""")
def source_lines(t):
    n = tx.count_of(F.col("line"), r"\S+")
    ls = D.lines(t.documents).filter(F.lower("line").rlike("license|copyright|version|http|@") & (n <= 45))
    return ls.select("doc_id", "line_no", n.alias("words"), (F.col("line").rlike(r"^\d+[.)]? ") | (n <= 15)).alias("source"))


@query("clipping_islands", "O057", f"""
WITH {LINES}, s AS (SELECT doc_id, line_no, len(regexp_extract_all(line, '[^\\p{{L}}\\s]')) / greatest(1, length(line)) AS ratio FROM L),
f AS (SELECT *, CASE WHEN line_no - lag(line_no) OVER w > 3 THEN 1 WHEN lag(line_no) OVER w IS NULL THEN 1 ELSE 0 END AS st FROM s WHERE ratio >= 0.1 WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
i AS (SELECT *, sum(st) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM f)
SELECT doc_id, island::BIGINT AS island, min(line_no) AS first_line, max(line_no) AS last_line, count(*) AS n, max(ratio) >= 0.35 OR sum(ratio) >= 0.5 AS strong FROM i GROUP BY doc_id, island""")
def clipping_islands(t):
    s = D.lines(t.documents).select("doc_id", "line_no", (tx.count_of(F.col("line"), r"[^\p{L}\s]") / F.greatest(F.lit(1), F.length("line"))).alias("ratio")).filter("ratio >= 0.1")
    return islands(s, ["doc_id"], "line_no", 3).groupBy("doc_id", "island").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.count("*").alias("n"), ((F.max("ratio") >= 0.35) | (F.sum("ratio") >= 0.5)).alias("strong"))


@query("paragraph_islands", "O089", f"""
WITH {LINES}, b AS (SELECT *, CASE WHEN lag(line) OVER w IS NULL OR regexp_matches(lag(line) OVER w, '[.!?]\\s*$') OR regexp_matches(line, '^\\d+[.)] ') THEN 1 ELSE 0 END AS br FROM L WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
p AS (SELECT *, sum(br) OVER (PARTITION BY doc_id ORDER BY line_no) AS para FROM b)
SELECT doc_id, para::BIGINT AS para, count(*) AS n_lines, string_agg(line, ' ' ORDER BY line_no) AS text FROM p GROUP BY doc_id, para""")
def paragraph_islands(t):
    """Paragraphs from lines: a new one after a sentence's end or at a list item."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    before = F.lag("line").over(w)
    br = F.when(before.isNull() | before.rlike(r"[.!?]\s*$") | F.col("line").rlike(r"^\d+[.)] "), 1).otherwise(0)
    p = D.lines(t.documents).withColumn("br", br).withColumn("para", F.sum("br").over(w))
    return p.groupBy("doc_id", "para").agg(F.count("*").alias("n_lines"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), " ").alias("text"))




@query("merge_broken", "O090", r"""
WITH RECURSIVE l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
m(doc_id, ls, i, cur, n) AS (
  SELECT doc_id, ls, 1, ls[1], 1 FROM l
  UNION ALL
  SELECT doc_id, ls, i + 1,
    CASE WHEN NOT regexp_matches(cur, '[.!?:;…»”"'')\]]\s*$') AND length(cur) > 40 AND regexp_matches(ls[i + 1], '^\p{Ll}') THEN cur || ' ' || ls[i + 1] ELSE ls[i + 1] END,
    CASE WHEN NOT regexp_matches(cur, '[.!?:;…»”"'')\]]\s*$') AND length(cur) > 40 AND regexp_matches(ls[i + 1], '^\p{Ll}') THEN n ELSE n + 1 END
  FROM m WHERE i < len(ls))
SELECT doc_id, n::BIGINT AS paras, md5(cur) AS last_para FROM m WHERE i = len(ls)""")
def merge_broken(t):
    p = D.merge_broken(F.split("text", "\n", -1))
    return t.documents.select("doc_id", p.alias("p")).select("doc_id", F.size("p").cast("long").alias("paras"), F.md5(F.element_at("p", -1)).alias("last_para"))


@query("chunk_3000", "O091", r"""
WITH RECURSIVE l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[\p{L}\p{N}]')) AS ls FROM documents),
c(doc_id, ls, i, part, n) AS (
  SELECT doc_id, ls, 1, 1, length(ls[1]) + 1 FROM l WHERE len(ls) > 0
  UNION ALL
  SELECT doc_id, ls, i + 1, CASE WHEN n + length(ls[i + 1]) > 3000 THEN part + 1 ELSE part END,
    CASE WHEN n + length(ls[i + 1]) > 3000 THEN length(ls[i + 1]) + 1 ELSE n + length(ls[i + 1]) + 1 END
  FROM c WHERE i < len(ls))
SELECT doc_id, part::BIGINT AS part, 'Part_' || lpad(part::VARCHAR, 3, '0') AS name, md5(string_agg(ls[i], chr(10) ORDER BY i)) AS digest, count(*) AS n_lines FROM c GROUP BY doc_id, part""")
def chunk_3000(t):
    parts = t.documents.select("doc_id", F.posexplode(D.pack(F.split("text", "\n", -1))).alias("i", "chunk"))
    part = (F.col("i") + 1).cast("long")
    return parts.select("doc_id", part.alias("part"), F.concat(F.lit("Part_"), F.lpad(part.cast("string"), 3, "0")).alias("name"), F.md5("chunk").alias("digest"), F.size(F.split("chunk", "\n", -1)).cast("long").alias("n_lines"))


@query("section_view", "O101, O092, O052", f"""
WITH {LINES}, h AS (SELECT *, regexp_matches(line, '^\\p{{Lu}}') AND length(line) <= 60 AND NOT regexp_matches(line, '[,;]') AS head FROM L),
s AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER w AS section, last_value(CASE WHEN head THEN line END IGNORE NULLS) OVER w AS title FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))
SELECT doc_id, section::BIGINT AS section, title, count(*) AS n_lines, sum(length(line))::BIGINT AS chars,
  round(avg(CASE WHEN regexp_matches(line, '^\\d') OR regexp_matches(lower(line), 'license|copyright') THEN 1.0 ELSE 0.0 END), 6) AS note_share FROM s GROUP BY doc_id, section, title""")
def section_view(t):
    """Sections from heading lines: the last heading carries forward; shares of note-like lines tell sections not to be read out."""
    c = F.col("line")
    head = c.rlike(r"^\p{Lu}") & (F.length(c) <= 60) & ~c.rlike("[,;]")
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    s = D.lines(t.documents).withColumn("head", head).withColumn("section", F.sum(F.col("head").cast("long")).over(w)).withColumn("title", F.last(F.when(F.col("head"), c), ignorenulls=True).over(w))
    note = F.when(c.rlike(r"^\d") | F.lower(c).rlike("license|copyright"), 1.0).otherwise(0.0)
    return s.groupBy("doc_id", "section", "title").agg(F.count("*").alias("n_lines"), F.sum(F.length(c)).alias("chars"), F.round(F.avg(note), 6).alias("note_share"))


@query("mixing_measure", "O085", r"""
WITH d AS (SELECT doc_id,
  len(regexp_extract_all(text, '[|~^%&$#*]{2,}')) AS junk, len(regexp_extract_all(text, '\d{4,}')) AS numbers, len(regexp_extract_all(text, '[\w.]+@[\w.]+')) AS mails,
  len(regexp_extract_all(lower(text), 'license|copyright')) AS licences, len(regexp_extract_all(text, '\p{Lu}{4,}')) AS capitals FROM documents)
SELECT detector, count(*) FILTER (WHERE n > 0) AS docs, sum(n)::BIGINT AS total FROM (UNPIVOT d ON junk, numbers, mails, licences, capitals INTO NAME detector VALUE n) GROUP BY detector""")
def mixing_measure(t):
    c = F.col("text")
    d = t.documents.select("doc_id", tx.count_of(c, r"[|~^%&$#*]{2,}").alias("junk"), tx.count_of(c, r"\d{4,}").alias("numbers"), tx.count_of(c, r"[\w.]+@[\w.]+").alias("mails"), tx.count_of(F.lower(c), "license|copyright").alias("licences"), tx.count_of(c, r"\p{Lu}{4,}").alias("capitals"))
    long = d.unpivot(["doc_id"], ["junk", "numbers", "mails", "licences", "capitals"], "detector", "n")
    return long.groupBy("detector").agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("total"))


@query("dialogue_dash", "O099", f"""
WITH {LINES}, c AS (SELECT doc_id, sum(CASE WHEN regexp_matches(line, '^[-–—] ?\\p{{L}}') THEN 1 ELSE 0 END)::BIGINT AS marks, count(*) AS n, sum(len(regexp_extract_all(line, '\\|')))::BIGINT AS bars FROM L GROUP BY doc_id)
SELECT doc_id, marks, bars, marks >= 10 AND marks >= 0.1 * n AS dialogue FROM c""")
def dialogue_dash(t):
    c = F.col("line")
    a = D.lines(t.documents).groupBy("doc_id").agg(F.sum(c.rlike(r"^[-–—] ?\p{L}").cast("long")).alias("marks"), F.count("*").alias("n"), F.sum(tx.count_of(c, r"\|")).alias("bars"))
    return a.select("doc_id", "marks", "bars", ((F.col("marks") >= 10) & (F.col("marks") >= 0.1 * F.col("n"))).alias("dialogue"))


@query("structure_violations", "O060, O072", f"""
WITH {LINES}, r AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(line, '\\d{{1,2}}'))::BIGINT AS no FROM L WHERE NOT regexp_matches(line, '^\\d')),
b AS (SELECT doc_id, line_no, try_cast(regexp_extract(line, '^(\\d{{1,2}})', 1) AS BIGINT) AS no FROM L WHERE regexp_matches(line, '^\\d')),
o AS (SELECT *, lag(no) OVER (PARTITION BY doc_id ORDER BY line_no) AS prior FROM b)
SELECT doc_id, 'ref_without_note' AS problem, count(*) AS n FROM r WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = r.doc_id AND b.no = r.no) GROUP BY doc_id
UNION ALL SELECT doc_id, 'note_without_ref', count(*) FROM b WHERE NOT EXISTS (SELECT 1 FROM r WHERE b.doc_id = r.doc_id AND b.no = r.no) GROUP BY doc_id
UNION ALL SELECT doc_id, 'not_increasing', count(*) FROM o WHERE no <= prior GROUP BY doc_id
UNION ALL SELECT doc_id, 'repeated', count(*) FROM (SELECT doc_id, no FROM b GROUP BY doc_id, no HAVING count(*) > 1) GROUP BY doc_id""")
def structure_violations(t):
    """References without notes, notes without references, note numbers that fall or repeat."""
    ls = D.lines(t.documents)
    starts = F.col("line").rlike(r"^\d")
    r = ls.filter(~starts).select("doc_id", F.explode(F.regexp_extract_all("line", F.lit(r"(\d{1,2})"), 1)).alias("no")).select("doc_id", F.col("no").cast("long").alias("no")).distinct()
    b = ls.filter(starts).select("doc_id", "line_no", F.regexp_extract("line", r"^(\d{1,2})", 1).cast("long").alias("no"))
    o = b.withColumn("prior", F.lag("no").over(Window.partitionBy("doc_id").orderBy("line_no"))).filter("no <= prior")
    twice = b.groupBy("doc_id", "no").count().filter("count > 1")
    kinds = {"ref_without_note": r.join(b, ["doc_id", "no"], "left_anti"), "note_without_ref": b.join(r, ["doc_id", "no"], "left_anti"), "not_increasing": o, "repeated": twice}
    out = None
    for name, rows in kinds.items():
        part = rows.groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", F.lit(name).alias("problem"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("exact_dups", "O105", "SELECT md5(text) AS digest, min(doc_id) AS first_doc, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def exact_dups(t):
    return t.documents.groupBy(F.md5("text").alias("digest")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")).filter("n > 1")


@query("spoken_filter", "O043, O125, O053", f"""
WITH {LINES}, k AS (SELECT doc_id, line_no, trim(regexp_replace(regexp_replace(line, '\\s*[\\(\\[][^()\\[\\]]*\\d[^()\\[\\]]*[\\)\\]]', '', 'g'), '^\\d+[.)] *', ''), ' ') AS line,
  len(regexp_extract_all(line, '(?:^|\\s)\\d{{1,5}}[,.;]*')) >= 5 AND len(regexp_extract_all(line, '(?:^|\\s)\\d{{1,5}}[,.;]*')) >= 0.6 * len(regexp_extract_all(line, '\\S+')) AS idx FROM L)
SELECT doc_id, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY line_no)) AS digest FROM k WHERE NOT idx AND regexp_matches(line, '\\p{{L}}') GROUP BY doc_id""")
def spoken_filter(t):
    """What is read out: no item numbers, no bracketed citations with numbers, no index lines, no lines without a letter."""
    c = F.col("line")
    numbers = tx.count_of(c, r"(?:^|\s)\d{1,5}[,.;]*")
    index = (numbers >= 5) & (numbers >= 0.6 * tx.count_of(c, r"\S+"))
    said = F.trim(F.regexp_replace(F.regexp_replace(c, r"\s*[\(\[][^()\[\]]*\d[^()\[\]]*[\)\]]", ""), r"^\d+[.)] *", ""))
    k = D.lines(t.documents).filter(~index).select("doc_id", "line_no", said.alias("line")).filter(c.rlike(r"\p{L}"))
    return k.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")).alias("digest"))


@query("spoken_lines", "O043, O125")
def spoken_lines(t):
    """The full reading filter, line by line: bracketed citations are judged one by one, beyond SQL; tests hold its cases."""
    from quiremill.functions.spoken import spoken

    return D.lines(t.documents).select("doc_id", "line_no", spoken(F.col("line")).alias("said")).filter("said IS NOT NULL")


@query("chunk_sections", "O091, O052", r"""
WITH RECURSIVE l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
c(doc_id, ls, i, part, n, flag) AS (
  SELECT doc_id, ls, 1, 1, length(ls[1]) + 1, regexp_matches(lower(ls[1]), 'license|copyright|\d{3}') FROM l
  UNION ALL
  SELECT doc_id, ls, i + 1, CASE WHEN n + length(ls[i + 1]) > 15000 OR regexp_matches(lower(ls[i + 1]), 'license|copyright|\d{3}') <> flag THEN part + 1 ELSE part END,
    CASE WHEN n + length(ls[i + 1]) > 15000 OR regexp_matches(lower(ls[i + 1]), 'license|copyright|\d{3}') <> flag THEN length(ls[i + 1]) + 1 ELSE n + length(ls[i + 1]) + 1 END,
    regexp_matches(lower(ls[i + 1]), 'license|copyright|\d{3}')
  FROM c WHERE i < len(ls))
SELECT doc_id, part::BIGINT AS part, bool_or(flag) AS silent, md5(string_agg(ls[i], chr(10) ORDER BY i)) AS digest FROM c GROUP BY doc_id, part""".replace("\\\\", "\\"))
def chunk_sections(t):
    """Chunks of 15,000 characters that also end where lines to be left silent begin or end."""
    marked = F.transform(F.split("text", "\n", -1), lambda x: F.struct(x.alias("text"), F.lower(x).rlike(r"license|copyright|\d{3}").alias("flag")))
    parts = t.documents.select("doc_id", F.posexplode(D.pack_flagged(marked)).alias("i", "c"))
    return parts.select("doc_id", (F.col("i") + 1).cast("long").alias("part"), F.col("c.flag").alias("silent"), F.md5("c.text").alias("digest"))


@query("broken_layer", "O007, O082", r"""
WITH d AS (SELECT doc_id, len(regexp_extract_all(text, '\p{L}')) AS letters, greatest(1, len(regexp_extract_all(text, '\p{L}+'))) AS words,
  len(list_filter(regexp_extract_all(lower(text), '\p{L}+'), lambda w: w IN ('der','die','und','le','la','et','el','de','que'))) AS stops, len(regexp_extract_all(lower(text), '[äöüßéèêçñáíóú]')) AS special,
  len(regexp_extract_all(text, '[|~^%&$#*]{2,}')) AS junk FROM documents)
SELECT doc_id, letters >= 800 AND ((stops > 0.03 * words AND special < 0.015 * letters) OR junk > 0.03 * words) AS broken, letters::BIGINT AS letters FROM d""".replace("\\\\", "\\"))
def broken_layer(t):
    """A text layer to be read anew: function words of a language with marks but hardly any marked letters, or junk."""
    c = F.col("text")
    stops = F.size(F.filter(tx.words(c), lambda w: w.isin("der", "die", "und", "le", "la", "et", "el", "de", "que")))
    d = t.documents.select("doc_id", tx.letters(c).alias("letters"), F.greatest(F.lit(1), tx.count_of(c, tx.WORD)).alias("words"), stops.alias("stops"), tx.count_of(F.lower(c), "[äöüßéèêçñáíóú]").alias("special"), tx.count_of(c, r"[|~^%&$#*]{2,}").alias("junk"))
    bad = ((F.col("stops") > 0.03 * F.col("words")) & (F.col("special") < 0.015 * F.col("letters"))) | (F.col("junk") > 0.03 * F.col("words"))
    return d.select("doc_id", ((F.col("letters") >= 800) & bad).alias("broken"), "letters")
