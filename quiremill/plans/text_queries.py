"""Scalar normalisation and language queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quiremill.functions import lang, text
from quiremill.functions.udfs import nfc
from quiremill.plans.registry import query


def _in(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _scores_sql(lists: dict[str, tuple[str, ...]]) -> str:
    parts = []
    for k, v in lists.items():
        tr = " + 0.5 * len(regexp_extract_all(lower(text), '[çğışöü]')) / greatest(len(ws), 1)" if k == "tr" else ""
        parts.append(f"len(list_filter(ws, lambda w: list_contains({_in(v)}, w))) / greatest(len(ws), 1){tr} AS s_{k}")
    return ", ".join(parts)


ALL_LISTS = lang.STOPWORDS | lang.MORE
_WS = r"SELECT doc_id, text, regexp_extract_all(lower(text), '\p{L}+') AS ws, len(regexp_extract_all(text, '\p{L}')) AS letters FROM documents"
_AR = r"len(regexp_extract_all(text, '[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]')) / greatest(letters, 1)"


def _pick(lists) -> str:
    top = "greatest(" + ", ".join(f"s_{k}" for k in lists) + ")"
    return "CASE " + " ".join(f"WHEN s_{k} = {top} THEN '{k}'" for k in lists) + " END"


@query("lang_detect", "O047, O017", f"""
WITH w AS ({_WS}), s AS (SELECT *, {_scores_sql(ALL_LISTS)} FROM w)
SELECT doc_id, letters::BIGINT AS letters, len(ws)::BIGINT AS n_words,
  {', '.join(f'round(s_{k}, 6) AS score_{k}' for k in ALL_LISTS)},
  CASE WHEN letters < 40 THEN 'tr' WHEN {_AR} > 0.5 THEN 'ar'
       WHEN greatest({', '.join(f's_{k}' for k in ALL_LISTS)}) <= 0.02 THEN 'tr' ELSE {_pick(ALL_LISTS)} END AS lang_pred
FROM s""")
def lang_detect(t):
    """For every document: letters, words, scores, and the language with a default."""
    m = F.col("m")
    measured = t.documents.select("doc_id", lang.measure(F.col("text"), ALL_LISTS).alias("m"))
    return measured.select("doc_id", m["letters"].alias("letters"), m["n_words"].alias("n_words"), *(F.round(m[f"s_{k}"], 6).alias(f"score_{k}") for k in ALL_LISTS), lang.pick_default(m, ALL_LISTS).alias("lang_pred"))


@query("lang_strict", "O046", f"""
WITH w AS ({_WS}), s AS (SELECT *, {_scores_sql(lang.STOPWORDS)} FROM w)
SELECT doc_id, CASE WHEN letters < 40 THEN NULL WHEN {_AR} > 0.3 THEN 'ar' ELSE {_pick(lang.STOPWORDS)} END AS lang_pred FROM s""")
def lang_strict(t):
    return t.documents.select("doc_id", lang.detect_strict(F.col("text")).alias("lang_pred"))


@query("lang_eval", "O046, O088", f"""
WITH w AS ({_WS.replace('doc_id, text,', 'doc_id, lang, text,')}), s AS (SELECT *, {_scores_sql(ALL_LISTS)} FROM w),
p AS (SELECT lang, CASE WHEN letters < 40 THEN 'tr' WHEN greatest({', '.join(f's_{k}' for k in ALL_LISTS)}) <= 0.02 THEN 'tr' ELSE {_pick(ALL_LISTS)} END AS pred FROM s)
SELECT lang, pred, count(*) AS n FROM p GROUP BY lang, pred""")
def lang_eval(t):
    return t.documents.select("lang", lang.detect_default(F.col("text"), ALL_LISTS).alias("pred")).groupBy("lang", "pred").agg(F.count("*").alias("n"))


@query("norm_text", "O026", r"""
SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), chr(173) || '[ \t]*\n', '-' || chr(10), 'g'), '[\x{00AD}\x{FEFF}]', '', 'g'), '[ \t\x{00A0}]+', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS t
FROM documents""")
def norm_text(t):
    return t.documents.select("doc_id", text.norm(nfc(F.col("text"))).alias("t"))


@query("turkish_case", "O027", """
SELECT doc_id, lower(translate(text, 'İI', 'iı')) AS low, md5(upper(translate(replace(text, 'ß', ''), 'iı', 'İI'))) AS up FROM documents""")
def turkish_case(t):
    c = F.col("text")
    return t.documents.select("doc_id", text.tr_lower(c).alias("low"), F.md5(text.tr_upper(F.replace(c, F.lit("ß"), F.lit("")))).alias("up"))


@query("title_case_names", "O027, O044", """
SELECT c_custkey, CASE WHEN regexp_matches(name, '\\p{L}') AND NOT regexp_matches(name, '\\p{Ll}')
  THEN array_to_string(list_transform(string_split(lower(translate(name, 'İI', 'iı')), ' '),
       lambda w: CASE WHEN w IN ('ve','ile','ya','da','de','ki','mi','the','of','and','et','la') THEN w ELSE upper(translate(w[1], 'iı', 'İI')) || w[2:] END), ' ')
  ELSE name END AS name
FROM (SELECT c_custkey, upper(c_name) || ' OF ' || c_mktsegment AS name FROM customer)""".replace("\\\\", "\\"))
def title_case_names(t):
    name = F.concat(F.upper("c_name"), F.lit(" OF "), F.col("c_mktsegment"))
    return t.customer.select("c_custkey", text.title_case(name).alias("name"))


def fold_sql(c: str) -> str:
    quoted = lambda x: x.replace("'", "''")
    s = f"replace(lower(replace({c}, 'İ', 'i')), '-', ' ')"
    for a, b in text.FOLD_PAIRS:
        s = f"replace({s}, '{quoted(a)}', '{b}')"
    s = f"regexp_replace(translate({s}, '{text.MARKED}', '{text.UNMARKED}'), '\\p{{M}}+', '', 'g')"
    s = f"regexp_replace({s}, '\\b(?:{'|'.join(text.FOLD_ARTICLES)})\\b', ' ', 'g')"
    # No back-references here: doubled characters one by one.
    for x in "abcdefghijklmnopqrstuvwxyz0123456789 ":
        s = f"replace({s}, '{x}{x}', '{x}')"
    return f"' ' || trim(regexp_replace(translate({s}, '{text.FOLD_FROM}', '{text.FOLD_TO}'), '[^a-z0-9]+', ' ', 'g'), ' ') || ' '"


@query("fold_key", "O028", f"SELECT p_partkey, {fold_sql('p_name')} AS k, {fold_sql('p_type')} AS k2 FROM part")
def fold_key(t):
    return t.part.select("p_partkey", text.fold_key(F.col("p_name")).alias("k"), text.fold_key(F.col("p_type")).alias("k2"))


@query("digit_fold", "O029", f"""
SELECT o_orderkey, translate(translate(o_orderkey::VARCHAR, '0123456789', '٠١٢٣٤٥٦٧٨٩'), '{text.ARABIC_DIGITS}', '{text.ASCII_DIGITS}') AS back,
  translate(o_orderkey::VARCHAR, '0123456789', '٠١٢٣٤٥٦٧٨٩') AS arabic FROM orders""")
def digit_fold(t):
    a = F.translate(F.col("o_orderkey").cast("string"), "0123456789", text.ARABIC_DIGITS[:10])
    return t.orders.select("o_orderkey", text.fold_digits(a).alias("back"), a.alias("arabic"))


@query("clean_text", "O030", r"""
SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text, '\{\{n\d{4,}\}\}|[\x{E000}-\x{E022}]', '', 'g'), '[ \t\n]+', ' ', 'g'), ' ') AS t FROM conversations""")
def clean_text(t):
    return t.conversations.select("conv_id", "turn", text.clean(F.col("text")).alias("t"))


@query("safe_names", "O031, O021", f"""
SELECT doc_id, regexp_replace(substr(regexp_replace(regexp_replace(translate(lower(text), '{text.ACCENTED}', '{text.PLAIN}'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 60), '_+$', '', 'g') AS name,
  array_to_string(string_split_regex(trim(string_split_regex(text, '[.!?\\n]')[1], ' '), ' +')[1:8], ' ') AS title
FROM documents""")
def safe_names(t):
    return t.documents.select("doc_id", text.safe_name(F.col("text")).alias("name"), text.title_of(F.col("text")).alias("title"))


@query("xml_escape", "O032", r"""
SELECT page_id, replace(replace(replace(replace(regexp_replace(html, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS x FROM pages""")
def xml_escape(t):
    return t.pages.select("page_id", text.xml_escape(F.col("html")).alias("x"))


@query("join_hyphens", "O033", r"""
SELECT doc_id, regexp_replace(regexp_replace(text, '(\p{L})-\n(\p{Ll})', '\1\2', 'g'), '\n+', ' ', 'g') AS t FROM documents""")
def join_hyphens(t):
    return t.documents.select("doc_id", text.join_hyphens(F.col("text")).alias("t"))


#: SQL of text.space_punctuation and text.strip_refs on an expression.
def space_sql(c: str) -> str:
    return rf"regexp_replace(regexp_replace({c}, '\s*[{text.JUNK_GLYPHS}]{{2,}}\s*', ' ', 'g'), '(\p{{L}})([,;:!?])(\p{{L}})', '\1\2 \3', 'g')"


def refs_sql(c: str) -> str:
    mark = text.NOTE_MARK.replace("'", "''")
    s = f"regexp_replace(regexp_replace({c}, '{text.PAGE_CITATION}', '', 'g'), '{text.BARE_CITATION}', '', 'g')"
    for _ in range(2):
        s = rf"regexp_replace({s}, '{mark}', '\1\2', 'g')"
    return s


@query("punctuation_spacing", "O039", f"SELECT doc_id, {space_sql('text')} AS t FROM documents")
def punctuation_spacing(t):
    return t.documents.select("doc_id", text.space_punctuation(F.col("text")).alias("t"))


@query("strip_refs", "O040", f"SELECT doc_id, {refs_sql('text')} AS t FROM documents")
def strip_refs(t):
    return t.documents.select("doc_id", text.strip_refs(F.col("text")).alias("t"))


_RUN = " OR ".join("(" + " AND ".join(f"keys[i + {k}] = keys[i]" for k in range(first, first + 4) if k) + ")" for first in range(-3, 0))


@query("collapse_repeats", "O038, O043", rf"""
WITH p AS (SELECT doc_id, text, regexp_extract_all(text, '\s*\S+') AS ps FROM documents),
k AS (SELECT doc_id, text, ps, list_transform(ps, lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '^[،,.]+([^،,.])', '\1')) AS keys FROM p),
u AS (SELECT doc_id, unnest(range(1, len(ps) + 1)) AS i, ps, keys FROM k),
c AS (SELECT doc_id, sum(length(ps[i])) AS n FROM u WHERE NOT coalesce(i > 1 AND length(keys[i]) <= 30 AND ({_RUN}), FALSE) GROUP BY doc_id)
SELECT doc_id, (coalesce(n, 0) + length(regexp_extract(text, '(\s*)$', 1)))::BIGINT AS n FROM k LEFT JOIN c USING (doc_id)""")
def collapse_repeats(t):
    return t.documents.select("doc_id", F.length(text.collapse_repeats(F.col("text"))).cast("long").alias("n"))


@query("homoglyph_fix", "O038", rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(text, '{text.SLIPS}', '{text.SLIPS_RIGHT}'), '\S+|\s+') AS ws FROM documents),
g AS (SELECT doc_id, array_to_string(list_transform(ws, lambda x: CASE WHEN regexp_matches(x, '[\x{{0370}}-\x{{03FF}}]') AND regexp_matches(x, '[A-Za-zÇĞİÖŞÜçğıöşüÂÎÛâîû]') THEN translate(x, '{text.GREEK}', '{text.GREEK_LATIN}') ELSE x END), '') AS t FROM w)
SELECT doc_id, CASE WHEN len(regexp_extract_all(t, '[A-Za-zÇĞİÖŞÜçğıöşüÂÎÛâîû]')) >= len(regexp_extract_all(t, '[\x{{0400}}-\x{{04FF}}]')) OR length(trim(t, ' ')) <= 2 THEN translate(t, '{text.CYRILLIC}', '{text.CYRILLIC_LATIN}') ELSE t END AS t FROM g""")
def homoglyph_fix(t):
    return t.documents.select("doc_id", text.fix_homoglyphs(F.col("text")).alias("t"))


@query("json_first", "O118", r"""
WITH j AS (SELECT event_id, 'ok ```json [' || props || ',{"v": ' || value::VARCHAR || '}] ``` done' AS s FROM events)
SELECT event_id, regexp_extract(replace(replace(s, '```json', ''), '```', ''), '(?s)(\[.*\])', 1) AS j,
       (regexp_extract(replace(replace(s, '```json', ''), '```', ''), '(?s)(\[.*\])', 1)::JSON -> 0 ->> 'k')::BIGINT AS k FROM j""")
def json_first(t):
    s = F.concat(F.lit("ok ```json ["), F.col("props"), F.lit(',{"v": '), F.col("value").cast("string"), F.lit("}] ``` done"))
    j = text.json_first(s)
    return t.events.select("event_id", j.alias("j"), F.get_json_object(j, "$[0].k").cast("long").alias("k"))


@query("json_salvage", "O119", r"""
WITH j AS (SELECT user_id, '[' || string_agg(props, ',' ORDER BY event_id) || ',{"k": 1' AS s FROM events GROUP BY user_id)
SELECT user_id, len(regexp_extract_all(s, '\{[^{}]*\}'))::BIGINT AS n,
  list_sum(list_transform(regexp_extract_all(s, '\{[^{}]*\}'), lambda x: (x::JSON ->> 'k')::BIGINT))::BIGINT AS total FROM j""")
def json_salvage(t):
    s = t.events.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "props"))), lambda x: x["props"]), ",").alias("s"))
    found = text.json_objects(F.concat(F.lit("["), F.col("s"), F.lit(',{"k": 1')))
    total = F.aggregate(found, F.lit(0).cast("long"), lambda a, x: a + F.get_json_object(x, "$.k").cast("long"))
    return s.select("user_id", F.size(found).cast("long").alias("n"), total.alias("total"))


@query("mark_positions", "O042", r"""
WITH m AS (SELECT doc_id, string_split_regex(text, '\d+') AS parts, regexp_extract_all(text, '\d+') AS marks FROM documents),
u AS (SELECT doc_id, unnest(range(1, len(marks) + 1)) AS i, parts, marks FROM m)
SELECT doc_id, i::BIGINT AS mark_no, marks[i] AS label, list_sum(list_transform(parts[1:i], lambda p: length(p)))::BIGINT AS pos FROM u""")
def mark_positions(t):
    """Marks (here: numbers) taken out of the text, each with its offset in the text that remains."""
    parts, marks = F.split("text", r"\d+", -1), F.regexp_extract_all("text", F.lit(r"(\d+)"), 1)
    ends = F.aggregate("parts", F.array(F.lit(0).cast("long")), lambda a, p: F.array_append(a, F.element_at(a, -1) + F.length(p)))
    u = t.documents.select("doc_id", parts.alias("parts"), marks.alias("marks")).filter(F.size("marks") > 0)
    u = u.select("doc_id", F.posexplode(F.arrays_zip(F.col("marks"), F.slice(ends, F.lit(2), F.size("marks")).alias("pos"))).alias("i", "m"))
    return u.select("doc_id", (F.col("i") + 1).cast("long").alias("mark_no"), F.col("m.marks").alias("label"), F.col("m.pos").alias("pos"))
