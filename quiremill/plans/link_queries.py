"""Link, join, repair and diff queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quiremill.functions import text as tx
from quiremill.functions.udfs import change_rows, osa
from quiremill.operators import audit
from quiremill.operators import documents as D
from quiremill.operators import links
from quiremill.operators import relational as R
from quiremill.plans.registry import LINES, WORDS, query

PAGES = LINES + ", P AS (SELECT *, line_no // 5 AS page_no FROM L)"


def _refs_notes(t):
    """References: numbers within lines; notes: numbers that start a line. By page."""
    p = D.pages(t.documents)
    starts = F.col("line").rlike(r"^\d")
    refs = p.filter(~starts).select("doc_id", "page_no", "line_no", F.posexplode(F.regexp_extract_all("line", F.lit(r"(\d{1,2})"), 1)).alias("i", "no"))
    notes = p.filter(starts).select("doc_id", "page_no", "line_no", F.regexp_extract("line", r"^(\d{1,2})", 1).cast("long").alias("no"), "line")
    return refs.select("doc_id", "page_no", "line_no", F.col("i").cast("long").alias("i"), F.col("no").cast("long").alias("no")), notes


_REFS = r"""r0 AS (SELECT doc_id, page_no, line_no, regexp_extract_all(line, '\d{1,2}') AS ns FROM P WHERE NOT regexp_matches(line, '^\d')),
r AS (SELECT doc_id, page_no, line_no, unnest(range(len(ns))) AS i, unnest(ns)::BIGINT AS no FROM r0),
n AS (SELECT doc_id, page_no, line_no, try_cast(regexp_extract(line, '^(\d{1,2})', 1) AS BIGINT) AS no FROM P WHERE regexp_matches(line, '^\d'))"""


@query("note_link_equi", "O064", """
WITH r AS (SELECT l_orderkey AS page, l_linenumber AS no, l_partkey AS pos, l_suppkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS k FROM lineitem)
SELECT page, no, pos AS ref_pos, o_custkey AS note_id FROM r JOIN orders ON page = o_orderkey AND no = o_custkey % 7 + 1 WHERE k = 1""")
def note_link_equi(t):
    """Notes (here: orders, each with a number) to the first reference of their number on their page (line items)."""
    r = t.lineitem.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("no"), F.col("l_partkey").alias("pos"), "l_suppkey")
    notes = t.orders.select(F.col("o_orderkey").alias("page"), (F.col("o_custkey") % 7 + 1).cast("int").alias("no"), F.col("o_custkey").alias("note_id"))
    return links.link_equi(r, notes, ["page", "no"], ["pos", "l_suppkey"]).select("page", "no", F.col("ref.pos").alias("ref_pos"), "note_id")


@query("note_orphans", "O072", f"""
WITH {PAGES}, {_REFS}
SELECT doc_id, page_no, no, 'note' AS side FROM n WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = n.doc_id AND r.page_no = n.page_no AND r.no = n.no)
UNION ALL SELECT doc_id, page_no, no, 'ref' FROM r WHERE NOT EXISTS (SELECT 1 FROM n WHERE r.doc_id = n.doc_id AND r.page_no = n.page_no AND r.no = n.no)""")
def note_orphans(t):
    refs, notes = _refs_notes(t)
    keys = ["doc_id", "page_no", "no"]
    return R.orphans(notes, refs, keys).select(*keys, F.lit("note").alias("side")).unionByName(R.orphans(refs, notes, keys).select(*keys, F.lit("ref").alias("side")))


@query("note_link_lifo", "O065")
def note_link_lifo(t):
    """Nearest open reference (here: a view) of its number before each note (a purchase) of a user."""
    kind = F.when(F.col("event_type") == "view", "ref").when(F.col("event_type") == "purchase", "note")
    marks = t.events.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("pos"), (F.floor("value") % 3).alias("no"), kind.alias("kind")).filter("kind IS NOT NULL")
    return links.link_lifo(marks, least=10, share=0.6)


@query("asof_backward", "O065, O092", """
SELECT e.event_id, e.user_id, p.value AS last_value, p.event_id AS last_id FROM (SELECT * FROM events WHERE event_type = 'purchase') e
ASOF LEFT JOIN (SELECT user_id, ts, value, event_id FROM events WHERE event_type = 'view') p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def asof_backward(t):
    """The last view at or before each purchase of a user."""
    e = t.events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    p = t.events.filter("event_type = 'view'").select("user_id", "ts", F.col("value").alias("last_value"), F.col("event_id").alias("last_id"))
    return R.asof_backward(e, p, ["user_id"], "ts", ["last_value", "last_id"]).select("event_id", "user_id", "last_value", "last_id")


@query("range_match", "O066, O067", """
WITH s AS (SELECT user_id, event_id AS span_id, epoch_us(ts) // 1000000 AS lo, epoch_us(ts) // 1000000 + 3600 AS hi FROM events WHERE event_type = 'signup')
SELECT s.span_id, count(*) AS n, round(sum(e.value), 4) AS total FROM (SELECT user_id, epoch_us(ts) // 1000000 AS sec, value FROM events WHERE event_type = 'click') e
JOIN s ON e.user_id = s.user_id AND e.sec BETWEEN s.lo AND s.hi GROUP BY s.span_id""")
def range_match(t):
    """Clicks within an hour after a sign-up."""
    sec = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    s = t.events.filter("event_type = 'signup'").select("user_id", F.col("event_id").alias("span_id"), sec.alias("lo"), (sec + 3600).alias("hi"))
    p = t.events.filter("event_type = 'click'").select("user_id", sec.alias("sec"), "value")
    return R.range_join(p, s, ["user_id"], "sec", "lo", "hi", 3600).groupBy("span_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("interval_merge", "O067, O006, O074", """
WITH a AS (SELECT l_orderkey AS k, l_linenumber AS i, l_quantity AS lo, l_quantity + l_linenumber AS hi FROM lineitem WHERE l_linenumber <= 3),
b AS (SELECT l_orderkey AS k, l_linenumber AS j, l_quantity AS lo, l_quantity + 5 AS hi FROM lineitem WHERE l_linenumber > 3),
o AS (SELECT a.k, a.i, b.j, least(a.hi, b.hi) - greatest(a.lo, b.lo) AS overlap, least(a.hi - a.lo, b.hi - b.lo) AS small FROM a JOIN b ON a.k = b.k),
r AS (SELECT *, row_number() OVER (PARTITION BY k, i ORDER BY overlap DESC, j) AS n FROM o WHERE overlap > 0.5 * small)
SELECT k, i, j, overlap FROM r WHERE n = 1""")
def interval_merge(t):
    """Each interval's owner: the one it overlaps most, by over half of the smaller height."""
    li = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), F.col("l_quantity").alias("lo"))
    a = li.filter("i <= 3").withColumn("hi", F.col("lo") + F.col("i"))
    b = li.filter("i > 3").select("k", F.col("i").alias("j"), F.col("lo").alias("lo2"), (F.col("lo") + 5).alias("hi2"))
    o = a.join(b, "k").withColumn("overlap", F.least("hi", "hi2") - F.greatest("lo", "lo2"))
    o = o.filter(F.col("overlap") > 0.5 * F.least(F.col("hi") - F.col("lo"), F.col("hi2") - F.col("lo2")))
    return R.top_k(o, ["k", "i"], [F.desc("overlap"), F.col("j")], 1).select("k", "i", "j", "overlap")


@query("region_lines", "O074", """
WITH b AS (SELECT p_size AS x, p_retailprice AS y, p_partkey FROM part), g AS (SELECT n_nationkey AS id, 2.0 * n_nationkey - 3 AS x0, 2.0 * n_nationkey + 3 AS x1, 900 + 40.0 * n_regionkey AS y0, 1100 + 40.0 * n_regionkey AS y1 FROM nation)
SELECT g.id, count(*) AS n, max(b.y) AS top FROM b JOIN g ON b.x BETWEEN g.x0 AND g.x1 AND b.y BETWEEN g.y0 AND g.y1 GROUP BY g.id""")
def region_lines(t):
    """Points inside boxes: equality on buckets of x, then the exact test."""
    g = t.nation.select(F.col("n_nationkey").alias("id"), (2 * F.col("n_nationkey") - 3).alias("x0"), (2 * F.col("n_nationkey") + 3).alias("x1"), (900 + 40.0 * F.col("n_regionkey")).alias("y0"), (1100 + 40.0 * F.col("n_regionkey")).alias("y1"))
    b = t.part.select(F.col("p_size").alias("x"), F.col("p_retailprice").alias("y"))
    hit = R.range_join(b, g, [], "x", "x0", "x1", 6).filter("y BETWEEN y0 AND y1")
    return hit.groupBy("id").agg(F.count("*").alias("n"), F.max("y").alias("top"))


@query("fuzzy_match", "O066, O068, O107", """
WITH a AS (SELECT DISTINCT p_brand, p_type AS a FROM part), b AS (SELECT DISTINCT p_brand, left(p_type, length(p_type) - 1) || 'x' AS b FROM part),
d AS (SELECT a.p_brand, a, b, levenshtein(a, b)::BIGINT AS distance FROM a JOIN b ON a.p_brand = b.p_brand),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, a ORDER BY distance, b) AS n FROM d WHERE distance <= 3)
SELECT p_brand, a, b, distance FROM r WHERE n = 1""")
def fuzzy_match(t):
    a = t.part.select("p_brand", F.col("p_type").alias("a")).distinct()
    b = t.part.select("p_brand", F.concat(F.expr("left(p_type, length(p_type) - 1)"), F.lit("x")).alias("b")).distinct()
    return R.fuzzy_match(a, b, ["p_brand"], "a", "b", 3)


@query("edit_distance", "O107", """
SELECT c_custkey, damerau_levenshtein(c_name, n_name)::BIGINT AS osa_like, levenshtein(c_name, n_name)::BIGINT AS plain FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def edit_distance(t):
    j = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows at every size
    return j.select("c_custkey", osa("c_name", "n_name").alias("osa_like"), F.levenshtein("c_name", "n_name").cast("long").alias("plain"))


@query("catalog_search", "O070, O012, O103", """
SELECT p_partkey, p_name, p_size FROM part WHERE contains(lower(p_name || ' ' || p_type), 'a') AND contains(lower(p_name || ' ' || p_type), 'e')
ORDER BY -(CASE WHEN contains(' ' || lower(p_type) || ' ', ' a ') THEN 1 ELSE 0 END), -p_size, p_partkey LIMIT 200""")
def catalog_search(t):
    """Every token contained; whole-word hits, then size, decide; 200 best."""
    key = F.lower(F.concat("p_name", F.lit(" "), "p_type"))
    every = F.forall(F.array(F.lit("a"), F.lit("e")), lambda x: F.contains(key, x))
    whole = F.contains(F.concat(F.lit(" "), F.lower("p_type"), F.lit(" ")), F.lit(" a ")).cast("int")
    return t.part.filter(every).orderBy(F.desc(whole), F.desc("p_size"), "p_partkey").limit(200).select("p_partkey", "p_name", "p_size")


@query("name_join", "O068, O014, O013", """
WITH a AS (SELECT c_custkey, unnest(string_split(lower(c_mktsegment || ' ' || c_name), ' ')) AS k FROM customer), b AS (SELECT DISTINCT unnest(string_split(lower(p_name || ' ' || p_type), ' ')) AS k FROM part)
SELECT c_custkey, count(*) AS names FROM (SELECT DISTINCT c_custkey, a.k FROM a JOIN b ON a.k = b.k WHERE length(a.k) >= 3) GROUP BY c_custkey
UNION ALL SELECT s_suppkey, count(*) FROM (SELECT s_suppkey, unnest(string_split(lower(replace(s_name, '#', ' ')), ' ')) AS k FROM supplier) WHERE length(k) >= 3 GROUP BY s_suppkey""")
def name_join(t):
    a = t.customer.select("c_custkey", F.explode(F.split(F.lower(F.concat("c_mktsegment", F.lit(" "), "c_name")), " ")).alias("k")).filter(F.length("k") >= 3)
    b = t.part.select(F.explode(F.split(F.lower(F.concat("p_name", F.lit(" "), "p_type")), " ")).alias("k")).distinct()
    s = t.supplier.select("s_suppkey", F.explode(F.split(F.lower(F.replace("s_name", F.lit("#"), F.lit(" "))), " ")).alias("k")).filter(F.length("k") >= 3)
    return a.distinct().join(b, "k").groupBy("c_custkey").agg(F.count("*").alias("names")).union(s.groupBy("s_suppkey").agg(F.count("*").alias("names")))


@query("side_inference", "O069", """
WITH p AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem), x AS (SELECT a, count(*) AS na FROM p GROUP BY a), y AS (SELECT b, count(*) AS nb FROM p GROUP BY b)
SELECT p.a, p.b, na >= 2 AND nb < 2 AS swapped, CASE WHEN na >= 2 AND nb < 2 THEN p.b ELSE p.a END AS one, CASE WHEN na >= 2 AND nb < 2 THEN p.a ELSE p.b END AS many FROM p JOIN x ON p.a = x.a JOIN y ON p.b = y.b""")
def side_inference(t):
    """Which side of a pair has several partners; pairs the wrong way round are swapped."""
    p = t.lineitem.select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"))
    return links.sides(p, "a", "b").select("a", "b", "swapped", "one", "many")


@query("lexicon_semi", "O071, O115", f"""
WITH {WORDS}, lex AS (SELECT word FROM W GROUP BY word HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) FILTER (WHERE word IN (SELECT word FROM lex)) AS known, count(*) FILTER (WHERE word NOT IN (SELECT word FROM lex)) AS unknown FROM (SELECT DISTINCT doc_id, word FROM W) GROUP BY doc_id""")
def lexicon_semi(t):
    w = D.tokens(t.documents).distinct()
    lex = D.lexicon(t.documents).select("word", F.lit(1).alias("ok"))
    return w.join(lex, "word", "left").groupBy("doc_id").agg(F.count("ok").alias("known"), F.count_if(F.col("ok").isNull()).alias("unknown"))


@query("positional_pairs", "O073, O019", """
WITH c AS (SELECT conv_id, string_split(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE role = 'user'), chr(10)) AS a, string_split(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE role = 'assistant'), chr(10)) AS b FROM conversations GROUP BY conv_id),
z AS (SELECT conv_id, unnest(range(greatest(len(a), len(b)))) AS i, a, b FROM c)
SELECT conv_id, i AS line_no, a[i + 1] AS a, b[i + 1] AS b FROM z""")
def positional_pairs(t):
    """Two columns of a text paired line by line; the shorter one ends in nulls."""
    def side(role: str):
        return F.split(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda x: x["text"]), "\n"), "\n", -1)

    def some(role: str, name: str):
        return F.when(F.count_if(F.col("role") == role) > 0, side(role)).alias(name)

    c = t.conversations.groupBy("conv_id").agg(some("user", "a"), some("assistant", "b"))
    z = c.select("conv_id", F.posexplode(F.arrays_zip(F.coalesce("a", F.array().cast("array<string>")).alias("a"), F.coalesce("b", F.array().cast("array<string>")).alias("b"))).alias("i", "z"))
    return z.select("conv_id", F.col("i").cast("long").alias("line_no"), F.col("z.a").alias("a"), F.col("z.b").alias("b"))


@query("memo_missing", "O075, O008, O115", """
WITH q AS (SELECT DISTINCT substr(sha1(event_type || chr(31) || user_id::VARCHAR || chr(31) || floor(value)::BIGINT::VARCHAR), 1, 16) AS key FROM events),
a AS (SELECT DISTINCT substr(sha1(event_type || chr(31) || user_id::VARCHAR || chr(31) || floor(value)::BIGINT::VARCHAR), 1, 16) AS key FROM events WHERE event_id % 3 = 0),
m AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS r FROM q WHERE key NOT IN (SELECT key FROM a))
SELECT key, (r // 100)::BIGINT AS batch FROM m""")
def memo_missing(t):
    e = t.events.withColumn("key", R.memo_key(F.col("event_type"), F.col("user_id").cast("string"), F.floor("value").cast("string")))
    return R.memo_missing(e.select("key"), e.filter("event_id % 3 = 0").select("key").distinct(), 100).select("key", "batch")


@query("snapshot_compare", "O105, O025, O116", r"""
WITH o AS (SELECT doc_id, md5(text) AS v FROM documents), n AS (SELECT doc_id, md5(CASE WHEN doc_id % 5 = 0 THEN upper(replace(text, 'ß', '')) ELSE text END) AS v FROM documents WHERE doc_id % 7 <> 0
  UNION ALL SELECT -1 - doc_id, md5(text) FROM documents WHERE doc_id % 11 = 0)
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN n.doc_id IS NULL THEN 'missing' WHEN o.doc_id IS NULL THEN 'new' WHEN o.v = n.v THEN 'same' ELSE 'changed' END AS state FROM o FULL JOIN n ON o.doc_id = n.doc_id""")
def snapshot_compare(t):
    """documents against a copy with documents changed, removed and added."""
    d = t.documents.select("doc_id", "text")
    up = F.when(F.col("doc_id") % 5 == 0, F.upper(F.replace("text", F.lit("ß"), F.lit("")))).otherwise(F.col("text"))
    n = d.filter("doc_id % 7 <> 0").select("doc_id", F.md5(up).alias("v")).union(d.filter("doc_id % 11 = 0").select(-1 - F.col("doc_id"), F.md5("text")))
    return R.snapshot_compare(d.select("doc_id", F.md5("text").alias("v")), n, "doc_id", "v")


@query("set_ops", "O105, O106", """
SELECT 'except_all' AS op, count(*) AS n FROM (SELECT l_partkey, l_suppkey FROM lineitem EXCEPT ALL SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
UNION ALL SELECT 'intersect', count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'union', count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)""")
def set_ops(t):
    li, c, s = t.lineitem.select("l_partkey", "l_suppkey"), t.customer.select("c_nationkey"), t.supplier.select("s_nationkey")
    parts = {"except_all": li.exceptAll(li.distinct()), "intersect": c.intersect(s), "union": c.union(s).distinct()}
    out = None
    for op, d in parts.items():
        one = d.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("sequence_diff", "O104, O085")
def sequence_diff(t):
    """Word changes between each text and its repaired form, as rows."""
    both = t.documents.select("doc_id", "text", tx.collapse_repeats(tx.space_punctuation(F.col("text"))).alias("repaired"))
    return change_rows(both.filter("text <> repaired"))


@query("corpus_changes", "O084, O024", r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '\p{L}+[|~^%&$#*]{2,}')) AS old FROM documents),
c AS (SELECT old, regexp_replace(old, '[|~^%&$#*]+$', '') AS new, count(DISTINCT doc_id) AS docs, count(*) AS n FROM w GROUP BY old)
SELECT old, new, docs, n FROM c WHERE docs >= 2 ORDER BY docs DESC, n DESC, old LIMIT 150""")
def corpus_changes(t):
    """Change pairs over the corpus, of two documents or more: the 150 of most documents."""
    w = t.documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(\p{L}+[|~^%&$#*]{2,})"), 1)).alias("old"))
    c = w.groupBy("old", "doc_id").agg(F.count("*").alias("k")).groupBy("old").agg(F.count("*").alias("docs"), F.sum("k").alias("n"))
    return c.filter("docs >= 2").orderBy(F.desc("docs"), F.desc("n"), "old").limit(150).select("old", F.regexp_replace("old", r"[|~^%&$#*]+$", "").alias("new"), "docs", "n")


_PAIRS = ", ".join(f"('{a}', '{b}')" for a, b in links.CONFUSED)


@query("confusion_repair", "O035, O037", f"""
WITH {WORDS}, {LINES}, lex AS MATERIALIZED (SELECT word FROM W GROUP BY word HAVING count(DISTINCT doc_id) >= 3),
x AS (SELECT doc_id, unnest(regexp_extract_all(lower(CASE WHEN line_no % 4 = 1 THEN replace(line, 'b', 'h') ELSE line END), '\\p{{L}}+')) AS word FROM L),
k AS MATERIALIZED (SELECT doc_id, word, count(*) AS n FROM x GROUP BY doc_id, word),
bad AS MATERIALIZED (SELECT doc_id, word FROM k WHERE word NOT IN (SELECT word FROM lex) AND (length(word) >= 3 OR word IN ('vc', 'cn', 'kı')) AND (NOT regexp_full_match(word, '[ivxlcdmı]+') OR word IN ('vc', 'cn', 'kı'))),
p(a, b) AS (VALUES {_PAIRS}),
m AS (SELECT doc_id, word, a, b, unnest(range(1, length(word) + 1)) AS i FROM bad JOIN p ON contains(word, a)),
c AS (SELECT DISTINCT doc_id, word, word[1:i - 1] || b || substr(word, i + length(a)) AS fix FROM m WHERE substr(word, i, length(a)) = a),
j AS (SELECT c.doc_id, c.word, c.fix, k.n, row_number() OVER v AS r, lead(k.n) OVER v AS nxt FROM c JOIN k ON k.doc_id = c.doc_id AND k.word = c.fix AND k.n >= 2 JOIN lex ON lex.word = c.fix
  WHERE c.fix <> c.word WINDOW v AS (PARTITION BY c.doc_id, c.word ORDER BY k.n DESC, c.fix))
SELECT doc_id, word, fix, n FROM j WHERE r = 1 AND (nxt IS NULL OR n >= 3 * nxt)""")
def confusion_repair(t):
    """A document's misread words, by what the same document writes elsewhere. Every fourth line is read, as recognition does, with h for b;
    the lexicon is of the texts as they are."""
    ls = D.lines(t.documents).select("doc_id", F.when(F.col("line_no") % 4 == 1, F.replace("line", F.lit("b"), F.lit("h"))).otherwise(F.col("line")).alias("text"))
    words = D.tokens(ls).groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    return links.repair_in_document(words, D.lexicon(t.documents))


@query("letter_repair", "O035", f"""
WITH {WORDS}, lex AS (SELECT word, count(DISTINCT doc_id) AS n FROM W GROUP BY word HAVING count(DISTINCT doc_id) >= 3),
bad AS (SELECT DISTINCT word, translate(word, '{tx.ACCENTED}', '{tx.PLAIN}') AS sk FROM W WHERE word NOT IN (SELECT word FROM lex)),
r AS (SELECT translate(word, '{tx.ACCENTED}', '{tx.PLAIN}') AS sk, word AS fix, n, row_number() OVER (PARTITION BY translate(word, '{tx.ACCENTED}', '{tx.PLAIN}') ORDER BY n DESC, word) AS k FROM lex)
SELECT bad.word, fix, n FROM bad JOIN r ON bad.sk = r.sk WHERE k = 1""")
def letter_repair(t):
    """Words whose letters have lost or gained marks, by skeleton."""
    return links.repair_by_skeleton(D.tokens(t.documents), D.lexicon(t.documents), lambda c: F.translate(c, tx.ACCENTED, tx.PLAIN))


@query("spelling_guard", "O036", f"""
WITH {WORDS}, k AS MATERIALIZED (SELECT doc_id, word, count(*) AS n FROM W GROUP BY doc_id, word),
a AS MATERIALIZED (SELECT doc_id, word, n, replace(word, 'ou', 'o') AS fix FROM k WHERE contains(word, 'ou')),
b AS MATERIALIZED (SELECT k.doc_id, k.word AS fix, k.n FROM k SEMI JOIN a ON k.doc_id = a.doc_id AND k.word = a.fix)
SELECT a.doc_id, a.word, a.n, coalesce(b.n, 0)::BIGINT AS other, a.n >= 2 AND b.n IS NULL AS keep FROM a LEFT JOIN b ON a.doc_id = b.doc_id AND a.fix = b.fix""")
def spelling_guard(t):
    """A document's own spelling stays where it is used twice and the repaired one never."""
    k = D.tokens(t.documents).groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    a = k.filter(F.contains("word", F.lit("ou"))).withColumn("fix", F.replace("word", F.lit("ou"), F.lit("o")))
    j = a.join(k.select("doc_id", F.col("word").alias("fix"), F.col("n").alias("m")), ["doc_id", "fix"], "left")
    return j.select("doc_id", "word", "n", F.coalesce("m", F.lit(0)).alias("other"), ((F.col("n") >= 2) & F.col("m").isNull()).alias("keep"))


@query("split_word_merge", "O034", f"""
WITH {LINES}, {WORDS}, lex AS MATERIALIZED (SELECT word FROM W GROUP BY word HAVING count(DISTINCT doc_id) >= 3),
k0 AS (SELECT doc_id, line_no, regexp_extract_all(lower(line), '\\p{{L}}+') AS ws FROM L), k AS (SELECT doc_id, line_no, unnest(range(len(ws))) AS pos, unnest(ws) AS word FROM k0),
o AS (SELECT k.*, lex.word IS NOT NULL AS ok FROM k LEFT JOIN lex ON lex.word = k.word),
n AS (SELECT *, lead(word) OVER v AS w2, lead(ok) OVER v AS o2, lead(word, 2) OVER v AS w3, lead(ok, 2) OVER v AS o3 FROM o WINDOW v AS (PARTITION BY doc_id, line_no ORDER BY pos)),
t AS (SELECT doc_id, line_no, pos, 2 AS parts, word || w2 AS joined FROM n WHERE w2 IS NOT NULL AND NOT (ok AND o2)
  UNION ALL SELECT doc_id, line_no, pos, 3, word || w2 || w3 FROM n WHERE w3 IS NOT NULL AND NOT (ok AND o2 AND o3))
SELECT doc_id, line_no, pos, min(parts)::BIGINT AS parts, arg_min(joined, parts) AS joined FROM t SEMI JOIN lex ON lex.word = t.joined GROUP BY doc_id, line_no, pos""")
def split_word_merge(t):
    return links.merge_split_words(D.lines(t.documents), D.lexicon(t.documents))


@query("spaced_words", "O034", rf"""
WITH {LINES}, {WORDS}, lex AS MATERIALIZED (SELECT word FROM W GROUP BY word HAVING count(DISTINCT doc_id) >= 3),
s AS (SELECT doc_id, line_no, regexp_replace(line, '(^| )(\p{{L}})(\p{{L}})(\p{{L}})(\p{{L}})( |$)', '\1\2 \3 \4 \5\6', 'g') AS line FROM L),
r AS (SELECT doc_id, line_no, unnest(regexp_extract_all(line, '(?:^|[^\p{{L}}\p{{N}}])((?:\p{{L}} ){{3,}}\p{{L}})(?:[^\p{{L}}\p{{N}}]|$)', 1)) AS run FROM s)
SELECT doc_id, line_no, run, lower(replace(run, ' ', '')) AS joined FROM r WHERE lower(replace(run, ' ', '')) IN (SELECT word FROM lex)""")
def spaced_words(t):
    """Words set with spaces between their letters; here, those of four letters are set so first."""
    spaced = F.regexp_replace("line", r"(^| )(\p{L})(\p{L})(\p{L})(\p{L})( |$)", "$1$2 $3 $4 $5$6")
    return links.join_spaced(D.lines(t.documents).select("doc_id", "line_no", spaced.alias("line")), D.lexicon(t.documents))


@query("word_candidates", "O058", f"""
WITH {WORDS}, c AS (SELECT word, count(*) AS n FROM W GROUP BY word), lex AS (SELECT word FROM W GROUP BY word HAVING count(DISTINCT doc_id) >= 3)
SELECT word, n FROM c WHERE n <= 3 AND length(word) >= 3 AND word NOT IN (SELECT word FROM lex)""")
def word_candidates(t):
    per = D.tokens(t.documents).groupBy("word", "doc_id").agg(F.count("*").alias("k")).groupBy("word").agg(F.sum("k").alias("n"), F.count("*").alias("docs"))
    return per.filter((F.col("n") <= 3) & (F.length("word") >= 3) & (F.col("docs") < 3)).select("word", "n")


@query("toc_match", "O066, O097, O098")
def toc_match(t):
    """Contents lines (title, leaders, page), as a printed contents page has them in capitals, parsed and found again, in order, among all heading-like lines."""
    ls = D.pages(t.documents)
    c = F.col("line")
    heads = ls.filter((F.length(c) <= 60) & c.rlike(r"^\p{Lu}") & tx.count_of(c, r"\S+").between(1, 6))
    printed = heads.filter("line_no % 3 <> 1").select("doc_id", F.col("line_no").alias("seq"), F.concat(F.upper(F.regexp_replace("line", r"[.!?]$", "")), F.lit(" ..... "), F.col("page_no") + 1).alias("line"))
    entries = audit.contents_entries(printed).select("doc_id", "seq", "title")
    return links.match_contents(entries, heads.select("doc_id", F.col("line_no").alias("pos"), F.col("line").alias("title")))


@query("header_clusters", "O081")
def header_clusters(t):
    p = D.pages(t.documents)
    w = Window.partitionBy("doc_id", "page_no")
    first = p.withColumn("lo", F.min("line_no").over(w)).filter("line_no = lo AND length(line) BETWEEN 1 AND 90").select("doc_id", "page_no", F.regexp_replace("line", "[0-9]", "").alias("line"))
    return links.cluster_headers(first)


@query("benchmark_overlap", "O049", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '\p{L}+') AS ws FROM documents), b AS (SELECT item_id, regexp_extract_all(lower(text), '\p{L}+') AS ws FROM benchmark),
ds AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 11], ' ')) AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 10)) AS i FROM d)),
bs AS (SELECT DISTINCT item_id, md5(array_to_string(ws[i:i + 11], ' ')) AS s FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 10)) AS i FROM b))
SELECT doc_id, item_id, count(*) AS shared FROM ds JOIN bs ON ds.s = bs.s GROUP BY doc_id, item_id""")
def benchmark_overlap(t):
    """Shared runs of twelve words. The query side is small in any corpus (a benchmark), the join is by hash."""
    def shingles(df, key):
        ws = F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)
        s = df.select(key, ws.alias("ws")).filter(F.size("ws") >= 12)
        return s.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.size("ws") - 11), lambda i: F.md5(F.array_join(F.slice("ws", i, F.lit(12)), " ")))).alias("s")).distinct()

    return shingles(t.documents, "doc_id").join(shingles(t.benchmark, "item_id"), "s").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))
