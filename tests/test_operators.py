"""Document, link and relational operators against plain loops."""

import random
import re

from pyspark.sql import functions as F

from quiremill.operators import documents as D
from quiremill.operators import links
from quiremill.operators import relational as R

END = re.compile(r"[.!?:;…»”\"')\]]\s*$")


def texts(seed=1, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    line = lambda: (rng.choice(["", "A", "b", "1. "]) + " ".join(word() for _ in range(rng.randint(0, 20))) + rng.choice(["", "", ".", "?"]))
    return [(i, "\n".join(line() for _ in range(rng.randint(1, 30)))) for i in range(n)]


def test_merge_broken_equals_loop(spark):
    data = texts()
    got = dict(spark.createDataFrame(data, "doc_id long, text string").select("doc_id", D.merge_broken(F.split("text", "\n", -1))).collect())
    for i, t in data:
        out = []
        for x in t.split("\n"):
            if out and not END.search(out[-1]) and len(out[-1]) > 40 and x[:1].islower():
                out[-1] += " " + x
            else:
                out.append(x)
        assert got[i] == out


def test_pack_equals_loop(spark):
    data = texts(2)
    got = dict(spark.createDataFrame(data, "doc_id long, text string").select("doc_id", D.pack(F.split("text", "\n", -1), 200)).collect())
    for i, t in data:
        out, cur, n = [], [], 0
        for x in t.split("\n"):
            if not any(c.isalnum() for c in x):
                continue
            if cur and n + len(x) > 200:
                out.append("\n".join(cur))
                cur, n = [], 0
            cur.append(x)
            n += len(x) + 1
        assert got[i] == out + (["\n".join(cur)] if cur else [])


def test_running_headers(spark):
    lines = [(1, i, f"{10 + i} ROADBOOK and the text goes on") for i in range(3)] + [(1, 5, "so it went ROADBOOK 15")]
    lines += [(1, 7 + i, "as IBLA 21 and IBLA 22 and IBLA 21 have it") for i in range(3)] + [(1, 20, "He met NASA in 1999"), (2, 0, "12 ROADBOOK of another book")]
    paras = spark.createDataFrame(lines, "doc_id long, line_no long, line string")
    marks = D.header_marks(paras)
    assert {(r.number, r.phrase) for r in marks.collect() if r.doc_id == 2} == {("12", "ROADBOOK")}
    assert [tuple(r) for r in D.running_headers(marks).collect()] == [(1, "ROADBOOK", 4, 4)]
    got = {(r.doc_id, r.line_no): r.line for r in D.drop_running_headers(paras).collect()}
    want = {(d, i): x for d, i, x in lines} | {(1, i): "and the text goes on" for i in range(3)} | {(1, 5): "so it went"}
    assert got == want


def test_repeated_edges(spark):
    page = lambda n: f"Title of the book {n}\nfirst {n}x\nmiddle\nbody of page {n} ends here\n{'q' * n}"
    docs = spark.createDataFrame([(1, "\n".join(page(n) for n in range(1, 8)))], "doc_id long, text string")
    got = {(r.key, r.n) for r in D.repeated_edges(D.pages(docs)).collect()}
    assert got == {("Title of the book", 7)}


def test_monotone_keeps_rising_values(spark):
    rng = random.Random(3)
    data = [(k, i, rng.randint(0, 50)) for k in range(5) for i in range(40)]
    got = {(r.k, r.i) for r in D.monotone(spark.createDataFrame(data, "k long, i long, v long"), ["k"], "i", "v").collect()}
    want, top = set(), {}
    for k, i, v in data:
        if v > top.get(k, -1):
            top[k] = v
            want.add((k, i))
    assert got == want


def test_lifo_links_and_gates(spark):
    marks = [(1, p, 1, "ref") for p in (1, 3)] + [(1, 5, 1, "note"), (1, 6, 1, "note"), (1, 7, 1, "note")]
    df = spark.createDataFrame(marks, "doc_id long, pos long, no long, kind string")
    assert sorted(tuple(r) for r in links.link_lifo(df, least=1, share=0.5).collect()) == [(1, 5, 3), (1, 6, 1)]
    assert links.link_lifo(df, least=1, share=0.8).count() == 0 and links.link_lifo(df).count() == 0


def test_contents_in_order(spark):
    assert [links.title_score(a, b) for a, b in (("The End", "the end."), ("The End of it", "The End"), ("Begining", "Beginning"), ("x", "y"), ("", "y"))] == [3, 2, 1, 0, 0]
    e = spark.createDataFrame([(1, 0, "First Part"), (1, 1, "Second Part"), (1, 2, "Third"), (2, 0, "only one")], "doc_id long, seq long, title string")
    h = spark.createDataFrame([(1, 10, "first part"), (1, 20, "other"), (1, 30, "Second Part of two"), (2, 5, "only one")], "doc_id long, pos long, title string")
    assert sorted((r.seq, r.pos) for r in links.match_contents(e, h).collect()) == [(0, 10), (1, 30)]


def test_header_clusters(spark):
    data = [(1, i, "The Book of Sand" if i % 2 else "The Bock of Sand") for i in range(8)] + [(1, 9, "something else")]
    got = links.cluster_headers(spark.createDataFrame(data, "doc_id long, page_no long, line string")).collect()
    assert [(r.leader, r.n) for r in got] == [("The Bock of Sand", 8)]


def test_repairs(spark):
    lex = spark.createDataFrame([("modem", 9), ("kind", 5), ("clock", 2), ("reading", 4), ("the", 9), ("house", 3)], "word string, n long")
    words = spark.createDataFrame([("rnodem",), ("house",), ("unknown",)], "word string")
    got = {tuple(r) for r in links.repair_words(words, lex, [("rn", "m")]).collect()}
    assert got == {("rnodem", "modem", 9)}
    lines = spark.createDataFrame([(1, 0, "he was rea ding the house")], "doc_id long, line_no long, line string")
    assert [(r.pos, r.joined) for r in links.merge_split_words(lines, lex).collect()] == [(2, "reading")]
    lines = spark.createDataFrame([(1, 0, "a re ad ing lamp, t h e h o u s e"), (1, 1, "the h o u s e, C l o c k"), (1, 2, "the kind house")], "doc_id long, line_no long, line string")
    assert [(r.line_no, r.pos, r.parts, r.joined) for r in links.merge_split_words(lines, lex, 3).collect()] == [(0, 1, 3, "reading"), (0, 5, 3, "the")]
    assert sorted((r.line_no, r.run, r.joined) for r in links.join_spaced(lines, lex).collect()) == [(1, "C l o c k", "clock"), (1, "h o u s e", "house")]
    assert links.segment_words("thehouse", {"the", "house", "t"}) == ["the", "house"] and links.segment_words("zz", {"the"}) is None


def test_heading_levels(spark):
    h = spark.createDataFrame([(1, i, r) for i, r in enumerate([1, 2, 2, 3, 2, 1, 3])], "doc_id long, pos long, rank int")
    assert [r.depth for r in links.heading_levels(h).orderBy("pos").collect()] == [1, 2, 2, 3, 2, 1, 2]


def test_asof_equals_loop(spark):
    rng = random.Random(4)
    left = [(i, rng.randint(0, 3), rng.randint(0, 100)) for i in range(80)]
    right = [(rng.randint(0, 3), t, t * 2) for t in rng.sample(range(100), 40)]
    got = {r.id: r.v for r in R.asof_backward(spark.createDataFrame(left, "id long, k long, t long"), spark.createDataFrame(right, "k long, t long, v long"), ["k"], "t", ["v"]).collect()}
    for i, k, t in left:
        before = [(u, v) for a, u, v in right if a == k and u <= t]
        assert got[i] == (max(before)[1] if before else None)


def test_range_join_equals_loop(spark):
    rng = random.Random(5)
    points = [(rng.randint(0, 2), rng.randint(0, 500)) for _ in range(200)]
    spans = [(rng.randint(0, 2), a, a + rng.randint(0, 90)) for a in (rng.randint(0, 450) for _ in range(30))]
    got = R.range_join(spark.createDataFrame(points, "k long, at long"), spark.createDataFrame(spans, "k long, lo long, hi long"), ["k"], "at", "lo", "hi", 25)
    assert got.count() == sum(k == j and lo <= at <= hi for k, at in points for j, lo, hi in spans)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_memo_and_snapshot(spark):
    asked = spark.range(500).select(R.memo_key(F.col("id").cast("string")).alias("key"))
    got = R.memo_missing(asked.union(asked), asked.limit(100), 50).collect()
    assert len(got) == 400 and sorted({r.batch for r in got}) == list(range(8)) and [r.batch for r in sorted(got, key=lambda r: r.key)] == [i // 50 for i in range(400)]
    old, new = spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (4, "d")], "k long, v string"), spark.createDataFrame([(1, "a"), (2, None), (3, "x"), (5, "e")], "k long, v string")
    assert sorted(tuple(r) for r in R.snapshot_compare(old, new, "k", "v").collect()) == [(1, "same"), (2, "same"), (3, "changed"), (4, "missing"), (5, "new")]


def test_islands_and_edit_state(spark):
    df = spark.createDataFrame([(1, x) for x in (1, 2, 6, 7, 20)], "k long, at long")
    assert [r.island for r in R.islands(df, ["k"], "at", 3).orderBy("at").collect()] == [1, 1, 2, 2, 3]
    e = spark.createDataFrame([(1, "old", 1, 1), (1, "new", 2, 2), (2, "only", 1, 3)], "b long, value string, ts long, seq long")
    assert sorted(tuple(r) for r in D.edit_state(e, ["b"]).collect()) == [(1, "new", "old"), (2, "only", None)]


def test_ranks_and_medians_by_buckets(spark):
    rng = random.Random(6)
    data = [(rng.randint(0, 3), i, float(rng.randint(0, 300))) for i in range(700)]
    df = spark.createDataFrame(data, "k long, id long, v double")
    got = {r.id: r.rank for r in R.rank_by_bucket(df, ["k"], F.floor(F.col("v") / 50), ["v", "id"]).collect()}
    pairs = {r.k: (r.lower, r.upper) for r in R.middle_pair(df, ["k"], "v", 20.0).collect()}
    for k in range(4):
        mine = sorted((v, i) for j, i, v in data if j == k)
        assert [got[i] for _, i in mine] == list(range(1, len(mine) + 1))
        assert pairs[k] == (mine[(len(mine) - 1) // 2][0], mine[len(mine) // 2][0])


def test_missing_numbers_equals_loop(spark):
    rng = random.Random(8)
    data = [(rng.choice([None, 1, 2, 3]), rng.choice([None, rng.randint(-90, 90)])) for _ in range(150)] + [(4, x) for x in range(-20, 21)] + [(5, None), (6, 7), (7, 0), (7, 10**15)]
    df = spark.createDataFrame(data, "k long, no long")
    want = {(7, 10**15 - 1, 1)}
    for k in (None, 1, 2, 3, 4, 5, 6):
        held = {no for j, no in data if j == k and no is not None}
        if lacking := [no for no in range(min(held), max(held)) if no not in held] if held else []:
            want.add((k, len(lacking), lacking[0]))
    assert len(want) == 5
    for width in (1, 8, 1000):
        got = [tuple(r) for r in R.missing_numbers(df, ["k"], "no", width).collect()]
        assert len(got) == 5 and set(got) == want, width


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_fuzzy_match_equals_all_pairs(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(0, 9)))
    left, right = [(rng.randint(0, 1), word()) for _ in range(80)] + [(0, None)], [(rng.randint(0, 1), word()) for _ in range(80)] + [(1, None)]
    for most in (0, 1, 2, 3):
        got = R.fuzzy_match(spark.createDataFrame(left, "k long, a string"), spark.createDataFrame(right, "k long, b string"), ["k"], "a", "b", most)
        want = {}
        for k, a in left:
            near = sorted((levenshtein(a, b), b) for j, b in right if j == k and a is not None and b is not None)
            if near and near[0][0] <= most:
                want[(k, a)] = near[0]
        assert {(r.k, r.a): (r.distance, r.b) for r in got.collect()} == want


def test_repair_in_document_equals_loop(spark):
    rng = random.Random(8)
    pairs = (("rn", "m"), ("h", "b"), ("h", "li"), ("ii", "ü"))
    known = ["bat", "mat", "bim", "libat", "modern", "üzüm", "hih", "bib"]
    data = {}
    for d in range(12):
        for w in rng.choices(known + ["hat", "rnat", "hirn", "hihat", "iizüm", "hib", "mdii", "xiv"], k=25):
            data[(d, w)] = data.get((d, w), 0) + 1
    words = spark.createDataFrame([(d, w, n) for (d, w), n in data.items()], "doc_id long, word string, n long")
    lex = spark.createDataFrame([(w, 5) for w in known], "word string, n long")
    got = {(r.doc_id, r.word): (r.fix, r.n) for r in links.repair_in_document(words, lex, pairs).collect()}
    want = {}
    for d, w in data:
        if w in known or len(w) < 3 or re.fullmatch("[ivxlcdmı]+", w):
            continue
        made = {w[:i] + b + w[i + len(a) :] for a, b in pairs for i in range(len(w)) if w.startswith(a, i)}
        found = sorted((-data[(d, c)], c) for c in made if c in known and data.get((d, c), 0) >= 2)
        if found and (len(found) == 1 or -found[0][0] >= 3 * -found[1][0]):
            want[(d, w)] = (found[0][1], -found[0][0])
    assert got == want and want


def test_divided_words(spark):
    text = ["we were rea-", "ding of a well-", "known man who is lib-  ", "eral and", "went home-", "", "Then no-", "One"]
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(text)], "doc_id long, line_no long, line string")
    lex = spark.createDataFrame([(w, 3) for w in ("reading", "well", "known", "home")], "word string, n long")
    got = {(r.line_no, r.left, r.right, r.verdict) for r in links.divided_words(lines, lex).collect()}
    assert got == {(0, "rea", "ding", "join"), (1, "well", "known", "keep"), (2, "lib", "eral", "join")}


def test_links_sides_and_pages(spark):
    refs = spark.createDataFrame([(1, 1, 9), (1, 1, 4), (2, 1, 5)], "page long, no long, pos long")
    notes = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "page long, no long, note string")
    assert {(r.note, r.ref.pos) for r in links.link_equi(refs, notes, ["page", "no"], ["pos"]).collect()} == {("a", 4), ("c", 5)}
    pairs = spark.createDataFrame([("Author", "x"), ("Author", "y"), ("t", "Writer"), ("u", "Writer"), ("t", "Writer")], "a string, b string")
    assert {(r.one, r.many) for r in links.sides(pairs, "a", "b").collect()} == {("x", "Author"), ("y", "Author"), ("t", "Writer"), ("u", "Writer")}
    labels = spark.createDataFrame([(1, i, v) for i, v in enumerate([11, 12, 40, 14, 15])] + [(2, 0, 5)], "k long, at long, v long")
    assert [(r.k, r.modal, r.n) for r in D.modal_offset(labels, ["k"], "at", "v").collect()] == [(1, 10, 4)]
    series = spark.createDataFrame([(1, 5 * i) for i in range(9)] + [(2, 5 * i) for i in range(4)] + [(3, 100 * i) for i in range(9)], "k long, v long")
    assert {r.k: r.series for r in D.series_gate(series, ["k"], "v", 1, 10).collect()} == {1: True, 2: False, 3: False}
    lines = spark.createDataFrame([(1, 0, "7"), (1, 1, "99"), (1, 2, "in 1999")], "p long, i long, x string").withColumn("v", F.regexp_extract("x", r"(\d+)", 1).cast("int"))
    sure = F.when(F.col("x").rlike(r"^\d+$"), 2).when(F.col("v") < 5000, 1)
    assert [(r.sure, r.no) for r in D.page_number(lines, ["p"], ["i"], "v", sure).collect()] == [(2, 7)]
    covered = spark.createDataFrame([(1, 3), (1, 4), (2, None)], "k long, x long")
    assert {(r.k, r.free, r.first_free) for r in D.free_positions(covered, ["k"], "x", 3, 6).collect()} == {(1, 2, 5), (2, 4, 3)}


def test_unspoken_regions_go_on(spark):
    from quiremill.operators.audit import continue_unspoken

    rows = [
        (1, 0, "First part", None, 20, 20, 900, 0.0, 0.0), (1, 1, "Second Part", None, 20, 20, 900, 0.0, 0.0), (1, 2, "Notes", "notes", 9, 8, 90, 0.9, 0.0),
        (1, 3, "SECOND PART:", None, 9, 8, 300, 0.0, 0.0), (1, 4, "More", None, 9, 8, 300, 0.25, 0.0), (1, 5, "Places", None, 9, 8, 60, 0.0, 0.6),
        (1, 6, "Afterword", None, 30, 30, 2000, 0.0, 0.0), (1, 7, "Third part", None, 9, 8, 60, 0.3, 0.9), (1, 8, "Index", "index", 9, 8, 60, 0.0, 0.9),
        (1, 9, "End", None, 2, 1, 40, 0.0, 0.0), (1, 10, "Sources", "sources", 9, 8, 60, 0.0, 0.0), (2, 0, None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, at long, title string, reason string, blocks long, paras long, words long, note_share double, entry_share double")
    got = {(r.doc_id, r.at): r.why for r in continue_unspoken(df).collect()}
    assert [got[(1, i)] for i in range(11)] == [None, None, "notes", "notes of a section before", "notes, continued", "list, continued", None, None, "index", "between", "sources"]
    assert got[(2, 0)] is None and continue_unspoken(df.filter("false")).count() == 0
