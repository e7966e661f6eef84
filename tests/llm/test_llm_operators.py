"""Each operator against a brute-force version, and on nulls, empties, long texts, ties, repeats and clashing names."""

import hashlib
import math
import random
import re
import struct
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiremill.llm import bpe, chunks, components, langid, lines, mixing, mpeg, neardup, neighbours, queries, tokens, toxicity

SPACE = " \t\n\x0b\x0c\r"


def sha(s):
    return hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# 1: token counts


def greedy(word, pieces, mark="##"):
    if not word:
        return 0
    at, n = 0, 0
    while at < len(word):
        for end in range(len(word), at, -1):
            if (mark if at else "") + word[at:end] in pieces:
                at, n = end, n + 1
                break
        else:
            return 1
    return n


def test_longest_match_equals_greedy():
    rng = random.Random(3)
    for _ in range(60):
        pieces = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 12))}
        pieces |= {"##" + "".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 12))}
        m = tokens.LongestMatch(pieces)
        for _ in range(150):
            w = "".join(rng.choice("abc") for _ in range(rng.randint(0, 9)))
            assert m.count(w) == greedy(w, pieces), (w, pieces)


def test_token_counts_of_long_words(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("日本語漢字仮名交じり文") for _ in range(2500)), "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(5000)), "https://example.org/" + "path/" * 600, "ab" * 50, "ab" * 51, "é" * 4000]
    texts = [*words, f"short {words[0]}\n{words[1]} end"]
    pieces = set(tokens.word_piece_vocabulary(queries.word_bpe_path()))
    longest, byte_level = max(map(len, pieces)), tokens._byte_level()

    def plain(word):
        word, at, n = word.encode().decode("latin-1").translate(byte_level), 0, 0
        while at < len(word):
            at = next(end for end in range(min(len(word), at + longest), at, -1) if ("##" if at else "") + word[at:end] in pieces)
            n += 1
        return n

    got = {r.doc_id: (r.n_words, r.n_tokens) for r in tokens.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), queries.word_bpe_path()).collect()}
    assert got == {i: (len(t.split()), sum(map(plain, t.split()))) for i, t in enumerate(texts)}
    assert all(n > 100 for i, (_, n) in got.items() if i not in (3, 4))


def test_token_counts_edges(edge, none):
    got = rows_of(tokens.token_counts(edge, queries.word_bpe_path()))
    assert len(got) == edge.count()
    assert {r[1:] for r in got if r[0] in (1, 2, 3)} == {(0, 0)}
    assert rows_of(tokens.token_counts(none, queries.word_bpe_path())) == []


# 2: BPE


def test_bpe_equals_library(edge, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.word_bpe_path())
    want = Counter()
    for r in edge.collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        want[(r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False)))] += 1
    assert Counter(rows_of(queries.op2_digests(edge))) == want
    assert rows_of(queries.op2_digests(none)) == []


def test_decode_alone(edge):
    path = queries.word_bpe_path()
    both = bpe.encode(edge, path, decode=True)
    again = bpe.decode(both.select("doc_id", "n_tokens", "ids"), path)
    assert Counter(rows_of(again.select("doc_id", "decoded"))) == Counter(rows_of(both.select("doc_id", "decoded")))


def test_bpe_small_blocks(spark, edge, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 50)
    small = Counter(rows_of(queries.op2_digests(edge.coalesce(1))))
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 8 << 20)
    assert small == Counter(rows_of(queries.op2_digests(edge)))


# 3: chunks


def test_inputs_in_doubtful_order_are_written_first(spark, tmp_path):
    """Blocks are named by their documents in order, so what comes out of a shuffle is read from a table."""
    from quiremill.llm import common

    spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    plain = docs.filter("doc_id > 3").select("doc_id", "text")
    assert common.reread(plain, "x") is plain
    for doubtful in (docs.repartition(5), docs.dropDuplicates(["text"]), docs.orderBy("text"), docs.withColumn("text", F.concat("text", F.rand().cast("string")))):
        assert common.reread(doubtful, "x") is not doubtful
        assert common.reread(doubtful, "x").count() == 50


def test_chunks_cover_texts():
    rng = np.random.default_rng(1)
    for text in ("", "a", "é" * 1000, "日本語" * 200, "x" * 5000, "".join(map(chr, rng.integers(32, 1000, 3000)))):
        raw = text.encode()
        ends = chunks.chunk_ends(np.frombuffer(raw, np.uint8)).tolist()
        assert ends == sorted(set(ends)) and (not raw or ends[-1] == len(raw))
        for a, b in zip([0, *ends], ends):
            raw[a:b].decode()
            assert b - a <= chunks.MAX_BYTES + 3


def test_shared_passages_found_and_clean_left(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    said = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    data = []
    for i in range(60):
        passage = said(55)
        data += [(3 * i, f"{said(rng.randint(5, 200))} {passage} {said(90)}"), (3 * i + 1, f"{said(rng.randint(5, 200))} {passage}"), (3 * i + 2, said(200))]
    got = chunks.repeated_passages(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == {x for x, _ in data if x % 3 < 2}
    assert all(r.first_doc_id == r.doc_id - r.doc_id % 3 for r in got)
    texts = dict(data)
    for r in got:
        part = texts[r.doc_id].encode()[r.start : r.start + r.bytes]
        assert part in texts[r.doc_id - r.doc_id % 3 + (1 - r.doc_id % 3)].encode()
    kept = dict(rows_of(chunks.drop_repeats(spark.createDataFrame(data, "doc_id long, text string"))))
    assert all(kept[x] == t for x, t in data if x % 3 != 1) and all(len(kept[x]) < len(t) for x, t in data if x % 3 == 1)


def test_passages_have_one_first_holder(spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    said = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    inside, left, right = said(55), said(60), said(60)
    copied = f"{said(150)} {inside} {said(150)}"
    touching = f"{said(100)} {left} {right} {said(100)}"
    data = [(1, f"{said(40)} {inside} {said(40)}"), (2, f"{said(40)} {left} {said(40)}"), (3, f"{said(40)} {right} {said(40)}"), (5, copied), (9, copied), (12, touching), (15, touching)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = chunks.repeated_passages(docs).collect()
    links = {(r.doc_id, r.first_doc_id) for r in got if r.first_doc_id != r.doc_id}
    assert links == {(5, 1), (9, 1), (9, 5), (12, 2), (12, 3), (15, 2), (15, 3), (15, 12)}
    texts = dict(data)
    for r in got:
        assert r.kept == (r.first_doc_id == r.doc_id)
    for d, passage in ((5, inside), (9, inside), (12, left), (12, right)):
        at = texts[d].index(passage)
        assert any(r.start < at + len(passage) and at < r.start + r.bytes and r.n_words >= 20 and not r.kept for r in got if r.doc_id == d)
    kept = dict(rows_of(chunks.drop_repeats(docs)))
    for d, parts in ((5, (inside,)), (12, (left, right))):
        assert all(p[len(p) // 3 : 2 * len(p) // 3] not in kept[d] for p in parts)
        assert texts[d].split()[:90] == kept[d].split()[:90] and texts[d].split()[-90:] == kept[d].split()[-90:]


def passages_brute(data, min_words=20):
    """Stretches compared as strings: for each document, runs of (start, end) with the least id that holds each of their stretches."""
    found, held = {}, defaultdict(set)
    for d, text in data:
        raw = text.encode()
        ends = chunks.chunk_ends(np.frombuffer(raw, np.uint8)).tolist()
        starts = [0, *ends[:-1]]
        worth = [max(sum(1 for i in range(a, b) if not raw[i : i + 1].isspace() and (i == 0 or raw[i - 1 : i].isspace())), (b - a) // chunks.WORD_BYTES) for a, b in zip(starts, ends)]
        found[d] = []
        for i in range(len(ends)):
            total, j = 0, i
            while j < len(ends) and total < min_words:
                total, j = total + worth[j], j + 1
            if total >= min_words:
                found[d].append((starts[i], ends[j - 1]))
                held[raw[starts[i] : ends[j - 1]]].add(d)
    out = []
    for d, text in data:
        raw, run = text.encode(), None
        for a, b in [*found[d], (None, None)]:
            owners = held[raw[a:b]] if a is not None else set()
            head = min(owners) if len(owners) > 1 else None
            if run and run[2] != head:
                out.append((d, run[0], run[1] - run[0], run[2]))
                run = None
            if head is not None:
                run = (run[0] if run else a, b, head)
    return out


def stitched_texts():
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    said = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    pool = [said(n) for n in (3, 6, 8, 12, 16, 25, 30, 40, 55, 70) for _ in range(5)]
    data = []
    for i in range(150):
        data.append((i, " ".join(rng.choice(pool) if rng.random() < 0.6 else said(rng.randint(2, 40)) for _ in range(rng.randint(1, 8)))))
    data += [(200 + i, data[i][1]) for i in range(0, 150, 9)]
    unspaced = "".join(rng.choice("日本語文字列検出重複大規模言語") for _ in range(200))
    return data + [(300, "あ" * 3 + unspaced + said(5)), (301, "い" * 7 + unspaced)]


def test_passages_equal_brute_force(spark):
    data = stitched_texts()
    got = chunks.repeated_passages(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.start, r.bytes, r.first_doc_id) for r in got) == sorted(passages_brute(data))
    assert {300, 301} <= {r.doc_id for r in got}


def test_passages_stand_whole_in_their_first_holder(spark):
    """Short shared pieces of several documents in a row make no passage; what is dropped stands in an earlier document."""
    data = stitched_texts()
    docs, raw = spark.createDataFrame(data, "doc_id long, text string"), {d: t.encode() for d, t in data}
    for r in chunks.repeated_passages(docs).collect():
        part = raw[r.doc_id][r.start : r.start + r.bytes]
        assert part in raw[r.first_doc_id] and any(part in t for d, t in raw.items() if d != r.doc_id)
        assert r.n_words >= 20 or len(part) >= 20 * chunks.WORD_BYTES
    kept = dict(rows_of(chunks.drop_repeats(docs)))
    want = {}
    for d, t in raw.items():
        gone = bytearray(len(t))
        for x, start, size, head in passages_brute(data):
            if x == d and head != d:
                gone[start : start + size] = b"\1" * size
        want[d] = bytes(b for b, g in zip(t, gone) if not g).decode()
    assert kept == want


def test_chunks_edges(edge, none):
    got = chunks.repeated_passages(edge).collect()
    assert {r.doc_id for r in got} <= {4, 5, 6, 7, 8}
    assert rows_of(chunks.repeated_passages(none)) == []
    assert chunks.drop_repeats(edge).count() == edge.count()


def test_chunk_blocks_dont_matter(spark, edge, monkeypatch):
    docs = edge.unionByName(edge.withColumn("doc_id", F.col("doc_id") + 100))
    whole = Counter(rows_of(chunks.repeated_passages(docs)))
    monkeypatch.setattr(chunks, "BLOCK_BYTES", 40)
    assert Counter(rows_of(chunks.repeated_passages(docs.coalesce(1)))) == whole


# 4: language


def test_language_held_out(spark):
    rng = random.Random(2)
    kinds = {"xx": "the of and thing with where shall", "yy": "der die und nicht werden schön über", "zz": "les des que dans être où ça"}
    data = [(i, " ".join(rng.choice(kinds[k].split()) + rng.choice(["", "", "a"]) for _ in range(40)), k) for i, k in ((i, rng.choice(list(kinds))) for i in range(300))]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = langid.identify(docs, langid.fit(docs.filter(langid.learners()))).filter(~langid.learners()).select("lang", "lang_pred").collect()
    assert len(got) > 40 and sum(a == b for a, b in got) >= 0.97 * len(got)


def test_profiles_equal_plain_counts():
    text = "Été, été là! ab"
    grams, counts = langid.text_grams(text)
    marked = "\0" + re.sub(r"\0+", "\0", "".join(c if c.isalpha() else "\0" for c in text.lower())).strip("\0") + "\0"
    want = Counter()
    for n in langid.GRAMS:
        for i in range(len(marked) - n + 1):
            g = marked[i : i + n]
            if (n == 1 and g != "\0") or (n == 2 and g != "\0\0") or (n == 3 and g[1] != "\0"):
                want[g] += 1
    assert sorted(counts.tolist()) == sorted(want.values())


def test_languages_are_bounded(spark):
    rows = [(i, "some words of a text", "en") for i in range(9)] + [(i, "wörter eines textes", "de") for i in range(9, 14)] + [(i, "x y z", f"dirt{i}") for i in range(14, 60)]
    got = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), languages=2)
    assert got.languages == ["de", "en"] and got.predict("wörter")[0] == "de"


def test_language_edges(edge, none):
    profiles = langid.fit(edge)
    got = langid.identify(edge, profiles)
    assert got.columns.count("score") == 1 and got.count() == edge.count()
    assert {(r.lang_pred, r.score) for r in got.collect() if r.doc_id in (1, 2, 3)} == {("und", 0.0)}
    assert all(0 <= r.score <= 1 for r in got.collect())
    assert rows_of(langid.identify(none, langid.fit(none))) == []
    kept = langid.keep_identified(edge)
    assert kept.columns == edge.columns and {r.score for r in kept.collect()} == {"z"} and not {1, 2, 3} & {r.doc_id for r in kept.collect()}
    assert {r.lang_pred for r in langid.identify(edge, langid.fit(none)).collect()} == {"und"}


# 5: neighbours


def test_neighbours_recall_order_and_scores(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(0, 12, 3000)] + 0.5 * rng.normal(size=(3000, 16))
    x[100:140] = x[100]
    data = [(i, [float(v) for v in np.float32(a)]) for i, a in enumerate(x)]
    data += [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, []), (None, [1.0] * 16), (9020, [float("inf")] + [0.0] * 15)]
    rows = neighbours.usable(spark.createDataFrame(data, "vec_id long, embedding array<float>"))
    assert rows.count() == 3000
    got = defaultdict(list)
    for r in neighbours.search(rows, rows.filter("vec_id % 20 = 0"), neighbours.fit(rows)).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    y = np.float32(x).astype(float)
    found = 0
    for q in range(0, 3000, 20):
        s = (y[q] * y).sum(1)
        s[q] = -np.inf
        top = np.lexsort((np.arange(3000), -s))[:20]
        assert len(got[q]) == 20 and all(abs(s[v] - z) < 1e-12 for v, z in got[q])
        assert got[q] == sorted(got[q], key=lambda p: (-p[1], p[0]))
        found += len(set(top.tolist()) & {v for v, _ in got[q]})
    assert found >= 0.9 * 20 * 150


def neighbour_recall(rows, y, router, k=20):
    """Share of the true neighbours found by every query; each list must be full and in order."""
    got = defaultdict(list)
    for r in neighbours.search(rows, rows.filter("vec_id % 20 = 0"), router, k).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r)
    found = total = 0
    for q in range(0, len(y), 20):
        s = (y[q] * y).sum(1)
        s[q] = -np.inf
        want = np.lexsort((np.arange(len(y)), -s))[: min(k, len(y) - 1)]
        mine = got[q]
        assert len(mine) == len(want) and [r.rank for r in mine] == list(range(1, len(want) + 1))
        assert [(r.score, r.vec_id) for r in mine] == sorted(((r.score, r.vec_id) for r in mine), key=lambda p: (-p[0], p[1]))
        found += len(set(want.tolist()) & {r.vec_id for r in mine})
        total += len(want)
    return found / total if total else 1.0


def vector_rows(spark, y):
    return neighbours.usable(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "vec_id long, embedding array<double>"))


def test_neighbours_recall_on_skewed_vectors(spark):
    # Tight clusters whose first component is least, and a diffuse rest: what finds the neighbours of the one loses those of the other.
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(60, 16)) - 6 * np.eye(16)[0]
    tight = np.repeat(centres, 50, axis=0) + 0.01 * rng.normal(size=(3000, 16))
    rest = rng.normal(size=(3000, 16))
    rest[:, 0] = np.abs(rest[:, 0])
    y = np.concatenate([tight, rest])[rng.permutation(6000)]
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    rows = vector_rows(spark, y)
    router = neighbours.fit(rows, part_rows=50)
    assert router.weights.shape[1] == 120 and 0 < router.floor < 1
    assert neighbour_recall(rows, y, router) >= 0.9


@pytest.mark.parametrize("n", [1, 15, 30, 60, 100])
def test_neighbours_of_few_rows_are_all_found(spark, n):
    rng = np.random.default_rng(n)
    y = rng.normal(size=(5, 8))[rng.integers(0, 5, n)] + 0.2 * rng.normal(size=(n, 8))
    rows = vector_rows(spark, y)
    assert neighbour_recall(rows, y, neighbours.fit(rows)) == 1.0
    router = neighbours.fit(rows, part_rows=4)  # many leaves of few rows: lists are full all the same
    assert neighbour_recall(rows, y, router) >= (0.0 if n < 60 else 0.7)


def test_neighbours_in_two_levels(spark):
    rng = np.random.default_rng(3)
    y = rng.normal(size=(40, 12))[rng.integers(0, 40, 4000)] + 0.15 * rng.normal(size=(4000, 12))
    rows = vector_rows(spark, y)
    router = neighbours.fit(rows, part_rows=50, max_parts=10)
    assert router.weights.shape[1] == 10 and router.subs and router.starts()[-1] > 40
    assert router.recall >= 0.95 and neighbour_recall(rows, y, router) >= 0.9
    order, count = router.visits(y[:400], 21)
    assert router.sizes[order][np.arange(order.shape[1])[None, :] < count[:, None]].sum() < 0.5 * 400 * 4000  # clustered: most rows are not visited


def test_neighbours_repeats(spark):
    """One vector on a third of the rows, ids with several vectors."""
    rng = np.random.default_rng(9)
    y = rng.normal(size=(900, 8))
    y[rng.random(900) < 0.35] = y[7]
    rows = vector_rows(spark, y)
    assert neighbour_recall(rows, y, neighbours.fit(rows, part_rows=100)) >= 0.9
    data = [(i % 30, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 4)))]
    twice = neighbours.usable(spark.createDataFrame(data + data[:50], "vec_id long, embedding array<double>"))
    for part_rows in (30, 400):
        got = neighbours.search(twice, twice.filter("vec_id % 20 = 0"), neighbours.fit(twice, part_rows=part_rows), 29).collect()
        assert sorted((r.query_id, r.vec_id) for r in got) == [(q, v) for q in (0, 20) for v in range(30) if v != q]
    least = {q: min(v for i, v in data if i == q) for q in (0, 20)}
    for r in got:
        assert abs(r.score - max(float(np.dot(least[r.query_id], v)) for i, v in data if i == r.vec_id)) < 1e-12


def test_neighbours_edges(spark):
    empty = neighbours.usable(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert neighbours.fit(empty) is None and neighbours.search(empty, empty, None).count() == 0
    few = neighbours.usable(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, [1.0, 2.0, 3.0])], "vec_id long, embedding array<float>"))
    got = neighbours.search(few, few.filter("vec_id = 0"), neighbours.fit(few)).orderBy("rank").collect()
    assert [(r.vec_id, r.rank) for r in got] == [(1, 1), (2, 2)]


# 6: toxicity


@pytest.fixture(scope="module")
def toxic(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(3, 8))) for _ in range(500)]
    bad = ["vileword", "nastything", "foulness"]
    docs, labels = [], []
    for i in range(600):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(20, 120))]
        is_bad = rng.random() < 0.25
        if is_bad:
            text[rng.randrange(len(text))] = rng.choice(bad) + rng.choice(["", "", "es"])
        docs.append((i, " ".join(text)))
        labels.append((i, int(is_bad)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_held_out(toxic):
    docs, labels = toxic
    index = toxicity.fit(docs, labels.filter(toxicity.learners()))
    got = toxicity.score(docs, index).filter(~toxicity.learners()).join(labels, "doc_id").select("predicted", "toxic", "score").collect()
    assert len(got) > 80 and sum(r.predicted == r.toxic for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_block_max_equals_brute_force(toxic):
    docs, labels = toxic
    index = toxicity.fit(docs, labels)
    rng = np.random.default_rng(3)
    dense = np.zeros((len(index.labels), len(index.terms)))
    for b, (slot, rows) in enumerate(index.postings):
        part = rows[slot].T
        dense[b * toxicity.BLOCK : (b + 1) * toxicity.BLOCK] = part[: len(dense) - b * toxicity.BLOCK]
    for _ in range(100):
        at, w = index.vector({int(i): int(rng.integers(1, 5)) for i in rng.choice(len(index.terms), min(4, len(index.terms)), replace=False)})
        s = dense[:, at] @ w
        want = np.lexsort((np.arange(len(s)), -s.round(12)))[: toxicity.NEIGHBOURS]
        near, cosine = index.nearest(at, w)
        assert np.allclose(cosine, s[want][: len(cosine)]) and (s[want][len(cosine) :] <= 0).all()


def test_evidence_equals_dense_tf_idf(toxic):
    """Neighbours and cosines against TF-IDF vectors made from the texts alone."""
    docs, labels = toxic
    index = toxicity.fit(docs, labels.filter(toxicity.learners()))
    texts = dict(rows_of(docs))
    known = sorted(index.terms)
    holders = Counter(t for text in texts.values() for t in set(toxicity.text_terms(text)))
    idf = {t: math.log((len(texts) + 1) / (holders[t] + 1)) + 1 for t in known}

    def vector(text):
        counts = toxicity.text_terms(text)
        v = np.array([idf[t] * (1 + math.log(counts[t])) if counts[t] else 0.0 for t in known])
        return v / (np.linalg.norm(v) or 1)

    assert {"vileword", "nastything", "foulness"} <= set(known)
    examples = [int(x) for x in index.doc_ids]
    dense = np.array([vector(texts[d]) for d in examples])
    assert all(toxicity._document_terms(t) == set(toxicity.text_terms(t)) for t in [None, "", *texts.values()])
    seen = 0
    for r in toxicity.score(docs, index).collect():
        s = np.sort(dense @ vector(r.text))[::-1]
        s = s[s > 1e-12][: toxicity.NEIGHBOURS]
        assert np.allclose([e.cosine for e in r.evidence], s)
        for e in r.evidence:
            assert abs(float(dense[examples.index(e.doc_id)] @ vector(r.text)) - e.cosine) < 1e-9
        seen += len(r.evidence) > 0
    assert seen > 50


def test_rare_wording_has_examples(spark):
    """A word of few toxic texts is found though the sample of examples is far smaller; copies of a text count once."""
    rng = random.Random(3)
    said = lambda: " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(3, 6))) for _ in range(20))
    data = [(i, said() + (" zzrareinsult" if i % 40 == 0 else " yyusualinsult" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(1600)]
    copied = said()
    data += [(2000 + i, copied, 1) for i in range(60)]
    docs = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    index = toxicity.fit(docs, docs.select("doc_id", "toxic"), fit_rows=(40, 10))
    assert "zzrareinsult" in index.terms and not set(copied.split()) & set(index.terms)
    got = toxicity.score(spark.createDataFrame([(1, said() + " zzrareinsult"), (2, said())], "doc_id long, text string"), index).collect()
    assert {r.doc_id: r.predicted for r in got} == {1: 1, 2: 0}
    assert len(index.labels) <= 40 + 10 + toxicity.TERM_ROWS * len(index.terms)


def test_toxicity_edges(edge, none, spark):
    labels = spark.createDataFrame([(4, 1), (4, 0), (None, 1), (5, None), (7, 0), (99, 1)], "doc_id long, toxic int")
    for index in (toxicity.fit(edge, labels), toxicity.fit(none, labels), toxicity.fit(edge, labels.filter("false"))):
        got = toxicity.score(edge, index).collect()
        assert len(got) == edge.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(none, index).count() == 0


# 7: audio


def test_audio_round_trip(edge, none):
    got = {}
    for r in mpeg.read_audio(mpeg.to_audio(edge.select("doc_id", mpeg.padded(F.col("text")).alias("payload")))).collect():
        got.setdefault(r.doc_id, []).append(r)
    for r in edge.collect():
        raw = (r.text or "").encode()
        raw += bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        x = got[r.doc_id][0]
        assert bytes(x.payload) == raw and x.bad_checksums == 0 and x.resyncs == 0
        assert x.n_frames == x.vbr_frames == -(-len(raw) // mpeg.ROOM) and x.duration_us == x.n_frames * 36_000
        assert all(mpeg.parse_header(bytes(x.media), at) for at in x.offsets)
    assert rows_of(mpeg.read_audio(mpeg.to_audio(none.select("doc_id", F.lit(b"").alias("payload"))))) == []


def test_audio_damage():
    payload = bytes(range(256)) * 40
    whole = mpeg.write_stream(payload)
    assert mpeg.read_stream(whole).payload == payload
    first = mpeg.read_stream(whole).offsets
    side = bytearray(whole)
    side[first[2] + 8] ^= 1
    assert mpeg.read_stream(bytes(side)).bad_checksums == 1
    cut = whole[: first[3]] + b"junk" + whole[first[3] :]
    s = mpeg.read_stream(cut)
    assert s.resyncs == 1 and len(s.offsets) == len(first) and s.payload == payload
    lost = bytearray(whole)
    lost[first[1]] = 0
    s = mpeg.read_stream(bytes(lost))
    assert s.resyncs == 1 and len(s.offsets) == len(first) - 1 and s.vbr_frames == len(first)
    assert mpeg.read_stream(None).payload == b"" and mpeg.read_stream(b"\xff\xfb\x90").offsets == []


# Sizes of common streams as the format gives them: (header bytes, size, samples, Hz).
KNOWN_FRAMES = [
    ("fffb9064", 417, 1152, 44100),  # 1, III, 128 kbit/s
    ("fffb9264", 418, 1152, 44100),  # the same with a padding slot
    ("fff344c4", 96, 576, 24000),  # 2, III, 32 kbit/s, mono
    ("ffe310c4", 52, 576, 11025),  # 2.5, III, 8 kbit/s, mono
    ("fffda4c4", 576, 1152, 48000),  # 1, II, 192 kbit/s
    ("ffff8264", 280, 384, 44100),  # 1, I, 256 kbit/s, padded
]


def frame_bytes(header, rng):
    f = mpeg.parse_header(header)
    return header + bytes(rng.integers(0, 255, f.size - 4, dtype=np.uint8))  # no 0xff: no false header


@pytest.mark.parametrize(("header", "size", "samples", "rate"), KNOWN_FRAMES)
def test_audio_versions_and_layers(header, size, samples, rate):
    rng = np.random.default_rng(1)
    head = bytes.fromhex(header)
    f = mpeg.parse_header(head)
    assert (f.size, f.samples, f.rate) == (size, samples, rate)
    stream = b"".join(frame_bytes(head, rng) for _ in range(50))
    s = mpeg.read_stream(stream)
    assert s.offsets == list(range(0, 50 * f.size, f.size)) and s.resyncs == 0 and s.rate == rate
    assert s.duration_us == 50 * samples * 1_000_000 // rate
    s = mpeg.read_stream(stream[: 10 * f.size + 3] + bytes(9) + stream[11 * f.size :])
    assert s.resyncs >= 1 and len(s.offsets) in (48, 49)
    for bad in ("ffea9064", "fff99064", "fffbf064", "fffb9c64", "fffb0064", "fffb9066"):
        assert mpeg.parse_header(bytes.fromhex(bad)) is None


def test_audio_layer_one_checksum():
    head = bytes.fromhex("fffe80c4")  # mono, with a checksum over header and 16 bytes of allocation
    body = bytes(range(16))
    f = mpeg.parse_header(head)
    frame = head + mpeg.crc16(head[2:] + body).to_bytes(2, "big") + body
    frame += bytes(f.size - len(frame))
    assert f.layer == 1 and f.checked and mpeg.read_stream(frame * 3).bad_checksums == 0
    assert mpeg.read_stream(frame * 2 + frame[:8] + b"\x77" + frame[9:]).bad_checksums == 1


def tag_bytes(version, frames, flags=0):
    body = b"".join(frames)
    return b"ID3" + bytes([version, 0, flags]) + mpeg._syncsafe(len(body)) + body


def test_audio_tags():
    rng = np.random.default_rng(2)
    frame = frame_bytes(bytes.fromhex("fffb9064"), rng)
    text = b"\x00An old title"
    two = tag_bytes(2, [b"TT2" + len(text).to_bytes(3, "big") + text])
    wide = b"\x01" + "Bir başlık".encode("utf-16")
    three = tag_bytes(3, [b"TIT2" + len(wide).to_bytes(4, "big") + b"\0\0" + wide, b"COMM" + (9).to_bytes(4, "big") + b"\0\0" + b"\0eng\0note", b"TXXX" + (6).to_bytes(4, "big") + b"\0\x80" + b"locked"])
    long = b"\x03" + ("ğ" * 100).encode()  # 201 bytes: syncsafe and plain sizes differ
    four = tag_bytes(4, [b"TIT2" + mpeg._syncsafe(len(long)) + b"\0\0" + long, b"TPE1" + mpeg._syncsafe(8) + b"\0\0" + b"\x03one\0two"])
    unsync = tag_bytes(4, [b"TALB" + mpeg._syncsafe(5) + b"\0\x02" + b"\0a\xff\0b"])
    one = b"TAG" + b"Last title".ljust(30, b"\0") + b"Someone".ljust(30, b" ") + bytes(30) + b"1999" + b"said".ljust(28, b"\0") + b"\0\x07" + b"\x11"
    for tag, want in ((two, {"TIT2": "An old title"}), (three, {"TIT2": "Bir başlık", "COMM": "note"}), (four, {"TIT2": "ğ" * 100, "TPE1": "one / two"}), (unsync, {"TALB": "a\xffb"})):
        s = mpeg.read_stream(tag + frame * 3)
        assert s.tags == want and s.offsets[0] == len(tag) and len(s.offsets) == 3 and not s.resyncs
    s = mpeg.read_stream(four + two + frame * 3 + one)
    assert s.tags == {"TIT2": "ğ" * 100, "TPE1": "one / two", "TYER": "1999", "COMM": "said", "TRCK": "7"} and len(s.offsets) == 3 and not s.resyncs
    ape = b"APETAGEX" + struct.pack("<IIII", 2000, 32, 0, 0) + bytes(8)
    assert len(mpeg.read_stream(frame * 3 + ape + one).offsets) == 3 and mpeg.read_stream(frame * 3 + ape + one).resyncs == 0


def test_audio_tables():
    rng = np.random.default_rng(3)
    head = bytes.fromhex("fffb9064")
    audio = b"".join(frame_bytes(head, rng) for _ in range(20))
    size = len(audio) // 20

    def with_table(at, table):
        return (head + bytes(at - 4) + table).ljust(size, b"\0") + audio

    lame = b"LAME3.100" + bytes(12) + (576 << 12 | 1000).to_bytes(3, "big")
    s = mpeg.read_stream(with_table(36, b"Info" + struct.pack(">III", 3, 20, 21 * size) + lame))
    assert (s.vbr_frames, s.encoder, s.delay, s.padding, s.counts_match) == (20, "LAME3.100", 576, 1000, True)
    assert len(s.offsets) == 20 and s.duration_us == (20 * 1152 - 1576) * 1_000_000 // 44100
    s = mpeg.read_stream(with_table(36, b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 21 * size, 20, 4, 1, 2, 5) + bytes(range(8))))
    assert (s.vbr_frames, s.vbr_bytes, s.toc, s.counts_match) == (20, 21 * size, bytes(range(8)), True) and len(s.offsets) == 20
    assert mpeg.read_stream(with_table(36, b"Xing" + struct.pack(">II", 1, 25))).counts_match is False
    assert mpeg.read_stream(audio).counts_match is None
    mixed = audio + b"".join(frame_bytes(bytes.fromhex("fffb9464"), rng) for _ in range(20))
    assert mpeg.read_stream(mixed).duration_us == int((Fraction(20 * 1152, 44100) + Fraction(20 * 1152, 48000)) * 1_000_000)


def test_audio_query(spark, edge, tmp_path):
    import zlib

    edge.write.parquet(str(tmp_path / "documents.parquet"))
    by = defaultdict(set)
    for r in queries.op7_mpeg_audio(spark, str(tmp_path)).collect():
        by[r.doc_id].add((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32))
    for r in edge.collect():
        raw = (r.text or "").encode()
        full = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert by[r.doc_id] == {(len(raw), len(full), sha(full), zlib.crc32(full[-64:]))}


# 8: near duplicates


def shingles(text):
    ws = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in words_of(text)]
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def brute_components(data):
    sets = [(i, shingles(t)) for i, t in data if i is not None]
    link = defaultdict(set)
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                link[a].add(b)
                link[b].add(a)
    least = {}
    for a in range(len(sets)):
        seen, queue = {a}, [a]
        while queue:
            for b in link[queue.pop()] - seen:
                seen.add(b)
                queue.append(b)
        least.setdefault((sets[a][0], frozenset(sets[a][1])), set()).add(min(sets[b][0] for b in seen))
    return least


def near_data(groups=25, size=8, seed=1, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    data = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(6, words))]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            data.append((rng.randrange(10**6), " ".join(w)))
    return data


def check_near(spark, data, **params):
    got = neardup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), **params).collect()
    want = brute_components(data)
    texts = defaultdict(set)
    for i, t in data:
        texts[i].add(frozenset(shingles(t)))
    seen = defaultdict(set)
    for r in got:
        if r.doc_id is not None:
            seen[r.doc_id].add((r.n_shingles, r.component_id, r.kept))
    for i, sets in texts.items():
        if i is not None:
            assert seen[i] == {(len(s), c, c == i) for s in sets for c in want[(i, s)]}
    assert len(got) == len(data)


def test_near_equals_brute_force(spark):
    check_near(spark, near_data())


def test_near_split_groups(spark, monkeypatch):
    """Groups over a task's bound are split into blocks, regions into pieces; the result is the same."""
    monkeypatch.setattr(neardup, "REGION_ROWS", 5)
    check_near(spark, near_data(groups=3, size=60, seed=2, words=40), group_shingles=300, envoys=2)


def test_near_dense_regions_are_cut_deeper(spark, monkeypatch):
    """Texts that share most of their words but aren't near: their regions are large and mixed, and are cut until they are small."""
    monkeypatch.setattr(neardup, "REGION_ROWS", 12)
    rng = random.Random(21)
    vocabulary = [f"w{i}" for i in range(5000)]
    common = [rng.choice(vocabulary) for _ in range(60)]
    data = []
    for i in range(240):
        own = [rng.choice(vocabulary) for _ in range(40)]
        data.append((i, " ".join(common + own)))
        if i % 4 == 0:  # one near copy: a word of its own part changes
            own[rng.randrange(5, 35)] = "changed"
            data.append((1000 + i, " ".join(common + own)))
    sizes = []
    cut = neardup._cut_deeper
    monkeypatch.setattr(neardup, "_cut_deeper", lambda *a: sizes.append(cut(*a)) or sizes[-1])
    check_near(spark, data)
    assert sizes and all(n <= 12 for n, in sizes[0].groupBy("h1", "h2").count().select("count").collect())


def test_near_many_components(spark, monkeypatch):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 300), (5, 5)], "a long, b long")
    want = {i: 0 for i in range(61)} | {100: 100, 200: 100, 300: 100}
    for one_task in (0, 10**6):
        assert dict(rows_of(components.components(edges, one_task=one_task))) == want


def test_near_edges(edge, none):
    got = neardup.near_duplicates(edge).collect()
    assert len(got) == edge.count()
    by = {r.doc_id: r for r in got}
    assert by[4].component_id == by[5].component_id == 4 and not by[5].kept
    assert by[1].n_shingles == 0 and by[1].component_id == 1 and by[3].kept
    assert by[None].component_id is None and by[None].kept
    assert neardup.near_duplicates(none).count() == 0
    kept = neardup.drop_near_duplicates(edge)
    assert kept.columns == edge.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, 3, None, 4, 6, 7, 8]))


# 9: lines


def brute_lines(data):
    key = lambda x: x.strip(SPACE).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    first = {}
    for i, t in data:
        for x in (t or "").split("\n"):
            if i is not None:
                first[key(x)] = min(first.get(key(x), i), i)
    out = Counter()
    for i, t in data:
        ls = (t or "").split("\n")
        keep = [x for x in ls if i is None or len(key(x)) < 10 or first[key(x)] == i]
        out[(i, len(ls), len(ls) - len(keep), "\n".join(keep))] += 1
    return out


def test_lines_equal_brute_force(spark, edge, none):
    rng = random.Random(6)
    pool = ["a line that is shared", "A line that is SHARED ", "short", "", "another of the lines\t", "ünïcode line ÄÖ", "tenletters", "nineletrs"]
    data = [(rng.choice([None, *range(40)]), "\n".join(rng.choice(pool + [f"own line number {n}"]) for _ in range(rng.randint(0, 9)))) for n in range(120)]
    for rows in (data, [(r.doc_id, r.text) for r in edge.collect()]):
        got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
        assert Counter(rows_of(got.select("doc_id", "n_lines", "n_dropped", "text"))) == brute_lines(rows)
    assert lines.dedup_lines(none).count() == 0
    carried = lines.dedup_lines(edge, carry=["lang", "n", "text"]).select("carried.lang", "carried.n").collect()
    assert len(carried) == edge.count() and {r.n for r in carried} == {"x"}


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_lines_in_both_sql_modes(spark, edge, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        got = lines.dedup_lines(edge).select("doc_id", "n_lines", "n_dropped", "text").collect()
        assert Counter(map(tuple, got)) == brute_lines([(r.doc_id, r.text) for r in edge.collect()])
        mixed = mixing.with_copies(edge).collect()
        assert all(r.n_copies in (0, 1, 2) for r in mixed) and len(mixed) == edge.count()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_lines_are_native(edge):
    plan = lines.dedup_lines(edge)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow(?!Eval)", plan)


def test_hot_keys_are_joined_apart(spark):
    from quiremill.llm.common import attach_by_hash

    rows = spark.range(6000).select(F.when(F.col("id") < 4000, 1).otherwise(F.col("id")).alias("h1"), F.lit(2).alias("h2"), "id")
    table = rows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("id").alias("v")).filter("h1 % 2 = 1")
    got = attach_by_hash(rows, table, F.xxhash64("id"), "v", "n", hot_keys=10)
    assert got.count() == 6000 and got.filter("h1 = 1 AND v = 0").count() == 4000 and got.filter("h1 % 2 = 0 AND v IS NULL").count() == 1000


# 10: mixing


def test_mixing_targets(spark):
    rng = random.Random(7)
    sources = ["b", "a", None, "Z", "é", "empty"]
    data = [(i, " ".join(["w"] * (0 if s == "empty" else rng.randint(1, 40))), s) for i, s in ((i, rng.choice(sources)) for i in range(3000))]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    size = Counter()
    for _, t, s in data:
        size[s] += len(words_of(t))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, left, budget = {}, set(order), 1.5 * sum(size.values())
    while True:
        share = {s: budget * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > 2 * size[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * size[s]
            budget -= target[s]
        left -= over
    target |= share
    got = mixing.with_copies(docs).withColumn("size", mixing.word_count(F.col("text")))
    taken = Counter()
    for r in got.collect():
        assert r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, target[r.source]) and 0 <= r.n_copies <= 2
        taken[r.source] += r.size * r.n_copies
    assert all(abs(taken[s] - target[s]) <= 0.12 * target[s] + 1 for s in order)
    assert sorted(rows_of(got.select("doc_id", "n_copies"))) == sorted(rows_of(mixing.with_copies(docs.repartition(7)).select("doc_id", "n_copies")))
    assert mixing.mix(docs).count() == got.agg(F.sum("n_copies")).first()[0] and mixing.mix(docs).columns == docs.columns


def test_mixing_many_sources(spark, monkeypatch):
    """Targets of thousands of sources against plain water-filling; the shuffle join of many sources gives the broadcast's rows."""
    rng = random.Random(17)
    size = {f"host{i}": rng.choice([0, 1, 1, 2, 5, 40, 300]) for i in range(3000)} | {"big": 40_000}
    docs = spark.createDataFrame([(i, "w " * n, s) for i, (s, n) in enumerate(size.items())], "doc_id long, text string, source string")
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(size))}
    low, high, budget = 0.0, 1e6, min(1.5 * sum(size.values()), 2.0 * sum(size.values()))
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(2 * size[s], level * weight[s]) for s in size) < budget else (low, level)
    few = mixing.with_copies(docs)
    for r in few.collect():
        assert abs(r.target - min(2 * size[r.source], level * weight[r.source])) < 1e-5
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 10)
    many = mixing.with_copies(docs)
    assert many.columns == few.columns and Counter(rows_of(many)) == Counter(rows_of(few))


def test_mixing_edges(edge, none):
    got = mixing.with_copies(edge)
    assert got.count() == edge.count() and got.columns.count("rate") == 1
    assert mixing.mix(none).count() == 0 and mixing.mix(edge).columns == edge.columns
    assert {r.rate for r in mixing.mix(edge).collect()} == {"q"}  # a column of that name in docs stays
    assert mixing.mix(edge.withColumn("text", F.lit(None).cast("string"))).count() == 0


# The pipeline


def test_pipeline_stages(spark, edge, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    near = near_data(groups=10, size=3, seed=4)
    data = [(i, t, rng.choice(["en", "de"]), rng.choice("ab"), len(t)) for i, t in near] + [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in edge.collect()]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now, seen = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == corpus_pipeline.COLUMNS
        seen.append([tuple(r) for r in now.collect()])
    by_language, by_lines, by_near, mixed = seen
    # Each stage against brute force on what the one before kept.
    profiles = langid.fit(docs.filter(langid.learners()))
    assert Counter(by_language) == Counter(r for r in data if profiles.predict(r[1])[0] != "und" and profiles.predict(r[1])[1] >= langid.KEEP_SCORE)
    assert Counter((i, t) for i, t, *_ in by_lines) == Counter({(i, t): n for (i, _, lost, t), n in brute_lines([r[:2] for r in by_language]).items() if not lost or t.strip(" \t\n\v\f\r")}) and all(r[4] == len(r[1]) for r in by_lines)
    least = brute_components([r[:2] for r in by_lines])
    assert set(by_near) == {r for r in by_lines if r[0] is None or r[0] in least[(r[0], frozenset(shingles(r[1])))]}
    rates = {r.source: r.rate for r in mixing.source_rates(spark.createDataFrame(by_near, docs.schema)).collect()}
    draw = lambda i: int(hashlib.md5(f"{mixing.SEED}|{'' if i is None else i}".encode()).hexdigest()[:13], 16) / 16**13
    assert Counter(mixed) == Counter({r: int(rates[r[3]]) + (draw(r[0]) < rates[r[3]] % 1) for r in by_near})
    last = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
    want = Counter(rows_of(last.select("doc_id", "n_tokens", "ids_sha256")))
    assert Counter(rows_of(corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256"))) == want and want
    # Clean documents pass the first stage; those without letters don't.
    first = {r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()}
    assert first >= {i for i, _ in near} and not first & {1, 2, 3}
    assert corpus_pipeline.near_dedup(spark, docs, "").count() < docs.count()
