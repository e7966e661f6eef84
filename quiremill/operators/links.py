"""Note links, contents matching and repairs: the order-dependent parts, one group per document."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def link_lifo(marks: DataFrame, least: int = 10, share: float = 0.8) -> DataFrame:
    """doc_id, pos, ref_pos: each note takes the nearest open reference of its number before it.

    marks: doc_id, pos, no, kind ('ref' or 'note'). A document with fewer than `least` notes, or under `share` of them matched,
    links none. A group is one document's marks.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        open_: dict[int, list[int]] = {}
        out = []
        notes = 0
        for pos, no, kind in pdf.sort_values(["pos", "kind"])[["pos", "no", "kind"]].itertuples(index=False):
            if kind == "ref":
                open_.setdefault(no, []).append(pos)
            else:
                notes += 1
                if open_.get(no):
                    out.append((pdf["doc_id"].iloc[0], pos, open_[no].pop()))
        if notes < least or len(out) < share * notes:
            out = []
        return pd.DataFrame(out, columns=["doc_id", "pos", "ref_pos"])

    return marks.select("doc_id", "pos", "no", "kind").groupBy("doc_id").applyInPandas(run, "doc_id long, pos long, ref_pos long")


def title_score(a: str, b: str) -> int:
    """3 equal, 2 a prefix by words or contained, 1 similar by 82 percent, else 0; case and punctuation aside."""
    x, y = ("".join(c if c.isalnum() else " " for c in s.lower()).split() for s in (a, b))
    if not x or not y:
        return 0
    if x == y:
        return 3
    n = min(len(x), len(y))
    if x[:n] == y[:n] or f" {' '.join(x)} " in f" {' '.join(y)} ":
        return 2
    return int(difflib.SequenceMatcher(None, " ".join(x), " ".join(y), autojunk=False).ratio() >= 0.82)


def match_contents(entries: DataFrame, headings: DataFrame, found_share: float = 0.4) -> DataFrame:
    """doc_id, seq, pos, score: contents entries matched, in order, to headings after the one before.

    entries: doc_id, seq, title; headings: doc_id, pos, title. Under three entries, or fewer found than the share, nothing is matched.
    """

    def run(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) >= 3 and len(b):
            b = b.sort_values("pos")
            rows, at = list(zip(b["pos"], b["title"], strict=True)), 0
            for seq, title in a.sort_values("seq")[["seq", "title"]].itertuples(index=False):
                best = max(((title_score(title, t), -i) for i, (_, t) in enumerate(rows[at:], at)), default=(0, 0))
                if best[0] > 0:
                    out.append((key[0], seq, rows[-best[1]][0], best[0]))
                    at = -best[1] + 1
            if len(out) < max(2, found_share * len(a)):
                out = []
        return pd.DataFrame(out, columns=["doc_id", "seq", "pos", "score"])

    return entries.groupBy("doc_id").cogroup(headings.groupBy("doc_id")).applyInPandas(run, "doc_id long, seq long, pos long, score long")


def cluster_headers(edges: DataFrame, alike: float = 0.75, least: int = 5, share: float = 0.1) -> DataFrame:
    """doc_id, leader, n: edge lines gathered greedily under the first line they resemble; frequent clusters only.

    edges: doc_id, page_no, line. Equal lines are one row with a count before they are compared, so a group is a document's distinct lines.
    """
    counted = edges.groupBy("doc_id", "line").agg(F.min("page_no").alias("page_no"), F.count("*").alias("n"))
    total = edges.groupBy("doc_id").agg(F.countDistinct("page_no").alias("pages"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        leaders: list[list] = []
        pages = int(pdf["pages"].iloc[0])
        for line, n in pdf.sort_values(["page_no", "line"])[["line", "n"]].itertuples(index=False):
            for x in leaders:
                m = difflib.SequenceMatcher(None, x[0], line, autojunk=False)
                if m.real_quick_ratio() >= alike and m.quick_ratio() >= alike and m.ratio() >= alike:
                    x[1] += n
                    break
            else:
                leaders.append([line, n])
        keep = [x for x in leaders if pages >= 5 and x[1] >= max(least, share * pages)]
        return pd.DataFrame([(pdf["doc_id"].iloc[0], *x) for x in keep], columns=["doc_id", "leader", "n"])

    return counted.join(total, "doc_id").groupBy("doc_id").applyInPandas(run, "doc_id long, leader string, n long")


def repair_words(words: DataFrame, lexicon: DataFrame, swaps: list[tuple[str, str]]) -> DataFrame:
    """word, fix, n: for words outside the lexicon, the candidate by one swap of letters that is in it; the most frequent, if it
    is alone or three times as frequent as the next. Each distinct word is worked on once."""
    bad = words.select("word").distinct().join(lexicon.select("word"), "word", "left_anti")
    made = F.array_distinct(F.array(*(F.replace("word", F.lit(a), F.lit(b)) for a, b in swaps)))
    cand = bad.withColumn("fix", F.explode(made)).filter("fix <> word").join(lexicon.select(F.col("word").alias("fix"), "n"), "fix")
    best = cand.groupBy("word").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "fix"))).alias("c"))
    first, second = F.col("c")[0], F.get("c", F.lit(1))
    return best.filter(second.isNull() | (first["k"] <= 3 * second["k"])).select("word", first["fix"].alias("fix"), (-first["k"]).alias("n"))


# Pairs of letters that recognition confuses (read, meant), in the order in which they are tried; vowels among them;
# words of two letters that are repaired all the same.
CONFUSED = (
    ("nn", "rı"), ("nn", "rın"), ("nn", "ın"), ("m", "ın"), ("rn", "m"), ("ii", "ü"), ("vc", "ve"), ("hir", "bir"),
    ("hi", "bi"), ("ih", "ib"), ("h", "lı"), ("h", "li"), ("h", "l"), ("h", "b"), ("c", "e"), ("i", "ı"), ("ı", "i"), ("s", "ş"), ("c", "ç"),
    ("g", "ğ"), ("u", "ü"), ("o", "ö"), ("l", "ı"), ("t", "i"), ("ü", "u"), ("ö", "o"),
)
SHORT_CONFUSED = ("vc", "cn", "kı")


def repair_in_document(words: DataFrame, lexicon: DataFrame, pairs=CONFUSED, short=SHORT_CONFUSED, least: int = 2, ratio: int = 3) -> DataFrame:
    """doc_id, word, fix, n: words (doc_id, word, n) outside the lexicon, each with the word that one confused pair, at one place, makes of it.

    The fix is a word of the lexicon that the same document uses `least` times; the only one, or one `ratio` times as frequent there as the next.
    Words under three letters (but `short`) and Roman numerals are left alone. Joins are on (document, word): a document's vocabulary never
    meets as a whole in one task.
    """
    known = lexicon.select("word")
    # What a word may be depends on the word alone: each distinct one is worked on once, and few candidates are words.
    bad = words.select("word").distinct().join(known, "word", "left_anti").filter((F.length("word") >= 3) | F.col("word").isin(*short))
    bad = bad.filter(~F.col("word").rlike("^[ivxlcdmı]+$") | F.col("word").isin(*short))
    table = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs))
    place = F.sequence(F.lit(1), F.length("word"))
    made = bad.select("word", F.explode(F.filter(table, lambda p: F.contains("word", p["a"]))).alias("p")).withColumn("i", F.explode(place))
    made = made.filter(F.substr("word", F.col("i"), F.length("p.a")) == F.col("p.a"))
    fix = F.concat(F.substr("word", F.lit(1), F.col("i") - 1), F.col("p.b"), F.substr("word", F.col("i") + F.length("p.a")))
    made = made.select("word", fix.alias("fix")).filter("fix <> word").distinct().join(known.select(F.col("word").alias("fix")), "fix", "left_semi")
    made = words.select("doc_id", "word").join(made, "word")
    used = words.filter(F.col("n") >= least).select("doc_id", F.col("word").alias("fix"), "n")
    best = made.join(used, ["doc_id", "fix"]).groupBy("doc_id", "word").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "fix"))).alias("c"))
    first, second = F.col("c")[0], F.get("c", F.lit(1))
    return best.filter(second.isNull() | (-first["k"] >= ratio * -second["k"])).select("doc_id", "word", first["fix"].alias("fix"), (-first["k"]).alias("n"))


def divided_words(lines: DataFrame, lexicon: DataFrame) -> DataFrame:
    """doc_id, line_no, left, right, verdict: words that a hyphen divides at the end of a line, and whether its halves belong together.

    lines: doc_id, line_no, line. 'join' where the whole is a word, or where the halves are not both words; 'keep' (the hyphen) where both are and
    the whole is none. Each distinct pair is looked up once.
    """
    after = F.lead("line").over(Window.partitionBy("doc_id").orderBy("line_no"))
    cut = lines.withColumn("_next", after).filter(F.col("line").rlike(r"\p{L}{2,}[-‐]\s*$") & F.col("_next").rlike(r"^\s*\p{Ll}{2,}"))
    cut = cut.select("doc_id", "line_no", F.lower(F.regexp_extract("line", r"(\p{L}{2,})[-‐]\s*$", 1)).alias("left"), F.regexp_extract("_next", r"^\s*(\p{Ll}{2,})", 1).alias("right"))
    pairs = cut.select("left", "right").distinct().withColumn("whole", F.concat("left", "right"))
    for c in ("left", "right", "whole"):
        pairs = pairs.join(lexicon.select(F.col("word").alias(c), F.lit(True).alias(f"{c}_ok")), c, "left")
    keep = F.col("left_ok").isNotNull() & F.col("right_ok").isNotNull() & F.col("whole_ok").isNull()
    return cut.join(pairs.select("left", "right", F.when(keep, "keep").otherwise("join").alias("verdict")), ["left", "right"]).select("doc_id", "line_no", "left", "right", "verdict")


def link_equi(refs: DataFrame, notes: DataFrame, keys: list[str], at: list[str]) -> DataFrame:
    """notes with `ref`: the first reference (a struct of `at`, least first) of their number on their page; notes without one are left out."""
    first = refs.groupBy(*keys).agg(F.min(F.struct(*at)).alias("ref"))
    return notes.join(first, keys)


def sides(pairs: DataFrame, a: str, b: str, several: int = 2) -> DataFrame:
    """Distinct pairs with the partners each side has, `swapped` where only a has several, and the pair set right as `one` and `many`.

    One side of a pair (a title) goes with one of the other (its author), who has several: where the sides are the wrong way
    round, a has the partners.
    """
    p = pairs.select(a, b).distinct()
    j = p.join(p.groupBy(a).agg(F.count("*").alias("n_a")), a).join(p.groupBy(b).agg(F.count("*").alias("n_b")), b)
    j = j.withColumn("swapped", (F.col("n_a") >= several) & (F.col("n_b") < several))
    return j.withColumn("one", F.when(F.col("swapped"), F.col(b)).otherwise(F.col(a))).withColumn("many", F.when(F.col("swapped"), F.col(a)).otherwise(F.col(b)))


def repair_by_skeleton(words: DataFrame, lexicon: DataFrame, skeleton) -> DataFrame:
    """word, fix, n: for words outside the lexicon, the most frequent word of it with the same skeleton (letters without their marks)."""
    bad = words.select("word").distinct().join(lexicon.select("word"), "word", "left_anti").withColumn("skeleton", skeleton(F.col("word")))
    best = lexicon.groupBy(skeleton(F.col("word")).alias("skeleton")).agg(F.min(F.struct((-F.col("n")).alias("k"), F.col("word").alias("fix"))).alias("b"))
    return bad.join(best, "skeleton").select("word", F.col("b.fix").alias("fix"), (-F.col("b.k")).alias("n"))


def merge_split_words(lines: DataFrame, lexicon: DataFrame, most: int = 3) -> DataFrame:
    """doc_id, line_no, pos, parts, joined: two to `most` neighbours that are one word together while one of them at least is none.

    Where the first two parts are a word already, three are not tried. Tokens meet the lexicon by equality; a line's tokens are one window.
    """
    toks = lines.select("doc_id", "line_no", F.posexplode(F.regexp_extract_all(F.lower("line"), F.lit(r"(\p{L}+)"), 1)).alias("pos", "word"))
    lex = lexicon.select("word")
    known = lambda name: lex.select(F.col("word").alias(name), F.lit(True).alias(f"{name}_ok"))
    toks = toks.join(known("word"), "word", "left").withColumn("ok", F.coalesce("word_ok", F.lit(False)))
    ahead = F.collect_list(F.struct("word", "ok")).over(Window.partitionBy("doc_id", "line_no").orderBy("pos").rowsBetween(0, most - 1))
    sizes = F.filter(F.sequence(F.lit(2), F.lit(most)), lambda n: n <= F.size("ahead"))
    tried = toks.select("doc_id", "line_no", "pos", ahead.alias("ahead")).withColumn("parts", F.explode(sizes))
    tried = tried.withColumn("some", F.slice("ahead", F.lit(1), F.col("parts"))).filter(F.exists("some", lambda x: ~x["ok"]))
    tried = tried.select("doc_id", "line_no", F.col("pos").cast("long").alias("pos"), F.col("parts").cast("long").alias("parts"), F.array_join(F.transform("some", lambda x: x["word"]), "").alias("joined"))
    found = tried.join(lex.withColumnRenamed("word", "joined"), "joined", "left_semi")
    best = found.groupBy("doc_id", "line_no", "pos").agg(F.min(F.struct("parts", "joined")).alias("b"))
    return best.select("doc_id", "line_no", "pos", "b.parts", "b.joined")


def join_spaced(lines: DataFrame, lexicon: DataFrame, least: int = 4) -> DataFrame:
    """doc_id, line_no, run, joined: `least` or more single letters with spaces between ("k i t a p") that are a word of the lexicon together."""
    run = F.regexp_extract_all("line", F.lit(rf"(?:^|[^\p{{L}}\p{{N}}])((?:\p{{L}} ){{{least - 1},}}\p{{L}})(?:[^\p{{L}}\p{{N}}]|$)"), 1)
    found = lines.select("doc_id", "line_no", F.explode(run).alias("run")).withColumn("joined", F.lower(F.replace("run", F.lit(" "), F.lit(""))))
    return found.join(lexicon.select(F.col("word").alias("joined")), "joined", "left_semi").select("doc_id", "line_no", "run", "joined")


def segment_words(s: str, known: set[str], longest: int = 20) -> list[str] | None:
    """The fewest known words that make up s, or None."""
    best: list[list[str] | None] = [[]] + [None] * len(s)
    for i in range(1, len(s) + 1):
        for j in range(max(0, i - longest), i):
            if best[j] is not None and s[j:i] in known and (best[i] is None or len(best[j]) + 1 < len(best[i])):
                best[i] = [*best[j], s[j:i]]
    return best[-1]


def heading_levels(headings: DataFrame) -> DataFrame:
    """doc_id, pos, depth: nesting from marker ranks by a stack (a smaller rank closes larger ones)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        stack: list[int] = []
        out = []
        for pos, rank in pdf.sort_values("pos")[["pos", "rank"]].itertuples(index=False):
            while stack and stack[-1] >= rank:
                stack.pop()
            stack.append(rank)
            out.append((pdf["doc_id"].iloc[0], pos, len(stack)))
        return pd.DataFrame(out, columns=["doc_id", "pos", "depth"])

    return headings.groupBy("doc_id").applyInPandas(run, "doc_id long, pos long, depth long")
