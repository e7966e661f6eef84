"""Language identification by rank-order profiles of character n-grams.

A profile is a list of the most frequent n-grams (n = 1 to 3, over lower-cased letters with a
boundary mark between words), most frequent first. A text goes to the language whose profile lies at the
least out-of-place distance from the text's own.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiremill.llm.common import release_memory

GRAMS = (1, 2, 3)
PROFILE = 400
#: Labelled rows of a language that its profile is fitted on, at most: picked by a hash of the id.
FIT_ROWS = 2000
#: Languages that are learned, at most: those of most labelled rows, ties by name. (ISO 639-1 names 184.)
LANGUAGES = 200
UNKNOWN = "und"
#: Least score of a text the corpus filter keeps: its distance to the best profile lies that far below the largest possible.
KEEP_SCORE = 0.2


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter or a mark on one."""
    import unicodedata

    out = np.zeros(0x110000, bool)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] in "LM":
            out[c] = True
    return out


@lru_cache(maxsize=1)
def _only_letters() -> np.ndarray:
    import unicodedata

    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)


def text_grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams as 64-bit numbers (three code points of 21 bits) and their counts; boundary = 0."""
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    if not len(code) or not _only_letters()[code].any():
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    mark = np.where(_letters()[code], code, 0).astype(np.uint64)
    mark = np.concatenate([[np.uint64(0)], mark, [np.uint64(0)]])
    keep = np.ones(len(mark), bool)
    keep[1:] = (mark[1:] != 0) | (mark[:-1] != 0)
    mark = mark[keep]
    s = np.uint64(21)
    two = mark[:-1] << s | mark[1:]
    three = two[:-1] << s | mark[2:]
    one = mark[mark != 0] | np.uint64(1 << 63)
    two = two[(mark[:-1] != 0) | (mark[1:] != 0)] | np.uint64(1 << 42)
    three = three[mark[1:-1] != 0]
    return np.unique(np.concatenate([one, two, three]), return_counts=True)


def top_grams(grams: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The `size` most frequent, most frequent first, ties by number."""
    if len(grams) > 4 * size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        few = counts >= least
        grams, counts = grams[few], counts[few]
    return grams[np.lexsort((grams, -counts))][:size]


@dataclass
class Profiles:
    languages: list[str]
    grams: np.ndarray  # all profiles' n-grams, sorted
    ranks: np.ndarray  # languages x grams, PROFILE where a language lacks it

    @classmethod
    def of(cls, ranked: dict[str, np.ndarray]) -> Profiles:
        languages = sorted(ranked)
        grams = np.unique(np.concatenate([ranked[x] for x in languages])) if languages else np.empty(0, np.uint64)
        ranks = np.full((len(languages), len(grams)), PROFILE, np.int16)
        for i, x in enumerate(languages):
            ranks[i, np.searchsorted(grams, ranked[x])] = np.arange(len(ranked[x]))
        return cls(languages, grams, ranks)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and 1 - distance / largest distance. Ties go to the language first in order."""
        top = top_grams(*text_grams(text))
        if not len(top) or not self.languages:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.grams, top)
        at[at == len(self.grams)] = 0
        known = self.grams[at] == top
        place = np.arange(len(top), dtype=np.int32)
        distance = np.abs(self.ranks[:, at[known]].astype(np.int32) - place[known]).clip(max=PROFILE).sum(1) + PROFILE * int((~known).sum())
        best = int(distance.argmin())
        return self.languages[best], float(1 - distance[best] / (PROFILE * len(top)))


def _count(batches):
    """n-gram counts of each language in a partition."""
    held: dict[str, list] = {}
    total = 0

    def merged():
        for lang, parts in held.items():
            grams, back = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            yield lang, grams, np.bincount(back, np.concatenate([c for _, c in parts])).astype(np.int64)

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            g, c = text_grams(text)
            held.setdefault(lang, []).append((g, c))
            total += len(g)
        if total > 3_000_000:
            held = {lang: [(g, c)] for lang, g, c in merged()}
            total = sum(len(p[0][0]) for p in held.values())
    for lang, g, c in merged():
        for at in range(0, len(g), 50_000):
            n = len(g[at : at + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * n), pa.array(g[at : at + 50_000].view(np.int64)), pa.array(c[at : at + 50_000])], names=["lang", "gram", "n"])


def fit(rows: DataFrame, fit_rows: int = FIT_ROWS, languages: int = LANGUAGES) -> Profiles:
    """Profiles of the languages of rows (doc_id, text, lang), null languages left out.

    About fit_rows rows of a language are read, all if there are fewer: those with the least hash of their id. Of more than `languages`
    values of lang those of most rows are learned, so a column of dirty values stays bounded: PROFILE n-grams for each reach the driver.
    """
    named = rows.filter("lang IS NOT NULL").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    sizes = named.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    place = (F.xxhash64(F.col("doc_id").cast("string")).cast("double") / 2.0**64) + 0.5
    picked = named.join(F.broadcast(sizes), "lang").filter(place * F.col("n") <= fit_rows)
    counted = picked.select("lang", "text").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    ranked: dict[str, list[int]] = {}
    for r in counted.withColumn("r", rank).filter(F.col("r") <= PROFILE).orderBy("lang", "r").collect():
        ranked.setdefault(r["lang"], []).append(r["gram"])
    return Profiles.of({k: np.array(v, np.int64).view(np.uint64) for k, v in ranked.items()})


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """docs with lang_pred and score, from the text alone.

    No text or no letter: `und` with score 0. Columns of those names are replaced, others kept; each
    row, whatever its id, gives one row; the whole of a long text counts.
    """
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(profiles)  # bounded: PROFILE n-grams for each of LANGUAGES

    def run(batches):
        known = shared.value
        for batch in batches:
            got = [known.predict(t.as_py()) for t in batch.column(batch.schema.get_field_index("text"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])
            release_memory()

    from pyspark.sql import types as T

    out = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(run, out)


def learners() -> Column:
    """Rows that a language may be learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2, F.lit(False))


def keep_identified(docs: DataFrame, min_score: float = KEEP_SCORE) -> DataFrame:
    """docs without the rows that have no language: null texts, texts without letters, and those scored under min_score.

    Profiles are learned from docs' own rows with a lang (learners() only). Where none has one, every row goes: nothing is like any profile.
    Each row is judged by its own text, whatever its id; every column stays as it was. Empty input: empty result.
    """
    packed = docs.select("text", F.struct(*[c for c in docs.columns if c != "text"]).alias("_row"))
    found = identify(packed, fit(docs.filter(learners())))
    kept = found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score))
    return kept.select(*("text" if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns))
