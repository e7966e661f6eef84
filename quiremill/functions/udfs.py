"""Vectorised functions for what the JVM has no built-in: NFC, edit distance with transpositions, sequence diff."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHANGES = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), T.StructField("old", T.StringType()), T.StructField("new", T.StringType()), T.StructField("at", T.LongType())]))


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or unicodedata.is_normalized("NFC", x) else unicodedata.normalize("NFC", x))


def osa_distance(a: str, b: str) -> int:
    """Edits and swaps of neighbours, none within another."""
    prior2: list[int] = []
    prior = list(range(len(b) + 1))
    for i in range(1, len(a) + 1):
        row = [i]
        for j in range(1, len(b) + 1):
            cost = min(prior[j] + 1, row[j - 1] + 1, prior[j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                cost = min(cost, prior2[j - 2] + 1)
            row.append(cost)
        prior2, prior = prior, row
    return prior[-1]


@F.pandas_udf(T.LongType())
def osa(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else osa_distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int64")


def _changes(a: str | None, b: str | None) -> list[dict]:
    old, new = (a or "").split(), (b or "").split()
    ops = [] if old == new else difflib.SequenceMatcher(None, old, new, autojunk=False).get_opcodes()
    return [{"op": op, "old": " ".join(old[i:j]), "new": " ".join(new[k:m]), "at": i} for op, i, j, k, m in ops if op != "equal"]


@F.pandas_udf(CHANGES)
def word_changes(a: pd.Series, b: pd.Series) -> pd.Series:
    """Changed word runs between two texts, in order."""
    return pd.Series([_changes(x, y) for x, y in zip(a, b, strict=True)])


def change_rows(pairs: DataFrame) -> DataFrame:
    """doc_id, op, old, new, at: the changed word runs of pairs (doc_id, old text, new text), a row each."""

    def run(frames):
        for pdf in frames:
            rows = [(d, c["op"], c["old"], c["new"], c["at"]) for d, x, y in pdf.itertuples(index=False) for c in _changes(x, y)]
            yield pd.DataFrame(rows, columns=["doc_id", "op", "old", "new", "at"])

    return pairs.mapInPandas(run, "doc_id long, op string, old string, new string, at long")
