"""Token counts by greedy longest match in linear time.

The vocabulary is a trie with failure links. When the trie has no edge for the next character,
the failure link gives the state that is left after popping the longest pieces from the
front, and a precomputed number says how many pieces that pops: so counting never goes back
over a character and never builds a piece. Words are counted once per batch and looked up after.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "##"
#: Distinct words remembered by a task between batches.
MEMO_WORDS = 200_000
#: Longer words are counted each time.
MEMO_BYTES = 100


class LongestMatch:
    """Counts the pieces of words: first pieces as they are, later ones marked with `mark`.

    A word that the pieces can't cover is one unknown token. So is one of over `max_chars`
    characters, unless that is None. An empty word has no piece.
    """

    def __init__(self, vocabulary: Iterable[str], mark: str = MARK, max_chars: int | None = 100):
        self.max_chars = max_chars
        #: State 0: nothing read. State 1: within a word, at the start of a later piece.
        self.edges: list[dict[str, int]] = [{}, {}]
        self.is_piece = [False, False]
        for piece in dict.fromkeys(vocabulary):
            later = piece.startswith(mark) and len(piece) > len(mark)
            state = 1 if later else 0
            for c in piece[len(mark) :] if later else piece:
                nxt = self.edges[state].get(c)
                if nxt is None:
                    nxt = self.edges[state][c] = len(self.edges)
                    self.edges.append({})
                    self.is_piece.append(False)
                state = nxt
            self.is_piece[state] |= state > 1
        self._link()

    def _link(self) -> None:
        """fail[s]: the state after popping the front pieces of s's string; pops[s]: how many. None: no way on."""
        n = len(self.edges)
        self.fail: list[int | None] = [None] * n
        self.pops = [0] * n
        queue = deque([0, 1])
        while queue:
            s = queue.popleft()
            for c, child in self.edges[s].items():
                if self.is_piece[child]:
                    self.fail[child], self.pops[child] = 1, 1
                else:
                    at, popped = self.fail[s], self.pops[s]
                    while at is not None and c not in self.edges[at]:
                        popped += self.pops[at]
                        at = self.fail[at]
                    if at is not None:
                        self.fail[child], self.pops[child] = self.edges[at][c], popped
                queue.append(child)

    def count(self, word: str) -> int:
        if not word:
            return 0
        if self.max_chars is not None and len(word) > self.max_chars:
            return 1
        edges, fail, pops = self.edges, self.fail, self.pops
        state, found = 0, 0
        for c in word:
            while c not in edges[state]:
                if fail[state] is None:
                    return 1
                found += pops[state]
                state = fail[state]
            state = edges[state][c]
        while state != 1:
            if fail[state] is None:
                return 1
            found += pops[state]
            state = fail[state]
        return found


@lru_cache(maxsize=2)
def word_piece_vocabulary(path: str, kind: str = "word_bpe") -> tuple[str, ...]:
    """Pieces of a BPE file as a longest-match vocabulary: each piece may start a word or go on."""
    import json

    with open(path, encoding="utf-8") as f:
        pieces = json.load(f)["model"]["vocab"]
    plain = sorted({p.removesuffix("</w>") for p in pieces} - {""})
    return tuple(plain) + tuple(MARK + p for p in plain)


@lru_cache(maxsize=2)
def _matcher(path: str) -> LongestMatch:
    return LongestMatch(word_piece_vocabulary(path), max_chars=None)


def _counts(batches, path: str):
    matcher = _matcher(path)
    memo: dict[bytes, int] = {}
    byte_level = _byte_level()
    for batch in batches:
        n_words, n_tokens = [], []
        for text in batch.column(1).cast(pa.large_binary()):
            words = (text.as_py() or b"").lower().split()
            total = 0
            for w in words:
                got = memo.get(w)
                if got is None:
                    got = matcher.count(w.decode("latin-1").translate(byte_level))
                    if len(w) <= MEMO_BYTES:
                        if len(memo) >= MEMO_WORDS:
                            memo.clear()
                        memo[w] = got
                total += got
            n_words.append(len(words))
            n_tokens.append(total)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])


def _byte_level() -> dict[int, int]:
    """Byte to printable character, as byte-level vocabularies write bytes: printable ones stay, the rest follow U+0100."""
    stay = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(stay)]
    return {b: b for b in stay} | {b: 256 + i for i, b in enumerate(rest)}


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words, n_tokens: longest-match tokens of each text's words, with the vocabulary file at `path`.

    Words are runs without ASCII white space, A-Z lower-cased, and are counted whatever their length. Null and empty texts have 0 of both;
    every row gives one row, whatever its id; other columns are ignored. Empty input: empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(lambda b: _counts(b, path), f"doc_id {kind}, n_words long, n_tokens long")
