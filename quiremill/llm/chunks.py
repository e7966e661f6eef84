"""Substring dedup by content-defined chunks.

A gear hash rolls over each text's bytes; a chunk ends where the hash of the last WINDOW bytes
has CUT_BITS zero bits, so ends depend on the text around them alone and an insertion shifts no other
chunk. What is compared is stretches: from each chunk on, the fewest chunks that hold MIN_WORDS words, by digest. So what
two documents share stands whole in both of them. Neighbouring shared stretches with the same first holder form a
passage. Blocks of documents send their distinct digests, dealt by hash, to the tasks that count them over the
corpus, and get back which are shared; a block is named by a digest of its documents, so both readings of the texts agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiremill.llm.common import raw_texts, release_memory, reread

WINDOW = 16
CUT_BITS = 4
MIN_BYTES = 14
MAX_BYTES = 256
#: A passage of 50 words or more holds whole chunks of 20 words but for one case in thousands.
MIN_WORDS = 20
#: So many bytes count as a word, where words are longer or the script has no spaces.
WORD_BYTES = 12
BLOCK_BYTES = 4 << 20
DOCS_PER_BUCKET = 4000

_GEAR = np.random.default_rng(977).integers(0, 2**32, 256, dtype=np.uint32)
_MASK = np.uint32(((1 << CUT_BITS) - 1) << (WINDOW - CUT_BITS))


def chunk_ends(data: np.ndarray) -> np.ndarray:
    """Ends of the chunks of a byte array, the last one len(data); on UTF-8 character boundaries."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64)
    h = _GEAR[data]
    width = 1
    while width < WINDOW:  # h[i] = sum of gear[b[i - k]] << k, by doubling
        h[width:] += h[:-width] << np.uint32(width) if n > width else 0
        width *= 2
    ends = np.flatnonzero((h & _MASK) == 0) + 1
    ends = ends[(ends >= WINDOW) & (ends < n)]
    ends = ends[(data[ends] & 0xC0) != 0x80]
    # An end too near the one before is left out: a rule of the place, not of the chunk before.
    if len(ends):
        ends = ends[np.diff(ends, prepend=-MIN_BYTES) >= MIN_BYTES]
    ends = np.append(ends, n)
    gaps = np.diff(ends, prepend=0)
    if (gaps > MAX_BYTES).any():
        more = [np.arange(e - g + MAX_BYTES, e, MAX_BYTES) for e, g in zip(ends[gaps > MAX_BYTES], gaps[gaps > MAX_BYTES], strict=True)]
        more = np.concatenate(more)
        for _ in range(3):
            inside = (data[more] & 0xC0) == 0x80
            more[inside] -= 1
        ends = np.unique(np.append(ends, more))
    return ends


def _stretches(lengths: np.ndarray, words: np.ndarray, min_words: int) -> np.ndarray:
    """End (the chunk after) of the shortest stretch of min_words words from each chunk on; chunks with too few left have none."""
    held = np.concatenate([[0], np.cumsum(np.maximum(words, lengths // WORD_BYTES))])
    ends = np.searchsorted(held, held[:-1] + max(1, min_words))
    return ends[ends < len(held)]


def _chunk_text(raw: bytes, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests (n x 2 int64) of a text's stretches, byte lengths and word counts of its chunks."""
    import xxhash

    data = np.frombuffer(raw, np.uint8)
    ends = chunk_ends(data)
    if not len(ends):
        return np.empty((0, 2), np.int64), ends, ends
    starts = np.concatenate([[0], ends[:-1]])
    # A word belongs to the chunk in which it starts.
    space = (data == 32) | ((data >= 9) & (data <= 13))
    begins = ~space
    begins[1:] &= space[:-1]
    words = np.add.reduceat(begins.astype(np.int32), starts)
    stop = ends[_stretches(ends - starts, words, min_words) - 1]
    digests = b"".join([xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(starts.tolist(), stop.tolist(), strict=False)])
    return np.frombuffer(digests, np.int64).reshape(-1, 2), ends - starts, words


def _pack(*arrays: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b"".join(a.tobytes() for a in arrays))


def _unpack(b: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(b)


def _distinct(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the distinct digests in order (the first of each), and for every row its place among them."""
    order = np.lexsort((digests[:, 1], digests[:, 0]))
    ranked = digests[order]
    new = np.ones(len(order), bool)
    new[1:] = (ranked[1:] != ranked[:-1]).any(1)
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return order[new], place


def _blocks(batches, buckets: int, ask: bool, min_words: int):
    """A block's distinct digests by bucket (ask), or else its documents' stretches as places among them, and their chunks."""
    import xxhash

    rows: list[tuple] = []
    held, name = 0, xxhash.xxh3_128()

    def flush() -> pa.RecordBatch:
        block = name.hexdigest()
        cut = [_chunk_text(raw, min_words) for *_, raw in rows]
        counts = np.array([len(x[1]) for x in cut], np.int64)
        digests = np.concatenate([x[0] for x in cut])
        docs = np.repeat(np.array([d for d, *_ in rows], np.int64), [len(x[0]) for x in cut])
        # By bucket first, so that a bucket's digests are neighbours.
        bucket = digests[:, 0].view(np.uint64) % np.uint64(buckets)
        order = np.lexsort((digests[:, 1], digests[:, 0], bucket))
        ranked = digests[order]
        new = np.ones(len(order), bool)
        new[1:] = (ranked[1:] != ranked[:-1]).any(1)
        place = np.empty(len(order), np.uint32)
        place[order] = (np.cumsum(new) - 1).astype(np.uint32)
        if not ask:
            lengths = np.concatenate([x[1] for x in cut]).astype(np.uint16) if cut else np.empty(0, np.uint16)
            words = np.concatenate([x[2] for x in cut]).astype(np.uint16) if cut else np.empty(0, np.uint16)
            return pa.RecordBatch.from_arrays(
                [pa.array([block]), pa.array([[d for d, *_ in rows]], pa.list_(pa.int64())), pa.array([[h for _, h, _ in rows]], pa.list_(pa.int64())), pa.array([counts.tolist()], pa.list_(pa.int64())), pa.array([_pack(place, lengths, words)], pa.binary())],
                names=["block", "docs", "hashes", "counts", "payload"],
            )
        at = np.flatnonzero(new)
        if not len(at):
            return pa.RecordBatch.from_arrays([pa.array([], pa.string()), pa.array([], pa.int32()), pa.array([], pa.binary())], names=["block", "bucket", "payload"])
        ids = docs[order]
        least, most, n = np.minimum.reduceat(ids, at), np.maximum.reduceat(ids, at), np.diff(np.append(at, len(order)))
        key = ranked[at]
        used, first = np.unique(bucket[order][at], return_index=True)
        last = np.append(first, len(at))[1:]
        payload = [_pack(key[a:b], least[a:b], most[a:b], n[a:b]) for a, b in zip(first, last, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([block] * len(used)), pa.array(used.astype(np.int32)), pa.array(payload, pa.binary())], names=["block", "bucket", "payload"])

    for batch in batches:
        for doc_id, key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw_texts(batch.column(2)), strict=True):
            name.update(f"{doc_id} {len(raw)} ".encode() + raw)
            rows.append((doc_id, key, raw))
            held += 8 + len(raw)
            if held >= BLOCK_BYTES:
                yield flush()
                rows, held, name = [], 0, xxhash.xxh3_128()
        release_memory()
    if rows:
        yield flush()


def _share(table: pa.Table) -> pa.Table:
    """For each block that asks: which of its digests two documents hold, the first of these, how many chunks there are."""
    asked = [np.frombuffer(_unpack(p), np.int64) for p in table["payload"].to_pylist()]
    sizes = [len(a) // 5 for a in asked]
    blocks = table["block"].to_pylist()
    owner = np.concatenate([np.full(n, i) for i, n in enumerate(sizes)])
    local = np.concatenate([np.arange(n) for n in sizes])
    key = np.concatenate([a[: 2 * n].reshape(-1, 2) for a, n in zip(asked, sizes, strict=True)])
    least, most, count = (np.concatenate([a[(2 + k) * n : (3 + k) * n] for a, n in zip(asked, sizes, strict=True)]) for k in range(3))
    first, place = _distinct(key)
    lo = np.full(len(first), np.iinfo(np.int64).max)
    hi = np.full(len(first), np.iinfo(np.int64).min)
    np.minimum.at(lo, place, least)
    np.maximum.at(hi, place, most)
    total = np.bincount(place, count, len(first)).astype(np.int64)
    hit = np.flatnonzero(lo[place] < hi[place])
    out = []
    for i in range(len(blocks)):
        mine = hit[owner[hit] == i] if len(blocks) < 8 else hit[np.searchsorted(owner[hit], i) : np.searchsorted(owner[hit], i, "right")]
        out.append(_pack(local[mine].astype(np.int64), lo[place[mine]], total[place[mine]]))
    release_memory()
    return pa.table({"block": table["block"].combine_chunks(), "bucket": table["bucket"].combine_chunks(), "size": pa.array(sizes, pa.int64()), "payload": pa.array(out, pa.binary())})


PASSAGE = "doc_id long, text_hash long, passage long, start long, bytes long, n_chunks long, n_words long, first_doc_id long, n_docs long, kept boolean"


def _passages(docs: pa.Table, answers: pa.Table, min_words: int) -> pa.Table:
    buckets, rows = np.unique(answers["bucket"].to_numpy(), return_index=True)
    sizes, payload = answers["size"].to_numpy()[rows], answers["payload"].take(pa.array(rows)).to_pylist()
    base = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    first, seen = np.zeros(total, np.int64), np.zeros(total, np.int64)  # seen 0: held by one document only
    for at, p in zip(base, payload, strict=True):
        local, lo, n = np.frombuffer(_unpack(p), np.int64).reshape(3, -1)
        first[at + local], seen[at + local] = lo, n
    out: list[list] = [[] for _ in range(10)]
    for r in range(len(docs)):
        raw, counts = _unpack(docs["payload"][r].as_py()), docs["counts"][r].as_py()
        n = sum(counts)  # chunks: two bytes of length and two of words; what stands before are the stretches' places
        place, rest = np.frombuffer(raw[: len(raw) - 4 * n], np.uint32), raw[len(raw) - 4 * n :]
        if len(place) and int(place.max()) >= total:
            raise RuntimeError("the documents changed between two readings")
        lengths, words = (np.frombuffer(x, np.uint16).astype(np.int64) for x in (rest[: 2 * n], rest[2 * n :]))
        at = at_place = 0
        for doc_id, key, count in zip(docs["docs"][r].as_py(), docs["hashes"][r].as_py(), counts, strict=True):
            size, word = lengths[at : at + count], words[at : at + count]
            ends = _stretches(size, word, min_words)
            here = place[at_place : at_place + len(ends)]
            held = seen[here] > 0
            at, at_place = at + count, at_place + len(ends)
            if not held.any():
                continue
            byte, spoken = (np.concatenate([[0], np.cumsum(x)]) for x in (size, word))
            # A passage: shared stretches, one after the other, with the same first holder.
            new = np.concatenate([[True], (held[1:] != held[:-1]) | (held[1:] & (first[here[1:]] != first[here[:-1]]))])
            edge = np.flatnonzero(new)
            number = 0
            for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(ends)], strict=True):
                if held[a]:
                    head, stop = int(first[here[a]]), int(ends[b - 1])
                    row = (doc_id, key, number, int(byte[a]), int(byte[stop] - byte[a]), stop - a, int(spoken[stop] - spoken[a]), head, int(seen[here[a:b]].max()), head == doc_id)
                    for col, x in zip(out, row, strict=True):
                        col.append(x)
                    number += 1
    release_memory()
    names = [f.split()[0] for f in PASSAGE.split(", ")]
    return pa.table({n: pa.array(c, pa.bool_() if n == "kept" else pa.int64()) for n, c in zip(names, out, strict=True)})


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each passage of a document that other documents share.

    doc_id, text_hash, passage (number in the text, from 0), start and bytes (in its UTF-8), n_chunks, n_words,
    first_doc_id (the least id that holds it), n_docs (how often its most common stretch occurs), kept (this document is that first one).

    A passage is a run of chunk stretches of min_words words (or WORD_BYTES bytes for each, where words are longer or not spaced) which all
    have the same first holder; each stretch stands whole in that document and in one other at least. Where the first
    holder changes a new passage starts, so neighbouring passages may overlap by less than a stretch.

    Null ids take no part; null and empty texts have no chunk; rows that repeat an id count as one
    document for sharing, and each gives its own passages. Other columns are ignored. Empty input: empty result.
    """
    base = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    base = reread(base, "texts")
    buckets = max(12, base.select("doc_id").count() // DOCS_PER_BUCKET)
    asked = base.mapInArrow(lambda b: _blocks(b, buckets, True, min_words), "block string, bucket int, payload binary")
    answers = asked.groupBy("bucket").applyInArrow(_share, "block string, bucket int, size long, payload binary")
    blocks = base.mapInArrow(lambda b: _blocks(b, buckets, False, min_words), "block string, docs array<long>, hashes array<long>, counts array<long>, payload binary")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda a, b: _passages(a, b, min_words), PASSAGE)


def drop_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text: each text without the passages that a document of smaller id holds; every row of docs gives one.

    A passage stays whole in the least document that holds it, unless part of it repeats a still smaller one, which then keeps that part.
    Null texts stay null, empty ones empty; rows of null id stay as they are; rows that repeat an id are cut by their own text. A text that
    is one repeat becomes empty. Other columns are left out. Empty input: empty result.
    """
    keys = [F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t")]
    spans = repeated_passages(docs, min_words).filter("NOT kept").select(*keys, F.col("start").alias("_from"), (F.col("start") + F.col("bytes")).alias("_to"))
    before = Window.partitionBy("_d", "_t").orderBy("_from", "_to").rowsBetween(Window.unboundedPreceding, -1)  # a document's own spans
    spans = spans.withColumn("_at", F.coalesce(F.max("_to").over(before), F.lit(0).cast("long")))
    between = F.when(F.col("_at") < F.col("_from"), F.struct(F.col("_at").alias("a"), F.col("_from").alias("b")))
    gone = spans.groupBy("_d", "_t").agg(F.array_sort(F.collect_list(between)).alias("stay"), F.max("_to").alias("rest"))
    base = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("_h"))
    joined = base.join(gone.hint("merge"), (F.col("doc_id").cast("long") == F.col("_d")) & (F.col("_h") == F.col("_t")), "left")
    size = F.octet_length("_raw").cast("long")
    parts = F.concat("stay", F.array(F.struct(F.col("rest").alias("a"), F.greatest("rest", size).alias("b"))))
    cut = F.array_join(F.transform(parts, lambda x: F.decode(F.substring(F.col("_raw"), (x["a"] + 1).cast("int"), (x["b"] - x["a"]).cast("int")), "UTF-8")), "")
    return joined.withColumn("_raw", F.encode("text", "UTF-8")).select("doc_id", F.when(F.col("rest").isNull(), F.col("text")).otherwise(cut).alias("text"))
