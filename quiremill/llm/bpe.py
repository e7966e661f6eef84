"""BPE encoding and decoding by a distinct-word table.

Texts are cut at ASCII white space, which this kind of tokenizer always drops, so a text's
ids are the ids of its words in order. Blocks of documents are turned into local word numbers;
each block sends its distinct words, dealt by hash, to the tasks that encode every distinct word
of the corpus once; the ids come back to the block and are joined by position. A block is named by
a digest of its documents, so the two readings of the texts (for words, for numbers) agree wherever
they run, and nothing as large as the texts is stored in between.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiremill.llm.common import raw_texts, release_memory, reread

BLOCK_BYTES = 8 << 20
#: Documents to a bucket of the distinct-word table; buckets grow with the input, so a bucket does not.
DOCS_PER_BUCKET = 4000


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


@lru_cache(maxsize=2)
def _pieces(path: str) -> pa.Array:
    """The id-to-piece table, by id: as large as the vocabulary, whatever the corpus."""
    tok = _tokenizer(path)
    return pa.array([tok.id_to_token(i) for i in range(max(tok.get_vocab(True).values()) + 1)], pa.large_string())


def _pack(a: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def _unpack(b: bytes, kind: str) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def _blocks(batches: Iterator[pa.RecordBatch], buckets: int, schema: pa.Schema, want_words: bool) -> Iterator[pa.RecordBatch]:
    """Rows of a block: its distinct words by bucket, or else its documents as word numbers."""
    import xxhash
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=3)
    numbers: dict[bytes, int] = {}
    ids: list = []
    codes: list[np.ndarray] = []
    held, digest = 0, xxhash.xxh3_128()

    def flush() -> pa.RecordBatch:
        block = digest.hexdigest()
        words = list(numbers)
        bucket = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(words), np.uint32)
        place[order] = np.arange(len(words), dtype=np.uint32)
        if want_words:
            used, starts = np.unique(bucket[order], return_index=True)
            ends = np.append(starts, len(words))[1:]
            sent = [squeeze.compress(b" ".join([words[j] for j in order[a:b]])) for a, b in zip(starts, ends, strict=True)]
            columns = [[block] * len(used), used.tolist(), sent]
        else:
            flat = place[np.concatenate(codes)] if words else np.empty(0, np.uint32)
            columns = [[block], [ids], [[len(c) for c in codes]], [squeeze.compress(flat.tobytes())]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for batch in batches:
        for doc_id, raw in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), strict=True):
            digest.update(f"{doc_id!r} {len(raw)} ".encode() + raw)
            words = raw.split()
            codes.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.uint32, len(words)))
            ids.append(doc_id)
            held += 8 + len(raw)
            if held >= BLOCK_BYTES:
                yield flush()
                numbers.clear()
                ids, codes, held, digest = [], [], 0, xxhash.xxh3_128()
        release_memory()
    if ids:
        yield flush()


def _encode_bucket(table: pa.Table, path: str, schema: pa.Schema) -> pa.Table:
    """Encode each distinct word of the bucket once; answer each block in its own order."""
    import zstandard

    tok, loosen = _tokenizer(path), zstandard.ZstdDecompressor()
    asked = [loosen.decompress(p.as_py()).split(b" ") for p in table["payload"]]
    distinct = list(dict.fromkeys(w for words in asked for w in words))
    number = {w: i for i, w in enumerate(distinct)}
    parts: list[list[int]] = []
    for at in range(0, len(distinct), 4096):
        parts += [e.ids for e in tok.encode_batch([w.decode() for w in distinct[at : at + 4096]], add_special_tokens=False)]
    lens = np.fromiter(map(len, parts), np.uint32, len(parts))
    ids = np.fromiter((i for p in parts for i in p), np.uint32, int(lens.sum()))
    starts = np.concatenate([[0], np.cumsum(lens[:-1], dtype=np.int64)]) if len(lens) else np.empty(0, np.int64)
    payload, sizes = [], []
    for words in asked:
        rows = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        payload.append(_pack(ids[_ranges(starts[rows], lens[rows])]))
        sizes.append(_pack(lens[rows]))
    release_memory()
    return pa.Table.from_arrays([table["block"].combine_chunks(), table["bucket"].combine_chunks(), pa.array(sizes, pa.binary()), pa.array(payload, pa.binary())], schema=schema)


def _ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The indices starts[i] .. starts[i] + lens[i] - 1 of all i, in order."""
    lens = lens.astype(np.int64)
    total = int(lens.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lens)
    return np.repeat(starts - (ends - lens), lens) + np.arange(total)


def decode_ids(ids: pa.ListArray, path: str) -> pa.Array:
    """The pieces of each list joined as the tokenizer joins them: it has no decoder, so by a space."""
    import pyarrow.compute as pc

    pieces = _pieces(path).take(ids.values)
    joined = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, pieces), pa.scalar(" ", pa.large_string()))
    return pc.fill_null(joined, "")


def _join_block(docs: pa.Table, words: pa.Table, path: str, schema: pa.Schema, decode: bool) -> pa.Table:
    """Documents of a block (twice where a block repeats) with the ids of their words, by position."""
    _, order = np.unique(words["bucket"].to_numpy(), return_index=True)
    sizes, payload = words["sizes"].to_pylist(), words["ids"].to_pylist()
    lens = np.concatenate([np.empty(0, np.uint32)] + [_unpack(sizes[i], "<u4") for i in order])
    ids = np.concatenate([np.empty(0, np.uint32)] + [_unpack(payload[i], "<u4") for i in order])
    starts = np.cumsum(lens, dtype=np.int64) - lens
    parts = []
    for row in range(len(docs)):
        codes = _unpack(docs["payload"][row].as_py(), "<u4")
        if len(codes) and int(codes.max()) >= len(lens):
            raise RuntimeError("the documents changed between two readings")
        per_word = lens[codes]
        flat = ids[_ranges(starts[codes], per_word)].astype(np.int32)
        before = np.concatenate([[0], np.cumsum(per_word, dtype=np.int64)])
        offsets = np.concatenate([[0], before[np.cumsum(np.array(docs["counts"][row].as_py(), np.int64))]]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
        columns = [docs["doc_ids"][row].values, pa.array(np.diff(offsets).astype(np.int64)), lists]
        if decode:
            columns.append(decode_ids(lists, path))
        parts.append(pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema))
    release_memory()
    return pa.concat_tables(parts) if parts else schema.empty_table()


def encode(docs: DataFrame, path: str, decode: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (and decoded) of each row of docs, by the tokenizer file at `path`.

    Null and empty texts have no ids. Rows that repeat an id, null ids, and texts of any
    length each give their own row; columns besides doc_id and text are ignored. Empty
    input: empty result. Special-token strings in a text become their ids, as the library does.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    docs = reread(docs.select("doc_id", F.col("text").cast("string").alias("text")), "texts")
    kind = docs.schema["doc_id"].dataType
    buckets = max(12, docs.select("doc_id").count() // DOCS_PER_BUCKET)

    def struct(*fields: tuple[str, T.DataType]) -> tuple[T.StructType, pa.Schema]:
        kind = T.StructType([T.StructField(*f) for f in fields])
        return kind, to_arrow_schema(kind)

    asked, asked_arrow = struct(("block", T.StringType()), ("bucket", T.IntegerType()), ("payload", T.BinaryType()))
    sent, sent_arrow = struct(("block", T.StringType()), ("bucket", T.IntegerType()), ("sizes", T.BinaryType()), ("ids", T.BinaryType()))
    held, held_arrow = struct(("block", T.StringType()), ("doc_ids", T.ArrayType(kind)), ("counts", T.ArrayType(T.IntegerType())), ("payload", T.BinaryType()))
    out, out_arrow = struct(("doc_id", kind), ("n_tokens", T.LongType()), ("ids", T.ArrayType(T.IntegerType())), *[("decoded", T.StringType())] * decode)
    words = docs.mapInArrow(lambda b: _blocks(b, buckets, asked_arrow, True), asked)
    encoded = words.groupBy("bucket").applyInArrow(lambda t: _encode_bucket(t, path, sent_arrow), sent)
    blocks = docs.mapInArrow(lambda b: _blocks(b, buckets, held_arrow, False), held)
    return blocks.groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(lambda a, b: _join_block(a, b, path, out_arrow, decode), out)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded (with `ids`) and the `decoded` text of each row; null ids give null."""
    out = T.StructType([f for f in encoded.schema.fields if f.name != "decoded"] + [T.StructField("decoded", T.StringType())])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                ids = pa.array(part.column("ids").to_pylist(), pa.list_(pa.int32()))
                text = pa.array([None if null else x for null, x in zip(ids.is_null().to_pylist(), decode_ids(ids, path).to_pylist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in part.schema.names), text.cast(schema.field("decoded").type)], schema=schema)

    return encoded.drop("decoded").mapInArrow(run, out)
