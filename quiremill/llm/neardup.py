"""MinHash near-dedup by an LSH forest.

1. Every text becomes its set of word shingles; equal sets are one class.
2. A class's MinHash signature, rotated, gives TREES sort orders. Classes that share the first
   DEPTH values of an order form a region; in each region the order's neighbours (those with
   the longest common prefix) and the region's first class become candidates.
3. Candidates with similar signatures join groups. Regions that still hold several groups are compared: in full where
   they have at most REGION_ROWS classes, or so few outside their largest group, which then meet every piece of it. Any other
   region is a forest of its own, whose ORDERS orders of the signature are cut deeper, each as deep as it takes until REGION_ROWS
   classes or fewer are left. Classes that share all values that may be cut by are compared in full, in blocks. So work
   grows with the rows of a region, not with their square.
4. Links are confirmed on full sets within each group; groups larger than a task's memory
   are split into blocks which are compared with each other.

Two texts at the threshold share no region with a probability of (1 - 0.75**4)**32, 5 in a million. In a region that is cut x values deeper
they stay together in one of its orders with a probability of 1 - (1 - 0.75**x)**16, above 0.99 up to x = 4 and 0.9 at x = 7; the other
trees, whose regions are mostly small, find them besides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quiremill.llm.common import attach_by_hash, materialize, raw_texts, release_memory, written
from quiremill.llm.components import components

WORDS = 5
PERCENT = 75
TREES = 32
DEPTH = 4
HASHES = TREES * DEPTH
#: Signatures that agree in so many of 128 values may belong to sets at the threshold (4 standard deviations below it).
AGREE = int(HASHES * 0.58)
#: Rows of a region that are sorted or compared in one piece; larger regions are cut deeper.
REGION_ROWS = 1000
#: Orders by which a region too large to be compared in full is cut, the values a cut adds, and the most it may add.
ORDERS = 16
STEP = 2
MAX_CUT = 40
#: Shingles of a group that one task holds (8 bytes each, with its index 32); larger groups are split.
GROUP_SHINGLES = 3_000_000
#: Members of a block's main part that are shown to other blocks first.
ENVOYS = 16

_rng = np.random.default_rng(20240501)
_XOR = _rng.integers(0, 2**32, (HASHES, 1), dtype=np.uint32)
_MUL = _rng.integers(0, 2**32, (HASHES, 1), dtype=np.uint32) | np.uint32(1)
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_set(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; A-Z are lower-cased."""
    import xxhash

    found = (text or b"").lower().split()  # bytes: A-Z and ASCII white space only
    n = len(found)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, n)
    width = min(words, n)
    with np.errstate(over="ignore"):
        s = np.full(n - width + 1, np.uint64(width), np.uint64)
        for k in range(width):
            s = (s ^ h[k : n - width + 1 + k]) * _P1
            s ^= s >> np.uint64(29)
        s *= _P2
        s ^= s >> np.uint64(32)
    return np.unique(s)


def signature(shingles: np.ndarray) -> np.ndarray:
    """HASHES minima, the low 16 bits of each."""
    x = (shingles >> np.uint64(16)).astype(np.uint32)
    least = np.full(HASHES, 2**32 - 1, np.uint32)
    for at in range(0, len(x), 2048):
        least = np.minimum(least, ((x[None, at : at + 2048] ^ _XOR) * _MUL).min(1))
    least ^= least >> np.uint32(16)
    return (least & np.uint32(0xFFFF)).astype(">u2")


def _sign(batches, words: int):
    import xxhash

    for batch in batches:
        n, d1, d2, sig = [], [], [], []
        for raw in raw_texts(batch.column(1)):
            s = shingle_set(raw, words)
            n.append(len(s))
            digest = xxhash.xxh3_128_digest(s.tobytes())
            d1.append(int.from_bytes(digest[:8], "big", signed=True))
            d2.append(int.from_bytes(digest[8:], "big", signed=True))
            sig.append(signature(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "text_hash", "n_shingles", "d1", "d2", "sig"])
        release_memory()


def _similar_rows(sigs: np.ndarray, labels: np.ndarray) -> list[tuple[int, int]]:
    """Edges between rows of different labels whose signatures agree; at most one fewer than the rows."""
    label = {x: x for x in labels.tolist()}

    def find(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    edges = []
    roots = labels.copy()
    for i in range(len(sigs)):
        mine = find(labels[i].item())
        others = np.flatnonzero(roots[:i] != mine)
        if not len(others):
            continue
        near = others[(sigs[others] == sigs[i]).sum(1) >= AGREE]
        for j in near.tolist():
            a, b = find(labels[i].item()), find(labels[j].item())
            if a != b:
                label[max(a, b)] = min(a, b)
                edges.append((i, j))
        if len(near):
            roots = np.array([find(x) for x in labels.tolist()])
    return edges


def _compare_region(table: pa.Table) -> pa.Table:
    ids = table["class_id"].to_numpy()
    labels = table["root"].to_numpy()
    _, first = np.unique(ids, return_index=True)
    ids, labels = ids[first], labels[first]
    sigs = np.frombuffer(b"".join(table["sig"].take(pa.array(first)).to_pylist()), ">u2").reshape(len(ids), HASHES)
    edges = _similar_rows(sigs, labels)
    return pa.table({"a": pa.array([ids[i] for i, _ in edges], pa.int64()), "b": pa.array([ids[j] for _, j in edges], pa.int64())})


def _linked(index: tuple[np.ndarray, np.ndarray], sizes: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Rows of an inverted index that s links to, by exact intersection sizes."""
    hashes, owners = index
    lo, hi = np.searchsorted(hashes, s, "left"), np.searchsorted(hashes, s, "right")
    n = hi - lo
    total = int(n.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(n)
    at = np.repeat(lo - (ends - n), n) + np.arange(total)
    common = np.bincount(owners[at], minlength=len(sizes))
    return np.flatnonzero(100 * common >= PERCENT * (sizes + len(s) - common))


def _index(sets: list[np.ndarray], rows: list[int]) -> tuple[np.ndarray, np.ndarray]:
    hashes = np.concatenate([sets[i] for i in rows]) if rows else np.empty(0, np.uint64)
    owners = np.repeat(np.array(rows, np.int64), [len(sets[i]) for i in rows])
    order = np.argsort(hashes, kind="stable")
    return hashes[order], owners[order]


def _exact_groups(sets: list[np.ndarray]) -> np.ndarray:
    """Component number of each set under exact links: breadth first, over those not yet reached."""
    sizes = np.array([len(s) for s in sets], np.int64)
    part = np.full(len(sets), -1, np.int64)
    left = list(range(len(sets)))
    index, built = _index(sets, left), len(left)
    for seed in range(len(sets)):
        if part[seed] >= 0:
            continue
        part[seed] = seed
        queue = [seed]
        while queue:
            found = _linked(index, sizes, sets[queue.pop()])
            found = found[part[found] < 0]
            part[found] = seed
            queue += found.tolist()
            left_now = int((part < 0).sum())
            if not left_now:
                break
            if left_now * 2 < built:
                left = np.flatnonzero(part < 0).tolist()
                index, built = _index(sets, left), left_now
        if (part >= 0).all():
            break
    return part


def _sets(table: pa.Table, column: str = "shingles") -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint64) for b in table[column].to_pylist()]


def _confirm(table: pa.Table) -> pa.Table:
    """class_id and label: the least class of its exact component in this block."""
    ids = table["class_id"].to_numpy()
    order = np.argsort(ids)
    ids = ids[order]
    part = _exact_groups(_sets(table.take(pa.array(order))))
    return pa.table({"grp": table["grp"].take(pa.array(order)), "block": table["block"].take(pa.array(order)), "class_id": pa.array(ids, pa.int64()), "label": pa.array(ids[part], pa.int64())})


def _cross(members: pa.Table, guests: pa.Table) -> pa.Table:
    """Links between guests and a block's members that have other labels, once for each pair of labels."""
    edges: set[tuple[int, int]] = set()
    if len(members) and len(guests):
        sets, labels = _sets(members), members["label"].to_numpy()
        sizes = np.array([len(s) for s in sets], np.int64)
        index = _index(sets, list(range(len(sets))))
        for own, s in zip(guests["label"].to_pylist(), _sets(guests), strict=True):
            edges |= {(own, x) for x in set(labels[_linked(index, sizes, s)].tolist()) if x != own}
    return pa.table({"a": pa.array([a for a, _ in edges], pa.int64()), "b": pa.array([b for _, b in edges], pa.int64())})


def _shingle_rows(batches, words: int):
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), pa.array([shingle_set(raw, words).tobytes() for raw in raw_texts(part.column(3))], pa.binary())], names=["grp", "block", "class_id", "shingles"])
        release_memory()


def similar_groups(classes: DataFrame) -> DataFrame:
    """node, root of the classes that have a similar signature in some region."""
    keys = [F.struct(F.lit(t).cast("long").alias("h2"), F.xxhash64(F.lit(t), F.substring("sig", 2 * DEPTH * t + 1, 2 * DEPTH)).alias("h1")) for t in range(TREES)]
    rows = classes.select("class_id", F.explode(F.array(*keys)).alias("k")).select("class_id", "k.h1", "k.h2")
    regions = materialize(rows.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").withColumn("region_rows", F.col("n")), "regions")
    held = attach_by_hash(rows, regions, F.xxhash64("class_id", "h2", "h1"), "region_rows", "n").filter("region_rows IS NOT NULL")
    held = materialize(held, "region_members")

    pieces = F.ceil(F.col("region_rows") / REGION_ROWS).cast("long")
    at = (F.col("h2") * (2 * DEPTH) + 1).cast("int")
    sorted_rows = held.join(classes.select("class_id", "sig").hint("merge"), "class_id").select(
        "class_id", "h1", "h2", F.pmod(F.xxhash64("class_id", "h2"), pieces).alias("piece"), F.concat(F.substr("sig", at, F.lit(24)), F.substr("sig", F.lit(1), F.lit(24))).alias("order_key")
    )
    w = Window.partitionBy("h1", "h2", "piece").orderBy("order_key", "class_id")
    near = sorted_rows.select("class_id", F.lag("class_id").over(w).alias("prior"), F.first("class_id").over(w).alias("top"))
    pairs = near.select("class_id", F.explode(F.array("prior", "top")).alias("other")).filter("other IS NOT NULL AND other <> class_id")
    pairs = pairs.select(F.least("class_id", "other").alias("a"), F.greatest("class_id", "other").alias("b")).distinct()
    left, right = classes.select(F.col("class_id").alias("a"), F.col("sig").alias("sig_a")), classes.select(F.col("class_id").alias("b"), F.col("sig").alias("sig_b"))
    edges = materialize(pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").mapInArrow(_agreeing, "a long, b long"), "similar_pairs")
    first = materialize(components(edges), "groups_1")

    # Regions that still hold several groups: compare their rows in full, or cut them deeper first.
    named = held.join(first.hint("merge"), held["class_id"] == first["node"], "left").select("class_id", "h1", "h2", "region_rows", F.coalesce("root", "class_id").alias("root"))
    by_group = named.groupBy("h1", "h2", "root").agg(F.count("*").alias("k"))
    mixed = by_group.groupBy("h1", "h2").agg(F.count("*").alias("groups"), F.sum("k").alias("n"), F.max(F.struct("k", "root")).alias("main")).filter("groups > 1")
    mixed = materialize(mixed.select("h1", "h2", "n", F.struct(F.col("main.root").alias("root"), (F.col("n") - F.col("main.k")).alias("others")).alias("main")), "mixed_regions")
    open_rows = attach_by_hash(named, mixed, F.xxhash64("class_id", "h2", "h1"), "main", "n").filter("main IS NOT NULL").select("class_id", "h1", "h2", "region_rows", "root", "main")
    large = mixed.filter(F.col("main.others") > REGION_ROWS)
    # A region's largest group is dealt over the pieces; the others, few, meet every piece.
    few = open_rows.filter((F.col("region_rows") <= REGION_ROWS) | (F.col("main.others") <= REGION_ROWS))
    piece = F.pmod(F.xxhash64("class_id"), pieces)
    cells = few.withColumn("i", F.explode(F.when(F.col("root") == F.col("main.root"), F.array(piece)).otherwise(F.sequence(F.lit(0).cast("long"), pieces - 1))))
    dealt = cells.select("h1", "h2", "i", F.col("i").alias("j"), "class_id", "root")
    if large.limit(1).count():
        deeper = _cut_deeper(open_rows.filter((F.col("region_rows") > REGION_ROWS) & (F.col("main.others") > REGION_ROWS)), classes)
        others = F.transform(F.sequence(F.lit(0).cast("long"), pieces - 1), lambda x: F.struct(F.least(x, F.col("block")).alias("i"), F.greatest(x, F.col("block")).alias("j")))
        dealt = dealt.unionByName(deeper.withColumn("block", piece).withColumn("cell", F.explode(others)).select("h1", "h2", "cell.i", "cell.j", "class_id", "root"))
    dealt = dealt.join(classes.select("class_id", "sig").hint("merge"), "class_id")
    more = materialize(dealt.groupBy("h1", "h2", "i", "j").applyInArrow(_compare_region, "a long, b long"), "similar_pairs_2")
    stars = first.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    return materialize(components(stars.unionByName(more)), "groups_2")


def _cut_deeper(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """rows (class_id, h1, h2, region_rows, root) of large regions, as rows of smaller ones within them.

    Each row enters ORDERS orders, which start at places spread over the signature and in each of which rows that share STEP more values stay together, until
    REGION_ROWS or fewer do. A region of one group is done. What MAX_CUT values can't part is left as large as it is.
    """
    signed = rows.join(classes.select("class_id", F.concat("sig", "sig").alias("sigs")).hint("merge"), "class_id")
    order = F.explode(F.sequence(F.lit(0), F.lit(ORDERS - 1))).alias("order")
    start = F.pmod(F.col("top2") * DEPTH + DEPTH + F.col("order") * (HASHES // ORDERS), F.lit(HASHES))
    open_rows = signed.select("class_id", F.col("h1").alias("top1"), F.col("h2").alias("top2"), "root", "sigs", order)
    open_rows = materialize(open_rows.withColumn("sigs", F.substr("sigs", (start * 2 + 1).cast("int"), F.lit(2 * MAX_CUT))), "open_orders")
    done = None
    for depth in range(STEP, MAX_CUT + 1, STEP):
        prefix = F.substring("sigs", 1, 2 * depth)
        keyed = open_rows.withColumn("h1", F.xxhash64("top1", "top2", "order", prefix)).withColumn("h2", F.col("top2"))
        sizes = keyed.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi")
        sizes = materialize(sizes.select("h1", "h2", "n", F.col("n").alias("region_rows")), "deeper_regions")
        placed = materialize(attach_by_hash(keyed, sizes, F.xxhash64("class_id", "order"), "region_rows", "n").filter("region_rows IS NOT NULL"), "deeper_rows")
        small = F.lit(depth == MAX_CUT) | (F.col("region_rows") <= REGION_ROWS)
        part = placed.filter(small).select("class_id", "h1", "h2", "region_rows", "root")
        done = part if done is None else done.unionByName(part)
        open_rows = placed.filter(~small).select("class_id", "top1", "top2", "root", "order", "sigs")
        if not open_rows.limit(1).count():
            break
    return done


def _agreeing(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.schema.names
        a, b = (np.frombuffer(b"".join(batch.column(names.index(c)).to_pylist()), np.uint16).reshape(-1, HASHES) for c in ("sig_a", "sig_b"))
        keep = pa.array((a == b).sum(1) >= AGREE)
        yield pa.RecordBatch.from_arrays([batch.column(names.index("a")).filter(keep), batch.column(names.index("b")).filter(keep)], names=["a", "b"])


def near_duplicates(docs: DataFrame, words: int = WORDS, group_shingles: int = GROUP_SHINGLES, envoys: int = ENVOYS) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept for each row of docs.

    Documents whose shingle sets have a Jaccard similarity of 0.75 or more are linked;
    component_id is the least doc_id reachable. A text without words has an empty set
    and is linked with nothing. A null doc_id takes no part: component_id null, kept true.
    Each row is judged by its own text, so rows that repeat an id agree if their texts do.
    Other columns are ignored. Empty input: empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = materialize(docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(lambda b: _sign(b, words), "doc_id long, text_hash long, n_shingles long, d1 long, d2 long, sig binary"), "signatures")
    classes = signed.filter("doc_id IS NOT NULL AND n_shingles > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("class_id"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.count("*").alias("copies"))
    # Rows that repeat an id can head several classes: a class is named by id and digest.
    classes = materialize(classes.withColumn("doc", F.col("class_id")).withColumn("class_id", F.xxhash64("d1", "d2")), "classes")
    groups = similar_groups(classes.select("class_id", "sig"))

    members = classes.join(groups, classes["class_id"] == groups["node"]).select("class_id", "doc", "n", "d1", "d2", F.col("root").alias("grp"))
    weight = members.groupBy(F.col("grp").alias("h1"), F.lit(0).cast("long").alias("h2")).agg(F.ceil(F.sum("n") / group_shingles).cast("long").alias("blocks"), F.count("*").alias("rows"))
    members = members.withColumn("h1", F.col("grp")).withColumn("h2", F.lit(0).cast("long"))
    members = attach_by_hash(members, materialize(weight, "group_weights"), F.xxhash64("class_id"), "blocks", "rows").withColumn("block", F.pmod(F.xxhash64("class_id"), F.col("blocks")))
    members = materialize(members.select("grp", "blocks", "block", "class_id", "doc", "d1", "d2"), "members")
    # One text for each class: the head's, found by its id and its set's digest.
    texts = docs.withColumnRenamed("doc_id", "doc").join(members.select("grp", "block", "class_id", "doc").hint("merge"), "doc")
    shingled = texts.select("grp", "block", "class_id", "text").mapInArrow(lambda b: _shingle_rows(b, words), "grp long, block long, class_id long, shingles binary")
    repeated = shingled.withColumn("digest", F.sha2("shingles", 256)).dropDuplicates(["class_id", "digest"]) if _has_repeats(signed) else None
    sets = _right_sets(repeated, members, words) if repeated is not None else shingled
    sets = materialize(sets.select("grp", "block", "class_id", "shingles"), "sets")
    local = materialize(sets.groupBy("grp", "block").applyInArrow(_confirm, "grp long, block long, class_id long, label long"), "local_labels")
    stars = local.filter("class_id <> label").select(F.col("class_id").alias("a"), F.col("label").alias("b"))
    large = members.filter("blocks > 1")
    if large.limit(1).count():
        stars = stars.unionByName(_across(sets, local, large, envoys))
    linked = materialize(components(stars), "components")

    # The least document of each component, then back to every row by its class.
    heads = classes.join(linked, classes["class_id"] == linked["node"], "left").select("d1", "d2", "doc", F.coalesce("root", "class_id").alias("root"), F.col("copies"))
    least = heads.groupBy(F.col("root").alias("h1"), F.lit(0).cast("long").alias("h2")).agg(F.min("doc").alias("component_id"), F.count("*").alias("n"))
    heads = heads.withColumn("h1", F.col("root")).withColumn("h2", F.lit(0).cast("long"))
    known = attach_by_hash(heads, materialize(least, "least_documents"), F.xxhash64("d1", "d2"), "component_id", "n")
    known = materialize(known.select(F.col("d1").alias("h1"), F.col("d2").alias("h2"), "component_id", "copies"), "class_components")
    rows = signed.select("doc_id", "text_hash", "n_shingles", F.col("d1").alias("h1"), F.col("d2").alias("h2"))
    placed = attach_by_hash(rows, known, F.xxhash64("doc_id"), "component_id", "copies")
    own = F.when(F.col("doc_id").isNull(), None).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return placed.select("doc_id", "text_hash", "n_shingles", own.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, **params) -> DataFrame:
    """docs with one document of each group, the least id, once. Rows of null id stay."""
    judged = near_duplicates(docs, **params).filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t")).agg(F.max("kept").alias("_kept"), F.count("*").alias("_rows"))
    gone = judged.filter("NOT _kept OR _rows > 1")
    marked = docs.withColumn("_h", F.xxhash64(F.col("text").cast("string")))
    marked = marked.join(gone.hint("merge"), (F.col("doc_id").cast("long") == F.col("_d")) & (F.col("_h") == F.col("_t")), "left").filter("coalesce(_kept, true)")
    once = marked.filter("_rows > 1").dropDuplicates(["doc_id", "_h"])
    return marked.filter("_rows IS NULL").unionByName(once).select(*docs.columns)


def _has_repeats(signed: DataFrame) -> bool:
    """Whether some id stands on rows with different sets."""
    return bool(signed.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("d1", "d2")).alias("a"), F.max(F.struct("d1", "d2")).alias("b")).filter("a <> b").limit(1).count())


def _right_sets(shingled: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """Of the sets found under a class's head id, the one with the class's digest."""

    def digests(batches):
        import xxhash

        for batch in batches:
            d = [xxhash.xxh3_128_digest(x) for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array([int.from_bytes(x[:8], "big", signed=True) for x in d], pa.int64()), pa.array([int.from_bytes(x[8:], "big", signed=True) for x in d], pa.int64())], names=["grp", "block", "class_id", "shingles", "d1", "d2"])

    found = shingled.select("grp", "block", "class_id", "shingles").mapInArrow(digests, "grp long, block long, class_id long, shingles binary, d1 long, d2 long")
    return found.join(members.select("class_id", "d1", "d2"), ["class_id", "d1", "d2"])


def _across(sets: DataFrame, local: DataFrame, large: DataFrame, envoys: int) -> DataFrame:
    """Links between the blocks of groups too large for one task, as edges of local labels.

    First every class outside its block's main part, and some envoys of each main part, visit all
    blocks. Main parts that are still apart then visit each other whole.
    """
    rows = sets.join(local.select("class_id", "label"), "class_id").join(large.select("class_id", "blocks"), "class_id")
    rows = materialize(rows.select("grp", "block", "blocks", "class_id", "label", "shingles"), "large_groups")
    size = rows.groupBy("grp", "block", "label").agg(F.count("*").alias("n"))
    main = size.withColumn("r", F.row_number().over(Window.partitionBy("grp", "block").orderBy(F.desc("n"), "label"))).filter("r = 1").select("grp", "block", F.col("label").alias("main"))
    rows = rows.join(main, ["grp", "block"])
    path = written(rows, "large_groups_marked")
    hosts, rows = (rows.sparkSession.read.schema(rows.schema).parquet(path) for _ in range(2))
    hosts = hosts.select("grp", "block", "label", "shingles")
    rank = F.row_number().over(Window.partitionBy("grp", "block", F.col("label") == F.col("main")).orderBy(F.xxhash64("class_id"), "class_id"))
    guests = rows.withColumn("r", rank).filter((F.col("label") != F.col("main")) | (F.col("r") <= envoys))
    guests = guests.withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).filter("to <> block").select("grp", F.col("to").alias("block"), "label", "shingles")
    edges = materialize(hosts.groupBy("grp", "block").cogroup(guests.groupBy("grp", "block")).applyInArrow(_cross, "a long, b long"), "cross_links")
    joined = components(edges)
    roots = materialize(main.join(joined, main["main"] == joined["node"], "left").select("grp", "block", "main", F.coalesce("root", "main").alias("root")), "main_parts")
    apart = roots.alias("x").join(roots.alias("y"), (F.col("x.grp") == F.col("y.grp")) & (F.col("x.block") < F.col("y.block")) & (F.col("x.root") != F.col("y.root")))
    apart = apart.select("x.grp", "x.block", F.col("x.main").alias("main"), F.col("y.block").alias("to"))
    visit = rows.filter("label = main").join(apart, ["grp", "block", "main"]).select("grp", F.col("to").alias("block"), "label", "shingles")
    rest = hosts.groupBy("grp", "block").cogroup(visit.groupBy("grp", "block")).applyInArrow(_cross, "a long, b long")
    return edges.unionByName(materialize(rest, "cross_links_2"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, hash(list_aggregate(ws[i:i + 4], 'string_agg', ' ')) AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM w UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, w.doc_id = m.c AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id) m ON m.doc_id = w.doc_id
"""
