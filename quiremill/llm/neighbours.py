"""Approximate nearest neighbours by learned partitions.

A sample's nearest-neighbour graph is cut into balanced parts and a softmax classifier learns them; where the rows need more
parts than one cut gives, each part is cut again by a classifier of its own, fitted where the part's rows are. Every distinct
vector goes to its most probable leaf. A query visits leaves from the most probable on while enough probability is left; how much
that is comes from the true neighbours, over all rows, of some rows that nothing was fitted on. Candidates are
ranked by the exact inner product in double precision. The first leaves visited set a bound, so the rest send little.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiremill.llm.common import attach_by_hash, materialize

#: Rows that a graph and its classifier are fitted on, at most: those with the least hash of their id. A part that is cut again
#: fits on PART_FIT_ROWS of its own rows.
FIT_ROWS = 4000
PART_FIT_ROWS = 1500
#: Rows that one leaf is meant for: there are as many leaves as that takes, up to MAX_PARTS in one cut, or else
#: TOP_PARTS parts of up to LEAVES leaves each. Beyond TOP_PARTS * LEAVES * PART_ROWS rows (1.6 million) leaves grow.
PART_ROWS = 400
MAX_PARTS = 256
TOP_PARTS = 64
LEAVES = 64
GRAPH_K = 12
#: Queries visit until they have found this share of the true neighbours of TUNE_ROWS rows that nothing was fitted on.
RECALL = 0.95
TUNE_ROWS = 400
#: Leaves that a query visits first; the others then send only what is no farther than its k-th nearest of these.
FIRST_VISITS = 3
#: Rows of a leaf that are ranked in one piece; a larger leaf is cut into pieces.
PIECE_ROWS = 4000
QUERY_ROWS = 2000


@dataclass
class Router:
    """Leaf probabilities: a softmax of a linear map of the unit vector, times that of the part's own map where it is cut again.

    `floor`: a query goes on while the leaves it hasn't visited hold that much probability. `sizes`: rows of each leaf.
    """

    weights: np.ndarray
    bias: np.ndarray
    subs: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    floor: float = 0.0
    sizes: np.ndarray = None
    recall: float = 1.0

    @property
    def dim(self) -> int:
        return len(self.weights)

    def parts(self, x: np.ndarray) -> np.ndarray:
        return _softmax(_unit(x), self.weights, self.bias)

    def starts(self) -> np.ndarray:
        """First leaf of each part."""
        counts = [self.subs[i][0].shape[1] if i in self.subs else 1 for i in range(self.weights.shape[1])]
        return np.concatenate([[0], np.cumsum(counts)])

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        u, first = _unit(x), self.starts()
        top = _softmax(u, self.weights, self.bias)
        if not self.subs:
            return top
        out = np.empty((len(x), first[-1]))
        for i in range(top.shape[1]):
            within = _softmax(u, *self.subs[i]) if i in self.subs else 1.0
            out[:, first[i] : first[i + 1]] = top[:, i : i + 1] * within
        return out

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: the most probable one of its most probable part."""
        u, first = _unit(x), self.starts()
        part = _softmax(u, self.weights, self.bias).argmax(1)
        leaf = first[part]
        for i in np.unique(part).tolist():
            if i in self.subs:
                mine = np.flatnonzero(part == i)
                leaf[mine] += _softmax(u[mine], *self.subs[i]).argmax(1)
        return leaf

    def visits(self, x: np.ndarray, least_rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Leaves in each row's order, and how many of them it visits: enough to leave less than `floor` and to hold least_rows rows."""
        p = self.probabilities(x)
        order = np.argsort(-p, axis=1, kind="stable")
        left = _left(np.take_along_axis(p, order, 1))
        count = (left >= self.floor).sum(1)
        if self.sizes is not None:
            count = np.maximum(count, (np.cumsum(self.sizes[order], 1) < least_rows).sum(1) + 1)
        return order, np.clip(count, 1, p.shape[1])


def _left(ranked: np.ndarray) -> np.ndarray:
    """Probability that is left before each place, summed from the far end so that small rests stay exact."""
    return np.cumsum(ranked[:, ::-1], 1)[:, ::-1]


def _softmax(u: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    z = u @ weights + bias
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def neighbour_graph(x: np.ndarray, k: int = GRAPH_K, rows: int | None = None) -> np.ndarray:
    """Numbers of each row's (or the first rows') k nearest others by inner product, ties to the smaller number."""
    n = len(x)
    k, rows = min(k, n - 1), n if rows is None else rows
    out = np.empty((rows, k), np.int64)
    for at in range(0, rows, 500):
        s = x[at : min(at + 500, rows)] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out[at : at + 500] = np.argsort(-s, axis=1, kind="stable")[:, :k]
    return out


def cut_graph(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.15) -> np.ndarray:
    """Balanced parts of the graph: halved again and again along its widest direction, then moved, row
    by row, to the part most of a row's neighbours are in while it has room."""
    n = len(x)
    label = np.zeros(n, np.int64)
    todo = [(np.arange(n), parts, 0)]
    while todo:
        rows, count, first = todo.pop()
        if count <= 1 or len(rows) < 2:
            label[rows] = first
            continue
        centred = x[rows] - x[rows].mean(0)
        direction = np.ones(x.shape[1]) / np.sqrt(x.shape[1])
        for _ in range(15):
            direction = centred.T @ (centred @ direction)
            direction /= max(np.linalg.norm(direction), 1e-300)
        order = np.argsort(centred @ direction, kind="stable")
        left = count // 2
        cut = len(rows) * left // count
        todo += [(rows[order[:cut]], left, first), (rows[order[cut:]], count - left, first + left)]
    room = int(np.ceil(slack * n / parts))
    size = np.bincount(label, minlength=parts)
    rng = np.random.default_rng(5)
    for _ in range(rounds):
        moved = 0
        for i in rng.permutation(n):
            votes = np.bincount(label[graph[i]], minlength=parts)
            best = int(votes.argmax())
            if votes[best] > votes[label[i]] and size[best] < room:
                size[label[i]] -= 1
                size[best] += 1
                label[i] = best
                moved += 1
        if moved < n // 200:
            break
    return label


def fit_router(x: np.ndarray, graph: np.ndarray, label: np.ndarray, parts: int, steps: int = 250) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression to the parts of a row and of its neighbours, by full-batch steps with momentum."""
    u = _unit(x)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.arange(len(x)), label), 1.0)
    for j in range(graph.shape[1]):
        np.add.at(target, (np.arange(len(x)), label[graph[:, j]]), 1.0 / graph.shape[1])
    target /= target.sum(1, keepdims=True)
    w, b = np.zeros((x.shape[1], parts)), np.zeros(parts)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):
        p = _softmax(u, w, b) - target
        vw = 0.9 * vw - 6.0 * (u.T @ p / len(x) + 1e-5 * w)
        vb = 0.9 * vb - 2.0 * p.mean(0)
        w, b = w + vw, b + vb
    return w, b


def _cut(x: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """A classifier of at most `parts` parts, one for each two rows of x at least."""
    parts = min(parts, len(x) // 2)
    if parts < 2:
        return np.zeros((x.shape[1], 1)), np.zeros(1)
    graph = neighbour_graph(x)
    return fit_router(x, graph, cut_graph(x, graph, parts), parts)


def _vectors(column) -> np.ndarray:
    """A list column whose lists are all of one length, as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


def _lengths(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.diff(column.offsets.to_numpy())


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, embedding (double) of the rows that take part: an id, and a vector neither null, empty, zero nor with null or non-finite components."""
    v = F.col("embedding")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False)))


def _by_part(batches, router: Router):
    """Rows of the router's dimension with their part."""
    for batch in batches:
        batch = batch.take(pa.array(np.flatnonzero(_lengths(batch.column(1)) == router.dim)))
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(router.parts(_vectors(batch.column(1))).argmax(1).astype(np.int32))], names=["vec_id", "embedding", "part"])


def fit(rows: DataFrame, fit_rows: int = FIT_ROWS, part_rows: int = PART_ROWS, max_parts: int = MAX_PARTS, tune_rows: int = TUNE_ROWS, k: int = 20) -> Router | None:
    """A router fitted on at most fit_rows usable rows of the most common dimension; None where there are none.

    Under 2 * part_rows rows there is one leaf. Probability left unvisited is tuned on tune_rows other rows of the same sample, drawn at
    random, whose k true neighbours are searched among all rows; `recall` is the share of these that the tuned visits reach.
    """
    n = rows.count()
    if not n:
        return None
    place = (F.xxhash64("vec_id").cast("double") / 2.0**64) + 0.5
    want = fit_rows + tune_rows
    few = rows.filter(place * n <= 1.2 * want).orderBy(F.xxhash64("vec_id"), "vec_id").limit(want).collect()
    if not few:
        few = rows.orderBy("vec_id").limit(want).collect()
    sizes = [len(r["embedding"]) for r in few]
    dim = max(sorted(set(sizes)), key=sizes.count)
    ids = np.array([r["vec_id"] for r in few if len(r["embedding"]) == dim])
    x = np.array([r["embedding"] for r in few if len(r["embedding"]) == dim])
    x, first = np.unique(x, axis=0, return_index=True)  # one of each repeated vector, so a common one is one node
    order = np.random.default_rng(7).permutation(len(x))  # unique() sorts; the rows held out are to be of every region
    x, ids = x[order], ids[first[order]]
    held = min(tune_rows, len(x) // 4)
    parts = n // part_rows
    two = parts > max_parts
    router = Router(*_cut(x[held : held + fit_rows], min(TOP_PARTS, max_parts) if two else parts))
    if two:
        router.subs = _cut_again(rows, router, part_rows)
    if held and router.starts()[-1] > 1:
        _tune(rows, router, x[:held], ids[:held], k)
    return router


def _cut_again(rows: DataFrame, router: Router, part_rows: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """A classifier for each part of more than part_rows rows, fitted by tasks on at most PART_FIT_ROWS of the part's rows."""
    marked = rows.mapInArrow(lambda b: _by_part(b, router), "vec_id long, embedding array<double>, part int")
    sizes = {r["part"]: r["n"] for r in marked.groupBy("part").agg(F.count("*").alias("n")).collect()}  # TOP_PARTS at most
    counts = {p: min(LEAVES, -(-n // part_rows)) for p, n in sizes.items()}
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.xxhash64("vec_id"), "vec_id"))
    sample = marked.withColumn("_r", rank).filter(F.col("_r") <= PART_FIT_ROWS).drop("_r")

    def one(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        x = np.unique(_vectors(table["embedding"]), axis=0)
        w, b = _cut(x[np.random.default_rng(part).permutation(len(x))], counts[part])
        return pa.table({"part": pa.array([part], pa.int32()), "weights": pa.array([w.astype(np.float32).tobytes()]), "bias": pa.array([b.tobytes()])})

    found = sample.groupBy("part").applyInArrow(one, "part int, weights binary, bias binary").collect()  # TOP_PARTS * LEAVES * dimension floats at most
    found = {r["part"]: (np.frombuffer(r["weights"], np.float32).reshape(router.dim, -1).astype(np.float64), np.frombuffer(r["bias"])) for r in found}
    return {p: m for p, m in found.items() if m[0].shape[1] > 1}


def _tune(rows: DataFrame, router: Router, x: np.ndarray, ids: np.ndarray, k: int) -> None:
    """Set the floor, and the recall it gives, by the true neighbours of x among all rows: a set of queries against all rows, in blocks."""

    def nearest(batches):
        best = None
        for batch in batches:
            batch = batch.take(pa.array(np.flatnonzero(_lengths(batch.column(1)) == router.dim)))
            if not batch.num_rows:
                continue
            y = _vectors(batch.column(1))
            s = x @ y.T
            s[ids[:, None] == batch.column(0).to_numpy()[None, :]] = -np.inf
            leaf = np.broadcast_to(router.leaves(y), s.shape)
            if best is not None:
                s, leaf = np.concatenate([best[0], s], 1), np.concatenate([best[1], leaf], 1)
            if s.shape[1] > k:
                top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                s, leaf = np.take_along_axis(s, top, 1), np.take_along_axis(leaf, top, 1)
            best = s, leaf
        if best is not None:
            q = np.repeat(np.arange(len(x), dtype=np.int32), best[0].shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(best[1].ravel().astype(np.int32)), pa.array(best[0].ravel())], names=["q", "leaf", "score"])

    found = rows.mapInArrow(nearest, "q int, leaf int, score double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "leaf"))
    found = found.withColumn("_r", rank).filter((F.col("_r") <= k) & (F.col("score") > float("-inf"))).select("q", "leaf").toPandas()  # TUNE_ROWS * k
    if not len(found):
        return
    order, _ = router.visits(x, 1)
    left = _left(np.take_along_axis(router.probabilities(x), order, 1))
    place = np.argsort(order, axis=1)
    q, leaf = found["q"].to_numpy(), found["leaf"].to_numpy()
    at = left[q, place[q, leaf]]
    router.floor = float(np.sort(at)[int((1 - RECALL) * len(at))])
    router.recall = float((at >= router.floor).mean())


def _route_rows(batches, router: Router):
    """(vec_id, embedding) with the leaf of each; vectors of other dimensions share leaf -1."""
    for batch in batches:
        if not batch.num_rows:
            continue
        leaf = np.full(batch.num_rows, -1, np.int32)
        mine = np.flatnonzero(_lengths(batch.column(1)) == router.dim)
        if len(mine):
            leaf[mine] = router.leaves(_vectors(batch.column(1).take(pa.array(mine))))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=["vec_id", "embedding", "leaf"])


def _route_queries(batches, router: Router, least_rows: int, all_leaves: bool):
    """(key, embedding) once for each leaf to visit, in order of probability."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            lengths = _lengths(part.column(1))
            odd, mine = np.flatnonzero(lengths != router.dim), np.flatnonzero(lengths == router.dim)
            rows, leaf, place = [odd], [np.full(len(odd), -1)], [np.zeros(len(odd), np.int64)]
            if len(mine):
                order, count = router.visits(_vectors(part.column(1).take(pa.array(mine))), least_rows)
                count = np.full(len(mine), order.shape[1]) if all_leaves else count
                keep = np.arange(order.shape[1])[None, :] < count[:, None]
                r, c = np.nonzero(keep)
                rows, leaf, place = [*rows, mine[r]], [*leaf, order[r, c]], [*place, c]
            taken = part.take(pa.array(np.concatenate(rows)))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(np.concatenate(leaf).astype(np.int32)), pa.array(np.concatenate(place).astype(np.int32))], names=["key", "embedding", "leaf", "place"])


FOUND = "key long, vec_id long, score double"


def _rank(candidates: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """Each query's k nearest ids of a piece, as far as they reach the query's bound."""
    out_q, out_v, out_s = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
    if len(candidates) and len(queries):
        dims, q_dims = _lengths(candidates["embedding"]), _lengths(queries["embedding"])
        for dim in np.unique(dims):
            c, q = candidates.take(pa.array(np.flatnonzero(dims == dim))), queries.take(pa.array(np.flatnonzero(q_dims == dim)))
            if not len(q):
                continue
            ids, x = c["vec_id"].to_numpy(), _vectors(c["embedding"])
            keys, y, bound = q["key"].to_numpy(), _vectors(q["embedding"]), q["bound"].to_numpy()
            several = len(np.unique(ids)) < len(ids)
            for at in range(0, len(keys), 256):
                s = y[at : at + 256] @ x.T
                least = bound[at : at + 256]
                if s.shape[1] > k and not several:
                    least = np.maximum(least, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k])
                # The product only picks: those that may tie with the k-th are summed again, each in the same order.
                slack = np.where(np.isfinite(least), 1e-9 * np.maximum(1.0, np.abs(least)), 0.0)
                row, col = np.nonzero(s >= (least - slack)[:, None])
                exact = np.concatenate([np.empty(0)] + [(y[at + row[i : i + 100_000]] * x[col[i : i + 100_000]]).sum(1) for i in range(0, len(row), 100_000)])
                good = exact >= bound[at : at + 256][row]
                row, col, exact = row[good], ids[col[good]], exact[good]
                order = np.lexsort((col, -exact, row))
                row, col, exact = row[order], col[order], exact[order]
                if several:  # an id with several vectors counts by its nearest
                    _, first = np.unique(np.stack([row, col]), axis=1, return_index=True)
                    first.sort()
                    row, col, exact = row[first], col[first], exact[first]
                nth = np.arange(len(row)) - np.searchsorted(row, row)
                top = nth < k
                out_q.append(keys[at + row[top]])
                out_v.append(col[top])
                out_s.append(exact[top])
    return pa.table({"key": pa.array(np.concatenate(out_q)), "vec_id": pa.array(np.concatenate(out_v)), "score": pa.array(np.concatenate(out_s))})


def _distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """rows without repeats, and of an often repeated vector only the k least ids: others can't be among any k nearest."""
    rank = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    return rows.distinct().withColumn("_r", rank).filter(F.col("_r") <= k).drop("_r")


def search(rows: DataFrame, queries: DataFrame, router: Router | None, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest rows found, itself (its id) left out; all candidates where there are fewer.

    Rows and queries are those of usable(). A row that repeats an id and a vector counts once; an id that stands on rows of several
    vectors is listed once, by the nearest of them found; a query whose id does is searched once, by the least of its vectors. Vectors of other
    dimensions are compared among themselves. Queries with the same vector are searched once. Empty tables: empty result.
    """
    spark = rows.sparkSession
    if router is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n = k + 1  # one of them may be the query itself
    own = materialize(_distinct_vectors(rows, n).mapInArrow(lambda b: _route_rows(b, router), "vec_id long, embedding array<double>, leaf int"), "vectors_by_leaf")
    sizes = {r["leaf"]: r["n"] for r in own.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # a row for each leaf: TOP_PARTS * LEAVES at most
    router.sizes = np.array([sizes.get(i, 0) for i in range(router.starts()[-1])])
    asked = queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit(7), "embedding"))
    asked = materialize(asked, "queries")
    # Equal vectors are asked once, under their least id.
    heads = asked.groupBy("h1", "h2").agg(F.min_by("embedding", "vec_id").alias("embedding"), F.min("vec_id").alias("key"), F.count("*").alias("n"))
    heads = materialize(heads, "query_vectors")

    def visits(keys: DataFrame, all_leaves: bool = False) -> DataFrame:
        return keys.select("key", "embedding").mapInArrow(lambda b: _route_queries(b, router, n, all_leaves), "key long, embedding array<double>, leaf int, place int")

    def visit(calls: DataFrame) -> DataFrame:
        """What the leaves send: each of a leaf's pieces meets each group of its queries once."""
        return _visit(own, calls, sizes, n)

    far = F.lit(float("-inf"))
    calls = materialize(visits(heads), "visits")
    first = materialize(visit(calls.filter(F.col("place") < FIRST_VISITS).withColumn("bound", far)), "first_found")
    bounds = _nearest(first, n).groupBy(F.col("key").alias("_key")).agg(F.when(F.count("*") >= n, F.min("score")).otherwise(far).alias("_bound"))
    later = calls.filter(F.col("place") >= FIRST_VISITS).join(bounds, F.col("key") == F.col("_key"), "left").withColumn("bound", F.coalesce("_bound", far)).drop("_key", "_bound")
    found = materialize(_nearest(first.unionByName(visit(later)), n), "found")
    # Leaves that hold rows enough may hold fewer ids (ids of several vectors): such queries ask all leaves.
    near = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id", "score"))).alias("near")
    lists = found.groupBy("key").agg(near)
    short = heads.join(lists.select("key", F.size("near").alias("_n")), "key", "left").filter(F.coalesce("_n", F.lit(0)) < n)
    if sum(sizes.values()) > n and len(sizes) > 1 and short.limit(1).count():
        again = _nearest(visit(visits(short, True).withColumn("bound", far)), n)
        lists = found.join(short.select("key"), "key", "left_anti").unionByName(again).groupBy("key").agg(near)
    table = materialize(heads.select("h1", "h2", "key", "n").join(lists, "key").select("h1", "h2", "near", "n"), "found_lists")
    placed = attach_by_hash(asked.select(F.col("vec_id").alias("query_id"), "h1", "h2"), table, F.xxhash64("query_id"), "near", "n")
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return placed.select("query_id", F.posexplode(others).alias("_at", "_x")).select("query_id", (F.col("_at") + 1).alias("rank"), "_x.vec_id", "_x.score")


def _nearest(found: DataFrame, n: int) -> DataFrame:
    """The n nearest ids of each key, ties to the smaller id, each id once."""
    best = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    once = found.groupBy("key", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= n).drop("_r")


def _visit(own: DataFrame, calls: DataFrame, sizes: dict[int, int], n: int) -> DataFrame:
    grid = calls.groupBy("leaf").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("groups"))
    pieces = own.sparkSession.createDataFrame([(a, -(-b // PIECE_ROWS)) for a, b in sorted(sizes.items())], "leaf int, pieces int")
    grid = F.broadcast(grid.join(F.broadcast(pieces), "leaf"))  # a row for each leaf: TOP_PARTS * LEAVES at most
    cells = own.join(grid, "leaf").withColumn("piece", F.pmod(F.xxhash64("vec_id"), "pieces").cast("int")).withColumn("grp", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    guests = calls.join(grid, "leaf").withColumn("grp", F.pmod(F.xxhash64("key"), "groups").cast("int")).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    names = ["leaf", "piece", "grp"]
    left, right = cells.select(*names, "vec_id", "embedding").groupBy(*names), guests.select(*names, "key", "embedding", "bound").groupBy(*names)
    return left.cogroup(right).applyInArrow(lambda a, b: _rank(a, b, n), FOUND)
