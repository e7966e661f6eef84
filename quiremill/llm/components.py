"""Connected components of an edge table, by stars; nothing of it reaches the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiremill.llm.common import attach_by_hash, materialize

#: So many edges (a few MB) are finished in one task; more go on in rounds over all executors.
ONE_TASK_EDGES = 200_000
EDGE = "a long, b long"


def _contract(batches):
    """Union-find over one partition's edges: gives a star for each component it sees."""
    import pyarrow as pa

    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    stars = [(x, find(x)) for x in parent]
    stars = [(x, r) for x, r in stars if x != r]
    for at in range(0, len(stars), 50_000):
        part = stars[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], pa.int64()), pa.array([r for _, r in part], pa.int64())], names=["a", "b"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: every node's neighbours (the larger ones, or the others) point to its least neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy(F.col("a").alias("h1"), F.lit(0).cast("long").alias("h2")).agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
    least = materialize(least, "least_neighbours")
    keyed = both.withColumn("h1", F.col("a")).withColumn("h2", F.lit(0).cast("long"))
    joined = attach_by_hash(keyed, least, F.xxhash64("b"), "m", "n").select("a", "b", "m")  # a component's centre is a hot key
    if large:
        return joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
    inner = joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select(F.col("h1").alias("a"), F.col("m").alias("b"))
    return inner.unionByName(own).filter("a <> b").distinct()


def components(edges: DataFrame, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """node, root: the least node of its component, for each node that an edge (a, b) names.

    Loops, repeats and either direction are fine; nulls are left out; no edges: empty result.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b")
    stars = materialize(edges.mapInArrow(_contract, EDGE), "stars")
    if stars.count() <= one_task:
        found = materialize(stars.coalesce(1).mapInArrow(_contract, EDGE), "roots")
    else:
        found = stars
        seen = None
        while True:
            found = materialize(_star(_star(found, True), False), "stars")
            now = found.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if now == seen:
                break
            seen = now
    nodes = found.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(found.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
