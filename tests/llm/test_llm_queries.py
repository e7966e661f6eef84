"""Every query of the subpackage on empty tables and on tables of edge cases; the contracts' columns and types."""

import pytest

from quiremill.llm.queries import QUERIES

COLUMNS = {
    "op2_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op4_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op5_nearest": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op6_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op7_mpeg_audio": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
    "op8_near_dedup": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op9_line_dedup": {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "kept_sha256": "string"},
    "op10_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
}


@pytest.fixture(scope="module")
def folders(spark, edge, tmp_path_factory):
    labels = spark.createDataFrame([(1, 0, 1), (4, 1, 1), (5, 1, 0), (7, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    vectors = spark.createDataFrame([(0, [1.0, 2.0], 1), (20, [1.0, 2.0], 1), (None, [1.0, 1.0], 1), (3, None, 1), (40, [0.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    out = {}
    for kind, keep in (("full", "true"), ("empty", "false")):
        at = tmp_path_factory.mktemp(kind)
        for name, df in (("documents", edge), ("labels", labels), ("embeddings", vectors)):
            df.filter(keep).write.parquet(f"{at}/{name}.parquet")
        out[kind] = str(at)
    return out


@pytest.mark.parametrize("name", QUERIES)
def test_edges(spark, edge, folders, name):
    df = QUERIES[name](spark, folders["full"])
    types = dict(df.dtypes)
    assert {k: types[k] for k in COLUMNS.get(name, {})} == COLUMNS.get(name, {})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    rows = df.count()
    if name == "op5_nearest":
        assert [(r.query_id, r.rank, r.vec_id, r.score) for r in df.orderBy("query_id").collect()] == [(0, 1, 20, 5.0), (20, 1, 0, 5.0)]
    elif name != "op3_substring_dedup":
        assert rows == edge.count()


@pytest.mark.parametrize("name", QUERIES)
def test_empty(spark, folders, name):
    assert QUERIES[name](spark, folders["empty"]).count() == 0
