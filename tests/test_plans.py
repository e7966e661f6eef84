"""Plans: no query multiplies rows by a nested loop; filters and columns reach the scan; top-k stays a top-k."""

import os

import pytest

from quiremill.plans import ALL
from quiremill.plans.registry import Tables

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")


def plan(spark, name):
    return ALL[name].run(Tables(spark, SF))._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(ALL))
def test_no_nested_loops(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    if ALL[name].sql:
        assert "BatchEvalPython" not in text  # no row-at-a-time Python


def test_scan_gets_filters_and_columns(spark):
    text = plan(spark, "rel_pricing")
    assert "PushedFilters: [IsNotNull(l_shipdate), LessThanOrEqual(l_shipdate" in text
    assert "l_orderkey" not in text.split("ReadSchema", 1)[1]


def test_top_k_is_one_operator(spark):
    assert "TakeOrderedAndProject" in plan(spark, "catalog_search")
    assert "TakeOrderedAndProject" in plan(spark, "corpus_changes")


def test_no_data_is_fine(spark, tmp_path):
    """Every query runs on empty tables."""
    for name in os.listdir(SF):
        spark.read.parquet(f"{SF}/{name}").limit(0).write.parquet(str(tmp_path / name))
    for name, q in ALL.items():
        rows = q.run(Tables(spark, str(tmp_path))).count()
        assert rows <= 5, name
