"""Every query with SQL against DuckDB on the smallest driver tables."""

import math
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if type(v).__name__ == "Decimal":
        return float(f"{float(v):.9g}")
    return v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    found = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in sorted(names))) for r in found.fetchall())
    got = sorted(repr(tuple(plain(x) for x in r)) for r in df.select(*sorted(names)).collect())
    assert got == want


def test_number_gaps_on_odd_orders(spark, tmp_path):
    """Orders of no customer, keys below zero, beyond 2^53, null and repeated; then a span too wide to generate its numbers."""
    import duckdb

    big = 2**63 - 1
    rows = [(None, 100), (None, 350), (None, 640), (None, None), (1, -250), (1, -50), (1, 420), (2, big), (2, big - 250), (3, None), (4, 5), (5, 100), (5, 100), (5, 130), (5, 301), (6, -199), (6, 100)]
    path = f"{tmp_path}/odd/orders.parquet"
    spark.createDataFrame(rows, "o_custkey long, o_orderkey long").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{path}/*.parquet'")
    want = con.execute(entry.oracle_sql()["number_gaps"]).fetchall()
    df = entry.queries()["number_gaps"](spark, f"{tmp_path}/odd")
    assert df.columns == ["o_custkey", "missing", "first_missing"] and {t for _, t in df.dtypes} == {"bigint"}
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in df.collect()) and len(want) == 5
    spark.createDataFrame([(1, 0), (1, 10**15), (2, 0), (2, 99)], "o_custkey long, o_orderkey long").write.parquet(f"{tmp_path}/wide/orders.parquet")
    assert [tuple(r) for r in entry.queries()["number_gaps"](spark, f"{tmp_path}/wide").collect()] == [(1, 10**13 - 1, 1)]


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql()) - {"pipeline"}))
def test_query_runs(spark, name):
    df = entry.queries()[name](spark, SF)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 200 and "lang_pred" in df.columns
