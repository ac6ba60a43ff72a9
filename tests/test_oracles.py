"""Every query with DuckDB text against it, on the smallest tables."""

import os

import duckdb
import pytest

from cartolith.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def text(v):
    if v is None:
        return "~"
    return f"{v + 0.0:.5g}" if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_like_duckdb(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    r = duck.sql(registry.oracle_sql()[name])
    assert sorted(r.columns) == columns
    at = [r.columns.index(c) for c in columns]
    want = sorted(tuple(text(row[i]) for i in at) for row in r.fetchall())
    assert sorted(tuple(text(row[c]) for c in columns) for row in df.collect()) == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() >= 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_hash_embedding_is_of_every_point_and_component(spark):
    rows = registry.queries()["hash_embedding"](spark, SF).groupBy("feature_id").count().collect()
    assert len(rows) == spark.read.parquet(f"{SF}/customer.parquet").count() and {r["count"] for r in rows} == {384}
