"""Every query against its SQL, or for sane rows where SQL cannot say it."""

from __future__ import annotations

import os

import duckdb
import pytest

from roadkrige import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(v + 0.0)
    return repr(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df, want = catalog.queries()[name](spark, SF), duck.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    types = dict(zip(want.columns, map(str, want.types), strict=True))
    assert {c: TYPES[t] for c, t in df.dtypes if t in TYPES} == {c: types[c] for c, t in df.dtypes if t in TYPES}
    order = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    at = [want.columns.index(c) for c in order]
    assert rows == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_gives_rows(spark, name):
    df = catalog.queries()[name](spark, "/root/testdata/sf0.01")
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 200
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["roads_left_aadt", "frontage_pivot", "centroid_count_300", "virtual_links_500", "population_wmean", "road_density_r300"])
def test_no_join_compares_all_pairs(spark, name):
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["centroid_count_300", "virtual_links_500"])
def test_a_centroid_is_worked_out_once(spark, name):
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString().splitlines()
    walks = [line for line in plan if "aggregate(" in line]
    assert walks and all("Generate explode" in line and line.count(" aggregate(") == 1 for line in walks)
