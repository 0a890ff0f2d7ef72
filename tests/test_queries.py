"""Every registered query with SQL gives DuckDB's rows; every query keeps a stable schema."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from waymark.jobs.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_each_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, sf_dir, duck, name):
    frame = QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    mine = sorted(repr(tuple(r[c] for c in columns)) for r in frame.collect())
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert mine == sorted(repr(tuple(dict(zip(names, r, strict=True))[c] for c in columns)) for r in result.fetchall())


def test_entry(spark):
    frame = __spark_entry__.entry(spark)
    assert frame.columns == ["node", "direction", "target"] and frame.count() > 0


def test_prefix_joins_are_no_nested_loops(spark, sf_dir):
    for name in ("territory_owner", "contains_tree", "exhaustiveness", "owning_chain_claims", "chain_budget", "heading_lookup"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name
