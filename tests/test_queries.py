"""Every query of the engine against its SQL in DuckDB, on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry
from framelark.llm.common import settings
from framelark.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


#: Dimensions that stand in the code.
STATIC = {"dim_chains", "dim_depths", "bc_opcodes"}


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, decimal.Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, sf, oracle, name):
    df = catalog.QUERIES[name](spark, sf)
    assert name in STATIC or df.inputFiles()  # every query reads tables
    expected = oracle.execute(catalog.SQL[name])
    columns = [d[0] for d in expected.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, expected.fetchall())


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)


@pytest.mark.parametrize("name", ["merge_possible_observed", "map_function", "flagship", "review_checks", "sort_merged"])
def test_frames_and_edges_are_made_once(spark, sf, name):
    plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= (20 if name in ("flagship", "review_checks") else 10), plan.count("FileScan parquet")


@pytest.mark.parametrize("name", ["join_range_segment", "topk_frame_cap", "discover_range", "discover_router", "rank_interleave"])
def test_segments_need_no_nested_loop(spark, sf, name):
    assert "NestedLoop" not in catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["norm_method_fallback", "norm_nested_frame", "scan_tx_nested"])
def test_nested_traces_have_no_row_limit(spark, sf, oracle, name):
    """With the bound that Spark sets on the rows of a recursion lowered far below those of the smallest tables."""
    with settings(spark, spark__sql__cteRecursionRowLimit="50"):
        test_equals_sql(spark, sf, oracle, name)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_push_filters_and_prune_columns(spark, sf):
    plan = catalog.QUERIES["src_code_lookup"](spark, sf)._jdf.queryExecution().toString()
    assert "EqualTo(p_partkey,7)" in plan and "ReadSchema: struct<p_partkey:bigint,p_name:string>" in plan
