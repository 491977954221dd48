"""Every registered query of the engine against its SQL in DuckDB, on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from folioquery.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()
#: Queries that SQL can't express, and the tests that hold their values against brute force or hand-made cases.
OTHERWISE = {
    "search_timings": "test_values", "search_snippets": "test_values", "search_explanations": "test_values", "answers": "test_values", "nation_search": "test_values", "settings_search": "test_values", "retrieval_quality_modes": "test_whole_results",
    "character_errors": "test_whole_results", "variant_sweep": "test_evaluation", "name_search": "test_names", "piece_ids": "test_vocabulary", "watched_sessions": "test_streaming",
}


def norm(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, decimal.Decimal):
        return round(float(x), 6)
    if isinstance(x, (list, tuple)):
        return tuple(map(norm, x))
    return x.replace(tzinfo=None) if isinstance(x, datetime.datetime) else x


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(map(norm, r)) for r in df.select(*columns).collect()), key=repr)
    if name in SQL:
        found = duck.execute(SQL[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        assert got == sorted((tuple(norm(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    else:
        assert got and name in OTHERWISE


def test_plans_stay_in_the_jvm_and_prune_columns(spark, sf):
    for name in ("ledger_buckets", "bm25", "reconcile"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().toString()
        assert "Python" not in plan and "MapInArrow" not in plan and "CartesianProduct" not in plan
    plan = QUERIES["hybrid_search"](spark, sf)._jdf.queryExecution().toString()
    assert plan.count("MapInArrow") and "CartesianProduct" not in plan  # vectors are multiplied with the queries where they lie, without a join
    plan = QUERIES["bm25"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(term" in plan or "StartsWith(term" in plan  # the stored index is read by token
    plan = QUERIES["content_hashes"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_each_query_has_sql_or_other_tests():
    assert set(QUERIES) - set(SQL) == set(OTHERWISE)
