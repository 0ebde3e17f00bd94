"""Every catalogue query with SQL gives what DuckDB gives."""

import math

import duckdb
import pytest

from progdiv.plans.catalogue import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, bool):
        return str(x)
    return repr(float(x)) if isinstance(x, (int, float)) else str(x)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    rel = duck.execute(SQL[name])
    columns = [d[0] for d in rel.description]
    rows = rel.fetchall()
    assert sorted(columns) == sorted(got.columns)
    order = sorted(columns)
    want = sorted(repr([plain(r[columns.index(c)]) for c in order]) for r in rows)
    have = sorted(repr([plain(r[c]) for c in order]) for r in got.collect())
    assert want == have


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 150
    assert set(e.oracle_sql()) <= set(e.queries())


def test_record_types_are_grouped_where_they_are(spark, sf):
    """Lines are dealt by order and orders by problem; nothing that is made of them is dealt again."""
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"]
    old = [spark.conf.get(n) for n in names]
    try:
        spark.conf.set(names[0], "-1")
        spark.conf.set(names[1], "false")
        plan = QUERIES["recordtype_report"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        for n, v in zip(names, old, strict=True):
            spark.conf.set(n, v)
    assert plan.count("Exchange hashpartitioning") <= 3


@pytest.mark.parametrize("name", ["summary_describe", "leaderboard_scaled", "recordtype_report", "pairwise_semantic_diversity", "coherence_by_generation", "accuracy_by_problem"])
def test_no_row_an_output_is_made(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode(" not in plan and "explode(sequence(" not in plan and "format_string(" not in plan
