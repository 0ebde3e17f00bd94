"""Every query of the subpackage with SQL gives what DuckDB gives."""

import math

import duckdb
import pytest

from progdiv.llm.queries import QUERIES, SQL

TABLES = ("documents", "embeddings", "conversations")


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
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
