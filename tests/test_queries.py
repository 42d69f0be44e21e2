"""Every registered query with SQL gives what the SQL gives, on the smallest tables."""

import math
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry_points  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
QUERIES, SQL = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def duck(testdata):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{testdata}/{t}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if hasattr(value, "isoformat"):
        return value.isoformat().removesuffix("T00:00:00")
    return repr(float(value)) if isinstance(value, (int, float)) else str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
    own = {q for q in set(QUERIES) - set(SQL) if QUERIES[q].__module__.startswith("registry")}
    assert own == {"classifier_train", "stacked_ensemble", "score_splits"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, testdata, name):
    df = QUERIES[name](spark, testdata)
    result = duck.execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert table(df.columns, df.collect()) == table(columns, result.fetchall())


def test_entry(spark, testdata):
    assert entry_points.entry(spark).count() > 0
