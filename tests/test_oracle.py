"""Every query that SQL can express against DuckDB on the smallest tables, and the others for rows and invariants."""

from __future__ import annotations

import math

import duckdb
import pytest

from foliospark.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Digits by which two engines' sums of doubles may differ, and not more.
CLOSE = 2e-6


@pytest.fixture(scope="module")
def duck(data_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data_dir}/{t}.parquet'")
    return con


def key(row):
    return tuple((v is None, "" if isinstance(v, float) or v is None else type(v).__name__, 0 if v is None or isinstance(v, float) else v) for v in row)


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=CLOSE, abs_tol=CLOSE)
    return a == b


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_against_sql(name, spark, duck, data_dir):
    df = catalog.QUERIES[name](spark, data_dir)
    want = duck.sql(catalog.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    rows = sorted(want.select(*(duckdb.ColumnExpression(c) for c in columns)).fetchall(), key=key)
    assert len(got) == len(rows)
    assert all(same(x, y) for a, b in zip(got, rows, strict=True) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(name, spark, data_dir):
    assert catalog.QUERIES[name](spark, data_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())
