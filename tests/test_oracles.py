"""Every registered query with SQL is compared with DuckDB on the same tables, values and names alike."""

import math
import os

import duckdb
import pytest

from millrace.registry import COVERS, ORACLE_SQL, QUERIES, load

load()

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "is_finite"):
        return round(float(v), 6)
    return v.isoformat() if hasattr(v, "isoformat") else v


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(plain(r[i])) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    cursor = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert len(got) == len(want)
    a, b = normal(df.columns, got), normal(names, want)
    assert a == b, next((x, y) for x, y in zip(a, b) if x != y)
    assert got, "no rows: the query shows nothing on these tables"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_every_query_names_what_it_covers():
    assert set(COVERS) == set(QUERIES)
