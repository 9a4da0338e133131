"""Each registered query of the archive operators against DuckDB over the same tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from palaver.plans.registry import ORACLE_SQL, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return round(float(v), 6)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    result = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in sorted(names))) for r in df.collect())
    want = sorted(repr(tuple(plain(v) for _, v in sorted(zip(names, r, strict=True)))) for r in result.fetchall())
    assert got == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() >= 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
