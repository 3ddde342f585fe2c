"""Every query of the catalogue against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from glosswork.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    got = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(df.columns) == sorted(got.columns)
    cols = sorted(df.columns)
    mine = sorted(tuple(plain(v) for v in r) for r in df.select(*cols).collect())
    theirs = sorted(tuple(plain(v) for v in r) for r in got.select(*[f'"{c}"' for c in cols]).fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    if os.path.isdir(DATA):
        assert entry.entry(spark).count() > 0
