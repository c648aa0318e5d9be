"""Every registered query with SQL gives what DuckDB gives, on the smallest test tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def cells(df, columns):
    text = lambda v: "" if v is None or v != v else repr(round(float(v), 9)) if isinstance(v, float) else str(v)
    return sorted(tuple(text(v) for v in row) for row in df[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    want, got = db.sql(entry.oracle_sql()[name]).df(), entry.queries()[name](spark, DIR).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    assert cells(got, columns) == cells(want, columns)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert entry.queries()[name](spark, DIR).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 100
