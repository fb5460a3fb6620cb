"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

from quarrymeter.plans import catalog

SF = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str)
    exp = duck.sql(catalog.ORACLE_SQL[name])
    names = list(exp.columns)
    assert sorted(names) == cols
    assert sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in exp.fetchall()), key=str) == got


def test_entry_without_llm(spark):
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries())
    assert e.entry(spark).count() > 0
