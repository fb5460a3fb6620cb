"""Operators that SQL can express give DuckDB's rows on the smallest tables."""

import duckdb
import pytest

from quarrymeter.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "sales"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    exp = c.sql(queries.ORACLE_SQL[name])
    names = list(exp.columns)
    assert sorted(names) == sorted(df.columns)
    assert sorted((tuple(r[n] for n in names) for r in df.collect()), key=str) == sorted(exp.fetchall(), key=str)
