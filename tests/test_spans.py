"""Overlapping spans: instants, touching ends and reversed spans, against the plain rule."""

import datetime as dt

import duckdb

from quarrymeter.operators import projects
from quarrymeter.plans import catalog


def test_overlaps_follow_the_plain_rule(spark):
    at = [dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(minutes=m) for m in (0, 30, 60, 90, 120, 600)]
    ends = [(i, j) for i in range(6) for j in range(6)]
    rows = [(k, n, at[i], at[j]) for k in (1, 2) for n, (i, j) in enumerate(ends)]
    got = sorted(tuple(r) for r in projects.overlaps(spark.createDataFrame(rows, "k int, id int, s timestamp, e timestamp"), "k", "s", "e", 3600).collect())
    want = sorted((k, a, b) for k in (1, 2) for a, (s, e) in enumerate(ends) for b, (t, f) in enumerate(ends) if a < b and s < f and t < e)
    assert got == want


def test_span_of_no_length_inside_another(spark, tmp_path):
    rows = "(0, TIMESTAMP '2024-01-01 00:00:00', 1, 90.0), (1, TIMESTAMP '2024-01-01 00:30:00', 1, 0.0), (2, TIMESTAMP '2024-01-01 01:30:00', 1, 0.0), (3, TIMESTAMP '2024-01-01 00:00:00', 1, 0.0)"
    duck = duckdb.connect()
    duck.execute(f"create table events as select * from (values {rows}) t(event_id, ts, user_id, value)")
    duck.execute(f"copy (select event_id::bigint event_id, ts, user_id::bigint user_id, value::double as value from events) to '{tmp_path}/events.parquet'")
    got = sorted(tuple(r) for r in catalog.QUERIES["span_overlaps"](spark, str(tmp_path)).collect())
    assert got == sorted(duck.sql(catalog.ORACLE_SQL["span_overlaps"]).fetchall()) == [(1, 0, 1)]
