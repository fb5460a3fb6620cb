"""Run estimates at their caps, as the SQL of the query states them."""

import duckdb
import pytest

from quarrymeter.plans import catalog, repo_catalog  # noqa: F401


def test_durations_at_the_cap_of_the_lane(spark, tmp_path):
    duck = duckdb.connect()
    duck.execute(f"copy (select i::bigint as event_id, 5.0::double as value from unnest([1, 999, 1198333, 1198334, 1198335, 1198336, 5999997]) t(i)) to '{tmp_path}/events.parquet'")
    duck.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    got = sorted(tuple(r) for r in catalog.QUERIES["durations"](spark, str(tmp_path)).collect())
    assert [r[2] for r in got if r[0] == 1198334] == [3600.0]
    exp = sorted(duck.sql(catalog.ORACLE_SQL["durations"]).fetchall())
    assert [r[:2] for r in got] == [r[:2] for r in exp]
    assert [r[2:] for r in got] == [pytest.approx(r[2:]) for r in exp]
