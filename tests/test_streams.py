"""Job states with timers and lanes that come late or never, over restarts."""

import itertools

import pytest
from pyspark.sql import functions as F

from quarrymeter.streaming import live

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_n = itertools.count()


@pytest.fixture(autouse=True)
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    yield
    spark.conf.set(key, was)


class Feed:
    """Rows put into a folder, and a query over it that is stopped and started again for each drain."""

    def __init__(self, spark, tmp, schema, build, mode):
        self.spark, self.tmp, self.schema, self.build, self.mode = spark, tmp, schema, build, mode

    def put(self, folder, *rows):
        df = self.spark.createDataFrame(rows, self.schema[folder])
        times = [c for c, t in df.dtypes if c.endswith("at") and t == "string"]
        df.withColumns({c: F.col(c).cast("timestamp") for c in times}).coalesce(1).write.mode("append").parquet(str(self.tmp / folder))

    def drain(self):
        streams = [self.spark.readStream.schema(s.replace("at string", "at timestamp")).parquet(str(self.tmp / f)) for f, s in self.schema.items()]
        got = []

        def keep(batch, _):
            got.extend(batch.collect())

        q = self.build(*streams).writeStream.outputMode(self.mode).option("checkpointLocation", str(self.tmp / "cp")).foreachBatch(keep).start()
        q.processAllAvailable()
        q.stop()
        return got


def test_jobs_fail_after_silence_and_keep_state_over_restarts(spark, tmp_path):
    feed = Feed(spark, tmp_path, {"jobs": "job string, state string, seq long, at string"}, lambda s: live.job_states(s, budget="30 minutes", late="1 minute"), "update")
    feed.put("jobs", ("a", "queued", 1, "2024-01-01 00:00:00"), ("a", "cloning", 2, "2024-01-01 00:01:00"), ("a", "completed", 3, "2024-01-01 00:02:00"), ("b", "cloning", 1, "2024-01-01 00:00:00"), ("c", "queued", 1, "2024-01-01 00:00:00"), ("d", "queued", None, "2024-01-01 00:00:00"))
    assert {tuple(r) for r in feed.drain()} == {("a", "cloning", 1, None), ("b", "", 1, None), ("c", "queued", 0, None), ("d", "", 1, None)}
    # after a restart the machine goes on, a repeated event is refused, and news move the deadline
    feed.put("jobs", ("a", "cloning", 2, "2024-01-01 00:01:30"), ("a", "measuring", 4, "2024-01-01 00:20:00"))
    assert {tuple(r) for r in feed.drain()} == {("a", "measuring", 2, None)}
    feed.put("jobs", ("e", "queued", 1, "2024-01-01 00:40:00"))
    assert {tuple(r) for r in feed.drain()} == {("e", "queued", 0, None), ("c", "failed", 0, "no_news_within_budget")}
    feed.put("jobs", ("a", "completed", 5, "2024-01-01 00:45:00"), ("c", "cloning", 2, "2024-01-01 00:45:00"))
    assert {tuple(r) for r in feed.drain()} == {("a", "completed", 2, None), ("c", "failed", 1, None)}
    feed.put("jobs", ("f", "queued", 1, "2024-01-02 00:00:00"))
    assert {tuple(r) for r in feed.drain()} == {("f", "queued", 0, None), ("e", "failed", 0, "no_news_within_budget")}


def test_a_lane_that_never_comes_is_null_once(spark, tmp_path):
    feed = Feed(
        spark, tmp_path, {"asked": "repo string, asked_at string", "told": "repo string, measured_at string, value long"},
        lambda e, m: live.late_lanes(e, m, "repo", within="1 hour", late="10 minutes").select("repo", "value", "reason"), "append",
    )
    feed.put("asked", ("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:00:00"), ("c", "2024-01-01 00:00:00"))
    feed.put("told", ("a", "2024-01-01 00:10:00", 7), ("x", "2024-01-01 00:10:00", 9))
    assert [tuple(r) for r in feed.drain()] == [("a", 7, None)]
    feed.put("told", ("b", "2024-01-01 00:50:00", 0))  # late, but within the hour, after a restart
    assert [tuple(r) for r in feed.drain()] == [("b", 0, None)]
    feed.put("asked", ("d", "2024-01-01 03:00:00"))
    feed.put("told", ("d", "2024-01-01 03:00:01", 1))
    assert {tuple(r) for r in feed.drain()} == {("d", 1, None), ("c", None, "lane_never_came")}
    feed.put("asked", ("e", "2024-01-01 09:00:00"))
    feed.put("told", ("e", "2024-01-01 09:00:00", 2))
    assert {tuple(r) for r in feed.drain()} == {("e", 2, None)}
