"""Structured Streaming: incremental commits, windows, sessions, job states with timers, lanes that come late or never."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQueryListener


def distinct_commits(stream: DataFrame, ts: str = "ts", late: str = "30 days") -> DataFrame:
    """Commits once each, within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(["repo", "sha"])


def daily_counts(stream: DataFrame, key: str, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Events a day and key; late ones count until the watermark passes."""
    w = F.window(ts, "1 day")
    return stream.withWatermark(ts, late).groupBy(w, key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), key, "n")


def sliding_counts(stream: DataFrame, key: str, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Seven-day counts that slide by a day."""
    w = F.window(ts, "7 days", "1 day")
    return stream.withWatermark(ts, late).groupBy(w, key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def bursts(stream: DataFrame, key: str, gap: str = "2 days", ts: str = "ts", late: str = "2 days") -> DataFrame:
    """Sessions of a key that a gap ends."""
    w = F.session_window(ts, gap)
    return stream.withWatermark(ts, late).groupBy(w, key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


#: Job states and the states that may follow.
JOB_STATES = {"queued": ("cloning", "failed"), "cloning": ("measuring", "failed"), "measuring": ("completed", "failed"), "completed": (), "failed": ()}


class JobProcessor(StatefulProcessor):
    """State machine of one job: its state and last number are state variables, a timer ends a job that stays silent.

    Events are taken in the order of seq. One that may not follow, or whose number isn't above the
    last one taken, is refused. Every event that is taken moves the job's deadline to its
    own time plus the budget; when the watermark passes it, an open job fails.
    """

    def __init__(self, budget_ms: int):
        self.budget = budget_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "state string, seq long, refused long, deadline long")

    def handleInputRows(self, key, rows, timerValues):
        state, seq, refused, deadline = self.job.get() if self.job.exists() else ("", None, 0, None)
        old = deadline
        for r in sorted(rows, key=lambda r: (r.seq is None, r.seq)):
            follows = (state == "" and r.state == "queued") or r.state in JOB_STATES.get(state, ())
            if r.seq is None or (seq is not None and r.seq <= seq) or not follows:
                refused += 1
                continue
            state, seq = r.state, r.seq
            if r.at_ms is not None:
                deadline = max(deadline or 0, r.at_ms + self.budget)
        if not JOB_STATES.get(state):
            deadline = None  # ended, or never begun
        if deadline != old:
            if old is not None:
                self.handle.deleteTimer(old)
            if deadline is not None:
                self.handle.registerTimer(deadline)
        self.job.update((state, seq, refused, deadline))
        yield Row(job=key[0], state=state, refused=refused, reason=None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        state, seq, refused, deadline = self.job.get()
        if deadline == expiredTimerInfo.getExpiryTimeInMs() and JOB_STATES.get(state):
            self.job.update(("failed", seq, refused, None))
            yield Row(job=key[0], state="failed", refused=refused, reason="no_news_within_budget")

    def close(self) -> None:
        pass


def job_states(events: DataFrame, budget: str = "1 hour", ts: str = "at", late: str = "10 minutes") -> DataFrame:
    """State of each job after its events (job, state, seq, at), how many were refused, and why it was ended; in update mode.

    A job without news for longer than ``budget`` fails. Needs Spark's RocksDB state store.
    """
    timed = events.withWatermark(ts, late).select("job", "state", "seq", ts, F.unix_millis(ts).alias("at_ms"))
    budget_ms = int(pd.Timedelta(budget).total_seconds() * 1000)
    return timed.groupBy("job").transformWithState(JobProcessor(budget_ms), "job string, state string, refused long, reason string", "update", "EventTime")


def late_lanes(expected: DataFrame, measured: DataFrame, key: str, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Every expected lane (key, asked_at) with what was measured for it (key, measured_at, ...), once.

    A measurement counts if it comes within ``within`` of the request. A lane for which none has
    come when the watermark passes that time has null columns and a reason. Append mode.
    """
    e = expected.withWatermark("asked_at", late).alias("e")
    m = measured.withColumnRenamed(key, "_key").withWatermark("measured_at", late).alias("m")
    on = (F.col(f"e.{key}") == F.col("m._key")) & (F.col("measured_at") >= F.col("asked_at")) & (F.col("measured_at") <= F.col("asked_at") + F.expr(f"interval {within}"))
    reason = F.when(F.col("_key").isNull(), "lane_never_came")
    return e.join(m, on, "left_outer").withColumn("reason", reason).drop("_key")


def write_once(df: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = ("repo", "sha")):
    """Start an idempotent sink: a batch that is replayed overwrites its own folder."""

    def put(batch: DataFrame, epoch: int) -> None:
        batch.dropDuplicates(list(keys)).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def log_tail(spark: SparkSession, folder: str) -> DataFrame:
    """(job, line) of the logs in a folder, as they come; a log is named after its job."""
    lines = spark.readStream.text(f"{folder.rstrip('/')}/*.log")
    return lines.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.log$", 1).alias("job"), F.col("value").alias("line"))


class Heartbeat(StreamingQueryListener):
    """Rows that each query has read so far, and whether it is still running, from its progress events."""

    def __init__(self):
        self.rows: dict[str, int] = {}
        self.running: set[str] = set()

    def onQueryStarted(self, event):
        self.running.add(str(event.id))

    def onQueryProgress(self, event):
        p = event.progress
        self.rows[str(p.id)] = self.rows.get(str(p.id), 0) + p.numInputRows

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.running.discard(str(event.id))
