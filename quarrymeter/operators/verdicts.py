"""Verdicts that combine deterministic figures with a judgement, and what happens when one of them fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import clamp


def choose_ref(candidates: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """The ref to analyse: the judged index if it is one, else most commits, then bytewise first name.

    candidates: (key, idx, ref, commits); answers: (key, choice as text). Modes are
    agentic and deterministic; a null choice is a failed judgement.
    """
    w = Window.partitionBy(key).orderBy(F.desc("commits"), "ref")
    ranked = candidates.withColumn("_r", F.row_number().over(w)).withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    j = ranked.join(answers, key, "left")
    top = F.col("_n") - 1
    n = F.col("choice").try_cast("int")
    index = F.when(n.isNotNull(), F.greatest(F.lit(0), F.least(top, n)))
    fallback = F.max(F.when(F.col("_r") == 1, F.col("ref")))
    judged = F.max(F.when(F.col("idx") == index, F.col("ref")))
    per = j.groupBy(key).agg(fallback.alias("fallback"), judged.alias("judged"), F.max("_n").alias("candidates"))
    return per.select(key, F.coalesce("judged", "fallback").alias("ref"), "candidates", F.when(F.col("judged").isNull(), "deterministic").otherwise("agentic").alias("mode"), F.coalesce(F.col("judged") != F.col("fallback"), F.lit(False)).alias("overrode"))


def withdraw(rows: DataFrame, contradicted: Column, counts: list[str]) -> DataFrame:
    """Where a verdict is contradicted its counts become null; the deterministic ones stay beside them."""
    for c in counts:
        rows = rows.withColumn(f"{c}_deterministic", F.col(c)).withColumn(c, F.when(~contradicted, F.col(c)))
    return rows


def attempt(rows: DataFrame, key: str, levels: list[str], value: str) -> DataFrame:
    """Result of the first level, in order, that gave one; which level was asked for and which it was."""
    rank = F.array_position(F.array(*map(F.lit, levels)), F.col("level"))
    best = F.min_by(F.struct("level", value), F.when(F.col(value).isNotNull(), rank))
    per = rows.groupBy(key).agg(best.alias("b"))
    return per.select(key, F.lit(levels[0]).alias("requested"), F.col("b.level").alias("actual"), F.col(f"b.{value}").alias(value))


#: Kinds of a failed model run by its output, in order, (kind, may be tried again, pattern).
RUN_FAILURES = (
    ("auth", False, r"(?i)invalid[ _-]?api[ _-]?key|authentication_error|permission_error|unauthorized|\b40[13]\b|not logged ?in|please run /?login|oauth token|credit balance is too low"),
    ("rate_limited", True, r"(?i)rate[ _-]?limit|\b429\b|too many requests|overloaded|\b529\b|quota|usage limit"),
    ("model_unavailable", False, r"(?i)model[ _-]?not[ _-]?found|not_found_error|unknown model|invalid model|model .{0,40}?(?:not (?:found|available|supported)|does not exist)|\b404\b"),
    ("crashed", True, r"(?i)econnreset|etimedout|eai_again|enotfound|socket hang ?up|fetch failed|network error|connection (?:reset|closed|refused|error)|\b50[0234]\b|bad gateway|service unavailable|gateway time-?out|internal server error|api_error|apiconnection"),
    ("crashed", False, r"(?i)segmentation fault|core dumped|bus error|stack overflow|abort(?:ed)?\b|out of memory|heap limit|fatal error|panic:"),
)


def run_failure(exit_code: Column, output: Column) -> Column:
    """struct(kind, retryable) of a failed model run: by the end of its output, else by a death by signal, else unknown."""
    tail = F.right(F.coalesce(output, F.lit("")), F.lit(4000))
    made = lambda k, r: F.struct(F.lit(k).alias("kind"), F.lit(r).alias("retryable"))
    out = F.when(F.lit(False), made("", False))
    for kind, again, pattern in RUN_FAILURES:
        out = out.when(tail.rlike(pattern), made(kind, again))
    return out.when(signalled(exit_code), made("crashed", False)).otherwise(made("unknown", False))


def signalled(exit_code: Column) -> Column:
    """Whether an exit status means death by a signal: negative, 128 and a signal, or a system's exception status."""
    return F.coalesce((exit_code < 0) | exit_code.between(129, 165) | (exit_code >= 0xC0000000), F.lit(False))


def backoff(attempt: Column, slept: Column, jitter: Column) -> Column:
    """Seconds to wait before the next attempt: doubling from 5 up to 30, half to one and a half times that, 45 in all."""
    nominal = F.least(F.lit(30.0), F.lit(5.0) * F.pow(F.lit(2.0), attempt - 1)) * (F.lit(0.5) + jitter)
    return F.greatest(F.lit(0.0), F.least(nominal, F.lit(45.0) - slept))


def least_attempt(budget: Column) -> Column:
    """Seconds that an attempt needs to be worth starting: 120, or a quarter of a smaller budget."""
    return F.least(F.lit(120.0), F.lit(0.25) * F.greatest(F.lit(1.0), budget))


def run_estimate(files: Column, projects: Column, level: Column, model_cap: Column, with_model: Column) -> Column:
    """Seconds that a measurement will take: its slowest concurrent lane, and then the build probe."""
    k = files / 1000.0
    lane = lambda base, per, cap: F.least(cap, F.lit(base) + F.lit(per) * k)
    model = F.when(with_model, lane(900.0, 45.0, model_cap)).otherwise(0.0)
    probe = F.when(level == "discover", 30.0 * projects + 4.0 * k).when(level == "full", 90.0 * projects + 20.0 * k).otherwise(0.0)
    return F.greatest(lane(5.0, 3.0, F.lit(3600.0)), model) + probe


def row_state(census_skip: Column, census_scored: Column, mining_skip: Column, mining_total: Column, build_ok: Column, timed_out: Column) -> Column:
    """struct(status, reason) of the flat row: measured only where every lane gave a measurement.

    A timeout outranks a lane that couldn't be read, which outranks one that was switched off.
    """
    broken = (census_skip.isNull() & ~F.coalesce(census_scored, F.lit(False))) | (mining_skip.isNull() & mining_total.isNull()) | (build_ok == False)  # noqa: E712
    off = F.when(F.coalesce(census_skip, F.lit("")).eqNullSafe("llm_disabled") | F.coalesce(mining_skip, F.lit("")).eqNullSafe("llm_disabled"), "llm_disabled").otherwise(F.coalesce(census_skip, mining_skip))
    reason = F.when(F.coalesce(timed_out, F.lit(False)), "lanes_timed_out").when(F.coalesce(broken, F.lit(False)), "lanes_unavailable").otherwise(off)
    return F.struct(F.when(reason.isNull(), "measured").otherwise("partial").alias("status"), reason.alias("reason"))


def judged_block(rows: DataFrame, key: str, enabled: Column, scored: Column, counts: list[str]) -> DataFrame:
    """State skipped, scored or unavailable; counts only where scored."""
    state = F.when(~enabled, "skipped").when(scored, "scored").otherwise("unavailable")
    return rows.select(key, state.alias("state"), *[F.when(state == "scored", F.col(c)).alias(c) for c in counts])


def substance(raw: Column) -> Column:
    """Judged substance, a whole number from 0 to 4, null where none was given."""
    return clamp(raw, 0, 4)


def capped_list(rows: DataFrame, key: str, order: list, item: str, cap: int) -> DataFrame:
    """First ``cap`` items of each key in order, and how many were left out, in one grouping."""
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    kept = F.array_sort(F.collect_list(F.when(F.col("_r") <= cap, F.struct("_r", item))))
    return ranked.groupBy(key).agg(F.transform(kept, lambda x: x[item]).alias("items"), F.greatest(F.count("*") - cap, F.lit(0)).alias("overflow"))


def duration(seconds: Column) -> Column:
    """Seconds below two minutes, minutes from there on."""
    return F.when(seconds < 120, F.format_string("%d second", F.bround(seconds).cast("long"))).otherwise(F.format_string("%d minute", F.bround(seconds / 60).cast("long")))
