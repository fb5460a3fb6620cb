"""Phase machine of build probes: plans, recorded outcomes, and one budget that all projects of a repository draw on.

projects(repo, project, ecosystem, weight), records(repo, project, phase, outcome,
attribution, seconds) and plans(ecosystem, phase, planned) are relations. A repository's projects are taken largest
first; each gets the part of what is left that its weight has of the weights still to
come, and what it doesn't spend stays for the others. Each phase of a project may take the smallest of
its cap, of what is left to the project and of what is left to the repository.

The machine is a fold: the phases of a repository (at most ``MAX_PROJECTS`` projects of
five phases, all others are skipped) are one sorted array, and F.aggregate carries
the budget, the project's share and the cause of a block along it. It runs inside Spark's own expressions.

States: passed, failed, no_tests, unavailable as recorded; timed_out where a phase
took more than it was allowed, which is charged to the runner and cut off there; blocked
after a phase that ends its project, with that phase's owner; skipped_budget where less
than ``MIN_PHASE`` seconds were left, and for projects over the cap; skipped_level
beyond the level asked for; not_planned for a phase that the ecosystem's plan leaves out; not_recorded for one that
has no outcome. Seconds are those that count: none for what never ran.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Phases in their order, seconds of a budget, a phase and a project, the last phase of each level.
PHASES = ("resolve", "build", "discover", "test", "coverage")
BUDGET, PHASE_CAP, MIN_PHASE, MIN_PROJECT = 1800, 900, 15, 30
MAX_PROJECTS = 8
LEVELS = {"discover": "discover", "full": "coverage"}
#: Phases without a command of their own, by ecosystem.
UNPLANNED = {"python": ("build",), "go": (), "rust": (), "node": (), "maven": (), "gradle": (), "dotnet": (), "ruby": ("build",), "php": ("build", "coverage")}
#: Outcomes of a phase that end its project; tests that fail, and a search for tests that does, don't.
BLOCKING = {"resolve": ("failed", "unavailable", "timed_out"), "build": ("failed", "unavailable", "timed_out"), "discover": ("unavailable", "timed_out"), "test": ("unavailable", "timed_out"), "coverage": ()}
LOST = ("failed", "unavailable", "timed_out")


def plan_table(spark: SparkSession) -> DataFrame:
    """(ecosystem, phase, planned): the phases that each ecosystem has a command for."""
    return spark.createDataFrame([(e, p, p not in out) for e, out in UNPLANNED.items() for p in PHASES], "ecosystem string, phase string, planned boolean")


def ranked_projects(projects: DataFrame, most: int = MAX_PROJECTS) -> DataFrame:
    """Adds ``rank`` (from 1, largest first, ties by name) and ``weight_left``, the weights from this project to the last that is probed; ranks above ``most`` are over the cap."""
    ranked = projects.withColumn("rank", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("weight"), "project")))
    rest = Window.partitionBy("repo").orderBy("rank").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    probed = F.when(F.col("rank") <= most, F.col("weight"))
    return ranked.withColumn("weight_left", F.coalesce(F.sum(probed).over(rest), F.lit(0)).cast("long"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once: an expression used twice inside a fold runs twice."""
    return F.transform(F.array(value), body)[0]


def _step(state: Column, e: Column, last: int, cap: int) -> Column:
    """State after one phase; the fields are left, share, cause, owner, stop and out."""
    begins = e["nth"] == 0
    left = state["left"]
    part = F.call_function("div", left * e["weight"], F.greatest(F.lit(1).cast("long"), e["weight_left"]))
    share = F.when(begins, F.greatest(part, F.least(F.lit(MIN_PROJECT).cast("long"), left))).otherwise(state["share"])
    none = F.lit(None).cast("string")
    now = F.struct(share.alias("share"), *(F.when(begins, none).otherwise(state[c]).alias(c) for c in ("cause", "owner", "stop")))
    return _let(now, lambda x: _let(_outcome(x, left, e, last, cap), lambda y: _after(state, x, y, e)))


def _outcome(x: Column, left: Column, e: Column, last: int, cap: int) -> Column:
    """struct(status, used, runs) of one phase."""
    allowed = F.least(F.lit(cap).cast("long"), x["share"], left)
    runs = x["cause"].isNull() & x["stop"].isNull() & (e["nth"] <= last) & e["planned"]
    enough = allowed >= MIN_PHASE
    seconds = F.coalesce(e["seconds"], F.lit(0).cast("long"))
    status = (
        F.when(x["cause"].isNotNull(), "blocked").when(x["stop"].isNotNull(), "skipped_budget").when(e["nth"] > last, "skipped_level").when(~e["planned"], "not_planned")
        .when(~enough, "skipped_budget").when(e["outcome"].isNull(), "not_recorded").when(seconds > allowed, "timed_out").otherwise(e["outcome"])
    )
    used = F.when(runs & enough & e["outcome"].isNotNull(), F.least(seconds, allowed)).otherwise(F.lit(0).cast("long"))
    return F.struct(status.alias("status"), used.alias("used"), runs.alias("runs"))


def _after(state: Column, x: Column, y: Column, e: Column) -> Column:
    """State after a phase with the outcome ``y``, where ``x`` held before it."""
    status, used = y["status"], y["used"]
    blocks = y["runs"] & F.concat(e["phase"], F.lit("_"), status).isin(*(f"{p}_{s}" for p, states in BLOCKING.items() for s in states))
    blame = F.when(status == "blocked", x["owner"]).when(status.isin("skipped_budget", "timed_out"), "runner").when(status.isin(*LOST), F.coalesce(e["attribution"], F.lit("unknown")))
    reason = F.when(status == "blocked", x["cause"]).when(status == "skipped_budget", "run_budget_exhausted").when(status == "skipped_level", "level_discover_only").when(status == "timed_out", "cut_off_by_budget")
    row = F.struct(e["project"].alias("project"), e["phase"].alias("phase"), e["rank"].alias("rank"), e["nth"].alias("nth"), status.alias("status"), reason.alias("reason"), blame.alias("owner"), used.alias("seconds"))
    return F.struct(
        (state["left"] - used).alias("left"), (x["share"] - used).alias("share"),
        F.when(blocks, F.concat(e["phase"], F.lit("_"), status)).otherwise(x["cause"]).alias("cause"), F.when(blocks, blame).otherwise(x["owner"]).alias("owner"),
        F.when(status == "skipped_budget", "run_budget_exhausted").otherwise(x["stop"]).alias("stop"), F.concat(state["out"], F.array(row)).alias("out"),
    )


def run_phases(projects: DataFrame, records: DataFrame, plans: DataFrame, budget: int = BUDGET, cap: int = PHASE_CAP, level: str = "full", most: int = MAX_PROJECTS) -> DataFrame:
    """(repo, project, phase, rank, nth, status, reason, owner, seconds): a row for each phase of each project."""
    last = PHASES.index(LEVELS[level])
    ranked = ranked_projects(projects, most)
    # a row for each project, not for each phase, is what is joined and shuffled
    told = F.struct("seconds", "outcome", "attribution")
    one = records.groupBy("repo", "project").agg(*(F.max(F.when(F.col("phase") == p, told)).alias(f"_{p}") for p in PHASES))
    plan = plans.groupBy("ecosystem").agg(*(F.max(F.when(F.col("phase") == p, F.col("planned"))).alias(f"_planned_{p}") for p in PHASES))
    full = ranked.where(F.col("rank") <= most).join(F.broadcast(plan), "ecosystem", "left").join(one, ["repo", "project"], "left")
    entry = lambda i, p: F.struct("rank", F.lit(i).alias("nth"), "project", F.lit(p).alias("phase"), F.coalesce(f"_planned_{p}", F.lit(False)).alias("planned"), F.col("weight").cast("long").alias("weight"), "weight_left", F.col(f"_{p}.outcome").alias("outcome"), F.col(f"_{p}.attribution").alias("attribution"), F.col(f"_{p}.seconds").cast("long").alias("seconds"))
    per = F.struct("rank", F.array(*(entry(i, p) for i, p in enumerate(PHASES))).alias("es"))
    inside = full.groupBy("repo").agg(F.sort_array(F.collect_list(per)).alias("ps")).select("repo", F.flatten("ps.es").alias("es"))
    text = F.lit(None).cast("string")
    row = "array<struct<project:{0},phase:string,rank:int,nth:int,status:string,reason:string,owner:string,seconds:bigint>>".format(dict(projects.dtypes)["project"])
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.lit(0).cast("long").alias("share"), text.alias("cause"), text.alias("owner"), text.alias("stop"), F.array().cast(row).alias("out"))
    folded = inside.select("repo", F.inline(F.aggregate("es", start, lambda s, e: _step(s, e, last, cap), lambda s: s["out"])))
    over = ranked.where(F.col("rank") > most).select("repo", "project", "rank", F.posexplode(F.array(*map(F.lit, PHASES))).alias("nth", "phase"))
    over = over.select("repo", "project", "phase", "rank", "nth", F.lit("skipped_budget").alias("status"), F.lit("project_cap_reached").alias("reason"), F.lit("runner").alias("owner"), F.lit(0).cast("long").alias("seconds"))
    return folded.select(*over.columns).unionByName(over)
