"""Reachability over commit graphs of many repositories at once.

commits(repo, sha, parents array<string>) is a DAG for each repository; refs(repo,
ref, sha) name its tips. A walk that follows one parent at a time needs as many
rounds as a history is long, so long histories get shortcuts: along first
parents, a commit at depth d points 2^k commits up for every k by which 2^k
divides d. These are found by pointer doubling, there are about as many as commits, and any
two commits of a chain are then some 2 log2(length) steps apart.

The walk carries sets of tips as bits: a row (repo, sha, block) holds 63 tips, so
it has one row for each commit and block, not for each pair of commit and ref. A round
passes only the bits that are new on to parents and shortcuts, merges them by
bit_or, and adds what is new to a table in the shared folder. Edges and that table are
kept in buckets of commits, so a round shuffles and writes only what it passes on. It ends
when no bit is new. The driver sees only whether there was one.

Defined cases: parents that aren't among the commits (shallow or limited
histories) are left out; repeated commits count once; a ref whose commit is
unknown, and one with a null commit, reaches 0 commits; refs that share a commit
share its count; null parents are none; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Buckets, Step

TIPS = 63  # of a block: bits of a long without its sign
MOST_ROUNDS = 10_000


def edges(commits: DataFrame) -> DataFrame:
    """(repo, sha, nth, parent): an edge for every parent that is a known commit; nth 0 is the first parent."""
    known = commits.select("repo", F.col("sha").alias("parent")).where("parent is not null").distinct()
    each = commits.select("repo", "sha", F.posexplode("parents").alias("nth", "parent")).where("sha is not null and parent is not null and parent <> sha")
    return each.groupBy("repo", "sha", "parent").agg(F.min("nth").alias("nth")).join(known, ["repo", "parent"], "left_semi").select("repo", "sha", "nth", "parent")


def first_parent_depths(nodes: DataFrame, first: DataFrame) -> DataFrame:
    """(repo, sha, depth): commits above each along first parents, by pointer doubling. first: (repo, sha, parent), one row a commit at most."""
    state = Step(nodes.join(first, ["repo", "sha"], "left").select("repo", "sha", F.col("parent").alias("up"), F.col("parent").isNotNull().cast("long").alias("depth")), "depths")
    while not state.df.where("up is not null").isEmpty():
        above = state.df.select("repo", F.col("sha").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        # rows that have come to a root are not joined any more, so a root gathers no key
        moving = state.df.where("up is not null").join(above, ["repo", "up"]).select("repo", "sha", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"))
        done = Step(moving.unionByName(state.df.where("up is null")), "depths")
        state.drop()
        state = done
    return state.df.select("repo", "sha", "depth")


def shortcuts(nodes: DataFrame, first: DataFrame) -> DataFrame:
    """(repo, sha, to): the 2^k-th first parent of every commit whose depth is a multiple of 2^k, for k from 1."""
    depths = first_parent_depths(nodes, first)
    jump = Step(first.join(depths, ["repo", "sha"]).select("repo", "sha", F.col("parent").alias("to"), "depth"), "jumps")
    out, k = None, 1
    while True:
        span = 1 << k
        half = jump.df.select("repo", F.col("sha").alias("to"), F.col("to").alias("far"))
        longer = Step(jump.df.where(F.col("depth") % span == 0).join(half, ["repo", "to"]).select("repo", "sha", F.col("far").alias("to"), "depth"), "jumps")
        if longer.df.isEmpty():
            break
        out = longer.df if out is None else out.unionByName(longer.df)
        jump, k = longer, k + 1
    empty = first.select("repo", "sha", F.col("parent").alias("to")).where("false")
    return empty if out is None else out.select("repo", "sha", "to")


def tip_bits(refs: DataFrame) -> DataFrame:
    """(repo, sha, block, bit): every tip of a repository has a bit of its own in one of its blocks."""
    tips = refs.where("sha is not null").select("repo", "sha").distinct()
    nth = F.row_number().over(Window.partitionBy("repo").orderBy("sha")) - 1
    return tips.withColumn("_n", nth).select("repo", "sha", F.floor(F.col("_n") / TIPS).cast("int").alias("block"), (F.col("_n") % TIPS).cast("int").alias("bit"))


def reached(commits: DataFrame, tips: DataFrame) -> DataFrame:
    """(repo, sha, block, bits): the tips from which each commit is reached; tips as of ``tip_bits``."""
    each = Step(edges(commits), "edges")
    nodes = commits.select("repo", "sha").where("sha is not null").distinct()
    first = each.df.where("nth = 0").select("repo", "sha", "parent")
    keys = ["repo", "sha"]
    ways = Buckets(each.df.select("repo", "sha", F.col("parent").alias("to")).unionByName(shortcuts(nodes, first)), "ways", keys)
    start = tips.join(nodes, keys, "left_semi").groupBy("repo", "sha", "block").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    seen = Buckets(start.withColumn("round", F.lit(0)), "seen", keys)
    n = ways.n
    for r in range(1, MOST_ROUNDS):
        fresh = seen.df.where(F.col("round") == r - 1)
        passed = fresh.join(ways.df, keys).select("repo", F.col("to").alias("sha"), "block", "bits")
        told = passed.repartition(n, *keys).groupBy("repo", "sha", "block").agg(F.bit_or("bits").alias("told"))
        # rows of both sides lie by commit; blocks are compared, but are no key to deal rows by
        old = seen.df.groupBy("repo", "sha", "block").agg(F.bit_or("bits").alias("old")).withColumnRenamed("block", "_block")
        t, o = told.alias("t"), old.alias("o")
        both = t.join(o, (F.col("t.repo") == F.col("o.repo")) & (F.col("t.sha") == F.col("o.sha")) & (F.col("t.block") - F.col("o._block") == 0), "left")
        new = F.col("told").bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0).cast("long"))))
        some = both.select("t.repo", "t.sha", "block", new.alias("bits")).where("bits <> 0").withColumn("round", F.lit(r))
        seen.add(some)
        if seen.df.where(F.col("round") == r).isEmpty():
            break
    else:
        raise RuntimeError("the walk over commits did not settle; is the graph acyclic?")
    each.drop()
    ways.drop()
    return seen.df.groupBy("repo", "sha", "block").agg(F.bit_or("bits").alias("bits"))


def _has(bit: int | str) -> Column:
    return F.expr(f"shiftright(bits, {bit}) & 1")


def reachable_counts(refs: DataFrame, found: DataFrame, tips: DataFrame) -> DataFrame:
    """The rows of refs with ``commits``, the number of commits that each reaches, itself included."""
    per = found.groupBy("repo", "block").agg(F.array(*(F.sum(_has(i)) for i in range(TIPS))).alias("n"))
    by_tip = tips.join(per, ["repo", "block"]).select("repo", "sha", F.col("n")[F.col("bit")].alias("commits"))
    return refs.join(by_tip, ["repo", "sha"], "left").withColumn("commits", F.coalesce("commits", F.lit(0)).cast("long"))


def within(marks: DataFrame, found: DataFrame, tips: DataFrame, ref: DataFrame) -> DataFrame:
    """The rows of marks (repo, sha, ...), such as tags, whose commit is reached from the commit of ``ref`` (repo, sha), one a repository."""
    one = tips.join(ref.select("repo", "sha").distinct(), ["repo", "sha"], "left_semi").select("repo", "block", "bit")
    inside = found.join(one, ["repo", "block"]).where(_has("bit") == 1).select("repo", "sha")
    return marks.join(inside, ["repo", "sha"], "left_semi")


def measure_refs(commits: DataFrame, refs: DataFrame) -> DataFrame:
    """The rows of refs (repo, ref, sha ...) with ``commits``."""
    tips = Step(tip_bits(refs), "tips")
    return reachable_counts(refs, reached(commits, tips.df), tips.df)
