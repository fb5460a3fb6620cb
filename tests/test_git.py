"""Commit graphs, streams of commits and filters of the git source, against git itself."""

import os
import random
import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

from quarrymeter.operators import graph
from quarrymeter.sources import git

ENV = os.environ | {"GIT_AUTHOR_NAME": "Ann", "GIT_AUTHOR_EMAIL": "ann@x.org", "GIT_COMMITTER_NAME": "Ann", "GIT_COMMITTER_EMAIL": "ann@x.org"}


def run(d, *args, **more):
    return subprocess.run(["git", "-C", d, *args], check=True, capture_output=True, text=True, env=ENV | more).stdout


def merges(d, n, seed):
    """A history of n commits with many merges, branches and tags, by git fast-import."""
    r = random.Random(seed)
    out, at, marks = ["blob\nmark :1\ndata 1\nx\n"], {}, []
    for i in range(n):
        b, mark = r.choice(["main"] * 6 + [f"b{r.randint(0, 9)}"]), i + 2
        out.append(f"commit refs/heads/{b}\nmark :{mark}\nauthor A <a@x.org> {1_600_000_000 + i * 60} +0000\ncommitter A <a@x.org> {1_600_000_000 + i * 60} +0000\ndata {len(str(i)) + 1}\nc{i}\n")
        if b in at:
            out.append(f"from :{at[b]}\n")
        elif marks and r.random() < 0.9:  # some branches have a root of their own
            out.append(f"from :{r.choice(marks)}\n")
        out += [f"merge :{r.choice(marks[-60:])}\n" for _ in range(r.choice([0, 0, 1, 1, 2])) if marks]
        out.append(f"M 100644 :1 f{i}.txt\n\n")
        at[b] = mark
        marks.append(mark)
    out += [f"reset refs/tags/t{i}\nfrom :{r.choice(marks)}\n\n" for i in range(20)]
    subprocess.run(["git", "init", "-q", "-b", "main", d], check=True)
    subprocess.run(["git", "-C", d, "fast-import", "--quiet"], input="".join(out).encode(), check=True)


@pytest.fixture(scope="module")
def repos(tmp_path_factory):
    out = []
    for name, n, seed in (("one,with comma", 400, 1), ("two", 150, 2)):
        d = str(tmp_path_factory.mktemp("graph") / name)
        merges(d, n, seed)
        out.append(d)
    run(out[1], "tag", "-a", "signed", "-m", "annotated", "main~3")
    return out


def load(spark, repos, relation="commits", **options):
    return git.read(spark, repos, relation, **options)


def test_reachable_commits_equal_git(spark, repos):
    refs = load(spark, repos, "refs")
    got = {(r.repo, r.ref): r.commits for r in graph.measure_refs(load(spark, repos, "graph"), refs).collect()}
    expect = {(d, ref): int(run(d, "rev-list", "--count", ref)) for d in repos for ref in run(d, "for-each-ref", "--format=%(refname)").split()}
    assert got == expect and len(got) > 50


def test_tags_within_a_ref_equal_git(spark, repos):
    refs = load(spark, repos, "refs")
    tags = refs.where("ref like 'refs/tags/%'")
    head = refs.where("ref = 'refs/heads/b3'")
    tips = graph.tip_bits(head)
    got = {(r.repo, r.ref) for r in graph.within(tags, graph.reached(load(spark, repos, "graph"), tips), tips, head).collect()}
    assert got == {(d, f"refs/tags/{t}") for d in repos for t in run(d, "tag", "--merged", "b3").split()}


def test_graph_of_odd_commits(spark):
    rows = [("r", "a", None), ("r", "b", ["a", "a", None, "gone"]), ("r", "b", ["a"]), ("r", "c", []), ("s", "a", ["b"]), (None, "x", []), ("r", None, ["a"])]
    commits = spark.createDataFrame(rows, "repo string, sha string, parents array<string>")
    refs = spark.createDataFrame([("r", "main", "b"), ("r", "same", "b"), ("r", "lost", "zzz"), ("r", "none", None), ("s", "main", "a"), ("t", "main", "a")], "repo string, ref string, sha string")
    assert {(r.repo, r.ref): r.commits for r in graph.measure_refs(commits, refs).collect()} == {("r", "main"): 2, ("r", "same"): 2, ("r", "lost"): 0, ("r", "none"): 0, ("s", "main"): 1, ("t", "main"): 0}
    assert graph.measure_refs(commits.where("false"), refs.where("false")).collect() == []


def test_more_tips_than_a_block_and_a_long_chain(spark):
    chain = spark.range(300).select(F.lit("r").alias("repo"), F.col("id").cast("string").alias("sha"), F.when(F.col("id") > 0, F.array((F.col("id") - 1).cast("string"))).alias("parents"))
    refs = spark.range(0, 300, 2).select(F.lit("r").alias("repo"), F.concat(F.lit("t"), "id").alias("ref"), F.col("id").cast("string").alias("sha"))
    assert {r.ref: r.commits for r in graph.measure_refs(chain, refs).collect()} == {f"t{i}": i + 1 for i in range(0, 300, 2)}


def test_fields_that_hold_separators_and_failed_reads(spark, tmp_path):
    d = str(tmp_path / "odd")
    subprocess.run(["git", "init", "-q", "-b", "main", d], check=True)
    (tmp_path / "odd" / "a\tb.txt").write_text("x\n")
    run(d, "add", "-A")
    run(d, "commit", "-qm", "one \x1f two \x1e three", GIT_AUTHOR_NAME="A\x1fB")
    got = load(spark, [d]).first()
    assert (got.subject, got.author_name, got.parents) == ("one \x1f two \x1e three", "A\x1fB", [])
    assert [(r.path, r.additions) for r in load(spark, [d], "commit_files").collect()] == [("a\tb.txt", 1)]
    with pytest.raises(Exception, match="failed in"):
        load(spark, [d], ref="nowhere").collect()
    assert load(spark, [str(tmp_path)]).collect() == []  # no repository: the relation status says so


def test_filters_reach_git(spark, repos):
    was = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        sha = run(repos[1], "log", "--no-merges", "-1", "--format=%H").strip()
        one = load(spark, [*repos, "/nowhere"], "commit_files").where(F.col("repo") == repos[1]).where(F.col("sha") == sha)
        assert one.rdd.getNumPartitions() == 1 and {r.sha for r in one.collect()} == {sha}
        plan = one._jdf.queryExecution().executedPlan().toString()
        assert "Filter" not in plan.split("BatchScan")[0] and "sha" in plan
        refs = load(spark, repos, "refs").where("ref in ('refs/heads/main', 'refs/tags/t1')").where("sha is not null")
        assert sorted(r.ref for r in refs.collect()) == ["refs/heads/main"] * 2 + ["refs/tags/t1"] * 2
        assert load(spark, repos, "commit_files").where(f"sha = '{'0' * 40}'").collect() == []
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", was)


@pytest.mark.parametrize("noted", [True, False])
def test_stream_gives_each_commit_once_after_restarts_and_forced_pushes(spark, tmp_path, noted):
    d = str(tmp_path / "live")
    subprocess.run(["git", "init", "-q", "-b", "main", d], check=True)
    spark.dataSource.register(git.GitSource)
    options = {"repo": d} | ({"history": str(tmp_path / "tips")} if noted else {})
    out = str(tmp_path / "out")

    def drain():
        q = spark.readStream.format("git").options(**options).load().writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()
        return sorted(r.subject for r in spark.read.schema(git.SCHEMAS["commits"]).parquet(out).collect()) if os.path.exists(out) else []

    def commit(name):
        run(d, "commit", "-q", "--allow-empty", "-m", name)

    assert drain() == []  # no commit yet
    commit("a")
    commit("b")
    commit("c")
    old = run(d, "rev-parse", "HEAD").strip()
    assert drain() == ["a", "b", "c"]
    assert drain() == ["a", "b", "c"]  # a restart finds nothing new
    run(d, "reset", "-q", "--hard", "HEAD~2")
    commit("d")
    assert drain() == ["a", "b", "c", "d"]  # forced to another line
    run(d, "checkout", "-q", "-b", "back", old)
    commit("e")
    expect = ["a", "b", "c", "d", "e"] if noted else ["a", "b", "b", "c", "c", "d", "e"]
    assert drain() == expect  # the old line is back
    run(d, "checkout", "-q", "main")
    run(d, "merge", "-q", "--no-edit", "back", "-m", "m")
    assert drain() == [*expect, "m"]
    shutil.rmtree(out)
