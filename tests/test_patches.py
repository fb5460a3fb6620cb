"""Patches, their caps and their writer; a tree read by filters."""

import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from quarrymeter.sources import git, patches, tree

ENV = os.environ | {"GIT_AUTHOR_NAME": "Ann", "GIT_AUTHOR_EMAIL": "ann@x.org", "GIT_COMMITTER_NAME": "Ann", "GIT_COMMITTER_EMAIL": "ann@x.org"}


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    d = tmp_path_factory.mktemp("patched")
    run = lambda *a: subprocess.run(["git", "-C", str(d), *a], check=True, capture_output=True, env=ENV)
    run("init", "-q", "-b", "main")
    for i in range(6):
        (d / "src").mkdir(exist_ok=True)
        (d / "src" / "a.py").write_text("".join(f"line {j} of {i}\n" for j in range(40)))
        if i == 2:
            (d / "prod.pem").write_text("TOP-SECRET-KEY\n")
        run("add", "-A")
        run("commit", "-qm", f"step {i}")
    return str(d)


def test_patches_leave_credentials_out_and_are_cut(spark, repo):
    c = git.read(spark, [repo, "/nowhere"])
    chosen = patches.spread(c, [F.col("ord")], 4).repartition(3)
    assert sorted(r.subject for r in chosen.collect()) == ["step 0", "step 2", "step 4", "step 5"] or chosen.count() == 4
    found = patches.patches(patches.spread(c, [F.col("ord")], 10))
    withheld = patches.credential_commits(git.read(spark, [repo], "commit_files"))
    all_ = {r.name: r.patch for r in patches.capped(found, withheld).collect()}
    assert len(all_) == 6 and sorted(n[:5] for n in all_) == [f"{i:04d}-" for i in range(6)]
    assert not any("TOP-SECRET" in p for p in all_.values()) and sum(p.endswith(patches.WITHHELD) for p in all_.values()) == 1
    few = patches.capped(found, withheld, each=300, total=700).orderBy("nth").collect()
    assert [r.nth for r in few] == [0, 1, 2] and all(r.patch == r.patch[:300] + patches.CUT for r in few)
    odd = spark.createDataFrame([(repo, "HEAD", 0), (repo, None, 1), (repo, "0" * 40, 2)], "repo string, sha string, nth long")
    assert patches.patches(odd).collect() == []


@pytest.mark.parametrize("n,k", [(0, 3), (3, 3), (10, 3), (161, 160), (1000, 160), (4096, 7)])
def test_spread_takes_the_same_places_as_a_loop(spark, n, k):
    df = spark.range(n).select(F.lit("r").alias("repo"), "id")
    got = [(r.nth, r.id) for r in patches.spread(df, [F.col("id")], k).orderBy("nth").collect()]
    assert got == [(i, int(i * (n / k)) if n > k else i) for i in range(min(n, k))]


def test_writer_shows_all_or_nothing(spark, tmp_path):
    path = str(tmp_path / "out" / "diffs")
    files = lambda: sorted(os.path.relpath(os.path.join(d, n), path) for d, _, names in os.walk(path) for n in names)
    rows = spark.createDataFrame([("r", f"{i}.diff", f"text é {i}") for i in range(20)] + [("s", "0.diff", None)], "folder string, name string, text string").repartition(4)
    patches.write_patches(spark, rows, path)
    assert len(files()) == 22 and open(f"{path}/r/3.diff", encoding="utf-8").read() == "text é 3" and json.load(open(f"{path}/_SUCCESS"))["files"] == 21
    bad = rows.unionByName(spark.createDataFrame([("r", "../x", "t")], rows.schema))
    for overwrite in (False, True):
        with pytest.raises(Exception, match="not a name|Exists"):
            patches.write_patches(spark, bad, path, overwrite)
    with pytest.raises(Exception, match="FileExistsError"):
        patches.write_patches(spark, rows, path)
    assert len(files()) == 22 and open(f"{path}/r/3.diff", encoding="utf-8").read() == "text é 3"
    assert all(n == "diffs" or n.startswith("diffs.staging-") for n in os.listdir(tmp_path / "out"))
    patches.write_patches(spark, rows.limit(1), path, overwrite=True)
    assert len(files()) == 2


def test_tree_filters_open_and_list_only_what_they_need(spark, tmp_path):
    root = tmp_path / "a,b"
    for name in ("x.py", "src/y.py", "src/deep/z.py", "src/deep/z.txt", "doc/w.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("x = 1\n")
    os.chmod(root / "doc" / "w.txt", 0)
    plain = tree.scan(spark, [str(root)], content=False)
    assert plain.columns == ["repo", "path", "size", "ext"] and plain.count() == 5
    reader = tree.FilteredTreeReader({"root": str(root)})
    opened = []

    def paths(*filters):
        r = tree.FilteredTreeReader({"roots": json.dumps([str(root)])})
        left = list(r.pushFilters(list(filters)))
        seen = r._entries
        r._entries = lambda store, folder: (opened.append(os.path.relpath(folder, root)), seen(store, folder))[1]
        return sorted(row[1] for p in r.partitions() for row in r.read(p)), left

    from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringEndsWith, StringStartsWith

    assert paths(StringEndsWith(("path",), ".py"), StringStartsWith(("path",), "src/de")) == (["src/deep/z.py"], []) and "doc" not in opened
    opened.clear()
    assert paths(In(("path",), ("x.py", "src/y.py", None))) == (["src/y.py", "x.py"], []) and "src/deep" not in opened
    assert paths(EqualTo(("repo",), "elsewhere")) == ([], [])
    more = GreaterThan(("size",), 3)
    assert paths(more, EqualTo(("path",), "x.py")) == (["x.py"], [more]) and reader.only == {}
    was = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = tree.scan(spark, [str(root)]).where(F.col("path").endswith(".py")).where("size > 3")
        assert sorted(r.path for r in got.collect()) == ["src/deep/z.py", "src/y.py", "x.py"]
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "EndsWith" not in plan.split("BatchScan")[0] and "size" in plan.split("BatchScan")[0]
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", was)
        os.chmod(root / "doc" / "w.txt", 0o600)
