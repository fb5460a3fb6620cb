"""Git and tree sources on repositories made here; streams on small folders."""

import os
import subprocess

import pytest
from pyspark.sql import functions as F

from quarrymeter.operators.tree import with_loc
from quarrymeter.sources import git, tree
from quarrymeter.streaming import live


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    d = str(tmp_path_factory.mktemp("repo"))
    env = os.environ | {"GIT_AUTHOR_NAME": "Ann", "GIT_AUTHOR_EMAIL": "ann@x.org", "GIT_COMMITTER_NAME": "Ann", "GIT_COMMITTER_EMAIL": "ann@x.org"}
    run = lambda *a, **k: subprocess.run(["git", "-C", d, *a], check=True, capture_output=True, env=env | k)
    run("init", "-q", "-b", "main")
    os.makedirs(f"{d}/.github/workflows")
    os.makedirs(f"{d}/node_modules")
    files = {
        "a.py": "def f(x):\n    if x and x > 1:\n        return 1\n    return [i for i in x]\n\ndef g():\n    pass\n",
        "requirements.txt": "Flask>=2\n# c\n-r x\nnumpy\n",
        "package.json": '{"dependencies": {"left-pad": "1"}, "scripts": {"test": "jest"}}',
        ".github/workflows/ci.yml": "on: push\njobs:\n  t:\n    steps:\n      - run: pytest -q && mypy .\n      - if: false\n        run: kubectl apply\n",
        "node_modules/x.js": "no",
        "bin.dat": "\x00\x01",
    }
    for k, v in files.items():
        with open(f"{d}/{k}", "w") as f:
            f.write(v)
    run("add", "-A")
    run("commit", "-qm", "feat: first", GIT_AUTHOR_DATE="2020-01-01T00:00:00Z")
    run("tag", "v1.0")
    with open(f"{d}/a.py", "a") as f:
        f.write("x = 1\n")
    run("commit", "-qam", "fix: second", GIT_AUTHOR_DATE="2020-01-03T00:00:00Z")
    return d


def test_git_relations(spark, repo, tmp_path):
    spark.dataSource.register(git.GitSource)
    load = lambda r, **o: spark.read.format("git").options(repo=repo, relation=r, **o).load()
    assert [x.subject for x in load("commits").orderBy("ord").collect()] == ["fix: second", "feat: first"]
    assert load("commits", limit="1").count() == 1
    f = load("commit_files")
    assert f.where("path = 'a.py'").agg(F.sum("additions")).first()[0] == 8
    assert [r.tag for r in load("tags").collect()] == ["v1.0"]
    main = load("refs").where("ref = 'refs/heads/main'").first()
    tree_of = load("trees", shas=main.sha).first()
    assert (tree_of.files, tree_of.top_dirs) == (6, 2)
    assert spark.read.format("git").options(repo="/nowhere").load().count() == 0
    subprocess.run(["git", "init", "-q", str(tmp_path / "new")], check=True)
    states = spark.read.format("git").options(repos=f"{repo},/nowhere,{tmp_path / 'new'}", relation="status").load()
    assert [r.status for r in states.orderBy("status").collect()] == ["empty", "not_a_repository", "ok"]


def test_git_peels_an_anonymiser(spark, repo, tmp_path):
    d = str(tmp_path / "copy")
    subprocess.run(["git", "clone", "-q", repo, d], check=True)
    subprocess.run(["git", "-C", d, "-c", "user.name=Anonymizer", "-c", "user.email=x@anonymizer.local", "commit", "-q", "--allow-empty", "-m", "patch"], check=True)
    spark.dataSource.register(git.GitSource)
    load = lambda **o: spark.read.format("git").options(repo=d, **o).load().count()
    assert load() == 3 and load(peel="true") == 2
    assert git.anonymised("x", "y", "anonymize repository now") and not git.anonymised("ann", "a@b.org", "fix")


def test_tree(spark, repo):
    files = tree.as_text(tree.scan(spark, repo))
    assert {r.path for r in files.collect()} == {"a.py", "requirements.txt", "package.json", ".github/workflows/ci.yml", "bin.dat"}
    every = {r.path for r in tree.scan(spark, [repo], everything=True).collect()}
    assert "node_modules/x.js" in every and not any(p.startswith(".git/") for p in every)
    deps = {(r.ecosystem, r.name) for r in tree.dependencies(files).collect()}
    assert deps == {("pypi", "flask"), ("pypi", "numpy"), ("npm", "left-pad")}
    flags = tree.ci_flags(files).first()
    assert (flags.ci_tests, flags.ci_typecheck, flags.ci_lint, flags.ci_deploy, flags.ci_systems) == (True, True, False, False, ["GitHub Actions"])
    got = {r.function: r.decisions for r in tree.function_decisions(files).where("parsed").collect()}
    assert got == {"f": 3, "g": 0}


def test_tree_keeps_large_files(spark, tmp_path):
    d = str(tmp_path)
    line = "x = 1  # " + "y" * 90 + "\n"
    for name, text in {"big.py": line * 12_000 + "def f():\n    return 1\n", "small.py": "def g():\n    return 1\n", "requirements.txt": "# " + "c" * 1_100_000 + "\nflask\n", "bad.py": "x = '\udcff'\n"}.items():
        with open(f"{d}/{name}", "w", errors="surrogateescape") as f:
            f.write(text)
    files = tree.as_text(tree.scan(spark, d))
    assert {r.path: r.size > 1_000_000 for r in files.collect()} == {"big.py": True, "small.py": False, "requirements.txt": True, "bad.py": False}
    assert [r.text for r in files.where("path = 'bad.py'").collect()] == ["x = '\ufffd'\n"]
    assert {r.path: r["loc"] for r in with_loc(files).where("ext = '.py'").collect()} == {"big.py": 12_002, "small.py": 2, "bad.py": 1}
    assert [r.name for r in tree.dependencies(files).collect()] == ["flask"]
    got = {(r.path, r.function): r.parsed for r in tree.function_decisions(files.where("path in ('big.py', 'small.py')")).collect()}
    assert got == {("big.py", None): False, ("small.py", "g"): True}
    short = spark.read.format("tree").options(root=d, maxlength="100").load()
    assert {r.path: r.content is None for r in short.collect()} == {"big.py": True, "small.py": False, "requirements.txt": True, "bad.py": False}


def test_readers():
    assert tree.make_recipes("a: b\n\t@echo x\n\techo y\nb:\n\tls\n") == {"a": ["echo x", "echo y"], "b": ["ls"]}
    assert tree.manifest_names("Cargo.toml", "[dependencies]\nserde = '1'\n") == [("cargo", "serde", False)]
    assert tree.manifest_names("package.json", "broken") == []
    assert tree.ci_steps("x.yml", "a: [") is None


def _drain(df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name).collect()


def test_streams(spark, tmp_path):
    rows = [("r", "s1", "2024-01-01 01:00:00"), ("r", "s1", "2024-01-01 01:00:00"), ("r", "s2", "2024-01-01 05:00:00"), ("r", "s3", "2024-02-20 00:00:00")]
    spark.createDataFrame(rows, "repo string, sha string, t string").select("repo", "sha", F.col("t").cast("timestamp").alias("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("repo string, sha string, ts timestamp").parquet(str(tmp_path / "in"))
    assert len(_drain(live.distinct_commits(stream), "once", "append")) == 3
    assert {r.n for r in _drain(live.daily_counts(stream, "repo"), "daily", "complete")} == {3, 1}
    assert sorted(r.n for r in _drain(live.bursts(stream, "repo"), "bursts", "complete")) == [1, 3]


def test_measure(spark, repo, tmp_path):
    from quarrymeter.operators import boundary, emit
    from quarrymeter.plans.measure import measure

    mined = spark.createDataFrame([(repo, "t", "net_new", "Large", "Add a cache to the parser", ["a.py"], None)], "repo string, title string, task_type string, complexity string, summary string, files array<string>, shas array<string>")
    clone = str(tmp_path / "clone")
    subprocess.run(["git", "clone", "-q", repo, clone], check=True)
    docs = measure(spark, [repo, clone, str(tmp_path / "nothing")], "2020-01-05 00:00:00", mined=mined)
    rows = {r.repo: r for r in docs["row"].collect()}
    got = rows[repo]
    assert docs["row"].columns == ["repo", *boundary.ROW] and len(boundary.ROW) == 41
    assert (got.commit_count, got.author_count, got.span_days, got.active_days, got.commits_by_month) == (2, 1, 2, 2, [0] * 11 + [2])
    assert (got.primary_language, got.ci_runs_tests, got.has_ci, got.status, got.skip_reason) == ("Python", True, True, "partial", "llm_disabled")
    assert got["loc"] == 7 and got.languages == {"Python": 7.0} and got.real_repo_name is None and got.fake_repo_name == "repo-" + got.repo_digest[:12]
    gone = rows[str(tmp_path / "nothing")]
    assert gone.commit_count is None and gone["loc"] is None and (gone.status, gone.skip_reason) == ("partial", "lanes_unavailable")
    nested = {r.repo: r for r in docs["measurement"].collect()}
    # a clone shares its commits' names, and is measured on its own
    assert nested[clone].git.class_d_bug_count == nested[repo].git.class_d_bug_count and nested[clone].git.total_commits == 2
    assert nested[repo].tree.frameworks == ["Flask"] and nested[repo].git.conventional_rate == 1.0 and nested[repo].git.tag_count == 1
    assert {r.repo: (r.total_candidates, r.n_net_new) for r in docs["mining"].collect()}[repo] == (1, 1)
    emit.write_documents(docs["row"], str(tmp_path / "csv"), "csv")
    emit.write_documents(docs["measurement"], str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 3
    with pytest.raises(NotImplementedError):
        emit.write_documents(docs["row"], str(tmp_path / "x"), "db")


def test_write_once_and_log_tail(spark, tmp_path):
    spark.createDataFrame([("r", "s1"), ("r", "s1"), ("r", "s2")], "repo string, sha string").coalesce(1).write.parquet(str(tmp_path / "c"))
    stream = spark.readStream.schema("repo string, sha string").parquet(str(tmp_path / "c"))
    for _ in range(2):  # a second run finds nothing new
        q = live.write_once(stream, str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "job-7.log").write_text("one\ntwo\n")
    got = {(r.job, r.line) for r in _drain(live.log_tail(spark, str(logs)), "tail", "append")}
    assert got == {("job-7", "one"), ("job-7", "two")}
    beat = live.Heartbeat()
    spark.streams.addListener(beat)
    try:
        q = stream.writeStream.format("noop").trigger(availableNow=True).start()
        q.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(beat)
    assert beat.rows.get(str(q.id), 0) == 3


def test_documents_in(spark, tmp_path):
    import json

    for i, (job, at) in enumerate((("a", "2024-01-02T00:00:00"), ("b", "2024-01-03T00:00:00"), ("c", "bad"))):
        d = tmp_path / "jobs" / job
        d.mkdir(parents=True)
        (d / "job.json").write_text(json.dumps({"id": job, "created_at": at, "stats": {"n": i}}))
    got = tree.job_history(spark, str(tmp_path / "jobs")).collect()
    assert [r.id for r in got] == ["b", "a", "c"] and got[2].created is None and got[0].stats.n == 1
