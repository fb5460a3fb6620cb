"""Column builders on literal rows."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrymeter.functions import paths, scores, text
from quarrymeter.operators import failures, history, projects, runtime, verdicts


def one(spark, values, expr, name="x", kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"{name} {kind}").coalesce(1)
    return [r[0] for r in df.select(expr(F.col(name))).collect()]


def test_line_count(spark):
    assert one(spark, ["a\n\n b\r\nc", "", None, "\r\r", "x"], text.line_count) == [3, 0, 0, 0, 1]
    assert one(spark, ["a\n\nb\n"], lambda c: text.line_count(c, cap=4)) == [4]


def test_generated_window(spark):
    assert one(spark, ["x" * 480 + " # DO NOT EDIT", "x" * 501 + "# do not edit", None], text.is_generated) == [True, False, False]


def test_redaction(spark):
    rows = ["see src/a.py at deadbeef1", "the WidgetFactory and PostgreSQL", "Acme", "Python", "plain", None, "a\n b", "x " * 1500]
    df = spark.createDataFrame([(r,) for r in rows], "x string").coalesce(1).select(text.redacted(F.col("x")).alias("r"))
    got = [(r.r.text, r.r.labels) for r in df.collect()]
    assert got[:3] == [("see [path] at [revision]", ["a filesystem path", "an object hash"]), ("the [identifier] and PostgreSQL", ["a class name"]), ("[identifier]", ["a proper name"])]
    assert got[3:7] == [("Python", []), ("plain", []), ("", []), ("a b", [])]
    assert got[7][0].endswith("x...") and len(got[7][0]) <= 2003


def test_redaction_settles(spark):
    rows = ["k src/b.py Foo.Bar() {x}", "a@b.org MAX_SIZE x_y", "call it(now) MyClass", "0" * 40]
    df = spark.createDataFrame([(r,) for r in rows], "x string").select(text.scrub(F.col("x")).alias("x"))
    assert df.where(text.first_leak(F.col("x")).isNotNull()).count() == 0


def test_scrub_reaches_nested_values(spark):
    from quarrymeter.operators import emit

    df = spark.sql("select array('src/a.py', 'fine') a, map('MyThing', struct('x_y' as s, 3 as n)) m, struct(array('deadbeef12') as z) t, 5 as n")
    got = emit.scrub(df).first()
    assert got.a == ["[path]", "fine"] and dict(got.m) == {"[identifier]": got.m["[identifier]"]} and got.m["[identifier]"].s == "[identifier]" and got.t.z == ["[revision]"] and got.n == 5
    ok = emit.refuse_leaks(spark.createDataFrame([("fine",)], "x string"), ["x"])
    assert ok.count() == 1
    with pytest.raises(Exception, match="x leaks"):
        emit.refuse_leaks(spark.createDataFrame([("src/a.py",)], "x string"), ["x"]).collect()


def test_sentences(spark):
    got = one(spark, ["Add a cache.", "", "see https: now", "a/b/c here", "my_var x", " ".join(["w"] * 41), " ".join(["w"] * 40), "Ask Acme for it", "Use Python for it"], text.sentence_verdict)
    assert got == ["ok", "empty", "url", "path separator", "snake_case identifier", "too long", "ok", "capitalised name", "ok"]
    own = one(spark, ["census failed (llm_disabled)", "other (thing_x)"], lambda c: text.sentence_verdict(c, 120, ("llm_disabled",)))
    assert own == ["ok", "snake_case identifier"]


def test_names(spark):
    assert one(spark, ["Foo_Bar", "'x'", "@a/b/", "a b", "g:a"], text.dependency_name) == ["foo-bar", "x", "@a/b", None, "g:a"]
    assert one(spark, ["Flask>=2", "-r other", "# no"], text.requirement_name) == ["flask", None, None]


def test_ci_commands(spark):
    assert one(spark, ["sudo pytest -q && FOO=1 make lint\n# c\necho x; ls"], text.ci_commands) == [["pytest -q", "make lint", "echo x", "ls"]]


def test_json_in(spark):
    got = one(spark, ['{"a": 1}', 'text ```json\n{"a": 2}\n``` more', 'say {"a": 3} ok', "none"], lambda c: F.expr("1") if c is None else F.try_variant_get(text.json_in(c), "$.a", "int"))
    assert got == [1, 2, 3, None]


def test_versions(spark):
    assert one(spark, ["v1.20.3-rc", "go 7", "none"], text.version_parts) == [[1, 20, 3], [7], None]


def test_paths(spark):
    assert one(spark, ["a/node_modules/b.js", ".github/w.yml", ".git/x", "src/a.py"], paths.in_skipped_dir) == [True, False, True, False]
    assert one(spark, ["https://h.org/o/r.git", "git@h.org:o/r", "/local/path", "https://h/a/b/c/d/e", "file:///a/b", "C:/x/y"], paths.remote_name) == ["o/r", "o/r", None, None, None, None]
    assert one(spark, ["a/b/c"], paths.ancestors) == [["", "a", "a/b"]]
    assert one(spark, ["x/.env", "a/key.pem", "a/keys.py"], paths.is_credential) == [True, True, False]
    assert one(spark, ["refs/heads/a", "refs/tags/v1", "HEAD"], paths.ref_kind) == ["local", "tag", "other"]
    assert one(spark, ["*.pem", "a?c.*"], lambda c: c) and [paths.glob_pattern(g) for g in ("*.pem", "a?c.*")] == [r"^[^/]*\.pem$", r"^a[^/]c\.[^/]*$"]


def test_iac(spark):
    rows = [("a/Dockerfile", "", False), ("m.tf", "", False), ("k.yaml", "apiVersion: v1\nkind: Pod\n", False), ("c.yaml", "services:\n a:\n  image: b", False), ("p.yml", "x\nhosts: all", False), ("x.py", "", False), ("c/values.yaml", "a: 1", True), (".github/a.yml", "hosts: x", False)]
    df = spark.createDataFrame(rows, "p string, t string, chart boolean").coalesce(1)
    got = [r[0] for r in df.select(paths.iac_type(F.col("p"), F.col("t"), F.col("chart"), F.lit(False))).collect()]
    assert got == ["Dockerfile", "Terraform", "Kubernetes", "Docker Compose", "Ansible", None, "Helm", None]


def test_scores(spark):
    assert one(spark, ["3", "99", "-1", "x", None], lambda c: scores.clamp(c, 0, 4, 0)) == [3, 4, 0, 0, 0]
    assert one(spark, [0.1, 5.0, 60.0, None], scores.depth_band, kind="double") == [0, 2, 6, None]
    df = spark.createDataFrame([(True, True), (True, None)], "a boolean, b boolean").coalesce(1)
    assert [r[0] for r in df.select(scores.index_of(F.col("a"), F.col("b"))).collect()] == [2, None]
    late = spark.sql("select timestamp'2020-01-01 23:50:00' a, timestamp'2020-01-02 00:10:00' b")
    assert late.select(scores.day_span(F.col("a"), F.col("b"))).first()[0] == 0


def test_csv_cells(spark):
    df = spark.sql("select null n, true b, map('z',1,'a',2) m, array(1,2) a, 'x' s")
    from quarrymeter.operators.emit import csv_row

    assert tuple(csv_row(df).first()) == ("", "true", '{"a":2,"z":1}', "[1,2]", "x")


def test_runner_counts(spark):
    rows = [("pytest", "== 1 failed, 4 passed, 2 skipped in 1s =="), ("cargo", "test result: ok. 3 passed; 0 failed; 1 ignored\ntest result: ok. 2 passed; 1 failed; 0 ignored"), ("mocha", "5 passing\n1 failing"), ("rspec", "6 examples, 1 failure, 2 pending"), ("jest", "nothing")]
    df = spark.createDataFrame(rows, "k string, o string").coalesce(1)
    got = [tuple(r[0]) for r in df.select(failures.runner_counts(F.col("k"), F.col("o"))).collect()]
    assert got == [(None, 4, 1, None, 2), (7, 5, 1, None, 1), (6, 5, 1, None, None), (6, 3, 1, None, 2), (None, None, None, None, None)]


@given(st.lists(st.integers(0, 30), min_size=1, max_size=3), st.sampled_from([">=14 <21", "^0.10", "~=3.11", "16 || 18", "=18.0.0", "*", ">=1.2,<=2", "bad spec!"]))
@settings(max_examples=200, deadline=None)
def test_windows_hold_their_floor(version, spec):
    got = runtime.windows_of(spec)
    if spec in ("bad spec!", "*"):
        assert got == []
    else:
        assert got and all(w["low"] is None or w["high"] is None or w["low"] < w["high"] for w in got)


def test_version_windows(spark):
    rows = [("^0.10", [0, 10, 5], True), ("^0.10", [0, 11, 0], False), ("~=3.11", [3, 12], False), ("~=3.11", [3, 11, 9], True), (">=14 <21", [20, 9], True), (">=14 <21", [21, 0], False), ("16 || 18", [18, 2], True), ("16 || 18", [17, 1], False), ("*", [1], True), ("what", [1], True)]
    df = runtime.with_windows(spark.createDataFrame([(s, v) for s, v, _ in rows], "spec string, v array<int>").coalesce(1), "spec")
    assert [r[0] for r in df.select(runtime.contains(F.col("v"), F.col("windows"))).collect()] == [r[2] for r in rows]


def test_even_sample(spark):
    df = spark.range(1000).select(F.col("id"))
    got = sorted(r.id for r in history.even_sample(df, ["id"], 160).collect())
    assert got == sorted({int(i * (1000 / 160)) for i in range(160)})
    assert history.even_sample(spark.range(5), ["id"], 160).count() == 5


def test_containment(spark):
    p = spark.createDataFrame([("npm", "a/b/c"), ("npm", "x/y"), ("pip", "a/b/c")], "ecosystem string, project string")
    r = spark.createDataFrame([("npm", "a"), ("npm", "a/b"), ("npm", "")], "ecosystem string, root string")
    assert {(x.ecosystem, x.project, x.root) for x in projects.covering_root(p, r).collect()} == {("npm", "a/b/c", "a/b"), ("npm", "x/y", "")}


def test_ladder(spark):
    rows = [(1, "ok", None), (1, "ok", None), (2, "ok", None), (2, "skipped", None), (3, "failed", "repo"), (3, "failed", "runner"), (4, "failed", "runner"), (5, "failed", None)]
    df = spark.createDataFrame(rows, "p long, status string, attribution string")
    got = {r.p: (r.reason, r.build_ok) for r in projects.roll_up(df, "p").collect()}
    assert got == {1: ("all_built", True), 2: ("skipped", None), 3: ("intrinsic", False), 4: ("limited", None), 5: ("unattributed", None)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "sha long, author long, ts timestamp, kind string, bot boolean")
    assert history.month_histogram(none).count() == 0
    assert history.author_profile(none).first().bot_ratio == 0.0
    assert history.calendar(none, "2020-01-01").first().active_days is None


def test_texts(spark):
    assert one(spark, ['{"cells":[{"cell_type":"code","source":["a\\n","b"]},{"cell_type":"markdown","source":["x"]}]}'], text.notebook_code) == ["a\nb"]
    assert one(spark, ["a|b", None], text.markdown_cell) == ["a\\|b", ""]
    assert one(spark, ["node pnpm!", "**"], text.slug) == ["node-pnpm", None]
    assert one(spark, ["HOME=/x run", "  "], lambda c: text.error_tails(c, F.lit("bad"))) == ["standard error tail: bad | standard output tail: HOME=/x run", "standard error tail: bad"]
    assert one(spark, ['{"is_error": true, "result": "busy"}', '{"error": {"message": "m"}}', "x"], text.envelope_error) == ["busy", "m", ""]
    assert one(spark, ["x"], lambda c: text.clean_commands(F.array(c, F.lit(" "), F.lit("run  it")))) == [["x", "run it"]]


def test_run_figures(spark):
    assert one(spark, [30.0, 600.0], verdicts.least_attempt, kind="double") == [7.5, 120.0]
    assert one(spark, [-9, 139, 3221225477, 1, None], verdicts.signalled, kind="long") == [True, True, True, False, False]


def test_commit_facts_tell_repositories_apart(spark):
    c = spark.createDataFrame([("a", "s"), ("b", "s")], "repo string, sha string")
    f = spark.createDataFrame([(r, "s", p, "d", "impl", 5, 1) for r in "ab" for p in ("x", "y")], "repo string, sha string, path string, dir string, file_kind string, additions int, deletions int")
    assert {(r.repo, r.files, r.additions) for r in history.commit_facts(c, f).collect()} == {("a", 2, 10), ("b", 2, 10)}


def test_substance(spark):
    assert one(spark, ["3", "9", "x", None], verdicts.substance) == [3, 4, None, None]


def test_declared_fields(spark):
    from quarrymeter.operators import boundary

    spec = boundary.Spec({"n": boundary.NUMBER, "kind": boundary.enum("a", "b", fold=True), "who": boundary.withheld("nobody is named")}, ("id",))
    assert spec.keys() == {"n", "kind", "who", "a", "b", "other"} and spec.withheld() == {"who": "nobody is named"}
    df = spark.createDataFrame([(1, 2.0, "a", "joe"), (2, float("nan"), "z", None)], "id int, n double, kind string, who string")
    assert [tuple(r) for r in spec.problems(df).collect()] == [(2, "n", "not finite")]
    assert tuple(spec.enforce(df.where("id = 1")).first()) == (1, 2.0, "a", None)
    with pytest.raises(Exception, match="refusing to write n"):
        spec.enforce(df).collect()
    with pytest.raises(ValueError, match="not declared"):
        spec.enforce(df.withColumn("path", F.lit("src/a.py")))


def test_rows_of_the_flat_table_are_declared():
    from quarrymeter.operators import boundary

    assert len(boundary.ROW) == 41 and {k.group for k in boundary.ROW.values()} >= {"numbers", "booleans", "enums", "identity", "timestamps", "withheld"}


def test_fields_are_dropped_at_any_depth(spark):
    from quarrymeter.operators import emit

    kind = "id int, log string, a struct<x: int, log: string, deep: array<struct<log: int, y: map<string, struct<log: int, z: int>>>>>, gone struct<log: int>, list array<struct<log: int>>, m map<string, array<int>>, `odd.name` struct<log: int, `v.w`: int>"
    rows = [(1, "l", (2, "l", [(3, {"k": (4, 5), "n": None}), None]), (6,), [(7,)], {"log": [8]}, (9, 10)), (2, None, None, None, None, None, None)]
    got = emit.without(spark.createDataFrame(rows, kind), ["log"])
    assert got.schema.simpleString() == "struct<id:int,a:struct<x:int,deep:array<struct<y:map<string,struct<z:int>>>>>,m:map<string,array<int>>,odd.name:struct<v.w:int>>"
    first, second = (r.asDict(True) for r in got.orderBy("id").collect())
    assert first == {"id": 1, "a": {"x": 2, "deep": [{"y": {"k": {"z": 5}, "n": None}}, None]}, "m": {"log": [8]}, "odd.name": {"v.w": 10}}
    assert second == {"id": 2, "a": None, "m": None, "odd.name": None}


def test_author_keys_hold_for_one_salt_only(spark):
    from quarrymeter.operators import history

    rows = [("Ann", "a@x.org"), ("Ann", "a@x.org"), ("Ann", "b@x.org"), ("An", "na@x.org"), (None, "a@x.org"), (None, None)]
    df = spark.createDataFrame(rows, "name string, email string")
    keys = lambda salt: [r[0] for r in df.select(history.author_key(F.col("name"), F.col("email"), salt)).collect()]
    one, two = keys("s"), keys("t")
    assert one[0] == one[1] and len(set(one)) == 5 and not set(one) & set(two) and all(len(k) == 16 for k in one)
