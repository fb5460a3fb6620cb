"""Projects and builds: containment, phases, roll-up, attribution, budgets, runner output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import ancestors, base_name, depth, folder, in_skipped_dir
from ..vocab import PROJECT_SKIP_DIRS


def subtree_sums(dirs: DataFrame, path: str, value: str) -> DataFrame:
    """Sum of a value at and below every folder: ancestors are exploded, so it is one grouped sum, not a prefix join."""
    return dirs.select(F.explode(ancestors(F.col(path))).alias("root"), F.col(value).alias("v")).groupBy("root").agg(F.sum("v").alias("total"), F.count("*").alias("n"))


def covering_root(projects: DataFrame, roots: DataFrame) -> DataFrame:
    """Nearest root of the same ecosystem above each project, by equi-join on exploded ancestors."""
    up = projects.select("ecosystem", "project", F.posexplode(ancestors(F.col("project"))).alias("depth", "root"))
    hit = up.join(roots.select("ecosystem", "root"), ["ecosystem", "root"])
    return hit.groupBy("ecosystem", "project").agg(F.max_by("root", "depth").alias("root"))


def overlaps(spans: DataFrame, key: str, start: str, end: str, width: int) -> DataFrame:
    """Pairs (a, b), a < b, of overlapping spans inside a key: each starts before the other ends.

    So spans that only touch don't overlap, an instant overlaps the spans that hold it
    between their ends, and so does a span that ends before it starts.

    Interval join by time cells: a span's level doubles ``width`` seconds until it
    fits, so it touches two cells of its level or of a higher one at most. Two
    spans meet at the higher of their levels, in the cell where the later one
    begins: each pair comes once, the join is an equi-join, and a long span is
    listed no more often than there are levels.
    """
    s = spans.select(F.col(key).alias("k"), F.col("id"), F.col(start).alias("s"), F.col(end).alias("e")).where("s is not null and e is not null")
    s = s.withColumn("lo", F.least("s", "e")).withColumn("hi", F.greatest("s", "e"))
    size = F.unix_micros("hi") - F.unix_micros("lo")
    level = F.when(size == 0, 0).otherwise(F.greatest(F.lit(0), F.ceil(F.log2(size / F.lit(width * 1_000_000))))).cast("int")
    s = s.withColumn("l", level)
    levels = sorted(r.l for r in s.select("l").distinct().collect())  # some forty at most
    up = s.withColumn("m", F.explode(F.filter(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>"), lambda x: x >= F.col("l"))))
    cell = lambda c: F.floor(F.unix_micros(c) / (F.lit(width * 1_000_000) * F.pow(F.lit(2.0), F.col("m"))))
    a, b = up.withColumn("cell", F.explode(F.sequence(cell("lo"), cell("hi")))).alias("a"), up.withColumn("cell", cell("lo")).alias("b")
    later = (F.col("a.lo") < F.col("b.lo")) | ((F.col("a.lo") == F.col("b.lo")) & (F.col("a.id") < F.col("b.id")))
    same = (F.col("a.k") == F.col("b.k")) & (F.col("a.m") == F.col("b.m")) & (F.col("a.cell") == F.col("b.cell"))
    meet = (F.col("a.s") < F.col("b.e")) & (F.col("b.s") < F.col("a.e"))
    hit = a.join(b, same & (F.col("a.m") == F.greatest("a.l", "b.l")) & later & meet & (F.col("a.id") != F.col("b.id")))
    return hit.select(F.col("a.k").alias(key), F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b"))


def propagate(phases: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Phases after a failure inherit its owner and are blocked."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    failed = F.when(F.col("status") == "failed", F.col("attribution"))
    owner = F.last(failed, ignorenulls=True).over(before)
    return phases.withColumn("effective", F.when(owner.isNotNull(), F.lit("blocked")).otherwise(F.col("status"))).withColumn("owner", F.coalesce(owner, failed))


def roll_up(phases: DataFrame, key: str) -> DataFrame:
    """Tri-state build verdict of each key with its reason: true, false or null (not attributable)."""
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    s = F.col("status")
    per = phases.groupBy(key).agg(F.count("*").alias("total"), n(s == "ok").alias("ok"), n(s == "skipped").alias("skipped"), n((s == "failed") & (F.col("attribution") == "repo")).alias("intrinsic"), n((s == "failed") & (F.col("attribution") == "runner")).alias("limited"))
    c = F.col
    reason = (
        F.when(c("total") == 0, "none").when(c("ok") == c("total"), "all_built").when(c("ok") + c("skipped") == c("total"), "skipped")
        .when(c("intrinsic") > 0, "intrinsic").when(c("limited") > 0, "limited").otherwise("unattributed")
    )
    verdict = F.when(reason == "all_built", True).when(reason == "intrinsic", False)
    return per.withColumn("reason", reason).withColumn("build_ok", verdict)


def as_shipped(phases: DataFrame) -> DataFrame:
    """Phases before any repair; what only ran after one is not measured."""
    return phases.withColumn("status", F.when(~F.coalesce(F.col("after_repair"), F.lit(False)), F.col("status")))


def status_histogram(phases: DataFrame) -> DataFrame:
    return phases.groupBy("status").agg(F.count("*").alias("n"))


def budget_shares(projects: DataFrame, key: str, weight: str, tie: str, top: int = 8) -> DataFrame:
    """Top projects of each key and each one's share of the weight that is still to come."""
    w = Window.partitionBy(key).orderBy(F.desc(weight), tie)
    ranked = projects.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    rest = Window.partitionBy(key).orderBy("rank").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return ranked.withColumn("budget_share", F.col(weight) / F.nullif(F.sum(weight).over(rest), F.lit(0)))


def running_cut(rows: DataFrame, key: str, order: str, size: str, limit: int) -> DataFrame:
    """Rows of each key while the bytes before them stay below the limit."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("before", F.coalesce(F.sum(size).over(before), F.lit(0))).where(F.col("before") < limit)


def go_events(lines: DataFrame) -> DataFrame:
    """Counts by final action of test events, one JSON object a line."""
    e = lines.select(F.from_json("line", "Action string, Test string, Package string").alias("e")).where("e.Test is not null and e.Action in ('pass', 'fail', 'skip')")
    return e.groupBy(F.col("e.Action").alias("action")).agg(F.count("*").alias("n"))


# -------------------------------------------------------------- discovery
#: Markers of an ecosystem, runtime lane of an ecosystem, bounds of a search.
MARKERS = {
    "node": ("package.json",), "python": ("pyproject.toml", "setup.py", "setup.cfg", "requirements.txt", "Pipfile", "tox.ini", "noxfile.py", "environment.yml"), "go": ("go.mod",), "maven": ("pom.xml",),
    "gradle": ("build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts"), "rust": ("Cargo.toml",), "ruby": ("Gemfile",), "php": ("composer.json",),
}
DOTNET = r"\.(sln|csproj|fsproj|vbproj)$"
LANES = {"node": "node", "python": "python", "go": "go", "maven": "java", "gradle": "java", "rust": "rust", "ruby": "ruby", "dotnet": "dotnet"}
MAX_DEPTH, MAX_PROJECTS, MAX_PROBED, MAX_LISTED = 4, 24, 8, 50
COVERAGE_CAPABLE, COVERAGE_BONUS = ("python", "node", "go"), 1.25


def lane_of(ecosystem: Column) -> Column:
    """Runtime lane of an ecosystem, null where it has none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in LANES.items() for x in kv]), ecosystem)


def ecosystems(files: DataFrame) -> DataFrame:
    """(repo, root, ecosystem, depth): folders that hold a build marker, '' for the repository's root.

    files: (repo, path, ...). Folders that a search never enters are left out.
    """
    name = base_name(F.col("path"))
    kind = F.when(name.rlike(DOTNET), "dotnet")
    for eco, names in MARKERS.items():
        kind = kind.when(name.isin(*names), eco)
    seen = files.where(~in_skipped_dir(F.col("path"), PROJECT_SKIP_DIRS, ())).withColumn("ecosystem", kind).where("ecosystem is not null")
    return seen.select("repo", folder(F.col("path")).alias("root"), "ecosystem", depth(F.col("path")).alias("depth")).distinct()


def workspace_globs(files: DataFrame) -> DataFrame:
    """(repo, ecosystem, root, globs): roots whose one command covers folders below them, and which."""
    path, text, name = F.col("path"), F.col("text"), base_name(F.col("path"))
    at = lambda cond, eco, globs: files.where(cond).select("repo", F.lit(eco).alias("ecosystem"), folder(path).alias("root"), globs.alias("globs"))
    listed = lambda p: F.from_json(F.get_json_object(text, p), "array<string>")
    everything = F.array(F.lit("**"))
    lines = F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^\s*-\s*['\"]?([^'\"\n]+)['\"]?\s*$"), F.lit(1)), F.trim)
    quoted = lambda key: F.regexp_extract_all(F.regexp_extract(text, rf"(?sm)^\s*{key}\s*=\s*\[(.*?)\]", 1), F.lit("['\"]([^'\"]+)['\"]"), F.lit(1))
    members = F.when(F.size(quoted("members")) > 0, quoted("members")).otherwise(everything)
    parts = [
        at(name == "package.json", "node", F.coalesce(listed("$.workspaces"), listed("$.workspaces.packages"))),
        at(name == "pnpm-workspace.yaml", "node", F.when(F.size(lines) > 0, lines).otherwise(everything)),
        at((name == "Cargo.toml") & text.rlike(r"(?m)^\s*\[workspace\]"), "rust", F.array_except(members, quoted("exclude"))),
        at(name == "go.work", "go", everything), at((name == "pom.xml") & text.rlike("<modules>"), "maven", everything),
        at(name.isin("settings.gradle", "settings.gradle.kts"), "gradle", everything), at(name.rlike(r"\.sln$"), "dotnet", everything),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("size(globs) > 0").groupBy("repo", "ecosystem", "root").agg(F.array_distinct(F.flatten(F.collect_list("globs"))).alias("globs"))


def glob_fits(path: Column, glob: Column) -> Column:
    """Whether a workspace glob covers a folder: as a pattern whose * crosses folders, as a name, or by a folder before '/*'."""
    g = F.regexp_replace(F.trim(glob), "/+$", "")
    pattern = F.regexp_replace(F.regexp_replace(F.regexp_replace(g, r"([.+^$(){}|\\])", r"\\$1"), r"\*+", ".*"), r"\?", ".")
    return F.when(g == "", False).when(g.isin("*", "**"), True).otherwise(F.rlike(path, F.concat(F.lit("^"), pattern, F.lit("(/.*)?$"))) | (path == g))


def discover(files: DataFrame) -> DataFrame:
    """(repo, project_id, root, ecosystem, workspace, members, weight, state, reason) of every folder with a build marker.

    A folder covered by a workspace of its ecosystem above it is a member of it
    (state member), unless that root isn't a project itself (ambiguous). Folders
    too deep, and projects beyond MAX_PROJECTS, are omitted with a reason. All
    joins are equi-joins on exploded ancestors.
    """
    found = ecosystems(files)
    near = found.where(F.col("depth") <= MAX_DEPTH)
    roots = workspace_globs(files).join(near.select("repo", "ecosystem", "root"), ["repo", "ecosystem", "root"])
    up = near.where("root <> ''").select("repo", "ecosystem", "root", F.posexplode(ancestors(F.col("root"))).alias("level", "above")).where("above <> root")
    hit = up.join(roots.select("repo", "ecosystem", F.col("root").alias("above"), "globs"), ["repo", "ecosystem", "above"])
    inner = F.when(F.col("above") == "", F.col("root")).otherwise(F.expr("substring(root, length(above) + 2)"))
    owner = hit.withColumn("inner", inner).where(F.exists("globs", lambda g: glob_fits(F.col("inner"), g))).groupBy("repo", "ecosystem", "root").agg(F.min_by("above", "level").alias("owner"))
    sizes = files.where(~in_skipped_dir(F.col("path"), PROJECT_SKIP_DIRS, ()) & (depth(F.col("path")) <= MAX_DEPTH)).groupBy("repo", folder(F.col("path")).alias("dir")).agg(F.count("*").alias("n"))
    weight = sizes.select("repo", F.explode(F.array_union(ancestors(F.col("dir")), F.array("dir"))).alias("root"), "n").groupBy("repo", "root").agg(F.sum("n").alias("weight"))
    all_ = found.join(owner, ["repo", "ecosystem", "root"], "left").join(roots.select("repo", "ecosystem", "root", F.lit(True).alias("ws")), ["repo", "ecosystem", "root"], "left").join(weight, ["repo", "root"], "left")
    own = all_.where((F.col("depth") <= MAX_DEPTH) & F.col("owner").isNull())
    w = Window.partitionBy("repo").orderBy("depth", "root", "ecosystem")
    ranked = own.withColumn("rank", F.row_number().over(w))
    projects = ranked.where(F.col("rank") <= MAX_PROJECTS)
    names = projects.select("repo", "ecosystem", F.col("root").alias("owner"), F.lit(True).alias("probed"))
    held = all_.where((F.col("depth") <= MAX_DEPTH) & F.col("owner").isNotNull()).join(names, ["repo", "ecosystem", "owner"], "left")
    members = held.where("probed").groupBy("repo", "ecosystem", F.col("owner").alias("root")).agg(F.array_sort(F.collect_list(F.col("root"))).alias("members"))
    row = lambda df, state, reason, id_=F.lit(None).cast("string"), mem=F.array().cast("array<string>"): df.select("repo", id_.alias("project_id"), "root", "ecosystem", F.coalesce("ws", F.lit(False)).alias("workspace"), mem.alias("members"), F.coalesce("weight", F.lit(1)).alias("weight"), F.lit(state).alias("state"), F.lit(reason).cast("string").alias("reason"))
    out = row(projects.join(members, ["repo", "ecosystem", "root"], "left"), "project", None, F.concat(F.lit("p"), "rank"), F.coalesce("members", F.array().cast("array<string>")))
    out = out.unionByName(row(ranked.where(F.col("rank") > MAX_PROJECTS), "omitted", "project_budget_exhausted")).unionByName(row(all_.where(F.col("depth") > MAX_DEPTH), "omitted", "depth_limit"))
    return out.unionByName(row(held.where("probed"), "member", None)).unionByName(row(held.where("probed is null"), "ambiguous", "workspace_root_not_probed"))


def discovery_report(found: DataFrame) -> DataFrame:
    """(repo, n_projects, ecosystems, n_omitted, n_ambiguous, unreachable, truncated) of a discovery."""
    is_ = lambda s: F.col("state") == s
    gap = is_("omitted") | is_("ambiguous")
    n = lambda cond: F.sum(cond.cast("int"))
    some = lambda cond: F.array_sort(F.collect_set(F.when(cond, F.col("ecosystem"))))
    return found.groupBy("repo").agg(n(is_("project")).alias("n_projects"), some(is_("project")).alias("ecosystems"), n(is_("omitted")).alias("n_omitted"), n(is_("ambiguous")).alias("n_ambiguous"), some(gap).alias("unreachable"), (n(is_("project")) >= MAX_PROJECTS).alias("truncated"))


def allocate(found: DataFrame) -> DataFrame:
    """(repo, project_id, rank, probed, share): projects by size, workspaces first, and each one's share of what is left."""
    weight = F.col("weight") * F.when(F.col("ecosystem").isin(*COVERAGE_CAPABLE), COVERAGE_BONUS).otherwise(1.0)
    w = Window.partitionBy("repo").orderBy(F.desc(weight), F.desc("workspace"), "root", "ecosystem")
    ranked = found.where("state = 'project'").withColumn("rank", F.row_number().over(w)).withColumn("probed", F.col("rank") <= MAX_PROBED)
    rest = Window.partitionBy("repo").orderBy("rank").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ahead = F.sum(F.when(F.col("probed"), F.col("weight"))).over(rest)
    return ranked.select("repo", "project_id", "rank", "probed", F.when(F.col("probed"), F.col("weight") / F.greatest(ahead, F.lit(1))).alias("share"))


# ------------------------------------------------------------------ records
#: Phases of a project in order, and statuses that are this engine's own doing.
PHASES = ("resolve", "build", "discover", "test", "coverage")
SKIPPED = ("skipped_level", "skipped_budget")


def blank_records(projects: DataFrame) -> DataFrame:
    """A record of every project with no measurement made: figures null, the outcome the repository's until shown otherwise."""
    none = lambda t: F.lit(None).cast(t)
    return projects.select(
        "*", none("string").alias("toolchain"), F.lit(True).alias("required"), none("int").alias("n_tests_collected"), none("int").alias("n_passed"), none("int").alias("n_failed"), none("double").alias("coverage_pct"), none("string").alias("coverage_method"),
        F.lit("NONE").alias("failure_class"), none("string").alias("build_error_class"), F.lit("repository").alias("attribution"), none("string").alias("skipped_reason"),
    )


def skipped_phases(projects: DataFrame, reason: str) -> DataFrame:
    """All phases of projects that were never tried, as this runner's doing."""
    phase = F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(p).alias("phase")) for i, p in enumerate(PHASES)]))
    return projects.select("repo", "project_id", phase.alias("p")).select("repo", "project_id", "p.*", F.lit("skipped_budget").alias("status"), F.lit(reason).alias("reason_code"), F.lit("runner").alias("attribution"), F.lit("high").alias("confidence"))


def aggregate(records: DataFrame, phases: DataFrame, discovery: DataFrame, level: str = "full", after_repair: bool = False) -> DataFrame:
    """One row a repository: install_ok and build_ok (true, false or null) with the reason, tests, coverage and the runnability index.

    records: (repo, project_id, failure_class, attribution, n_passed, n_failed, coverage_pct, repaired); phases: (repo, project_id,
    phase, status, attribution, after_repair); discovery: (repo, unreachable, truncated). Limits of this runner give
    null, failures of the repository a low figure. With ``after_repair`` repaired projects count as they are after it.
    """
    c = F.col
    late = F.coalesce(c("after_repair"), F.lit(False))
    best = F.max_by(F.struct("status", "attribution"), late.cast("int")) if after_repair else F.max(F.when(~late, F.struct("status", "attribution")))
    per = phases.groupBy("repo", "project_id", "phase").agg(best.alias("s"), F.max(c("status").isin(*SKIPPED)).alias("skip"), F.max(c("status") == "skipped_budget").alias("late"))
    wide = per.groupBy("repo", "project_id").agg(*[F.max(F.when(c("phase") == p, c("s"))).alias(f"_{p}") for p in PHASES], F.max("skip").alias("any_skip"), F.max("late").alias("budget"))
    r = records.join(wide, ["repo", "project_id"], "left")
    if after_repair:
        mended = F.coalesce(c("repaired"), F.lit(False))
        r = r.withColumn("failure_class", F.when(mended, "NONE").otherwise(c("failure_class"))).withColumn("attribution", F.when(mended, "repository").otherwise(c("attribution")))
    is_ = lambda p, *s: F.coalesce(c(f"_{p}.status").isin(*s), F.lit(False))
    built, resolved, skipped = is_("build", "passed"), is_("resolve", "passed"), F.coalesce(c("budget"), F.lit(False))
    limited = ~built & (is_("resolve", "unavailable", "timed_out") | is_("build", "unavailable", "timed_out") | skipped | c("attribution").isin("runner", "external_service"))
    blocked = F.when(c("_test").isNull(), "unknown").when(is_("test", "passed") | (c("_test.attribution") == "repository"), None).otherwise(c("_test.attribution"))
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    a = r.groupBy("repo").agg(
        F.count("*").alias("required"), n(built).alias("n_built"), n(resolved).alias("n_resolved"), n(c("failure_class") == "REPO_INTRINSIC").alias("n_intrinsic"), n(skipped).alias("n_skipped"), n(limited).alias("n_limited"),
        n(~resolved & c("attribution").isin("repository", "credentials")).alias("n_unresolved"), n(is_("test", "passed")).alias("n_ran"), F.collect_set("_test.status").alias("test_states"), n(c("_test").isNull()).alias("n_untested"),
        F.sum(F.coalesce("n_passed", F.lit(0))).alias("n_passed"), F.sum(F.coalesce("n_failed", F.lit(0))).alias("n_failed"), F.round(F.avg("coverage_pct"), 2).alias("coverage_pct"), F.count("coverage_pct").alias("n_covered"),
        n(is_("coverage", "passed", "unavailable")).alias("n_coverage_expected"), F.max(F.coalesce("any_skip", F.lit(False))).alias("any_skip"), F.array_sort(F.collect_set(blocked)).alias("blocked_by"),
    )
    a = discovery.join(a, "repo", "left").fillna(0, ["required", "n_built", "n_resolved", "n_intrinsic", "n_skipped", "n_limited", "n_unresolved", "n_ran", "n_untested", "n_passed", "n_failed", "n_covered", "n_coverage_expected"])
    gaps, every = F.size("unreachable") > 0, c("n_built") == c("required")
    install = F.when(c("required") == 0, None).when(c("n_resolved") == c("required"), True).when(c("n_unresolved") > 0, False)
    reason = (
        F.when(c("required") == 0, "none").when(every & ~gaps & (c("n_skipped") == 0), "all_built").when(every & (c("n_skipped") == 0), "not_covered").when((c("n_skipped") > 0) & (c("n_intrinsic") == 0), "budget")
        .when(c("n_intrinsic") > 0, "intrinsic").when((c("n_limited") > 0) | c("truncated") | gaps, "limited").otherwise("unattributed")
    )
    build = F.when(reason == "all_built", True).when(reason == "intrinsic", False)
    within = lambda *s: (c("n_untested") == 0) & (F.size(F.array_except("test_states", F.array(*map(F.lit, s)))) == 0)
    tests = F.when(c("n_ran") > 0, F.when(c("n_failed") > 0, "tests_failed").otherwise("tests_passed")).when(c("required") == 0, "unknown").when(within("no_tests"), "no_tests").when(within(*SKIPPED, "no_tests"), "not_attempted").otherwise("tests_did_not_run")
    out = a.withColumn("install_ok", install).withColumn("reason", reason).withColumn("build_ok", build).withColumn("tests_status", tests)
    tried = F.lit(level == "full") & ~F.coalesce("any_skip", F.lit(False)) & c("build_ok").isNotNull() & ((c("n_ran") > 0) | (F.size(F.coalesce("blocked_by", F.array().cast("array<string>"))) == 0))
    index = c("build_ok").cast("int") + (c("n_ran") > 0).cast("int") + (c("n_passed") > 0).cast("int") + (F.coalesce("coverage_pct", F.lit(0.0)) > 0).cast("int")
    why = F.when(F.lit(level != "full"), "level").when(F.coalesce("any_skip", F.lit(False)), "budget").when(c("build_ok").isNull(), "no_verdict").when(F.size("blocked_by") > 0, F.concat(F.lit("blocked by "), F.try_element_at("blocked_by", F.lit(1)))).otherwise("no_terms")
    out = out.withColumn("index", F.when(tried, index)).withColumn("index_reason", F.when(~tried, why)).withColumn("coverage_complete", (c("n_coverage_expected") > 0) & (c("n_covered") == c("n_coverage_expected")))
    discovered = (c("n_ran") > 0) | c("tests_status").isin("tests_failed", "tests_passed")
    return out.withColumn("discover_index", F.when(c("install_ok").isNotNull() & c("build_ok").isNotNull(), c("install_ok").cast("int") + c("build_ok").cast("int") + discovered.cast("int")))


def repair_summary(repairs: DataFrame, by: str, offered: bool = True) -> DataFrame:
    """Counters of (key, attempted, ok, reason_code, seconds); all null where no repair was offered."""
    c = F.col
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    tried = F.coalesce(c("attempted"), F.lit(False))
    per = repairs.groupBy(by).agg(
        F.count("*").alias("candidates"), n(tried).alias("attempted"), n(tried & c("ok")).alias("succeeded"), n(~tried).alias("refused"), n(tried & (c("reason_code") == "repair_modified_tracked_source")).alias("rejected_source_edit"),
        F.round(F.sum(F.when(tried, F.coalesce("seconds", F.lit(0.0))).otherwise(0.0)), 1).alias("seconds"),
    )
    out = per if offered else per.select(by, *[F.lit(None).cast(t).alias(x) for x, t in per.dtypes if x != by])
    return out.withColumn("offered", F.lit(offered))
