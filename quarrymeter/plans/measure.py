"""All lanes of repositories to one flat row and three documents.

    python -m quarrymeter.plans.measure REPO [REPO ...] --out DIR

Every lane is left-joined to the list of repositories, so a lane that gave
nothing leaves nulls and a reason, never zeros. All repositories go through
one plan: the sources take the list of them, and rows are told apart by ``repo``.
"""

from __future__ import annotations

import argparse
import secrets

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions import paths, scores
from ..operators import boundary, census, classify, detectors, emit, failures, history, projects, runtime, tree, verdicts
from ..sources import git
from ..sources import tree as trees

VERSION = "1.0"


def commits(spark: SparkSession, repos: list[str], **options) -> tuple[DataFrame, DataFrame]:
    """(commits, commit_files) with kinds, bots and top folders; a tip added by an anonymising tool is left out. Authors are keys made with a salt of this call."""
    subject, salt = F.col("subject"), secrets.token_hex(32)
    c = git.read(spark, repos, "commits", peel="true", **options).select(
        "repo", "sha", history.author_key(F.col("author_name"), F.lower(F.trim("author_email")), salt).alias("author"), F.col("author_ts").alias("ts"), "author_date", F.size("parents").alias("parents"), "subject", "ord", paths.subject_kind(subject).alias("kind"), paths.is_bot(F.col("author_name"), F.col("author_email")).alias("bot"),
    )
    f = git.read(spark, repos, "commit_files", peel="true", **options).select("repo", "sha", "path", F.coalesce(paths.top_dir(F.col("path")), F.lit("")).alias("dir"), paths.commit_file_kind(F.col("path")).alias("file_kind"), "additions", "deletions")
    return c, f


def history_lane(c: DataFrame, f: DataFrame, as_of: str) -> DataFrame:
    """One row a repository: commits, authors, calendar, classes, capacity."""
    facts = history.commit_facts(c.where("parents < 2"), f).withColumn("cls", history.commit_class()).withColumn("repair", history.is_repair())
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    classes = facts.groupBy("repo").agg(
        n(F.col("cls") == "A").alias("class_a_count"), n(F.col("cls") == "B").alias("class_b_count"), n(F.col("cls") == "C-pre").alias("class_c_pre_count"), n(F.col("repair")).alias("class_d_bug_count"),
        n(F.col("cls").isin("A", "B")).alias("confirmed_candidate_count"), n(F.col("cls") == "C-pre").alias("provisional_candidate_count"),
    )
    # implementation and churn of a mineable commit leave out generated files, and its implementation also tests
    real = f.where(~F.col("path").rlike("(?i)" + vocab.HISTORY_NON_IMPL)).groupBy("repo", "sha").agg(F.sum(F.col("additions") + F.col("deletions")).alias("churn"), n(~F.col("path").rlike(paths.HISTORY_TEST)).alias("impl"))
    good = (~F.col("bot")) & (F.col("impl") >= 2) & F.col("churn").between(20, 10000)
    mined = c.where("parents < 2").join(real, ["repo", "sha"], "left").groupBy("repo").agg(n(good).alias("mineable_commits"), n(~F.col("bot")).alias("real_commits"))
    people = c.groupBy("repo", "author").agg(F.count("*").alias("k"), F.max("bot").alias("bot")).groupBy("repo").agg(n(~F.col("bot")).alias("human_authors"), n(F.col("bot")).alias("bot_authors"), F.sum(F.when(F.col("bot"), F.col("k")).otherwise(0)).alias("bot_commit_count"))
    recent = c.where("ord < 200").groupBy("repo").agg(F.avg(F.col("subject").rlike("(?i)" + vocab.CONVENTIONAL_SUBJECT).cast("double")).alias("conventional_rate"))
    totals = c.groupBy("repo").agg(
        F.count("*").alias("total_commits"), n(F.col("parents") >= 2).alias("merge_commit_count"), F.countDistinct(F.when(F.col("parents") < 2, F.col("author_date"))).alias("active_days"),
        F.min_by("ts", F.struct("parents", (-F.col("ord")).alias("o"))).alias("first_commit"), F.min_by("ts", "ord").alias("last_commit"),
    )
    out = totals.join(people, "repo").join(recent, "repo", "left").join(classes, "repo", "left").join(mined, "repo", "left").join(months(c), "repo", "left")
    out = out.withColumn("bot_commit_ratio", F.round(scores.share(F.col("bot_commit_count").cast("double"), F.col("total_commits")), 4)).withColumn("span_days", scores.day_span(F.col("first_commit"), F.col("last_commit"))).withColumn("recency_days", scores.day_span(F.col("last_commit"), F.lit(as_of).cast("timestamp")))
    burst = F.col("total_commits").between(2, 12) & (F.col("span_days") <= 2) & (F.col("merge_commit_count") == 0) & (F.col("human_authors") <= 2)
    return out.withColumn("looks_like_burst_copy", F.coalesce(burst, F.lit(False)))


def months(c: DataFrame) -> DataFrame:
    """(repo, commits_by_month): twelve counts that end at each repository's newest month."""
    m = c.where("parents < 2").select("repo", (F.substring("author_date", 1, 4).cast("int") * 12 + F.substring("author_date", 6, 2).cast("int")).alias("m"))
    per = m.groupBy("repo", "m").agg(F.count("*").alias("n"))
    last = F.max("m").over(Window.partitionBy("repo"))  # a row a month
    slot = per.withColumn("slot", (F.col("m") - last + 11).cast("int")).where("slot >= 0")
    return slot.groupBy("repo").agg(F.map_from_entries(F.collect_list(F.struct("slot", "n"))).alias("s")).select("repo", F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.coalesce(F.try_element_at("s", i), F.lit(0))).alias("commits_by_month"))


def tags_lane(tags: DataFrame) -> DataFrame:
    return tags.groupBy("repo").agg(F.count("*").alias("tag_count"), F.sum(F.col("tag").rlike(r"^v?\d+\.\d+").cast("int")).alias("semver_tag_count"))


def tree_lane(files: DataFrame) -> DataFrame:
    """One row a repository from (repo, path, text): the tree document."""
    f = tree.with_loc(files).withColumn("language", paths.language(F.col("path")))
    code = f.where(F.col("language").isNotNull())
    own = code.where(~detectors.is_generated(F.col("text")))
    iac = detectors.iac_files(files)
    facts, deps = detectors.root_facts(files), trees.dependencies(files)
    fw, docs = detectors.frameworks(facts, deps), detectors.documentation(facts)
    by = tree.language_rank(own, 4)
    ranked = by.groupBy("repo").agg(F.max(F.when(F.col("rank") == 1, F.col("language"))).alias("primary_language"), F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") > 1, F.struct("rank", "language")))), lambda x: x["language"]).alias("secondary_languages"))
    lines = own.groupBy("repo", "language").agg(F.sum("loc").alias("loc"), F.count("*").alias("n"))
    # infrastructure counts as a language of its own beside code
    both = lines.select("repo", "language", "loc").unionByName(iac.groupBy("repo", F.col("iac").alias("language")).agg(F.sum("loc").alias("loc")))
    maps = both.groupBy("repo").agg(F.map_from_entries(F.collect_list(F.struct("language", "loc"))).alias("loc_by_language"), F.sum("loc").alias("total_loc"))
    counts = lines.groupBy("repo").agg(F.map_from_entries(F.collect_list(F.struct("language", "n"))).alias("file_count_by_language"), F.round(scores.share(F.sum(F.when(F.col("language").isin(*vocab.JVM_NET_LANGUAGES), F.col("loc")).otherwise(0)).cast("double"), F.sum("loc")), 4).alias("jvm_dotnet_loc_share"))
    sized = own.select("repo", "path", "loc").unionByName(iac.select("repo", "path", "loc"))
    sizes = tree.size_distribution(sized, "repo")
    test = F.col("path").rlike(paths.TREE_TEST)
    plain = sized.where("loc > 0").groupBy("repo").agg(F.sum((~test).cast("int")).alias("non_test_files"))
    top = Window.partitionBy("repo").orderBy(F.desc("loc"), "path")
    largest = sized.withColumn("_r", F.row_number().over(top)).where("_r <= 10").groupBy("repo").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "path", "loc"))), lambda x: F.struct(x["path"].alias("path"), x["loc"].alias("loc"))).alias("largest_files"))
    big = F.col("path").rlike(paths.FIXTURE) | (F.col("loc") > 5000)
    specs = f.groupBy("repo").agg(F.sum((test & ~big).cast("int")).alias("test_spec_files"), F.sum((test & big).cast("int")).alias("test_fixture_files"), F.sum((F.col("language").isNotNull() & detectors.is_generated(F.col("text"))).cast("int")).alias("generated_excluded"))
    kinds = detectors.project_type(facts, fw)
    signals = detectors.class_signals(files, facts, fw, detectors.keyword_hits(deps), iac)
    scored = classify.score_classes(detectors.class_terms(signals, kinds), "repo")
    confidence = scored.groupBy("repo").agg(F.map_from_entries(F.collect_list(F.struct("class", "confidence"))).alias("class_confidence"))
    parts = [
        maps, counts, ranked, sizes.withColumnRenamed("files", "total_source_files"), plain, largest, specs, detectors.iac_counters(iac), fw, kinds, detectors.lock_counts(files), detectors.direct_dependencies(facts), trees.ci_flags(files), detectors.hygiene(files), detectors.lint(facts),
        detectors.test_frameworks(facts), docs, detectors.demo_signals(facts, docs), detectors.reproducibility(facts), detectors.observability(files, facts), signals.drop("total_loc"), classify.choose(scored, "repo"), confidence, detectors.private_registry(files),
    ]
    out = files.groupBy("repo").agg(F.count("*").alias("files"))
    for p in parts:
        out = out.join(p.drop(*[x for x in p.columns if x in out.columns and x != "repo"]), "repo", "left")
    ratio = F.bround(F.col("non_test_files") / F.col("test_spec_files")).cast("int")
    out = out.withColumn("ci_present", F.col("ci_systems").isNotNull()).withColumn("test_ratio", F.round(scores.share(F.col("test_spec_files").cast("double"), F.col("total_source_files")), 4))
    return out.withColumn("test_source_ratio", F.when(F.col("test_spec_files") > 0, F.concat(F.lit("1:"), ratio)).otherwise("0 tests"))


def structure_lane(files: DataFrame) -> DataFrame:
    """(repo, source_files, prod_loc, test_files, functions, decisions_top1pct): structure of the source files."""
    states = tree.structure_inputs(files)
    seen = files.join(states.where("state = 'source'").select("repo", "path"), ["repo", "path"], "left_semi")
    n = lambda s: F.sum((F.col("state") == s).cast("int"))
    counts = states.groupBy("repo").agg(n("source").alias("source_files"), n("test").alias("test_files"), n("too_large").alias("skipped_big"), n("over_cap").alias("over_cap"))
    lines = seen.groupBy("repo").agg(F.sum(tree.newline_total(F.col("text"))).alias("prod_loc"))
    found = trees.function_decisions(seen.withColumn("ext", paths.extension(F.col("path"))).withColumn("size", F.octet_length("text"))).where("function is not null")
    top = history.concentration(found.withColumn("order", F.concat_ws(":", "path", "function")), "repo", "decisions", "order").select("repo", F.col("n").alias("functions"), F.round("top_share", 4).alias("decisions_top1pct"))
    return counts.join(lines, "repo", "left").join(top, "repo", "left")


def build_lane(files: DataFrame, phases: DataFrame | None, records: DataFrame | None) -> DataFrame:
    """(repo, ...): projects and runtimes that the tree declares and, where phase records were taken in, the build verdict."""
    found = projects.discover(files)
    report = projects.discovery_report(found)
    asked = runtime.declarations(files)
    lanes = asked.groupBy("repo").agg(F.array_sort(F.collect_list("lane")).alias("runtime_lanes_declared"))
    out = report.join(lanes, "repo", "left")
    if phases is None:
        return out.withColumn("build_ok", F.lit(None).cast("boolean")).withColumn("testable_at_head", F.lit(None).cast("boolean"))
    verdict = projects.aggregate(records, phases, report).select("repo", "build_ok", "install_ok", "tests_status", "coverage_pct", F.col("index").alias("observed_runnability"))
    return out.join(verdict, "repo", "left").withColumn("testable_at_head", F.col("tests_status").isin("tests_passed", "tests_failed"))


def measure(spark: SparkSession, repos: list[str], as_of: str, phases: DataFrame | None = None, records: DataFrame | None = None, mined: DataFrame | None = None, ceiling: int = 150) -> dict[str, DataFrame]:
    """row (41 columns), measurement (nested), mining and status documents of the repositories.

    Build phases and mined items are taken in where they were recorded; without
    them these lanes are null, or skipped, with a reason.
    """
    expected = spark.createDataFrame([(r,) for r in repos], "repo string")
    c, f = commits(spark, repos)
    everything = trees.scan(spark, repos, everything=True)
    digest = tree.content_digest(everything, "repo", "path", "content").select("repo", "digest")
    files = trees.as_text(everything.where(~paths.in_skipped_dir(F.col("path")))).select("repo", "path", "text").persist()
    h = history_lane(c, f, as_of).join(tags_lane(git.read(spark, repos, "tags")), "repo", "left").fillna(0, ["tag_count", "semver_tag_count"])
    t, s, b = tree_lane(files), structure_lane(files), build_lane(files, phases, records)
    status = git.read(spark, repos, "status", peel="true").select("repo", F.col("status").alias("git_state"), "detail", "remote")
    lanes = expected.withColumn("requested", F.lit(mined is not None)).withColumn("finished", F.lit(True))
    none = spark.createDataFrame([], "repo string, id string, strategy string, complexity string, sentence string")
    mining = census.mining_block(lanes, census.candidates(mined) if mined is not None else none, ceiling)
    j = expected.join(status, "repo", "left").join(h, "repo", "left").join(t, "repo", "left").join(digest, "repo", "left").join(s, "repo", "left").join(b.drop("ecosystems"), "repo", "left").join(mining.select("repo", F.col("total_candidates"), F.col("note")), "repo", "left")
    off = F.when(F.col("note") == "skipped", "mine_disabled")
    state = verdicts.row_state(F.lit("llm_disabled"), F.lit(False), off, F.col("total_candidates"), F.lit(None).cast("boolean"), F.lit(False))
    lost = F.col("git_state") != "ok"
    j = j.withColumn("_state", F.when(lost | F.col("files").isNull(), F.struct(F.lit("partial").alias("status"), F.lit("lanes_unavailable").alias("reason"))).otherwise(state)).persist()  # a row a repository, for all documents
    time = lambda x: F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    none_of = lambda kind="string": F.lit(None).cast(kind)
    values = {
        "repo_digest": F.col("digest"), "fake_repo_name": F.concat(F.lit("repo-"), F.substring("digest", 1, 12)), "status": F.col("_state.status"), "skip_reason": F.col("_state.reason"), "measured_at": time(F.lit(as_of).cast("timestamp")), "loc": F.col("total_loc"),
        "languages": F.col("loc_by_language"), "primary_language": F.col("primary_language"), "test_code_files": F.col("test_files"), "test_spec_files": F.col("test_spec_files"), "test_ratio": F.col("test_ratio"), "test_source_ratio": F.col("test_source_ratio"), "test_framework": F.col("test_frameworks"),
        "has_ci": F.col("ci_present"), "ci_present": F.col("ci_present"), "ci_runs_tests": F.col("ci_tests"), "detected_frameworks": F.col("frameworks"), "commit_count": F.col("total_commits"), "author_count": F.col("human_authors"), "first_commit_at": time("first_commit"), "last_commit_at": time("last_commit"),
        "active_days": F.col("active_days"), "span_days": F.col("span_days"), "commits_by_month": F.col("commits_by_month"), "repo_class": F.col("primary_class"), "is_likely_demo": F.col("is_likely_demo"), "build_ok": F.col("build_ok"), "testable_at_head": F.col("testable_at_head"), "capacity": F.col("mineable_commits"),
    }
    flat = j.select("repo", *[values.get(n, none_of()).alias(n) for n in boundary.ROW])
    row = boundary.Spec(boundary.ROW, ("repo",)).enforce(flat)
    group = lambda df, name, more=(): F.struct(*[F.col(x) for x in df.columns if x != "repo"], *more).alias(name)
    nested = j.select("repo", F.lit(VERSION).alias("measurer_version"), "digest", paths.remote_name(F.col("remote")).alias("real_repo_name"), F.col("mineable_commits").alias("capacity"), group(h, "git", (F.col("git_state"), F.col("detail"))), group(t, "tree"), group(s, "structure"), group(b.drop("ecosystems"), "build"))
    return {"row": row, "measurement": nested, "mining": mining, "status": j.select("repo", "git_state", "detail", F.col("_state.status").alias("status"), F.col("_state.reason").alias("reason"))}


def attributed_logs(logs: DataFrame, files: DataFrame) -> DataFrame:
    """Failure records of (repo, project_id, log, timed_out), owned with the tree's own registry files in view."""
    asked = detectors.private_registry(files)
    return failures.attributed(logs.join(asked, "repo", "left"), F.coalesce("private_registry", F.lit(False))).drop("private_registry")


def main() -> None:
    p = argparse.ArgumentParser(description="Measure repositories.")
    p.add_argument("repos", nargs="+")
    p.add_argument("--out", required=True)
    p.add_argument("--as-of", default="2026-01-01 00:00:00")
    p.add_argument("--sink", default="json", choices=("json", "csv", "db"))
    a = p.parse_args()
    spark = SparkSession.builder.appName("quarrymeter").getOrCreate()
    docs = measure(spark, a.repos, a.as_of)
    emit.write_documents(docs["row"], f"{a.out}/codebase_repos", a.sink)
    emit.write_documents(docs["row"], f"{a.out}/codebase_repos_csv", "csv")
    emit.write_documents(docs["mining"], f"{a.out}/codebase_repo_mining")
    for name in ("measurement", "status") if a.sink != "csv" else ("status",):
        emit.write_documents(docs[name], f"{a.out}/{name}")


if __name__ == "__main__":
    main()
