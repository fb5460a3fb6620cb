"""Commit history: per-commit facts, classes, repairs, authors, calendar.

Relations: commits(sha, author, ts, kind, bot), commit_files(sha, path, dir,
file_kind, additions, deletions). ``kind`` is feature, repair, noise or neutral;
``file_kind`` is test, test_infra, docs, schema or impl. One grouping by sha
serves every measure of a commit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import complexity_band, day_span, repair_complexity, share


def commit_facts(commits: DataFrame, files: DataFrame) -> DataFrame:
    """One row a commit; commits without files keep zeros. Where both sides name a repository, commits are told apart by it too."""
    key = [c for c in ("repo", "sha") if c in commits.columns and c in files.columns]
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    kind = F.col("file_kind")
    per = files.groupBy(*key).agg(
        F.count("*").alias("files"), n(kind == "test").alias("tests"), n(kind.isin("impl", "schema")).alias("impl"), n(kind == "schema").alias("schema"),
        F.countDistinct("dir").alias("diversity"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"),
    )
    out = commits.join(per, key, "left")
    return out.fillna(0, ["files", "tests", "impl", "schema", "diversity", "additions", "deletions"])


def commit_class(max_files: int = 30, max_dirs: int = 3, many_tests: int = 5) -> Column:
    """A, B, C-pre or none."""
    c = F.col
    small = (c("files") <= max_files) & (c("diversity") <= max_dirs)
    person, clean = ~c("bot"), c("kind") != "noise"
    return (
        F.when(small & (c("tests") >= 1) & (c("impl") >= 1) & person & clean, "A")
        .when((c("tests") >= many_tests) & (c("impl") < 3) & person & clean, "B")
        .when(small & (c("impl") >= 1) & (c("tests") == 0) & (c("kind") == "feature") & person, "C-pre")
        .otherwise("none")
    )


def is_repair() -> Column:
    c = F.col
    return (c("kind") == "repair") & (c("impl") >= 1) & ~c("bot") & (c("deletions") >= 1) & ((c("tests") >= 1) | (c("additions") <= 10 * c("deletions")))


def class_tallies(facts: DataFrame, many_tests: int = 5) -> DataFrame:
    """Commits and repairs of each class; latent counts at most 15 tests of a commit."""
    out = facts.withColumn("commit_class", commit_class(many_tests=many_tests)).withColumn("repair", is_repair())
    latent = F.when(F.col("commit_class") == "B", F.least("tests", F.lit(15))).otherwise(0)
    return out.groupBy("commit_class").agg(F.count("*").alias("commits"), F.sum(F.col("repair").cast("int")).alias("repairs"), F.sum(latent).alias("latent"))


def repairs(facts: DataFrame) -> DataFrame:
    """Repair commits by complexity band."""
    x = repair_complexity(F.col("impl"), F.col("diversity"), F.col("additions") + F.col("deletions"))
    return facts.where(is_repair()).withColumn("band", complexity_band(x)).groupBy("band").agg(F.count("*").alias("commits"), F.sum("deletions").alias("deletions"))


def mineable(facts: DataFrame) -> DataFrame:
    """Real commits, mineable commits and human authors in one row."""
    c = F.col
    churn = c("additions") + c("deletions")
    good = ~c("bot") & (c("impl") >= 2) & churn.between(20, 10000)
    return facts.agg(F.count("*").alias("commits"), F.sum(good.cast("int")).alias("mineable"), F.countDistinct(F.when(~c("bot"), c("author"))).alias("human_authors"))


def author_key(name: Column, email: Column, salt: str) -> Column:
    """A handle for one author that means nothing outside the run that made the salt: names and addresses go no further than this."""
    inner = F.sha2(F.concat_ws("\0", F.lit(salt), F.coalesce(name, F.lit("")), F.coalesce(email, F.lit(""))), 256)
    return F.substring(F.sha2(F.concat_ws("\0", F.lit(salt), inner), 256), 1, 16)


def author_profile(commits: DataFrame) -> DataFrame:
    per = commits.groupBy("author").agg(F.count("*").alias("n"), F.max("bot").alias("bot"))
    out = per.agg(F.sum((~F.col("bot")).cast("int")).alias("humans"), F.sum(F.col("bot").cast("int")).alias("bots"), F.sum(F.when(F.col("bot"), F.col("n")).otherwise(0)).alias("bot_commits"), F.sum("n").alias("commits"))
    return out.withColumn("bot_ratio", F.coalesce(share(F.col("bot_commits").cast("double"), F.col("commits")), F.lit(0.0)))


def recent_rate(rows: DataFrame, hit: Column, ts: str, tie: str, n: int = 200) -> DataFrame:
    """Share of hits among the newest n rows."""
    newest = rows.orderBy(F.desc(ts), F.desc(tie)).limit(n)
    return newest.agg(F.count("*").alias("rows"), F.avg(hit.cast("double")).alias("rate"))


def month_histogram(commits: DataFrame, months: int = 12) -> DataFrame:
    """Dense months that end at the newest one; months without commits count 0."""
    per = commits.groupBy(F.trunc("ts", "MM").alias("month")).agg(F.count("*").alias("n"))
    last = commits.agg(F.trunc(F.max("ts"), "MM").alias("last")).where("last is not null")
    dense = last.select(F.explode(F.sequence(F.add_months("last", 1 - months), F.col("last"), F.expr("interval 1 month"))).alias("month"))
    return dense.join(per, "month", "left").select(F.date_format("month", "yyyy-MM").alias("month"), F.coalesce("n", F.lit(0)).alias("commits"))


def calendar(commits: DataFrame, as_of: str) -> DataFrame:
    """First and last instant, span, recency, active days and the burst flag, in one row."""
    a = commits.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.nullif(F.countDistinct(F.to_date("ts")), F.lit(0)).alias("active_days"), F.count("*").alias("commits"))
    span = day_span(F.col("first_ts"), F.col("last_ts"))
    out = a.withColumn("span_days", span).withColumn("recency_days", day_span(F.col("last_ts"), F.lit(as_of).cast("timestamp")))
    return out.withColumn("burst_copy", F.coalesce((F.col("commits") >= 2) & (F.col("span_days") <= 2), F.lit(False)))


def even_sample(rows: DataFrame, order: list[str], k: int) -> DataFrame:
    """k rows spread evenly over an ordered table: positions floor(i * (n / k)) in double arithmetic.

    Positions come from a range sort and per-partition counts, not from one
    window over the whole table.
    """
    spark = rows.sparkSession
    ranked = with_position(rows, order)
    n = ranked.agg(F.count("*").alias("n")).first()[0]
    if n <= k:
        return ranked
    picks = spark.range(k).select(F.floor(F.col("id") * F.lit(n / k)).cast("long").alias("position")).distinct()
    return ranked.join(F.broadcast(picks), "position", "left_semi")


def with_position(rows: DataFrame, order: list[str]) -> DataFrame:
    """Global 0-based position in sort order, from a range partitioning and the sizes before each part."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_local", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each partition
    base = sizes.withColumn("_base", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")
    return dealt.join(F.broadcast(base), "_part").withColumn("position", F.col("_base") + F.col("_local")).drop("_part", "_local", "_base")


def concentration(functions: DataFrame, group: str, weight: str, order: str, percent: float = 0.01) -> DataFrame:
    """Share of the weight in the top max(1, round(n * percent)) rows of each group; ties by ``order``."""
    w = Window.partitionBy(group).orderBy(F.desc(weight), order)
    per = Window.partitionBy(group)
    k = F.greatest(F.lit(1), F.bround(F.count("*").over(per) * F.lit(percent)))
    ranked = functions.withColumn("_top", F.row_number().over(w) <= k)
    top, total = F.sum(F.when(F.col("_top"), F.col(weight)).otherwise(0)), F.sum(weight)
    return ranked.groupBy(group).agg(F.count("*").alias("n"), top.alias("top"), total.alias("total")).withColumn("top_share", share(F.col("top").cast("double"), F.col("total")))


def without_anonymiser(commits: DataFrame, key: str = "repo") -> DataFrame:
    """Commits without a tip (ord 0) that bears the signature of an anonymising tool; an only commit stays."""
    from ..functions.paths import is_anonymiser

    tips = commits.groupBy(key).agg(F.count("*").alias("_n"), F.max(F.when(F.col("ord") == 0, is_anonymiser(F.col("author_name"), F.col("author_email"), F.col("subject")))).alias("_a"))
    drop = (F.col("ord") == 0) & F.coalesce("_a", F.lit(False)) & (F.col("_n") > 1)
    return commits.join(tips, key).where(~drop).drop("_n", "_a")


def ref_reason(candidates: DataFrame, key: str, chosen: str) -> DataFrame:
    """(key, reason): a fixed code for a chosen ref from (key, ref, files, commits): largest tree, deepest history, both or neither."""
    w = Window.partitionBy(key)
    c = candidates.withColumn("big", F.col("files") >= F.max("files").over(w)).withColumn("deep", F.col("commits") >= F.max("commits").over(w)).where(F.col("ref") == F.col(chosen))
    return c.select(key, F.when(F.col("big") & F.col("deep"), "largest_tree_and_deepest_history").when(F.col("big"), "largest_tree").when(F.col("deep"), "deepest_history").otherwise("model_choice_recorded").alias("reason"))


def brief(commits: DataFrame, patches: DataFrame, key: str = "repo", shown: int = 12) -> DataFrame:
    """(key, ord, line): a table line of every substantive commit, with the name of its patch where one was written.

    commits: (key, sha, ord, day, subject, files, churn, paths array); patches: (key,
    sha, name). Names of files that look like credentials are left out.
    """
    from ..functions.paths import is_credential
    from ..functions.text import markdown_cell

    j = commits.join(patches, [key, "sha"], "left")
    plain = F.filter("paths", lambda p: ~is_credential(p))
    listed = F.array_join(F.transform(F.slice(plain, 1, shown), markdown_cell), ", ")
    more = F.when(F.size(plain) > shown, F.concat(F.lit(" +"), F.size(plain) - shown, F.lit(" more"))).otherwise("")
    name = F.coalesce(F.concat(F.lit("`"), "name", F.lit("`")), F.lit(""))
    cells = F.concat_ws(" | ", F.concat(F.lit("`"), F.substring("sha", 1, 12), F.lit("`")), "day", "files", "churn", name, F.substring(markdown_cell(F.col("subject")), 1, 160), F.concat(listed, more))
    return j.select(key, "ord", F.concat(F.lit("| "), cells, F.lit(" |")).alias("line"))


def collapse_refs(refs: DataFrame) -> DataFrame:
    """Aliases of one commit fold into the bytewise first name."""
    return refs.groupBy("sha").agg(F.min("ref").alias("ref"), F.count("*").alias("aliases"))


def deepest_ref(refs: DataFrame, k: int = 12) -> DataFrame:
    """Top k refs by commits, then name."""
    return refs.orderBy(F.desc("commits"), "ref").limit(k)
