"""Census and mining: sentence filtering, weighted totals, blocks with null-on-failure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import depth_band
from ..functions.text import sentence_verdict


def sentence_counts(sentences: DataFrame, by: str, max_words: int = 40) -> DataFrame:
    """Sentences by verdict; only 'ok' ones count further on."""
    return sentences.groupBy(by, sentence_verdict(F.col("text"), max_words).alias("verdict")).agg(F.count("*").alias("n"))


def weighted_total(counts: DataFrame, key: str, weights: dict[str, float], with_test: float = 0.4) -> DataFrame:
    """Weighted total of a (key, kind, n, with_test, repairs) table, and its depth."""
    w = F.lit(0.0)
    for kind, x in weights.items():
        w = F.when(F.col("kind") == kind, F.lit(x)).otherwise(w)
    per = counts.groupBy(key).agg(F.sum(w * F.col("n")).alias("base"), F.sum("with_test").alias("wt"), F.sum("repairs").alias("rp"))
    total = F.col("base") + F.lit(with_test) * F.least("wt", "rp")
    return per.select(key, total.alias("total")).withColumn("depth", depth_band(F.col("total")))


def type_counts(rows: DataFrame, key: str, kind: str, kinds: list[str]) -> DataFrame:
    """One column for each kind; kinds that don't occur count 0."""
    return rows.groupBy(key).agg(*[F.sum((F.col(kind) == k).cast("int")).alias(k) for k in kinds])


def block(expected: DataFrame, measured: DataFrame, key: str, counts: list[str]) -> DataFrame:
    """Every expected key stays: counts are null, with a reason, where nothing was measured, and 0 only where measured."""
    out = expected.join(measured.withColumn("_there", F.lit(True)), key, "left")
    reason = F.when(F.col("_there").isNull(), "not_measured")
    return out.select(key, *[F.when(F.col("_there"), F.coalesce(c, F.lit(0))).alias(c) for c in counts], reason.alias("reason"))


#: Kinds of material with their weights, task types, bands.
IDEA_WEIGHTS = {"complex_logic": 1.0, "work_units": 1.0, "net_new_capabilities": 1.0, "substantial_features": 0.7, "defect_repairs": 0.7, "repo_evolutions": 0.6, "hardening_work": 0.5, "integration_work": 0.5, "performance_work": 0.5}
TASK_TYPES = ("net_new", "agentic", "bug_repair", "repo_evolution")
BANDS = ("Small", "Medium", "Large")


def idea_id(strategy: Column, shas: Column, files: Column) -> Column:
    """Identity of an idea: its type, and 12 hex digits over its type, sorted commits and sorted files."""
    joined = F.concat_ws("|", strategy, F.array_join(F.array_sort(shas), ","), F.array_join(F.array_sort(files), ","))
    return F.concat(strategy, F.lit(":"), F.substring(F.sha1(joined.cast("binary")), 1, 12))


def candidates(items: DataFrame) -> DataFrame:
    """(repo, id, strategy, complexity, sentence) of mined items (repo, title, task_type, complexity, summary, files, shas).

    A type that isn't known is filed under the lane's own name; a sentence that may not go out is dropped, and its idea stays counted.
    """
    said = F.lower(F.trim(F.coalesce("task_type", F.lit(""))))
    strategy = F.when(said.isin(*TASK_TYPES), said).otherwise("agentic")
    band = F.when(F.col("complexity").isin(*BANDS), F.col("complexity")).otherwise("Medium")
    line = F.trim(F.coalesce("summary", F.lit("")))
    sentence = F.when(sentence_verdict(line) == "ok", line).otherwise("")
    files = F.concat(F.array(F.coalesce("title", F.lit(""))), F.coalesce("files", F.array().cast("array<string>")))
    return items.select("repo", idea_id(strategy, F.coalesce("shas", F.array().cast("array<string>")), files).alias("id"), strategy.alias("strategy"), band.alias("complexity"), sentence.alias("sentence"))


def mining_block(lanes: DataFrame, found: DataFrame, ceiling: int) -> DataFrame:
    """One row a lane (repo, requested, finished): total, counts by type, tagged sentences, and which zero or null it is.

    Not asked for: zeros with a skip reason. Not finished: nulls. Finished without
    ideas: measured zeros. At the ceiling: a floor instead of a total.
    """
    c = F.col
    tagged = F.when(c("sentence") != "", F.concat("strategy", F.lit(": "), "sentence"))
    per = found.groupBy("repo").agg(F.count("*").alias("total"), *[F.sum((c("strategy") == t).cast("int")).alias(f"n_{t}") for t in TASK_TYPES], F.array_sort(F.collect_list(tagged)).alias("summaries"))
    j = lanes.join(per, "repo", "left")
    figure = lambda x: F.when(~c("requested"), 0).when(c("finished"), F.coalesce(x, F.lit(0)))
    total = figure("total")
    note = F.when(~c("requested"), "skipped").when(~c("finished"), "unfinished").when(total == 0, "measured_none").when(total >= ceiling, "floor")
    ran = c("requested") & c("finished")
    return j.select("repo", total.alias("total_candidates"), *[figure(f"n_{t}").alias(f"n_{t}") for t in TASK_TYPES], (ran & (total > 0)).alias("scored"), F.when(ran, F.coalesce("summaries", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("summaries"), note.alias("note"))


def cleaned_sentences(sentences: DataFrame, by: str, most: int = 400) -> DataFrame:
    """(key, category, kept, refused): redacted sentences of (key, category, text) that may go out, at most ``most`` of a category."""
    from ..functions.text import redact

    clean = redact(F.col("text"))
    ok = (clean != "") & (sentence_verdict(clean) == "ok")
    per = sentences.groupBy(by, "category").agg(F.sum(ok.cast("int")).alias("kept"), F.sum((~ok).cast("int")).alias("refused"))
    return per.withColumn("kept", F.least("kept", F.lit(most)))
