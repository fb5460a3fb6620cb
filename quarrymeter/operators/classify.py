"""Classes of repositories: evidence, confidence and choice, from the named terms of ``detectors.class_terms``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Classes in the order that breaks ties, and decision thresholds.
CLASSES = ("frontend", "backend", "ml", "ai_research", "data_engineering", "security", "infra")
SUPPORT, ALONE, LEAST, LEAST_RAW, LEAST_SHARE = 0.5, 4.0, 1.0, 2.0, 0.18


def score_classes(long: DataFrame, key: str) -> DataFrame:
    """(key, class, raw, support, confidence, corroborated, detected, rank) from terms (key, class, counted).

    A class is corroborated by two terms of some weight, or by one strong family.
    Confidence is the share of all points, of one point at least.
    """
    c = F.col
    per = long.groupBy(key, "class").agg(F.round(F.sum("counted"), 3).alias("raw"), F.sum((c("counted") >= SUPPORT).cast("int")).alias("support"))
    order = F.array_position(F.array(*[F.lit(x) for x in CLASSES]), c("class"))
    whole = Window.partitionBy(key)  # seven rows
    out = per.withColumn("confidence", F.round(c("raw") / F.greatest(F.sum("raw").over(whole), F.lit(LEAST)), 4))
    out = out.withColumn("corroborated", (c("support") >= 2) | (c("raw") >= ALONE))
    out = out.withColumn("detected", (c("confidence") >= LEAST_SHARE) & (c("raw") >= LEAST_RAW) & c("corroborated"))
    return out.withColumn("rank", F.row_number().over(whole.orderBy(F.desc("raw"), order)))


def choose(scored: DataFrame, key: str) -> DataFrame:
    """(key, primary_class, suggested_classes, is_monorepo, evidence).

    Primary is the strongest class if it is corroborated, else the strongest
    corroborated one, else the strongest; backend where nothing reaches a point.
    Frontend and backend without a third class are one fullstack application.
    """
    c = F.col
    evidenced = (c("raw") >= LEAST) & c("corroborated")
    per = scored.groupBy(key).agg(
        F.max(F.when(c("rank") == 1, c("class"))).alias("top"), F.max("raw").alias("best"), F.min(F.when(evidenced, F.struct("rank", "class")))["class"].alias("sure"), F.collect_set(F.when(c("detected"), c("class"))).alias("found"),
    )
    none = c("best") < LEAST
    primary = F.when(none, "backend").otherwise(F.coalesce("sure", "top"))
    order = F.array(*[F.lit(x) for x in CLASSES])
    found = F.filter(order, lambda x: F.array_contains(F.col("found"), x) | (x == primary))
    both = F.array_sort(found) == F.array(F.lit("backend"), F.lit("frontend"))
    suggested = F.when(none, F.array(F.lit("backend"))).when(both, F.array(F.lit("fullstack"))).otherwise(found)
    state = F.when(none, "none").when(c("sure").isNull(), "weak").when(c("sure") == c("top"), "corroborated").otherwise("rival")
    return per.select(key, primary.alias("primary_class"), suggested.alias("suggested_classes"), (F.size(suggested) >= 2).alias("is_monorepo"), state.alias("evidence"))
