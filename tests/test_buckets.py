"""Tables in buckets are joined and grouped by their keys without a shuffle of their own."""

from pyspark.sql import functions as F

from quarrymeter.operators.shared import Buckets


def test_buckets_are_not_shuffled_again(spark):
    rows = spark.range(100).select((F.col("id") % 5).alias("repo"), F.col("id").cast("string").alias("sha"), "id")
    a, b = Buckets(rows, "a", ["repo", "sha"]), Buckets(rows, "b", ["repo", "sha"])
    a.add(rows)
    out = a.df.join(b.df.select("repo", "sha").hint("merge"), ["repo", "sha"]).groupBy("repo", "sha").count()
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 100 and out.agg(F.sum("count")).first()[0] == 200
    a.drop()
    b.drop()
