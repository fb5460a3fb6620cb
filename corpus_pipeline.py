"""Corpus pipeline: quality, near-dedup, decontamination, secret scan, tokenisation.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. The result of a
stage is written as Parquet to the shared folder and read again as the next
stage's documents. All stages but the last keep the columns of ``documents``.

Defined cases, in every stage: a null or empty text is scored as an empty
passage by the first stage, and if it stays there it stays in all others; a null
id is as good as any; very long texts are read whole; repeated rows are exact
copies, of which one stays; different texts that share an id are decided each on
its own; of equal candidates the smallest id stays; columns keep their names,
types and values, whatever their names, but for the text where secrets are masked;
empty tables, also of labels or of the benchmark, give an empty result or take
nothing away.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrymeter.llm import bpe, decontaminate, minhash, quality, secrets
from quarrymeter.llm.common import Table
from quarrymeter.llm.queries import BYTE_VOCAB


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier (1): documents scored below the threshold go."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup (3): one document of each group stays (five words, similarity 0.8)."""
    return minhash.keep_one(docs, k=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination (5): documents that contain a benchmark item go."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans (6): secrets are masked in the text; all documents stay."""
    return secrets.redact(docs, secrets.model(docs))


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE encoding and decoding (10): token count and digests of every document that is left."""
    return bpe.roundtrip_digests(docs, BYTE_VOCAB)


STAGES = [
    ("quality", good_quality),
    ("near_dedup", one_of_each),
    ("decontaminate", without_benchmark),
    ("secrets", without_secrets),
    ("bpe", tokenised),
]

#: The first stage is a learned model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = Table(stage(spark, docs, sf_dir), f"stage-{name}").df
    return STAGES[-1][1](spark, docs, sf_dir)
