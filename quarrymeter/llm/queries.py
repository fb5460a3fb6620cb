"""Queries opN_<name> of this subpackage and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import bpe, decontaminate, dominance, hpylm, itq, kmtree, langid, minhash, oracle, quality, secrets, substrings, token_files, whitening
from .common import crc_mod

WORD_VOCAB = public_tokenizers.path("word_bpe_49k.json")
BYTE_VOCAB = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _held(m: int, r: int):
    return F.coalesce(crc_mod(F.col("doc_id"), m) == r, F.lit(False)).alias("held_out")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = quality.train(docs, _read(spark, sf_dir, "labels"))
    return quality.with_scores(docs.select("doc_id", "text"), model).select("doc_id", _held(5, 0), "score", "predicted")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"), k=2, percent=80)


def op4_hpylm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.score_documents(_read(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_pairs(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.model(docs))
    return found.select("doc_id", "n_candidates", "n_secrets", "max_score", F.to_json("spans").alias("spans"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs)).select("doc_id", _held(4, 2), "lang_pred", "score")


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_read(spark, sf_dir, "documents"), digest=True)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_digests(_read(spark, sf_dir, "documents"), WORD_VOCAB, END_ID)


def op10_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.roundtrip_digests(_read(spark, sf_dir, "documents"), BYTE_VOCAB)


def op11_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmtree.neighbours(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op12_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dominance.sales_above(_read(spark, sf_dir, "sales"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_components(_read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_minhash_dedup": op3_minhash_dedup,
    "op4_hpylm": op4_hpylm,
    "op5_decontaminate": op5_decontaminate,
    "op6_secrets": op6_secrets,
    "op7_langid": op7_langid,
    "op8_substrings": op8_substrings,
    "op9_token_files": op9_token_files,
    "op10_bpe_roundtrip": op10_bpe_roundtrip,
    "op11_kmeans_tree": op11_kmeans_tree,
    "op12_dominance": op12_dominance,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op2_embedding_dedup": oracle.OP2,
    "op3_minhash_dedup": oracle.OP3,
    "op5_decontaminate": oracle.OP5,
    "op8_substrings": oracle.OP8,
    "op12_dominance": oracle.OP12,
}
