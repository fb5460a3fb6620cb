"""Intermediate tables of iterative operators, in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only in a local session that doesn't name it a temporary folder."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="quarrymeter-steps-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return _own[0]


class Step:
    """A DataFrame written as Parquet, which cuts its lineage; ``drop()`` removes the files."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/step-{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


class Buckets:
    """A table in that folder kept in buckets of its keys, so what is joined or grouped by them reads it without a shuffle."""

    def __init__(self, df: DataFrame, name: str, keys: list[str]):
        self.spark, self.keys = df.sparkSession, keys
        self.n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"{name}_{uuid.uuid4().hex}"
        self.path = f"{shared_dir(self.spark)}/step-{self.name}"
        self.add(df)

    def add(self, df: DataFrame) -> None:
        dealt = df.repartition(self.n, *self.keys)  # one file a bucket
        dealt.write.format("parquet").bucketBy(self.n, *self.keys).option("path", self.path).mode("append").saveAsTable(self.name)

    @property
    def df(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
