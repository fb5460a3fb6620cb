"""Source-tree measures: lines by language, ranks, size distribution, digests, vocabularies.

Relation: files(repo, path, language, text, ...) with ``loc`` added once by
``with_loc``; all measures are grouped aggregates with map-side partials.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions import paths
from ..functions.scores import share
from ..functions.text import line_count, newline_count


def with_loc(files: DataFrame) -> DataFrame:
    return files.withColumn("loc", line_count(F.col("text")))


def language_loc(files: DataFrame) -> DataFrame:
    return files.groupBy("language").agg(F.sum("loc").alias("loc"), F.count("*").alias("files"))


def language_rank(files: DataFrame, top: int = 4) -> DataFrame:
    """Rank 1 is the primary language of a repo, 2 to 4 the secondary ones; of equal ones the first met in path order."""
    per = files.groupBy("repo", "language").agg(F.sum("loc").alias("loc"), F.min("path").alias("_first"))
    w = Window.partitionBy("repo").orderBy(F.desc("loc"), "_first")
    return per.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).drop("_first")


def size_distribution(files: DataFrame, by: str, large: tuple[int, int] = (500, 1000)) -> DataFrame:
    """Counts and exact order statistics of file sizes; the median is the upper one.

    Sizes are first counted by value, so the sorted windows hold distinct sizes,
    not files; a condition on their counts leaves the lines of a text to be
    counted once. Columns over_N count files above the two limits.
    """
    sizes = files.groupBy(by, "loc").agg(F.count_if(F.col("loc") > 0).alias("k")).where("k > 0")
    w = Window.partitionBy(by).orderBy("loc")
    cum = sizes.withColumn("upto", F.sum("k").over(w)).withColumn("n", F.sum("k").over(Window.partitionBy(by)))
    pick = lambda i: F.min(F.when(F.col("upto") > i, F.col("loc")))
    over = [F.sum(F.when(F.col("loc") > x, F.col("k")).otherwise(0)).alias(f"over_{x}") for x in large]
    return cum.groupBy(by).agg(F.first("n").alias("files"), pick(F.floor(F.col("n") / 2)).alias("median_loc"), pick(F.floor(F.col("n") * F.lit(0.9))).alias("p90_loc"), *over)


def spec_fixture(files: DataFrame, fixture: Column, test: Column, big: int = 5000) -> DataFrame:
    is_fixture = fixture | (F.col("loc") > big)
    return files.where(test | fixture).agg(F.sum((~is_fixture).cast("int")).alias("specs"), F.sum(is_fixture.cast("int")).alias("fixtures"))


def loc_share(files: DataFrame, by: str, part: Column) -> DataFrame:
    """Share of lines in a subset; null where there are no lines."""
    per = files.groupBy(by).agg(F.sum(F.when(part, F.col("loc")).otherwise(0)).alias("part_loc"), F.sum("loc").alias("loc"))
    return per.withColumn("loc_share", share(F.col("part_loc").cast("double"), F.col("loc")))


def merged_loc(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Full-outer sum of two (key, loc) tables."""
    return a.select(key, "loc").unionByName(b.select(key, "loc")).groupBy(key).agg(F.sum("loc").alias("loc"))


def largest(files: DataFrame, n: int = 10) -> DataFrame:
    return files.orderBy(F.desc("loc"), "path").limit(n)


def error_density(files: DataFrame, by: str, pattern: str) -> DataFrame:
    """Pattern hits for each thousand lines."""
    per = files.groupBy(by).agg(F.sum(F.regexp_count("text", F.lit(pattern))).alias("hits"), F.sum("loc").alias("loc"))
    return per.withColumn("per_kloc", F.col("hits") / F.greatest(F.col("loc") / 1000.0, F.lit(0.001)))


def content_digest(files: DataFrame, by: str, path: str, content: str) -> DataFrame:
    """(key, digest, files): SHA-256 over 'path\\0sha256\\0' of each key's files, in order of their folders and names.

    The files' own digests are made where they are read; what is sorted and
    shuffled is paths and digests. The one running hash of a key goes over its
    sorted rows, so no list of files is ever held. A file without content counts as unreadable.
    """
    hex_ = F.coalesce(F.sha2(F.col(content).cast("binary"), 256), F.lit("unreadable"))
    leaf = files.select(F.col(by).cast("string").alias("k"), F.col(path).cast("string").alias("p"), hex_.alias("h")).withColumn("o", F.split("p", "/"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, running = None, 0, hashlib.sha256()
        row = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array([running.hexdigest()]), pa.array([n], pa.int64())], ["k", "digest", "files"])
        for b in batches:
            for k, p, h in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if n and k != now:
                    yield row()
                    n, running = 0, hashlib.sha256()
                now, n = k, n + 1
                running.update(f"{p}\0{h}\0".encode())
        if n:
            yield row()

    dealt = leaf.repartition("k").sortWithinPartitions("k", "o").select("k", "p", "h")
    out = dealt.mapInArrow(fold, "k string, digest string, files long")
    return out.select(F.col("k").cast(dict(files.dtypes)[by]).alias(by), "digest", "files")


def fold_vocabulary(rows: DataFrame, key: str, allowed: list[str], other: str = "other") -> DataFrame:
    """Counts by a closed vocabulary; what isn't in it counts as ``other``."""
    folded = F.when(F.col(key).isin(*allowed), F.col(key)).otherwise(other)
    return rows.groupBy(folded.alias("term")).agg(F.count("*").alias("n"))


def unmapped_extensions(files: DataFrame, known: list[str], limit: int = 500) -> DataFrame:
    rest = files.where(~F.col("ext").isin(*known)).groupBy("ext").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    return rest.orderBy(F.desc("files"), "ext").limit(limit)


def structure_inputs(files: DataFrame, most: int = 2500, largest: int = 1_000_000) -> DataFrame:
    """(repo, path, state) of the files that a scan for structure looks at: source, test, too large, generated or unknown.

    Of a repository's sources the first ``most`` in path order count; the rest is
    over the cap. Files in skipped folders, and bundles, are left out.
    """
    path = F.col("path")
    seen = files.where(~path.rlike("(?i)" + vocab.STRUCTURE_SKIP_DIR) & ~path.rlike("(?i)" + vocab.STRUCTURE_SKIP_FILE))
    known = paths.is_code(path) | paths.extension(path).isin(".ipynb", ".m", ".v", ".pl")
    size = F.octet_length("text")
    state = (
        F.when(~known, "unknown").when(path.rlike(paths.STRUCTURE_TEST), "test").when(size > largest, "too_large")
        .when((paths.extension(path) != ".ipynb") & F.substring("text", 1, 4096).rlike(vocab.STRUCTURE_GENERATED), "generated").otherwise("source")
    )
    w = Window.partitionBy("repo", "state").orderBy("path")
    out = seen.select("repo", "path", state.alias("state")).withColumn("_r", F.row_number().over(w))
    return out.select("repo", "path", F.when((F.col("state") == "source") & (F.col("_r") > most), "over_cap").otherwise(F.col("state")).alias("state"))


def newline_total(text: Column) -> Column:
    """Lines of a text by its newlines, the last one counted whether it ends in one or not."""
    return newline_count(text) + F.when((text != "") & ~text.endswith("\n"), 1).otherwise(0)


def ambiguous_language(path: Column, text: Column) -> Column:
    """Language of the extensions that two languages share, by content; null for all others."""
    ext = paths.extension(path)
    return (
        F.when(ext == ".m", F.when(text.rlike(r"(?m)^[ \t]*(#import|#include|@interface|@implementation|@end)"), "objc").otherwise("matlab")).when(ext == ".v", F.when(text.rlike(r"\bendmodule\b"), "verilog").otherwise("v"))
        .when(ext == ".pl", F.when(text.rlike(r"(?m)^[ \t]*[a-z][A-Za-z0-9_]*[ \t]*(\(.*\))?[ \t]*:-"), "prolog").otherwise("perl"))
    )
