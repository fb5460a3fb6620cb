"""Patches of commits: a relation that git fills, its caps, and a writer of .diff files.

``patches(chosen)`` asks git for one patch a row, wherever Spark has put the row, so a
repository's patches are made by many tasks. Contents of files that look like
credentials are left out by git itself. ``capped`` cuts each patch and the sum of a
repository. ``write_patches`` writes files through a data source with a commit
protocol: tasks write to a staging folder beside the target, which is renamed to it when all
have ended; of a job that fails nothing is visible there. A task that is killed late may leave
files in the staging folder, which no one reads.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions.paths import is_credential
from ..vocab import CREDENTIAL_GLOBS
from .git import try_git
from .tree import _store

#: Characters of a patch and of all patches of a repository, patches of a repository, and the notes that tell of a cut.
EACH, ALL, MOST = 200_000, 48_000_000, 160
CUT = "\n[patch truncated at the size limit]\n"
WITHHELD = "\n[one or more credential-shaped files changed in this commit; their contents are deliberately not included]\n"


def spread(commits: DataFrame, order: list, k: int = MOST) -> DataFrame:
    """At most k commits of each repository, evenly over its list: places int(i * (n / k)); adds ``nth``, their number from 0.

    A list of k or fewer stays whole. commits: (repo, ...), sorted by ``order``.
    """
    w = Window.partitionBy("repo")
    placed = commits.withColumn("_p", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    step = F.col("_n").cast("double") / k
    near = F.ceil(F.col("_p") / step)
    # the division may be off by one place, so its neighbours are tried as well
    hits = [F.when((i >= 0) & (i < k) & (F.floor(i * step) == F.col("_p")), i) for i in (near, near - 1, near + 1)]
    nth = F.when(F.col("_n") <= k, F.col("_p").cast("long")).otherwise(F.coalesce(*hits))
    return placed.withColumn("nth", nth).where("nth is not null").drop("_p", "_n")


def patches(chosen: DataFrame) -> DataFrame:
    """(repo, sha, nth, patch): the patch of every row of (repo, sha, nth); commits that git can't show have none."""
    left_out = [f":(exclude,glob,icase)**/{g}" for g in CREDENTIAL_GLOBS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for repo, sha, nth in zip(*(b.column(c).to_pylist() for c in ("repo", "sha", "nth")), strict=True):
                if not re.fullmatch(r"[0-9a-f]{40,64}", sha or ""):
                    continue
                # neither flag lets a program named by the repository run
                code, text, _ = try_git(repo, "show", sha, "--no-textconv", "--no-ext-diff", "--format=%H%n%cd%n%s%n", "--date=short", "--", *left_out)
                if code == 0 and text.strip():
                    yield pa.RecordBatch.from_pydict({"repo": [repo], "sha": [sha], "nth": pa.array([nth], pa.int64()), "patch": [text]})

    return chosen.select("repo", "sha", F.col("nth").cast("long")).mapInArrow(run, "repo string, sha string, nth long, patch string")


def capped(found: DataFrame, withheld: DataFrame | None = None, each: int = EACH, total: int = ALL) -> DataFrame:
    """Patches cut to ``each`` characters, and of every repository, in the order of nth, those that begin before ``total``.

    withheld: (repo, sha) of commits that touch files whose content was left out,
    which a note says. Adds ``name``, the file of the patch.
    """
    text = F.col("patch")
    if withheld is not None:
        found = found.join(withheld.select("repo", "sha").distinct().withColumn("_w", F.lit(True)), ["repo", "sha"], "left")
        text = F.when(F.col("_w"), F.concat("patch", F.lit(WITHHELD))).otherwise(F.col("patch"))
    cut = found.withColumn("patch", text).withColumn("patch", F.when(F.length("patch") > each, F.concat(F.substring("patch", 1, each), F.lit(CUT))).otherwise(F.col("patch")))
    # sums are made over lengths, so texts don't go through the window
    before = F.sum("_len").over(Window.partitionBy("repo").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1))
    kept = cut.select("repo", "nth", F.length("patch").cast("long").alias("_len")).withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < total)
    out = cut.join(kept.select("repo", "nth"), ["repo", "nth"])
    name = F.concat(F.lpad(F.col("nth").cast("string"), 4, "0"), F.lit("-"), F.substring("sha", 1, 12), F.lit(".diff"))
    return out.select("repo", "sha", "nth", F.when(F.col("nth") < 10_000, name).otherwise(F.concat("nth", F.lit("-"), F.substring("sha", 1, 12), F.lit(".diff"))).alias("name"), "patch")


def credential_commits(files: DataFrame) -> DataFrame:
    """(repo, sha) of commits that touch a file that looks like a credential."""
    return files.where(is_credential(F.col("path"))).select("repo", "sha").distinct()


# ------------------------------------------------------------------ writer
@dataclass
class _Written(WriterCommitMessage):
    files: int
    bytes: int


class PatchWriter(DataSourceWriter):
    """Files ``<path>/<folder>/<name>``, first below a staging folder beside ``path``."""

    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"].rstrip("/")
        self.overwrite = overwrite
        self.staging = f"{self.path}.staging-{uuid.uuid4().hex}"

    def write(self, iterator) -> _Written:
        store, base = _store(self.staging)
        n = size = 0
        for row in iterator:
            for part in (row.folder, row.name):
                if not part or part.startswith(".") or re.search(r"[/\\\x00]", part):
                    raise ValueError(f"not a name of a file or folder: {part!r}")
            data = (row.text or "").encode()
            # under a name of its own until it is whole, so that attempts of one task can't mix
            begun = f"{base}/_begun/{uuid.uuid4().hex}"
            store.create_dir(f"{base}/_begun", recursive=True)
            store.create_dir(f"{base}/{row.folder}", recursive=True)
            with store.open_output_stream(begun) as f:
                f.write(data)
            store.move(begun, f"{base}/{row.folder}/{row.name}")
            n, size = n + 1, size + len(data)
        return _Written(n, size)

    def commit(self, messages) -> None:
        from pyarrow import fs

        store, base = _store(self.staging)
        _, target = _store(self.path)
        store.create_dir(base, recursive=True)
        if store.get_file_info(f"{base}/_begun").type != fs.FileType.NotFound:
            store.delete_dir(f"{base}/_begun")
        with store.open_output_stream(f"{base}/_SUCCESS") as f:
            f.write(json.dumps({"files": sum(m.files for m in messages if m), "bytes": sum(m.bytes for m in messages if m)}).encode())
        there = store.get_file_info(target).type != fs.FileType.NotFound
        if there and not self.overwrite:  # made by another job since this one began
            self.abort(messages)
            raise FileExistsError(self.path)
        if there:
            store.move(target, f"{base}-old")
        store.move(base, target)
        if there:
            store.delete_dir(f"{base}-old")

    def abort(self, messages) -> None:
        from pyarrow import fs

        store, base = _store(self.staging)
        if store.get_file_info(base).type != fs.FileType.NotFound:
            store.delete_dir(base)


class PatchSink(DataSource):
    """``patches``: a folder of text files from (folder, name, text)."""

    @classmethod
    def name(cls):
        return "patches"

    def schema(self):
        return "folder string, name string, text string"

    def writer(self, schema, overwrite: bool):
        from pyarrow import fs

        store, target = _store(self.options["path"].rstrip("/"))
        if not overwrite and store.get_file_info(target).type != fs.FileType.NotFound:
            raise FileExistsError(self.options["path"])
        return PatchWriter(dict(self.options), overwrite)


def write_patches(spark: SparkSession, files: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write (folder, name, text) as files below path, all or none."""
    spark.dataSource.register(PatchSink)
    files.select("folder", "name", "text").write.format("patches").mode("overwrite" if overwrite else "append").option("path", path).save()
