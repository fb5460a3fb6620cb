"""Flat token-id files with 64-bit document offsets (operator 9).

Format, for each partition of ascending ids: ``part-N.bin`` holds the ids of
its documents back to back as little-endian unsigned integers (2 bytes where
the vocabulary fits, else 4); ``part-N.idx`` holds the 64-bit document ids and
then one 64-bit offset more than documents. A manifest row for each partition
has its document and token counts; the partition's base, the ids of all
partitions before it, is the prefix sum of those counts. Readers map the files
into memory.

Files are written under a temporary name and then renamed, so a task that runs
twice leaves one whole file.

A task writes ids as they are made, so it holds one batch of texts and sixteen
bytes a document; partitions follow the size of the input.

Defined cases: null text counts as empty (only the end id); null ids come
first; rows with equal ids are ordered by a hash of their text, and repeated rows
get their ids each; a very long text is encoded whole; columns other than id and
text are not read, whatever their names; an empty table gives a manifest without
rows.
"""

from __future__ import annotations

import itertools
import os

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, local_path, new_file, on_release, pieces, put_file, scratch_path, working

#: Words that are kept encoded: a young generation and the one before it, so that frequent words stay when room is made.
CACHE_WORDS = 1_800_000
PART_BYTES = 64 << 20
_codec: dict[str, tuple] = {}
on_release("token_files", _codec.clear)
_NULL_ID = -(2**63)


def _map(uri: str, kind) -> np.ndarray:
    if path := local_path(uri):
        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return np.frombuffer(store.open_input_file(path).read_buffer(), kind)


class WordEncoder:
    """Encodes by the tokenizers library, once for each distinct word of a worker.

    Valid for vocabularies whose split never lets a piece cross white space and
    drops white space: the ids of a text are then those of its words in a row.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def learn(self, words: set[bytes]) -> None:
        missing = [w for w in words if w not in self.cache]
        if 2 * (len(self.cache) + len(missing)) > CACHE_WORDS:
            self.older, self.cache = self.cache, {}
            missing = list(words)
        new = []
        for w in missing:
            known = self.older.get(w)
            if known is None:
                new.append(w)
            else:
                self.cache[w] = known
        for w, e in zip(new, self.tok.encode_batch_fast([w.decode() for w in new], add_special_tokens=False), strict=True):
            self.cache[w] = np.array(e.ids, self.kind).tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        split = [t.split() for t in texts]
        self.learn(set().union(*split) if split else set())
        get = self.cache.__getitem__
        return [b"".join(map(get, s)) for s in split]


def word_encoder(path: str) -> WordEncoder:
    working("token_files")
    if path not in _codec:
        _codec[path] = WordEncoder(path)
    return _codec[path]


def _size(df: DataFrame) -> int:
    """Bytes of a table by the optimiser's figures, 0 where it has none."""
    got = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return got if got < 1 << 60 else 0


def write_token_files(docs: DataFrame, vocab_path: str, out: str, end_id: int | None = None, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files of all documents in ascending id order; returns the manifest.

    One shuffle: texts are range-partitioned by id, then encoded and written
    where they arrive. Manifest: (part, path, n_docs, n_tokens, base, width).
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), _size(docs) // PART_BYTES + 1)

    def run(batches):
        part = TaskContext.get().partitionId()
        enc = word_encoder(vocab_path)
        tail = np.array([] if end_id is None else [end_id], enc.kind).tobytes()
        ids, sizes, path = [], [], f"{out}/part-{part:06d}"
        slices = (b for batch in batches for b in pieces(batch))
        first = next(slices, None)
        if first is None:
            return
        with new_file(f"{path}.bin") as to:
            for b in itertools.chain([first], slices):
                got = [x + tail for x in enc.encode(b.column("text").cast(pa.binary()).fill_null(b"").to_pylist())]
                sizes.append(np.array([len(x) // enc.kind.itemsize for x in got], np.int64))
                to.write(b"".join(got))
                ids.append(b.column("doc_id").fill_null(_NULL_ID).to_numpy(zero_copy_only=False))
        sizes, ids = np.concatenate(sizes), np.concatenate(ids)
        put_file(f"{path}.idx", ids.astype("<i8").tobytes() + np.concatenate([[0], np.cumsum(sizes)]).astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([path]), pa.array([len(ids)], pa.int64()), pa.array([int(sizes.sum())], pa.int64()), pa.array([enc.kind.itemsize], pa.int32())], ["part", "path", "n_docs", "n_tokens", "width"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = src.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    rows = dealt.mapInArrow(run, "part int, path string, n_docs long, n_tokens long, width int").collect()  # one row a partition
    base, out_rows = 0, []
    for r in sorted(rows, key=lambda r: r.part):
        out_rows.append((r.part, r.path, r.n_docs, r.n_tokens, base, r.width))
        base += r.n_tokens
    return spark.createDataFrame(out_rows, "part int, path string, n_docs long, n_tokens long, base long, width int").repartition(max(1, len(out_rows)), "part")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary): documents read back from mapped files; ids are little-endian unsigned 32-bit."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                ids = _map(f"{r['path']}.bin", f"<u{r['width']}")
                idx = _map(f"{r['path']}.idx", "<i8")
                doc, off = idx[: r["n_docs"]], idx[r["n_docs"] :]
                for i in range(0, len(doc), 512):
                    j = min(len(doc), i + 512)
                    blobs = [ids[off[k] : off[k + 1]].astype("<u4").tobytes() for k in range(i, j)]
                    d = np.asarray(doc[i:j])
                    yield pa.RecordBatch.from_arrays([pa.array(d, mask=d == _NULL_ID), pa.array(r["base"] + np.asarray(off[i:j])), pa.array(np.diff(off[i : j + 1])), pa.array(blobs, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return manifest.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def token_file_digests(docs: DataFrame, vocab_path: str, end_id: int, out: str | None = None) -> DataFrame:
    """Write all documents, read them back, and give (doc_id, start, n_tokens, ids_crc32) from the files."""
    manifest = write_token_files(docs, vocab_path, out or scratch_path(docs.sparkSession, "tokens"), end_id)
    return read_token_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def manifest_of(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Manifest of files that are there already, in the order of ``write_token_files``."""
    return spark.createDataFrame(rows, "part int, path string, n_docs long, n_tokens long, base long, width int")
