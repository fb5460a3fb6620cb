"""Shared pieces: shared storage, Arrow tokenisation, hashing and components.

Word model used by several operators: ``[^\\x20\\x09-\\x0D]+`` over UTF-8 bytes,
optionally lower-casing A-Z only. Tokenisation works on Arrow string buffers
with numpy, so no Python object is made per word.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Arrow's own pools keep freed memory; workers give it back.
pa.set_memory_pool(pa.system_memory_pool())
_own_dir: dict[str, str] = {}


# ---------------------------------------------------------------- workers
_held: dict[str, Callable[[], None]] = {}
_working: list[str] = []


def on_release(owner: str, drop: Callable[[], None]) -> None:
    """What frees the caches that an operator keeps in a Python worker."""
    _held[owner] = drop


def working(owner: str) -> None:
    """Called where an operator's work begins: what other operators kept in this worker is freed.

    Workers are used again by later stages, so caches of several operators would
    otherwise add up in one executor.
    """
    if _working != [owner]:
        for name, drop in _held.items():
            if name != owner:
                drop()
        _working[:] = [owner]
        gc.collect()
        trim()


def trim() -> None:
    """Give freed memory back to the system."""
    if _libc is not None:
        _libc.malloc_trim(0)


try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library
    _libc = None


# ---------------------------------------------------------------- storage
def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share.

    It is ``spark.checkpoint.dir`` of the session. Only where that is unset in a
    local session, as in tests, a temporary folder is made; elsewhere executors
    would not see it, so that is an error.
    """
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _own_dir:
        _own_dir["dir"] = tempfile.mkdtemp(prefix="quarrymeter-")
        atexit.register(shutil.rmtree, _own_dir["dir"], True)
    return _own_dir["dir"]


def bounded_batches(spark: SparkSession, records: int = 1000, size: int = 4 << 20) -> None:
    """Lower the session's Arrow batches where they are larger, so that a batch of long texts or sets stays small."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", records), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = int(re.sub(r"[^0-9-]", "", spark.conf.get(key)) or 0)
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/qm-{name}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def local_path(uri: str) -> str | None:
    """Plain path of a URI on a mounted file system, else None."""
    u = urlparse(uri)
    return u.path if u.scheme in ("", "file") else None


@contextmanager
def new_file(uri: str):
    """A file to write to, under a temporary name until it is whole, so a task that runs twice leaves one whole file."""
    tmp = f"{uri}.{uuid.uuid4().hex}.tmp"
    if path := local_path(tmp):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            yield f
        os.replace(path, local_path(uri))
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(tmp)
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(path) as f:
        yield f
    store.move(path, fs.FileSystem.from_uri(uri)[1])


def put_file(uri: str, data: bytes) -> None:
    with new_file(uri) as f:
        f.write(data)


def read_file(uri: str) -> bytes:
    if path := local_path(uri):
        with open(path, "rb") as f:
            return f.read()
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        return f.read()


class Table:
    """A DataFrame written to the shared folder; ``drop()`` removes the files."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = scratch_path(self.spark, name)
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        delete_path(self.spark, self.path)


def crc_mod(col: Column, m: int) -> Column:
    """crc32 of the id written as decimal text, modulo m. Null ids give null."""
    return F.crc32(col.cast("string").cast("binary")) % m


# ---------------------------------------------------------------- hashing
def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser: spreads every input bit over the 64 output bits."""
    x = np.asarray(x, U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_P = U64(0x9E3779B97F4A7C15)
_PINV = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PIECE = 1 << 18
_powers: list[np.ndarray] = []


def _pow_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, _PIECE + 64)
        one = np.ones(1, U64)
        _powers[:] = [np.concatenate([one, np.multiply.accumulate(np.full(n, p, U64))]) for p in (_P, _PINV)]
    return _powers[0], _powers[1]


@dataclass
class Words:
    """Words of a run of documents: hashes, byte spans and document offsets."""

    buf: np.ndarray  # bytes
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # byte after each word
    doc: np.ndarray  # word offsets of the documents, one more than documents
    hash: np.ndarray  # 64-bit hash of each word

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.doc)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.doc) - 1), self.counts)


def text_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and its offsets from 0. Null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    wide = pa.types.is_large_string(arr.type)
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64) if len(arr) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


def words_of(arr: pa.Array, lower: bool) -> Words:
    """Words of every document of a string array."""
    buf, offsets = text_bytes(arr)
    inside = ~_SPACE[buf]
    if not len(buf):
        z = np.zeros(0, np.int64)
        return Words(buf, z, z, np.zeros(len(offsets), np.int64), np.zeros(0, U64))
    first, last = inside.copy(), inside.copy()
    cut = np.zeros(len(buf) + 1, bool)
    cut[offsets] = True
    first[1:] &= ~inside[:-1] | cut[1:-1]
    last[:-1] &= ~inside[1:] | cut[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    table = _BYTE_LOWER if lower else _BYTE
    out = np.empty(len(start), U64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + _PIECE, "right")))
        lo, hi = start[i], end[j - 1]
        fw, bw = _pow_tables(hi - lo + 1)
        pre = np.zeros(hi - lo + 1, U64)
        np.cumsum(table[buf[lo:hi]] * fw[: hi - lo], out=pre[1:])
        s, e = start[i:j] - lo, end[i:j] - lo
        out[i:j] = mix((pre[e] - pre[s]) * bw[s] + (e - s).astype(U64))
        i = j
    return Words(buf, start, end, np.searchsorted(start, offsets).astype(np.int64), out)


def runs_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive word hashes (len(h) - k + 1 values).

    Doubling: a run of a+b words is the run of a words times M**b plus the run
    of b words, so k words take about 2*log2(k) passes.
    """
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    m = 0xD6E8FEB86659FD93

    def span(length: int) -> np.ndarray:
        if length == 1:
            return h
        half = length // 2
        low = span(half)
        rest = span(length - half) if length - half != half else low
        keep = len(h) - length + 1
        return low[:keep] * U64(pow(m, length - half, 2**64)) + rest[half : half + keep]

    return mix(span(k)[:n])


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` text bytes (one document at least)."""
    _, off = text_bytes(batch.column(batch.schema.get_field_index(column)))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j
    trim()


def unique_per_doc(values: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each document, sorted inside it, and their documents."""
    order = np.lexsort((values, doc))
    v, d = values[order], doc[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    return v[keep], d[keep]


def as_long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


# ------------------------------------------------------- bounded id filter
BLOOM_BITS = 1 << 25  # 4 MB: a fixed bound, whatever the corpus
BLOOM_PART = 1 << 16  # bytes that one group folds


def _bloom_slots(ids: np.ndarray) -> list[np.ndarray]:
    h = mix(ids.astype(np.int64).view(U64) + U64(77))
    step = (h >> U64(32)) | U64(1)
    return [((h + step * U64(i)) % U64(BLOOM_BITS)).astype(np.int64) for i in range(3)]


def bloom_of(ids: DataFrame) -> bytes:
    """Bit set of a one-column id frame, of fixed size; ids are folded on the executors."""

    def fold(batches):
        bits = np.zeros(BLOOM_BITS, bool)
        seen = False
        for b in batches:
            got = b.column(0).drop_null().to_numpy(zero_copy_only=False)
            for s in _bloom_slots(got):
                bits[s] = True
            seen = seen or len(got) > 0
        if seen:
            packed = np.packbits(bits).reshape(-1, BLOOM_PART)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(packed)), pa.int32()), pa.array([r.tobytes() for r in packed], pa.binary())], ["part", "bits"])

    def join(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for b in batches:
            for x in b.column("bits"):
                got = np.frombuffer(x.as_py(), np.uint8)
                out = got.copy() if out is None else out | got
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["part", "bits"])

    spark = ids.sparkSession
    few = ids.coalesce(max(4, spark.sparkContext.defaultParallelism))
    rows = few.mapInArrow(fold, "part int, bits binary").groupBy("part").applyInArrow(join, "part int, bits binary").collect()
    out = np.zeros(BLOOM_BITS // 8, np.uint8).reshape(-1, BLOOM_PART)
    for r in rows:
        out[r.part] = np.frombuffer(r.bits, np.uint8)
    return out.tobytes()


def bloom_has(bits: bytes, ids: np.ndarray) -> np.ndarray:
    """Whether each id may be in the set."""
    packed = np.frombuffer(bits, np.uint8)
    return np.logical_and.reduce([(packed[s >> 3] >> (7 - (s & 7)).astype(np.uint8)) & 1 == 1 for s in _bloom_slots(ids)])


def bloom_keep(df: DataFrame, column: str, bits: bytes, outside: bool = False) -> DataFrame:
    """Rows whose id may be in the set: never loses a member, may keep others. outside: exactly the other rows."""
    held = df.sparkSession.sparkContext.broadcast(bits)

    def keep(batches):
        for b in batches:
            col = b.column(b.schema.get_field_index(column))
            ids = col.fill_null(0).to_numpy(zero_copy_only=False)
            ok = bloom_has(held.value, ids) & ~col.is_null().to_numpy(zero_copy_only=False)
            if outside:
                ok = ~ok
            if ok.any():
                yield b.filter(pa.array(ok))

    return df.mapInArrow(keep, df.schema)


# -------------------------------------------------------------- components
HOT_KEYS, HOT_ROWS = 2000, 256


def frequent(rows: DataFrame, key: str, least: int = HOT_ROWS, most: int = HOT_KEYS) -> list:
    """The ``most`` most frequent keys among those with more than ``least`` rows; any other key has at most 1/``most`` of the rows, or ``least``."""
    count = rows.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > least)
    return [r[0] for r in count.orderBy(F.desc("count"), key).limit(most).collect()]


def unskewed(rows: DataFrame, named: DataFrame, key: str, hot: list | None = None) -> DataFrame:
    """Left join of a written table with one that has each key once, where a few keys may hold most rows.

    Frequent keys, at most HOT_KEYS, take their partner from a broadcast; all
    others are joined by a shuffle. hot: the frequent keys, where they are known.
    """
    hot = frequent(rows, key) if hot is None else hot
    if not hot:
        return rows.join(named, key, "left")
    few = F.broadcast(rows.sparkSession.createDataFrame([(h, True) for h in hot], f"`{key}` {dict(rows.dtypes)[key]}, _hot boolean"))
    told = named.join(few, key, "left_semi")
    marked = rows.join(few, key, "left")
    common = marked.where("_hot is null").drop("_hot").join(named, key, "left")
    return common.unionByName(marked.where("_hot").drop("_hot").join(F.broadcast(told), key, "left"))


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, component) of the ends of a bounded number of edges."""
    got = [np.stack([b.column(c).to_numpy() for c in ("a", "b")]) for b in batches]
    ids, at = np.unique(np.concatenate([np.zeros((2, 0), np.int64), *got], 1), return_inverse=True)
    x, y = at.reshape(2, -1)
    top = np.arange(len(ids))
    while (top[x] != top[y]).any():
        low = np.minimum(top[x], top[y])
        np.minimum.at(top, top[x], low)
        np.minimum.at(top, top[y], low)
        while (top[top] != top).any():
            top = top[top]
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[top])], ["id", "component"])


def few_components(edges: DataFrame) -> DataFrame:
    """(id, component) of the ends of edges (a, b) without nulls, for a number of edges that its caller bounds: one task holds them."""
    return edges.select("a", "b").coalesce(1).mapInArrow(_settle, "id long, component long")


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id of every node.

    nodes: (id long), distinct. edges: (a long, b long), any direction,
    repeated or not. Each round takes the smallest label of the neighbours,
    lowers the label of the whole tree that a node hangs on, and follows the
    label of the label. Every round is a few joins of skinny rows with map-side
    minimums, written to the shared folder; hubs and the labels of giant
    components are joined by broadcast, so no key fills a task. The only thing the
    driver sees is the number of labels that changed, and at most ``HOT_KEYS``
    frequent keys. Returns (id, component).
    """
    e = edges.where("a <> b and a is not null and b is not null")
    both = Table(e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    hubs = frequent(both.df, "a")
    touched = both.df.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("p"))
    state = Table(touched, "labels")
    for _ in range(max_rounds):
        p = state.df
        near = unskewed(both.df, p.withColumnRenamed("id", "a"), "a", hubs).groupBy(F.col("b").alias("id")).agg(F.min("p").alias("q"))
        now = p.join(near, "id").select("id", "p", F.least("p", "q").alias("q"))
        pulled = now.groupBy(F.col("p").alias("id")).agg(F.min("q").alias("r"))
        hung = Table(now.join(pulled, "id", "left").select("id", "p", F.least("q", F.coalesce("r", "q")).alias("q")), "hung")
        up = hung.df.select(F.col("id").alias("q"), F.col("q").alias("top"))
        done = Table(unskewed(hung.df, up, "q").select("id", F.col("p").alias("old"), F.least("q", F.coalesce("top", "q")).alias("p")), "labels")
        changed = not done.df.where("old <> p").isEmpty()
        hung.drop()
        state.drop()
        state = done
        if not changed:
            break
    else:
        raise RuntimeError("components did not settle")
    both.drop()
    got = state.df.select("id", F.col("p").alias("component"))
    return nodes.join(got, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
