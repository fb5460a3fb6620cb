"""Substring dedup with a log-structured fingerprint index (operator 8).

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A word goes if a window of
``window`` words of its document covers it and that window's words also start
somewhere else.

Every window has an anchor: the smallest hash among its runs of ``anchor`` words
(the leftmost of equal ones). Equal windows have equal anchors, and one anchor
serves about a dozen neighbouring windows, so the index holds a tenth of the
positions. The index is log-structured: each batch of documents becomes an
immutable run of (anchor hash, count), sorted by hash; a new batch is
merge-joined with the runs before it to find the anchors that occur again; runs
are compacted into one when there are more than ``max_runs``.

``remove_known`` is the incremental form: an index of window fingerprints (two
of 64 bits) that is kept in a folder, opened again by later batches, merge-joined
with each of them and compacted. It holds every window, so it takes some 16 bytes
a word of all batches so far; earlier documents aren't read again.

Only windows whose anchor occurs again are then verified: the documents that
hold such anchors are read again, and pairs of anchor and window hash (64 bits
each) are compared inside buckets of anchors. Anchors that occur
more than ``HOT`` times are spread over buckets by window hash instead, and a
window that repeats inside one slice of a task is sent once, so a passage that a
third of all documents share fills no single bucket.

Defined cases: null, empty and short texts lose nothing; a null text has no
words; repeated rows are documents of their own, so their windows repeat; rows
with a null id, or that share an id, are compared like others; a very long text is
compared whole; a window that overlaps its own repeat counts; other columns are
not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Table, Words, as_long, bounded_batches, bloom_keep, bloom_of, delete_path, mix, pieces, put_file, read_file, runs_hash, scratch_path, words_of

WINDOW, ANCHOR = 35, 12
HOT = 5000
BUCKET_WORDS = 1_500_000


class FingerprintIndex:
    """Sorted immutable runs of (keys, n) in a folder, which may outlive the session.

    A manifest names the runs; it is replaced by renaming, after a run is whole
    and before runs that it no longer names are deleted, so whoever opens the
    folder again finds all that was added. It names the batches too: one that is
    added again under its name is looked up, but counted once. Without ``path`` the
    index is in the shared folder.
    """

    def __init__(self, spark: SparkSession, max_runs: int = 3, path: str | None = None, keys: tuple[str, ...] = ("h",)):
        self.spark, self.max_runs, self.keys = spark, max_runs, list(keys)
        self.path = (path or scratch_path(spark, "index")).rstrip("/")
        self.compactions = 0
        try:
            named = json.loads(read_file(f"{self.path}/manifest.json"))
        except FileNotFoundError:
            named = {"runs": [], "batches": []}
        self.runs: list[str] = named["runs"]
        self.batches: list[str] = named["batches"]

    def _read(self, run: str) -> DataFrame:
        return self.spark.read.schema(", ".join(f"{k} long" for k in [*self.keys, "n"])).parquet(f"{self.path}/{run}")

    def _write(self, counts: DataFrame) -> str:
        run = f"run-{uuid.uuid4().hex}"
        counts.select(*self.keys, F.col("n").cast("long").alias("n")).sortWithinPartitions(*self.keys).write.option("compression", "zstd").parquet(f"{self.path}/{run}")
        return run

    def _name(self, runs: list[str], batches: list[str]) -> None:
        put_file(f"{self.path}/manifest.json", json.dumps({"runs": runs, "batches": batches}).encode())
        self.runs, self.batches = runs, batches

    def append(self, batch: DataFrame, name: str | None = None) -> DataFrame:
        """Add a batch of (keys, n); returns those of its keys that occur more than once so far, n over all runs.

        A batch whose name is in the index already is part of its runs, and isn't added again.
        """
        again = name is not None and name in self.batches
        new = self._write(batch.groupBy(*self.keys).agg(F.sum("n").alias("n")))
        seen, total = self._read(new), F.lit(0).cast("long") if again else F.col("n")
        for i, old in enumerate(self.runs):
            seen = seen.hint("merge").join(self._read(old).withColumnRenamed("n", f"n{i}"), self.keys, "left")
            total = total + F.coalesce(F.col(f"n{i}"), F.lit(0))
        more = Table(seen.select(*self.keys, total.alias("n")).where("n > 1"), "again").df
        if again:
            delete_path(self.spark, f"{self.path}/{new}")
            return more
        self._name([*self.runs, new], self.batches + [name] * (name is not None))
        if len(self.runs) > self.max_runs:
            self.compact()
        return more

    def compact(self) -> None:
        """Merge all runs into one."""
        old = self.runs
        merged = self._read(old[0])
        for r in old[1:]:
            merged = merged.union(self._read(r))
        self._name([self._write(merged.groupBy(*self.keys).agg(F.sum("n").alias("n")))], self.batches)
        self.compactions += 1
        for r in old:
            delete_path(self.spark, f"{self.path}/{r}")

    def drop(self) -> None:
        delete_path(self.spark, self.path)


def same_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group of each pair of values, and the first place of each group."""
    order = np.lexsort((b, a))
    x, y = a[order], b[order]
    new = np.ones(len(order), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return group, order[new]


def anchors(words: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window starts, position of each window's anchor, hashes of all anchor runs)."""
    none = np.zeros(0, np.int64)
    if len(words.hash) < window:
        return none, none, np.zeros(0, U64)
    g = mix(runs_hash(words.hash, anchor) + U64(5))
    span = window - anchor + 1
    at = np.arange(len(g))
    width = 1
    while width < span:  # leftmost minimum of `width` positions, by doubling
        step = min(width, span - width)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(g[left] <= g[right], left, right)
        width += step
    doc = words.doc_of()
    start = np.flatnonzero(doc[: len(doc) - window + 1] == doc[window - 1 :])
    return start, at[start], g


def _anchor_rows(window: int, anchor: int):
    def run(batches):
        for batch in batches:
            for b in pieces(batch):
                w = words_of(b.column("text"), False)
                start, at, g = anchors(w, window, anchor)
                pos = np.unique(at)
                doc = w.doc_of()[pos] if len(pos) else pos
                order = np.lexsort((g[pos], doc))
                h, d = g[pos][order], doc[order]
                fresh = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])) if len(h) else np.zeros(0, np.int64)
                n = np.diff(np.concatenate([fresh, [len(h)]]))
                key = b.column("key").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(key[d[fresh]]), pa.array(as_long(h[fresh])), pa.array(n.astype(np.int32))], ["key", "h", "n"])

    return run


def _window_rows(window: int, anchor: int, buckets: int):
    """Windows with repeated anchors: (bucket, key, h, pos, weight, hs). weight 0: found to repeat already."""

    def run(batches):
        for batch in batches:
            for b in pieces(batch):
                w = words_of(b.column("text"), False)
                start, at, g = anchors(w, window, anchor)
                key = b.column("key").to_numpy()
                flags = b.column("flags")
                doc = w.doc_of()
                took, hot = np.zeros(len(start), bool), np.zeros(len(start), bool)
                first = np.searchsorted(start, w.doc)
                for i in range(b.num_rows):
                    s = slice(first[i], first[i + 1])
                    f = flags[i].values
                    hs, is_hot = f.field(0).to_numpy(), f.field(1).to_numpy(zero_copy_only=False)
                    order = np.argsort(hs)
                    own = as_long(g[at[s]])
                    j = np.minimum(np.searchsorted(hs, own, sorter=order), len(hs) - 1)
                    took[s] = hs[order[j]] == own
                    hot[s] = took[s] & is_hot[order[j]]
                start, at, hot = start[took], at[took], hot[took]
                if not len(start):
                    continue
                full = runs_hash(w.hash, window)[start]
                h = g[at]
                out = {n: [] for n in ("bucket", "key", "h", "pos", "weight", "hs")}
                # hot anchors: a row a window, spread by window hash
                k = np.flatnonzero(hot)
                if len(k):
                    back, rep = same_pairs(h[k], full[k])
                    count = np.bincount(back)
                    for rows, weight in ((k[rep], np.minimum(count, 2)), (k[count[back] > 1], None)):
                        # the first lot is evidence for other slices; the second is known to repeat
                        by = full[rows] if weight is not None else key[doc[start[rows]]].view(U64) + start[rows].astype(U64)
                        out["bucket"].append((mix(by) % U64(buckets)).astype(np.int64))
                        out["key"].append(key[doc[start[rows]]])
                        out["h"].append(as_long(h[rows]))
                        out["pos"].append(start[rows] - w.doc[doc[start[rows]]])
                        out["weight"].append(np.zeros(len(rows), np.int64) if weight is None else weight)
                        out["hs"] += [x.tobytes() for x in full[rows]]
                # other anchors: a row for each run of windows with one anchor
                k = np.flatnonzero(~hot)
                if len(k):
                    s, a = start[k], at[k]
                    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (s[1:] != s[:-1] + 1)]))
                    stop = np.concatenate([new[1:], [len(k)]])
                    raw, f = full[k], s[new]
                    out["bucket"].append((mix(h[k][new]) % U64(buckets)).astype(np.int64))
                    out["key"].append(key[doc[f]])
                    out["h"].append(as_long(h[k][new]))
                    out["pos"].append(f - w.doc[doc[f]])
                    out["weight"].append(np.ones(len(new), np.int64))
                    out["hs"] += [raw[i:j].tobytes() for i, j in zip(new, stop, strict=True)]
                kinds = {"bucket": pa.int32(), "weight": pa.int32(), "pos": pa.int32()}
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out[n]), kinds.get(n, pa.int64())) if n != "hs" else pa.array(out[n], pa.binary()) for n in out], list(out))

    return run


def _repeats(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Inside one bucket: which windows of each row occur more than once: (key, pos, mask)."""
    t = pa.Table.from_batches(batches)
    col = lambda n: t.column(n).to_numpy()
    hs = t.column("hs").combine_chunks()
    size = np.diff(np.frombuffer(hs.buffers()[1], np.int32)[hs.offset : hs.offset + len(hs) + 1]) // 8
    full = np.frombuffer(b"".join(x.as_py() for x in hs), U64)
    row = np.repeat(np.arange(len(size)), size)
    weight = col("weight")[row]
    back, _ = same_pairs(col("h").view(U64)[row], full)
    again = (np.bincount(back, weight)[back] > 1) | (weight == 0)
    bit = np.arange(len(row)) - (np.cumsum(size) - size)[row]
    mask = np.bincount(row, np.where(again, 2.0 ** bit, 0), len(size)).astype(np.int64)
    hit = np.flatnonzero(mask)
    yield pa.RecordBatch.from_arrays([pa.array(col("key")[hit]), pa.array(col("pos")[hit]), pa.array(mask[hit])], ["key", "pos", "mask"])


def _cut(window: int, marked: bool, digest: bool):
    """Drops the covered words. digest: only figures and the hash of what is kept, else the text."""

    def run(batches):
        for batch in batches:
            for b in pieces(batch):
                w = words_of(b.column("text"), False)
                gone = np.zeros(len(w.hash) + 1, np.int64)
                marks = b.column("marks") if marked else None
                for i in range(b.num_rows if marked else 0):
                    if not marks[i].is_valid:
                        continue
                    f = marks[i].values
                    pos, mask = f.field(0).to_numpy().astype(np.int64), f.field(1).to_numpy()
                    bits = (mask[:, None] >> np.arange(window)) & 1
                    r, c = np.nonzero(bits)
                    at = pos[r] + c + w.doc[i]
                    np.add.at(gone, at, 1)
                    np.add.at(gone, np.minimum(at + window, len(w.hash)), -1)
                keep = np.cumsum(gone[:-1]) <= 0
                data = w.buf.tobytes()
                n, cut, texts = w.counts, [], []
                for i in range(b.num_rows):
                    own = slice(w.doc[i], w.doc[i + 1])
                    k = keep[own]
                    cut.append(int((~k).sum()))
                    texts.append(b" ".join([data[s:e] for s, e in zip(w.start[own][k].tolist(), w.end[own][k].tolist(), strict=True)]))
                last = pa.array([hashlib.sha256(x).hexdigest() for x in texts]) if digest else pa.array([x.decode() for x in texts])
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(cut, pa.int64()), last], ["doc_id", "n_words", "n_removed", "kept_sha256" if digest else "text"])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, batches: int = 4, max_runs: int = 2, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, text), or with ``digest`` (doc_id, n_words, n_removed, kept_sha256)."""
    if not 1 <= anchor <= window <= anchor + 52:
        raise ValueError("window must be at least anchor and at most anchor + 52 words")
    spark = docs.sparkSession
    bounded_batches(spark)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    held = Table(src.select("key", "text").mapInArrow(_anchor_rows(window, anchor), "key long, h long, n int"), "anchors")
    index = FingerprintIndex(spark, max_runs)
    found = [index.append(held.df.where(F.pmod("key", F.lit(batches)) == i).select("h", "n")) for i in range(batches)]
    again = found[0]
    for f in found[1:]:
        again = again.union(f)
    again = again.groupBy("h").agg(F.max("n").alias("n")).select("h", (F.col("n") > HOT).alias("hot"))
    flags = Table(held.df.select("key", "h").join(again, "h").groupBy("key").agg(F.collect_list(F.struct("h", "hot")).alias("flags")), "flags")
    held.drop()
    index.drop()
    total = flags.df.agg(F.sum(F.size("flags"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total * (window - anchor + 1) // 2 // BUCKET_WORDS) + 1)
    bits = bloom_of(flags.df.select("key"))
    some = bloom_keep(src.select("key", "text"), "key", bits).join(flags.df, "key").select("key", "text", "flags")
    rows = some.mapInArrow(_window_rows(window, anchor, buckets), "bucket int, key long, h long, pos int, weight int, hs binary")
    marks = Table(rows.groupBy("bucket").applyInArrow(_repeats, "key long, pos int, mask long").groupBy("key").agg(F.collect_list(F.struct("pos", "mask")).alias("marks")), "marks")
    bits = bloom_of(marks.df.select("key"))
    schema = "doc_id long, n_words long, n_removed long, " + ("kept_sha256 string" if digest else "text string")
    touched = bloom_keep(src, "key", bits).join(marks.df, "key", "left").select("doc_id", "text", "marks")
    rest = bloom_keep(src, "key", bits, outside=True).select("doc_id", "text")
    return touched.mapInArrow(_cut(window, True, digest), schema).union(rest.mapInArrow(_cut(window, False, digest), schema))


def _all_windows(window: int):
    def run(batches):
        for batch in batches:
            for b in pieces(batch):
                w = words_of(b.column("text"), False)
                doc = w.doc_of()
                start = np.flatnonzero(doc[: max(0, len(doc) - window + 1)] == doc[window - 1 :])
                h, g = runs_hash(w.hash, window)[start], runs_hash(mix(w.hash + U64(91)), window)[start]
                yield pa.RecordBatch.from_arrays([pa.array(b.column("key").to_numpy()[doc[start]]), pa.array((start - w.doc[doc[start]]).astype(np.int32)), pa.array(as_long(h)), pa.array(as_long(g))], ["key", "pos", "h", "g"])

    return run


def remove_known(docs: DataFrame, path: str, window: int = WINDOW, max_runs: int = 3, digest: bool = False, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, text) of a batch: words go that a window covers which stands elsewhere in the batch or in an earlier one.

    ``path`` is the folder of the index, made by the first batch; this batch's
    windows are added to it before anything is returned. A batch that runs again, because what
    came after it failed, is known by its name ``batch`` and gives the same result: its windows count
    once. Without a name it is known by its rows (their number, and a sum and a parity of two hashes).
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    if batch is None:
        batch = "rows-{}-{}-{}".format(*src.agg(F.count("*"), F.coalesce(F.sum(F.col("key").cast("decimal(38,0)")), F.lit(0)), F.coalesce(F.bit_xor(F.xxhash64(F.lit(3), "doc_id", "text")), F.lit(0))).first())
    seen = Table(src.select("key", "text").mapInArrow(_all_windows(window), "key long, pos int, h long, g long"), "windows")
    again = FingerprintIndex(spark, max_runs, path, ("h", "g")).append(seen.df.select("h", "g", F.lit(1).alias("n")), batch)
    marks = Table(seen.df.join(again.select("h", "g"), ["h", "g"]).select("key", "pos").distinct().groupBy("key").agg(F.collect_list(F.struct("pos", F.lit(1).cast("long").alias("mask"))).alias("marks")), "marks")
    seen.drop()
    schema = "doc_id long, n_words long, n_removed long, " + ("kept_sha256 string" if digest else "text string")
    return src.join(marks.df, "key", "left").select("doc_id", "text", "marks").mapInArrow(_cut(window, True, digest), schema)
