"""Embedding near-dedup by iterative quantisation (operator 2).

Vectors are compared only inside a label (and length). A rotation is learned on
a bounded sample (``SAMPLE`` vectors, smallest digest): principal axes, then
alternating between binary codes and the rotation that fits them best, so codes
are balanced. Several rotations from different starts give enough bits; one that ends
in planes that an earlier one has (as in few dimensions, where starts end in one optimum)
is replaced by a random rotation, so that bits don't repeat. Vectors aren't centred, because only planes through the origin keep cosine and equal bits
linked, so codes are balanced as far as the data lie around the origin.

Multi-index tables: the code's bits are cut into hash tables of ``bits`` bits.
``bits`` follows the log of the label's own size, so buckets keep their size in
small and large labels alike, and the number of tables follows from ``bits``: a
pair at cosine 0.98 differs in a bit with probability acos(0.98)/pi, and tables
are added until such a pair is missed with a probability below ``MISS`` (closer
pairs less often). Labels of at most ``BUCKET`` vectors are one bucket.

Only ids and codes go to the buckets. There, pairs whose codes of ``CODE`` bits
differ in more than ``MOST`` bits are ruled out (a pair at 0.98 does with less
than 1e-8), and a pair that meets in several tables counts in the first. Vectors
are fetched only for the survivors, and reranked by cosine in double precision.

Exact copies are folded into one representative first; representatives have ids
of their own, so vectors may share a ``vec_id``. A bucket above ``BLOCK`` vectors
is split into pairs of blocks, so no task holds a whole hot bucket. A bucket
returns for each vector a number of links and one edge to its local root, never
all pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components, and those with a null label or id, link with nothing; vectors of
different lengths never link; repeated rows are vectors of their own and link
with each other, and so are different vectors that share an id; pairs at exactly
the threshold link; other columns are not read, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, bounded_batches, components, unskewed

THRESHOLD = 0.98
SAMPLE = 5000
ROUNDS = 30
MISS = 2e-5
BUCKET = 256
BLOCK = 1024
MAX_BITS = 30
CODE, MOST = 256, 42
#: Cosine between the normals of two planes that count as the same, and how many rotations a new one is held against.
SAME, REPEATS = 0.9, 16


def random_rotation(d: int, seed: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))[0]


def learn_rotation(x: np.ndarray, seed: int) -> np.ndarray:
    """Rotation (length x bits) by iterative quantisation of unit vectors.

    Vectors aren't centred: only planes through the origin keep the link between
    cosine and equal bits, also where one dense group draws the mean to itself.
    """
    d = x.shape[1]
    turn = random_rotation(d, seed)
    if len(x) < 2 * d:
        return turn
    _, axes = np.linalg.eigh(x.T @ x / len(x))
    v = x @ axes
    for _ in range(ROUNDS):
        codes = np.where(v @ turn >= 0, 1.0, -1.0)
        a, _, b = np.linalg.svd(v.T @ codes)
        turn = a @ b
    return axes @ turn


class Quantiser:
    """Codes and table keys of vectors; rotations are learned for the sampled lengths, random for others."""

    def __init__(self, sample: list[list[float]], n_bits: int):
        self.n_bits = n_bits
        self.fitted: dict[int, np.ndarray] = {}
        by_length: dict[int, list] = {}
        for v in sample:
            by_length.setdefault(len(v), []).append(v)
        for d, rows in by_length.items():
            self.fitted[d] = self._rotations(d, unit(np.array(rows, float)))

    def _rotations(self, d: int, x: np.ndarray) -> np.ndarray:
        out: list[np.ndarray] = []
        for i in range(-(-self.n_bits // d)):
            turn = learn_rotation(x, 100 + i)
            if out and np.abs(np.concatenate(out[:REPEATS], 1).T @ turn).max() > SAME:
                turn = random_rotation(d, 100 + i)
            out.append(turn)
        return np.concatenate(out, 1)[:, : self.n_bits]

    def bits(self, x: np.ndarray) -> np.ndarray:
        """(vectors x n_bits) bits of unit vectors of one length."""
        d = x.shape[1]
        if d not in self.fitted:
            self.fitted[d] = self._rotations(d, np.zeros((0, d)))
        return x @ self.fitted[d] >= 0


def keys_of(bits: np.ndarray, width: int, tables: int) -> np.ndarray:
    """(vectors x tables) keys: the next ``width`` bits for each table."""
    if not width:
        return np.zeros((len(bits), 1), np.int32)
    return np.stack([bits[:, i * width : (i + 1) * width] @ (1 << np.arange(width)) for i in range(tables)], 1).astype(np.int32)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-300)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)


def plan_of(n_label: float) -> tuple[int, int]:
    """(bits of a table, tables) for a number of vectors in a label."""
    bits = int(min(MAX_BITS, max(0, math.ceil(math.log2(max(1.0, n_label / BUCKET))))))
    if not bits:
        return 0, 1
    same = (1 - math.acos(THRESHOLD) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log(1 - same))


def _members(batches: Iterator[pa.RecordBatch], lo: int, hi: int) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of one pair of blocks: left and right members, and table keys."""
    t = pa.Table.from_batches(batches)
    block = t.column("block").to_numpy()
    keys = np.stack([np.frombuffer(k.as_buffer(), np.int32) for k in t.column("keys")])
    return t, np.flatnonzero(block == lo), np.flatnonzero(block == hi), keys


def _fresh(a: np.ndarray, b: np.ndarray, keys: np.ndarray, table: int) -> np.ndarray:
    """Pairs that share no earlier table."""
    return ~(keys[a, :table] == keys[b, :table]).any(1) if table else np.ones(len(a), bool)


def _survivors(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of one pair of blocks of one bucket that have a partner by Hamming distance."""
    table, lo, hi = key[2].as_py(), key[4].as_py(), key[5].as_py()
    t, left, right, keys = _members(batches, lo, hi)
    code = np.stack([np.frombuffer(c.as_buffer(), np.uint64) for c in t.column("code")])
    some = np.zeros(len(code), bool)
    for i in range(0, len(left), 256):
        rows = left[i : i + 256]
        far = np.zeros((len(rows), len(right)), np.uint16)
        for w in range(code.shape[1]):
            far += np.bitwise_count(code[rows, w][:, None] ^ code[right, w][None])
        a, b = np.nonzero(far <= MOST)
        a, b = rows[a], right[b]
        ok = a < b if lo == hi else np.ones(len(a), bool)
        a, b = a[ok], b[ok]
        for j in range(0, len(a), 1 << 16):
            aa, bb = a[j : j + (1 << 16)], b[j : j + (1 << 16)]
            new = _fresh(aa, bb, keys, table)
            some[aa[new]] = True
            some[bb[new]] = True
    yield from t.filter(pa.array(some)).select(MET).to_batches()


MET = ["label", "length", "tab", "key", "lo", "hi", "block", "id", "keys"]


def _links(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside one pair of blocks of one bucket: (id, links, root)."""
    table, lo, hi = key[2].as_py(), key[4].as_py(), key[5].as_py()
    t, left, right, keys = _members(batches, lo, hi)
    vector = t.column("vector").combine_chunks()
    x = unit(vector.values.to_numpy()[vector.offsets[0].as_py() : vector.offsets[-1].as_py()].astype(float).reshape(len(vector), -1))
    ids, copies = t.column("id").to_numpy(), t.column("copies").to_numpy()
    links = np.zeros(len(ids), np.int64)
    root = np.arange(len(ids))
    pairs = []
    for i in range(0, len(left), 512):
        rows = left[i : i + 512]
        a, b = np.nonzero(x[rows] @ x[right].T >= THRESHOLD)
        a, b = rows[a], right[b]
        ok = a < b if lo == hi else np.ones(len(a), bool)
        a, b = a[ok], b[ok]
        for j in range(0, len(a), 1 << 16):
            aa, bb = a[j : j + (1 << 16)], b[j : j + (1 << 16)]
            new = _fresh(aa, bb, keys, table)
            aa, bb = aa[new], bb[new]
            np.add.at(links, aa, copies[bb])
            np.add.at(links, bb, copies[aa])
            pairs.append((aa.astype(np.int32), bb.astype(np.int32)))
    a, b = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, np.int32) for k in (0, 1))
    while len(a):
        # lower both ends to the smaller root, and follow roots of roots
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    hit = links > 0
    yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(links[hit]), pa.array(ids[root[hit]])], ["id", "links", "root"])


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row for each row of the input."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    v = F.col("vector")
    narrow = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast(narrow).alias("vector"))
    usable = F.coalesce(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(v) > 0)
        & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0),
        F.lit(False),
    )
    named = F.col("label").cast("string")
    # the length of the label comes first, so that a label can't be taken for a part of the vector
    digest = F.when(usable, F.md5(F.concat_ws(",", F.length(named), named, v.cast("array<string>"))))
    rows = rows.withColumn("digest", digest)
    good = rows.where("digest is not null")
    first = good.groupBy("digest").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    # ids of the representatives are fixed once they are written
    reps = Table(first.select(F.monotonically_increasing_id().alias("id"), "*", F.size("vector").alias("length")), "reps")
    sizes = reps.df.groupBy("label", "length").agg(F.count("*").alias("n_label"))
    most = sizes.agg(F.max("n_label")).first()[0] or 1
    widest = max(b * t for b, t in (plan_of(BUCKET * 2.0**k) for k in range(max(1, math.ceil(math.log2(max(1.0, most / BUCKET)))) + 1)))
    sample = [list(r.vector) for r in reps.df.orderBy("digest").limit(SAMPLE).select("vector").collect()]  # at most SAMPLE rows
    held = spark.sparkContext.broadcast(Quantiser(sample, max(CODE, widest)))

    def encode(batches):
        q = held.value
        for b in batches:
            vector, n_label = b.column("vector"), b.column("n_label").to_numpy()
            start = vector.offsets.to_numpy()
            flat, size = vector.values.to_numpy(), np.diff(start)
            codes, packed, lists = ([None] * b.num_rows for _ in range(3))
            plans = np.array([plan_of(n) for n in n_label]).reshape(-1, 2)
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                bits = q.bits(unit(np.stack([flat[start[i] : start[i + 1]] for i in at]).astype(float)))
                code = np.packbits(bits[:, :CODE], axis=1)
                for width, tables in np.unique(plans[at], axis=0):
                    same = (plans[at] == (width, tables)).all(1)
                    keys = keys_of(bits[same], int(width), int(tables))
                    for i, c, k in zip(at[same], code[same], keys, strict=True):
                        codes[i], packed[i], lists[i] = c.tobytes(), k.tobytes(), k
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("id", "label", "length")), pa.array(codes, pa.binary()), pa.array(packed, pa.binary()), pa.array(lists, pa.list_(pa.int32()))],
                ["id", "label", "length", "code", "keys", "key"],
            )

    kind = dict(reps.df.dtypes)["label"]
    cell = f"label {kind}, length int, tab int, key int, lo int, hi int"
    planned = reps.df.join(sizes, ["label", "length"]).select("id", "label", "length", "vector", "n_label")
    coded = Table(planned.mapInArrow(encode, f"id long, label {kind}, length int, code binary, keys binary, key array<int>"), "codes")
    bucket = ["label", "length", "tab", "key"]
    skinny = coded.df.select("id", "label", "length", "code", "keys", F.posexplode("key").alias("tab", "key"))
    filled = skinny.groupBy(*bucket).agg(F.count("*").alias("m")).where("m > 1")
    met = skinny.join(filled, bucket).withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*bucket, "id", "code", "keys", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    near = Table(dealt.groupBy(*bucket, "lo", "hi").applyInArrow(_survivors, f"{cell}, block int, id long, keys binary"), "near")
    coded.drop()
    full = near.df.join(reps.df.select("id", "copies", "vector"), "id")
    found = Table(full.groupBy(*bucket, "lo", "hi").applyInArrow(_links, "id long, links long, root long"), "links")
    near.drop()
    counts = found.df.groupBy("id").agg(F.sum("links").alias("links"))
    edges = found.df.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))
    comp = components(reps.df.select("id"), edges)
    named = Table(reps.df.select("digest", "id", "low", "copies").join(counts, "id", "left").join(comp, "id"), "named").df
    low = named.groupBy("component").agg(F.min("low").alias("component_id"))
    known = unskewed(named, low, "component").select("digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = unskewed(Table(rows.select("vec_id", "digest"), "rows").df, known, "digest")
    comp_id = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"), F.coalesce(F.col("vec_id") == comp_id, F.lit(True)).alias("kept"))
