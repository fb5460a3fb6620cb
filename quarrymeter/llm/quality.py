"""Attention-based multiple-instance quality classifier (operator 1).

A document is a bag of passages of 64 words. Every passage is encoded from its
whole text: pairs of byte classes, hashed words, repetition, case and length
figures, then a learned layer. Gated attention gives each passage a weight,
softmax((tanh(V h) * sigmoid(U h)) w), learned from document labels alone; the
weighted passage representation gives the score.

Fitting takes at most ``MAX_BAGS`` labelled documents, those with the smallest
hash of their id, as whole texts. Scoring reads every passage of every document. The model
has a fixed size, so it is broadcast.

Defined cases: a null or empty text, or one without words, is a bag of one
empty passage and gets that passage's score; repeated rows get equal scores;
rows of ``labels`` with a null id or label are left out of fitting, as are
labels of documents that aren't there; a document with labels of both kinds
counts as 0; a very long text is a bag of all its passages; without labels of
both kinds every score is the share of label 1 among the rest, or 0.5, and so it
is for an empty table of labels; an empty table of documents gives an empty
result. ``with_scores`` replaces columns named like its results; ``keep_good``
leaves all columns as they are, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, bounded_batches, crc_mod, pieces, words_of, working

PASSAGE = 64
MAX_BAGS = 3000
HASHED = 64
HIDDEN, GATE = 32, 16
EPOCHS, BATCH, RATE, DECAY = 12, 64, 3e-3, 1e-4


def _byte_classes() -> np.ndarray:
    c = np.full(256, 15, np.uint8)
    c[128:] = 14
    c[97:123], c[65:91], c[48:58] = 0, 1, 2
    for i, group in enumerate((b" ", b"\n", b"\t\r\x0b\x0c", b".,;:", b"!?", b"'\"", b"|", b"*#%&$@^~", b"<>[]{}()", b"=+/\\_", b"-")):
        c[list(group)] = 3 + i
    return c


_CLASS = _byte_classes()
N_FEATURES = 256 + HASHED + 10


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray]
    constant: float | None = None


def passages(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Features of each passage and the passage offsets of the documents."""
    counts = words.counts
    per_doc = np.maximum(1, -(-counts // PASSAGE))
    offsets = np.concatenate([[0], np.cumsum(per_doc)])
    n = int(offsets[-1])
    out = np.zeros((n, N_FEATURES), np.float32)
    if not len(words.start):  # as an empty passage beside others
        out[:, -2:] = np.log1p(1) / 5, 1 / PASSAGE
        return out, offsets
    doc = words.doc_of()
    place = np.arange(len(doc)) - words.doc[doc]
    of = offsets[doc] + place // PASSAGE
    # pairs of byte classes, over the span from the first word to the last of each passage
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    last = np.concatenate([first[1:], [len(of)]]) - 1
    lo, hi, which = words.start[first], words.end[last], of[first]
    size = hi - lo
    at = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    cls = _CLASS[words.buf[at]]
    owner = np.repeat(which, size)
    same = owner[1:] == owner[:-1]
    code = cls[:-1].astype(np.int64) * 16 + cls[1:]
    pairs = np.bincount(owner[1:][same] * 256 + code[same], minlength=n * 256).reshape(n, 256)
    total = np.maximum(pairs.sum(1, keepdims=True), 1)
    out[:, :256] = np.sqrt(pairs / total)
    n_words = np.maximum(np.bincount(of, minlength=n), 1)
    slot = (words.hash >> np.uint64(40)).astype(np.int64) % HASHED
    sign = np.where(words.hash & np.uint64(1), 1.0, -1.0)
    bag = np.bincount(of * HASHED + slot, sign, n * HASHED).reshape(n, HASHED)
    out[:, 256 : 256 + HASHED] = bag / np.sqrt(n_words)[:, None]
    length = (words.end - words.start).astype(float)
    mean = np.bincount(of, length, n) / n_words
    order = np.lexsort((words.hash, of))
    h, o = words.hash[order], of[order]
    fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])])
    runs = np.flatnonzero(fresh)
    run_len = np.diff(np.concatenate([runs, [len(h)]]))
    top = np.zeros(n)
    np.maximum.at(top, o[runs], run_len)
    again = np.zeros(len(of), bool)
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (of[1:] == of[:-1])
    lines = np.bincount(owner[cls == 4], minlength=n)
    extra = [
        np.bincount(o[runs], minlength=n) / n_words,
        top / n_words,
        np.bincount(of[again], minlength=n) / n_words,
        mean / 10,
        np.sqrt(np.maximum(np.bincount(of, length**2, n) / n_words - mean**2, 0)) / 10,
        np.bincount(of[length == 1], minlength=n) / n_words,
        np.bincount(of[length > 15], minlength=n) / n_words,
        lines / n_words,
        np.log1p(np.diff(offsets))[np.repeat(np.arange(len(per_doc)), per_doc)] / 5,
        n_words / PASSAGE,
    ]
    out[:, 256 + HASHED :] = np.stack(extra, 1)
    return out, offsets


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _forward(w: dict, x: np.ndarray, first: np.ndarray, bag: np.ndarray) -> dict:
    h = np.tanh(x @ w["W"] + w["b"])
    a, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
    e = (a * g) @ w["w"]
    e = np.exp(e - np.maximum.reduceat(e, first)[bag])
    weight = e / np.add.reduceat(e, first)[bag]
    z = np.add.reduceat(weight[:, None] * h, first)
    return {"h": h, "a": a, "g": g, "weight": weight, "z": z, "p": _sigmoid(z @ w["c"] + w["d"])}


def fit(x: np.ndarray, offsets: np.ndarray, y: np.ndarray, seed: int = 1) -> Model:
    """Learn encoder, gated attention and classifier from bags and their labels (Adam)."""
    mean, scale = x.mean(0), x.std(0) + 1e-2
    if len(y) == 0 or y.min() == y.max():
        return Model(mean, scale, {}, float(y.mean()) if len(y) else 0.5)
    x = ((x - mean) / scale).astype(np.float32)
    rng = np.random.default_rng(seed)
    norm = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    w = {"W": norm(x.shape[1], HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": norm(HIDDEN, GATE), "U": norm(HIDDEN, GATE), "w": norm(GATE), "c": norm(HIDDEN), "d": np.zeros(1, np.float32)}
    m1, m2, t = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for i in range(0, len(y), BATCH):
            take = order[i : i + BATCH]
            size = offsets[take + 1] - offsets[take]
            first = np.concatenate([[0], np.cumsum(size)[:-1]])
            bag = np.repeat(np.arange(len(take)), size)
            xb = x[np.repeat(offsets[take] - first, size) + np.arange(size.sum())]
            f = _forward(w, xb, first, bag)
            d = ((f["p"] - y[take]) / len(take)).astype(np.float32)
            dz = d[:, None] * w["c"]
            da = (f["h"] * dz[bag]).sum(1)
            de = f["weight"] * (da - np.add.reduceat(f["weight"] * da, first)[bag])
            dag = de[:, None] * w["w"]
            dA, dG = dag * f["g"] * (1 - f["a"] ** 2), dag * f["a"] * f["g"] * (1 - f["g"])
            dh = (f["weight"][:, None] * dz[bag] + dA @ w["V"].T + dG @ w["U"].T) * (1 - f["h"] ** 2)
            grad = {"W": xb.T @ dh, "b": dh.sum(0), "V": f["h"].T @ dA, "U": f["h"].T @ dG, "w": (f["a"] * f["g"]).T @ de, "c": f["z"].T @ d, "d": d.sum(keepdims=True)}
            t += 1
            for k in w:
                gk = grad[k] + DECAY * w[k]
                m1[k] = 0.9 * m1[k] + 0.1 * gk
                m2[k] = 0.999 * m2[k] + 0.001 * gk**2
                w[k] = w[k] - RATE * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.999**t)) + 1e-8)
    return Model(mean.astype(np.float32), scale.astype(np.float32), w)


def score(model: Model, x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Score of each bag."""
    n = len(offsets) - 1
    if model.constant is not None or n == 0:
        return np.full(n, model.constant if model.constant is not None else 0.5)
    bag = np.repeat(np.arange(n), np.diff(offsets))
    return _forward(model.w, (x - model.mean) / model.scale, offsets[:-1], bag)["p"].astype(float)


def train(docs: DataFrame, labels: DataFrame, fold_of: int = 5, held: int = 0, max_bags: int = MAX_BAGS) -> Model:
    """Model from labelled documents whose crc32(id) modulo ``fold_of`` is not ``held``."""
    bounded_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_y")).where("_id is not null and _y in (0, 1)").where(crc_mod(F.col("_id"), fold_of) != held)
    known = known.groupBy("_id").agg(F.min("_y").alias("_y"))
    picked = known.orderBy(F.xxhash64("_id"), "_id").limit(max_bags)  # at most max_bags rows

    def bags(batches):
        working("quality")
        for batch in batches:
            for b in pieces(batch):
                x, off = passages(words_of(b.column("text"), False))
                rows = [x[off[i] : off[i + 1]].astype(np.float16).tobytes() for i in range(b.num_rows)]
                yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_y"), pa.array(rows, pa.binary())], ["id", "y", "x"])

    texts = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("text")).join(F.broadcast(picked), "_id").select("_id", "_y", "text")
    got = sorted({(r.id, r.y, bytes(r.x)) for r in texts.mapInArrow(bags, "id long, y int, x binary").toLocalIterator()})
    x = [np.frombuffer(r[2], np.float16).reshape(-1, N_FEATURES).astype(np.float32) for r in got]
    off = np.concatenate([[0], np.cumsum([len(v) for v in x])]).astype(np.int64)
    return fit(np.concatenate(x) if x else np.zeros((1, N_FEATURES), np.float32), off, np.array([r[1] for r in got], float))


THRESHOLD = 0.3


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least the threshold, with all their columns as they are, in one pass."""
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        working("quality")
        for batch in batches:
            for b in pieces(batch):
                s = score(held.value, *passages(words_of(b.column(b.schema.get_field_index("text")), False)))
                yield b.filter(pa.array(s >= threshold))

    return docs.mapInArrow(run, docs.schema)


def with_scores(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with ``score`` and ``predicted``, in one pass."""
    base = docs.drop("score", "predicted")
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        working("quality")
        for batch in batches:
            for b in pieces(batch):
                s = score(held.value, *passages(words_of(b.column("text"), False)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*b.schema.names, "score", "predicted"])

    schema = T.StructType([*base.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return base.mapInArrow(run, schema)
