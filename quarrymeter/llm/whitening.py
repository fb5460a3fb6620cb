"""Embedding whitening by matrix-free block subspace iteration (operator 13).

Entries become integers x = floor(64 * c) + 1000000, and the covariance is taken
over the fit list, each distinct integer vector once, which is written to the
shared folder. A covariance matrix of all rows is never formed: a Spark pass
centres the rows of its batches, multiplies them with the block Q and back, and
adds up X'(XQ) (length x width numbers). From that the driver gets, without
another pass, the Rayleigh-Ritz values and vectors of the block, their residuals
|VQw - e Qw|, and by QR the next block. It ends when the residuals of all wanted
components are below ``TOLERANCE`` of the largest eigenvalue. Where the spectrum
is so flat that more than ``PATIENCE`` further passes would be needed, the block
is widened with new directions (twice as many each time, the vectors' length at
most), so passes stay few for any spectrum.

A task sums its own rows and gives ``length`` rows of ``width`` numbers, which Spark adds up
by key with map-side partials: the driver sees length x width numbers, whatever
the input. Centring is exact in integers, (n*x - S) / n, before any product.

Defined cases: rows whose vector is null, empty or holds null or non-finite
entries are dropped; the common length is the most frequent one (the smaller of
equals), and rows of other lengths, which have no place in the same covariance,
are dropped as well; null and repeated ids, and repeated rows, are rows like any
other (the fit list has each vector once); entries beyond 2**40 count as 2**40;
a deviation beyond a long is null; a component whose eigenvalue is zero up to
rounding doesn't exist, so vectors that span few dimensions give few components,
and a single distinct vector or an empty table gives none; other columns of the
input are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Table, bounded_batches

SCALE, SHIFT, LARGEST = 64, 1_000_000, 1 << 40
TOLERANCE = 1e-13  # residual over the largest eigenvalue
PATIENCE = 4
MOST_PASSES = 500


@dataclass
class Whitening:
    """A fitted whitening: vectors y (x without the shift), sums and components of the fit list."""

    n: int
    sums: np.ndarray  # of x - SHIFT, one long for each dimension
    vectors: np.ndarray  # (length x components), unit columns
    values: np.ndarray  # eigenvalues, falling
    trace: float
    identity_error: float
    passes: int


def usable(v: Column) -> Column:
    """Vectors with at least one entry and only finite ones."""
    return F.coalesce((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def whole(v: Column) -> Column:
    """floor(64 * c) of every entry as longs: x without its shift."""
    return F.transform(v, lambda c: F.least(F.greatest(F.floor(c.cast("double") * SCALE), F.lit(-LARGEST)), F.lit(LARGEST)).cast("long"))


def matrix(col: pa.Array, d: int) -> np.ndarray:
    """(rows x d) longs of a list column without nulls."""
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _centred(y: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n, with the difference made in integers where they fit."""
    if n * max(1.0, float(np.abs(y).max(initial=0))) < 2**62:
        return (n * y - sums) / n
    return y - sums / n


def _products(fit: DataFrame, n: int, sums: np.ndarray, q: np.ndarray, project: bool = False) -> np.ndarray:
    """X'(XQ), or with ``project`` (XQ)'(XQ), over the centred rows of the fit list, in one pass."""
    d, width = q.shape
    height = width if project else d

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((height, width))
        seen = False
        for b in batches:
            if b.num_rows:
                x = _centred(matrix(b.column(0), d), n, sums)
                z = x @ q
                total += (z if project else x).T @ z
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(height, dtype=np.int32)), *(pa.array(total[:, j].copy()) for j in range(width))], ["row", *(f"c{j}" for j in range(width))])

    parts = fit.select("y").mapInArrow(add, "row int, " + ", ".join(f"c{j} double" for j in range(width)))
    out = np.zeros((height, width))
    for r in parts.groupBy("row").agg(F.array(*(F.sum(f"c{j}") for j in range(width))).alias("c")).collect():  # height rows
        out[r.row] = r.c
    return out


def _wider(q: np.ndarray, width: int, rng: np.random.Generator) -> np.ndarray:
    """An orthonormal block with the span of q and random further directions."""
    return np.linalg.qr(np.concatenate([q, rng.standard_normal((len(q), width - q.shape[1]))], 1))[0]


def subspace(apply, d: int, k: int, seed: int = 13) -> tuple[np.ndarray, np.ndarray, int]:
    """(unit eigenvectors, eigenvalues, passes) of the k largest eigenvalues of a symmetric operator that is known by ``apply(block)`` only."""
    rng = np.random.default_rng(seed)
    k = min(k, d)
    q = _wider(np.zeros((d, 0)), min(d, 2 * k), rng)
    before = None
    for passes in range(1, MOST_PASSES + 1):
        vq = apply(q)
        h = q.T @ vq
        values, w = np.linalg.eigh((h + h.T) / 2)
        values, w = values[::-1], w[:, ::-1]
        ritz, image = q @ w, vq @ w
        left = np.linalg.norm(image[:, :k] - ritz[:, :k] * values[:k], axis=0)
        worst = left.max() / max(abs(values[0]), 1e-300)
        if worst <= TOLERANCE or values[0] <= 0 or (q.shape[1] == d and before is not None and worst > before / 2):
            # a block of full width is exact up to rounding, which further passes don't mend
            return ritz[:, :k], values[:k], passes
        rate = worst / before if before else 1.0
        to_go = np.inf if rate >= 1 else np.log(TOLERANCE / worst) / np.log(rate)
        width = q.shape[1]
        # image spans V times the old block; where it has lost rank, QR fills it up
        q = np.linalg.qr(image)[0]
        if passes > 1 and width < d and to_go > PATIENCE:
            q, worst = _wider(q, min(d, 2 * width), rng), None
        before = worst
    raise RuntimeError(f"residuals above {TOLERANCE} after {MOST_PASSES} passes")


def integer_rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, y): usable rows of the most frequent length, as integers without the shift."""
    v = F.col(vector_col)
    rows = vectors.where(usable(v)).select(F.col(id_col).alias("id"), whole(v).alias("y"))
    length = rows.groupBy(F.size("y").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("y") == (length.d if length else 0))


def fit(rows: DataFrame, k: int = 16) -> Whitening | None:
    """Whitening of (id, y) rows by their distinct vectors; None without rows."""
    listed = Table(rows.select("y").distinct(), "fit")
    first = listed.df.first()
    if first is None:
        listed.drop()
        return None
    d = len(first.y)
    total = listed.df.agg(F.count("*").alias("n"), *(F.sum(F.col("y")[i]) for i in range(d))).first()
    n, sums = total[0], np.array(total[1:], np.int64)
    squares = listed.df.select("y").mapInArrow(_squares(d, n, sums), "v double").agg(F.sum("v")).first()[0]
    trace = squares / n
    vectors, values, passes = subspace(lambda q: _products(listed.df, n, sums, q) / n, d, k)
    real = values > max(values[0], 0) * 1e-12 * d
    vectors, values = vectors[:, real], values[real]
    error = 0.0
    if len(values):
        cov = _products(listed.df, n, sums, vectors / np.sqrt(values), project=True) / n
        error = float(np.abs(cov - np.eye(len(values))).max())
    listed.drop()
    return Whitening(n, sums, vectors, values, trace, error, passes)


def _squares(d: int, n: int, sums: np.ndarray):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(float((_centred(matrix(b.column(0), d), n, sums) ** 2).sum()) for b in batches if b.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array([total])], ["v"])

    return add


def deviations(y: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """Exact sums of (n*x - S)^2 as longs; null beyond a long."""
    rough = ((n * y.astype(float) - sums) ** 2).sum(1)
    near = rough < 2**61
    out = np.zeros(len(y), np.int64)
    off = n * y[near] - sums
    out[near] = (off * off).sum(1)
    exact = {i: sum((n * int(c) - int(s)) ** 2 for c, s in zip(y[i], sums, strict=True)) for i in np.flatnonzero(~near) if rough[i] < 2**64}
    for i, x in exact.items():
        out[i] = x if x < 2**63 else 0
    lost = ~near & ~np.isin(np.arange(len(y)), [i for i, x in exact.items() if x < 2**63])
    return pa.array(out, mask=lost)


def transform(rows: DataFrame, model: Whitening) -> DataFrame:
    """(id, deviation, whitened array<double>) of every (id, y) row."""
    d = len(model.sums)
    turn = rows.sparkSession.sparkContext.broadcast((model.n, model.sums, model.vectors / np.sqrt(model.values)))  # length x components numbers

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, w = turn.value
        for b in batches:
            y = matrix(b.column(1), d)
            z = _centred(y, n, sums) @ w
            ends = np.arange(len(z) + 1, dtype=np.int32) * w.shape[1]
            yield pa.RecordBatch.from_arrays([b.column(0), deviations(y, n, sums), pa.ListArray.from_arrays(pa.array(ends), pa.array(z.ravel()))], ["id", "deviation", "whitened"])

    kind = dict(rows.dtypes)["id"]
    return rows.select("id", "y").mapInArrow(project, f"id {kind}, deviation long, whitened array<double>")


def whitened_components(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16) -> DataFrame:
    """One row for each vector and component: (vec_id, component, n, deviation, whitened, explained, identity_error)."""
    bounded_batches(vectors.sparkSession, records=4096)
    rows = integer_rows(vectors, id_col, vector_col)
    model = fit(rows, k)
    kind = dict(vectors.dtypes)[id_col]
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    share = F.array(*(F.lit(float(e / model.trace)) for e in model.values))
    each = transform(rows, model).select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        F.col("id").alias("vec_id"), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        share[F.col("at")].alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
