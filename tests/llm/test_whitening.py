"""Whitening (13) against numpy's eigenvectors of the whole covariance."""

import numpy as np
import pytest

from quarrymeter.llm import whitening

NAN, INF = float("nan"), float("inf")
KIND = "vec_id long, embedding array<float>, component string, id string"


def rows_of(x, first=0):
    return [(first + i, [float(c) for c in v], "c", "i") for i, v in enumerate(x)]


def expected(vectors, k=16):
    y = np.floor(64 * np.array(vectors, np.float32).astype(float)).astype(int) + 1_000_000
    u = np.unique(y, axis=0)
    c = (u - u.mean(0)).T @ (u - u.mean(0)) / len(u)
    e, v = np.linalg.eigh(c)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return len(u), ((len(u) * y - u.sum(0)) ** 2).sum(1), (y - u.mean(0)) @ v / np.sqrt(e), e / np.trace(c)


def compare(spark, data, vectors):
    got = whitening.whitened_components(spark.createDataFrame(data, KIND).repartition(3)).toPandas()
    n, deviation, white, share = expected(vectors)
    wide = got.pivot(index="vec_id", columns="component", values="whitened")
    z = wide.loc[range(len(vectors))].to_numpy()
    assert np.abs(z * np.sign((z * white).sum(0)) - white).max() < 1e-9
    one = got[got.component == 1].set_index("vec_id").loc[range(len(vectors))]
    assert set(got.n) == {n} and list(one.deviation) == list(deviation)
    assert np.allclose(got.groupby("component").explained.first(), share, rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    return got


def test_whitening_equals_whole_covariance_with_repeats_and_broken_rows(spark):
    r = np.random.default_rng(1)
    x = r.standard_normal((400, 24)) * np.linspace(3, 0.5, 24) + 5
    x[100:200] = x[7]  # a quarter of the rows are copies
    broken = [(900, None, "c", "i"), (901, [], "c", "i"), (902, [NAN] * 24, "c", "i"), (903, [None] + [1.0] * 23, "c", "i"), (904, [INF] + [0.0] * 23, "c", "i"), (905, [1.0] * 23, "c", "i")]
    got = compare(spark, rows_of(x) + broken, x)
    assert len(got) == 400 * 16


def test_flat_spectrum_is_certified_by_widening(spark):
    x = np.random.default_rng(2).standard_normal((3000, 48))
    compare(spark, rows_of(x), x)


def test_null_and_repeated_ids_are_rows(spark):
    x = np.random.default_rng(3).standard_normal((40, 3))
    data = rows_of(x) + [(None, [float(c) for c in x[0]], "c", "i"), (0, [float(c) for c in x[1]], "c", "i")]
    got = whitening.whitened_components(spark.createDataFrame(data, KIND)).collect()
    assert len(got) == 42 * 3 and {r.n for r in got} == {40} and sum(r.vec_id is None for r in got) == 3 and sum(r.vec_id == 0 for r in got) == 6


@pytest.mark.parametrize("data", [[], [(1, [1.0, 2.0], "c", "i")] * 3, [(1, None, "c", "i")]])
def test_nothing_to_whiten(spark, data):
    assert whitening.whitened_components(spark.createDataFrame(data, KIND)).collect() == []


def test_vectors_of_low_rank_give_few_components(spark):
    r = np.random.default_rng(4)
    x = r.integers(-9, 9, (200, 2)) @ r.integers(-3, 3, (2, 20))
    got = whitening.whitened_components(spark.createDataFrame(rows_of(x), KIND)).toPandas()
    assert set(got.component) == {1, 2} and abs(got.groupby("component").explained.first().sum() - 1) < 1e-9


def test_subspace_takes_few_passes_where_the_spectrum_falls():
    r = np.random.default_rng(5)
    q = np.linalg.qr(r.standard_normal((300, 300)))[0]
    e = 0.5 ** np.arange(300)
    v = (q * e) @ q.T
    vectors, values, passes = whitening.subspace(lambda b: v @ b, 300, 8)
    assert passes < 12 and np.allclose(values, e[:8]) and np.allclose(np.abs((vectors * q[:, :8]).sum(0)), 1)


def test_deviations_are_exact_beyond_doubles_and_null_beyond_longs():
    y = np.array([[3, -5], [2**31, 7], [2**33, 0]])
    assert whitening.deviations(y, 1, np.array([1, 1])).to_pylist() == [4 + 36, (2**31 - 1) ** 2 + 36, None]
