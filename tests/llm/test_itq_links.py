"""Embedding near-dedup (2): isolated pairs in few dimensions, and labels that look like parts of vectors."""

import numpy as np
import pytest

from quarrymeter.llm import itq


def pairs(d, n, low, high, seed):
    """n pairs of unit vectors at cosines between low and high, and their cosines in double precision."""
    r = np.random.default_rng(seed)
    a = itq.unit(r.standard_normal((n, d)))
    o = r.standard_normal((n, d))
    o = itq.unit(o - (o * a).sum(1, keepdims=True) * a)
    c = r.uniform(low, high, (n, 1))
    return a, c * a + np.sqrt(1 - c * c) * o


@pytest.mark.parametrize("d", [2, 3, 4, 8])
def test_isolated_pairs_in_few_dimensions(spark, d):
    n = 400
    a, b = pairs(d, n, 0.9801, 0.985, d)
    far, away = pairs(d, n, 0.97, 0.979, d + 50)
    rows = [(4 * i + k, [float(c) for c in v], f"l,{i},{k // 2}") for i in range(n) for k, v in enumerate((a[i], b[i], far[i], away[i]))]
    got = {r.vec_id: (r.n_links, r.component_id) for r in itq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").repartition(4)).collect()}
    assert got == {4 * i + k: (1, 4 * i) if k < 2 else (0, 4 * i + k) for i in range(n) for k in range(4)}


def test_labels_with_commas_stay_apart(spark):
    rows = [(1, [1.0, 2.0], "a"), (2, [2.0], "a,1.0"), (3, [1.0, 2.0], "a"), (4, [2.0], ""), (5, [1.0, 2.0], "1,a"), (6, [2.0], "a,1.0")]
    got = {r.vec_id: r.component_id for r in itq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5, 6: 2}


@pytest.mark.parametrize("d", [1, 2, 4, 64])
def test_planes_do_not_repeat(d):
    x = itq.unit(np.random.default_rng(1).standard_normal((4000, d)) + 0.2)
    q = itq.Quantiser([list(v) for v in x], 256)
    a, b = pairs(d, 500, 0.98, 0.98, 2) if d > 1 else (x[:500], x[:500])
    assert ((q.bits(a) != q.bits(b)).sum(1) <= itq.MOST).all()
