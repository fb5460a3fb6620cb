"""The k-means tree (11) against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymeter.llm import kmtree

NAN, INF = float("nan"), float("inf")
KIND = "vec_id long, embedding array<double>, rank string, score string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], "r", "s") for i, v in rows], KIND).repartition(3)


def brute(rows, queries, k):
    """{query: [(id, score)]} over distinct usable rows, own row left out, ties to the smaller id."""
    good = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)})
    out = {}
    for i, v in good:
        if i in queries:
            near = sorted((-float((np.array(v) * np.array(w)).sum()), j) for j, w in good if (j, w) != (i, v) and len(w) == len(v))
            out.setdefault(i, []).append([(j, -s) for s, j in near[:k]])
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def odd_rows():
    r = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(r.integers(-3, 4, (300, 6)).astype(float))]
    rows += [(i, [1.0, 2.0, 0.0, 0.0, 0.0, 1.0]) for i in range(300, 420)]  # copies
    rows += [(7, rows[7][1]), (300, rows[300][1])]  # repeated rows
    rows += [(500, None), (501, []), (502, [0.0] * 6), (503, [NAN] * 6), (504, [INF] + [1.0] * 5), (505, [None] + [1.0] * 5), (None, [1.0] * 6)]
    rows += [(600, [1.0, 2.0]), (601, [2.0, 1.0]), (602, [3.0])]  # other lengths
    return rows


@pytest.mark.parametrize("block", [16, 2048])
def test_all_leaves_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(kmtree, "BLOCK", block)
    monkeypatch.setattr(kmtree, "ASKS", 20)
    monkeypatch.setattr(kmtree, "ROUNDS", (2, 5))
    rows = odd_rows()
    queries = {*range(0, 300, 20), 300, 301, 419, 500, 502, 600, 602}
    got = found(kmtree.neighbours(table(spark, rows), F.col("vec_id").isin(*queries), k=20, target=1.1))
    expect = {q: lists[0] for q, lists in brute(rows, queries, 20).items() if lists[0]}
    assert got == expect


def test_ids_shared_by_different_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [0.5, 0.1])]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in kmtree.neighbours(table(spark, rows), F.col("vec_id") == 1, k=2).collect())
    assert got == sorted([(1, 1, 2, 1.0), (1, 2, 3, 0.5), (1, 1, 2, 1.0), (1, 2, 3, 0.1)])


def test_recall_on_clustered_and_varied_lengths_of_vectors(spark, monkeypatch):
    monkeypatch.setattr(kmtree, "SAMPLE", 1500)
    r = np.random.default_rng(8)
    x = (r.standard_normal((40, 16))[r.integers(0, 40, 4000)] + 0.4 * r.standard_normal((4000, 16))) * r.uniform(0.5, 2, (4000, 1))
    df = table(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    got = found(kmtree.neighbours(df, F.col("vec_id") % 20 == 0))
    hits = 0
    for q, near in got.items():
        s = x @ x[q]
        s[q] = -INF
        hits += len({j for j, _ in near} & set(np.argsort(-s)[:20].tolist()))
        assert len(near) == 20 and np.allclose([v for _, v in near], s[[j for j, _ in near]], rtol=1e-13)
    assert len(got) == 200 and hits / 4000 >= 0.9


def test_calibrated_visits_read_a_part_of_the_leaves():
    r = np.random.default_rng(9)
    x = r.standard_normal((60, 8))[r.integers(0, 60, 6000)] * 4 + 0.3 * r.standard_normal((6000, 8))
    tree = kmtree.fit_tree(x)
    leaf = tree.route(x)
    assert tree.leaves > 100 and np.bincount(leaf).max() < 600
    order = tree.order(x[:50], tree.leaves, 3.0)
    assert all(sorted(o) == list(range(tree.leaves)) for o in order)
    near = np.argsort(-(x[:50] @ x.T), axis=1)[:, :20]
    places = [int(np.flatnonzero(order[i] == leaf[j])[0]) for i in range(50) for j in near[i]]
    assert np.quantile(places, 0.95) < tree.leaves / 4


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 2.0])], [(0, None), (20, [])]])
def test_no_neighbours(spark, rows):
    assert kmtree.neighbours(table(spark, rows), F.col("vec_id") % 20 == 0).collect() == []
