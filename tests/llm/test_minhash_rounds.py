"""MinHash near-dedup (3): few links are settled in one task, and members are renamed by a broadcast of the names."""

import random

import pytest

from quarrymeter.llm import common, minhash

from .test_llm import Links
from .test_minhash_groups import mutated


def near_copies(seed, n=220):
    r = random.Random(seed)
    words = [f"v{i}" for i in range(400)]
    base = [f"b{i}" for i in range(110)]
    texts = [mutated(r, words, base[: r.randint(90, 110)], r.uniform(0, 0.09)) for _ in range(n)]
    texts += [mutated(r, words, t, 0.02) for t in texts[:30]]
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def result(spark, rows):
    return sorted(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), k=2).collect())


def test_members_are_not_shuffled_to_take_names(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 32)
    keys, whole = [], minhash.unskewed
    monkeypatch.setattr(minhash, "unskewed", lambda rows, named, key, *a: keys.append(key) or whole(rows, named, key, *a))
    monkeypatch.setattr(minhash, "components", lambda *a: pytest.fail("few links took rounds of joins"))
    got = result(spark, near_copies(1))
    assert "comp" not in keys and {"a", "b"}.isdisjoint(keys), keys
    assert 1 < len({x.component_id for x in got}) < len(got)


def test_many_links_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 32)
    rows = near_copies(2)
    few = result(spark, rows)
    monkeypatch.setattr(minhash, "FEW_LINKS", 0)
    monkeypatch.setattr(minhash, "FEW_NAMES", 0)
    assert result(spark, rows) == few


@pytest.mark.parametrize("seed", range(3))
def test_few_components(spark, seed):
    r = random.Random(seed)
    ids = [r.randrange(-(2**60), 2**60) for _ in range(600)]
    pairs = [(r.choice(ids), r.choice(ids)) for _ in range(300)] + list(zip(ids[::2], ids[2::2]))[: 80 * seed]
    uf = Links()
    for a, b in pairs:
        uf.join(a, b)
    got = {x.id: x.component for x in common.few_components(spark.createDataFrame(pairs, "a long, b long").repartition(5)).collect()}
    assert got == {i: uf.find(i) for p in pairs for i in p}
    assert common.few_components(spark.createDataFrame([], "a long, b long")).count() == 0
