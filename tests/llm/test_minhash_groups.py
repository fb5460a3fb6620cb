"""MinHash near-dedup (3): large groups of near copies in buckets of many blocks."""

import random
from itertools import combinations

import pytest

from quarrymeter.llm import minhash

from .test_llm import Links, sets_of


def mutated(r, words, base, rate):
    return [r.choice(words) if r.random() < rate else w for w in base]


@pytest.fixture
def written(monkeypatch):
    """Names and frames of the tables that the operator writes."""
    seen = []

    class Recorded(minhash.Table):
        def __init__(self, df, name):
            super().__init__(df, name)
            seen.append((name, self.df))

    monkeypatch.setattr(minhash, "Table", Recorded)
    return seen


def test_rows_of_a_bucket_do_not_grow_with_its_square(spark, monkeypatch, written):
    monkeypatch.setattr(minhash, "BLOCK", 32)
    r = random.Random(1)
    words = [f"w{i}" for i in range(20000)]
    base = r.sample(words, 120)
    rows = [(i, " ".join(mutated(r, words, base, r.uniform(0, 0.07)))) for i in range(600)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), k=2).collect()
    assert len(got) == len(rows) and 2 < len({x.component_id for x in got}) < 300
    counts = [(name, df.count()) for name, df in written if name in ("mixed", "cells")]
    assert counts and max(n for _, n in counts) <= 1.5 * 40 * len(rows), counts  # a document has 40 bands


@pytest.mark.parametrize(("vocabulary", "block"), [(12, 16), (3000, 48)])
def test_large_buckets_equal_brute_force(spark, monkeypatch, written, vocabulary, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "RARE", 8)
    r = random.Random(vocabulary)
    words = [f"v{i}" for i in range(vocabulary)]
    base = [f"b{i}" for i in range(120)]
    texts = [mutated(r, words, base[: r.randint(95, 120)], r.uniform(0, 0.09)) for _ in range(260)]
    texts += [mutated(r, words, t, 0.02) for t in texts[:40] for _ in range(2)]  # families, some away from the others
    texts += [base[:60] + [f"own{i}x{j}" for j in range(r.randint(5, 50))] for i in range(40)]  # a shared passage
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    s, links = sets_of(rows, 2), Links()
    for a, b in combinations(s, 2):
        if 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
            links.join(a, b)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), k=2).collect()
    assert {x.doc_id: x.component_id for x in got} == {i: links.find(i) for i in s}
    roles = {x.role for name, df in written if name == "cells" for x in df.select("role").distinct().collect()}
    assert minhash.HOME in roles or minhash.HOME_ASKS in roles  # members have met in cells


def test_linked_pairs_are_in_reach_or_share_a_rare_shingle(spark, monkeypatch):
    monkeypatch.setattr(minhash, "RARE", 12)
    r = random.Random(3)
    words = [f"v{i}" for i in range(40)]
    base = [f"b{i}" for i in range(80)]
    families = [mutated(r, words, base[: r.randint(60, 80)], 0.15 if i % 2 else 0.01) for i in range(12)]
    texts = [" ".join(mutated(r, words, t, 0.02)) for t in families for _ in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    minhash.bounded_batches(spark)
    signed = docs.withColumnRenamed("key", "doc_id").mapInArrow(minhash._sign(2), "doc_id long, n long, key long, bands array<long>, sig binary")
    keys = {x.doc_id: x.key for x in signed.collect()}
    sets = docs.join(signed.select(signed.doc_id.alias("id"), signed.key.alias("k")), docs.key == minhash.F.col("id")).select(minhash.F.col("k").alias("key"), "text").mapInArrow(minhash._sets(2), "key long, items binary").distinct()
    told = {x.key: x for x in minhash._common_and_rare(sets, 80).collect()}
    s = sets_of([(i, t) for i, t in enumerate(texts)], 2)
    met = {True: 0, False: 0}
    for a, b in combinations(s, 2):
        if keys[a] != keys[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
            x, y = told[keys[a]], told[keys[b]]
            reach = 180 * min(x.common, y.common) >= 80 * (len(s[a]) + len(s[b]))
            assert reach or set(x.rare) & set(y.rare)
            met[reach] += 1
    assert all(met.values()), met


def test_later_rounds_read_only_what_is_open(spark, written):
    r = random.Random(4)
    words = [f"w{i}" for i in range(20000)]
    base = r.sample(words, 120)
    near = [(i, " ".join(mutated(r, words, base, r.uniform(0, 0.07)))) for i in range(150)]
    alone = [(i, " ".join(r.sample(words, 120))) for i in range(1000, 1400)]
    got = minhash.near_duplicates(spark.createDataFrame(near + alone, "doc_id long, text string").repartition(3), k=2).collect()
    assert len(got) == 550 and len({x.component_id for x in got}) > 401 and all(x.kept for x in got if x.doc_id >= 1000)
    names = [name for name, _ in written]
    assert "top" in names and names.count("components") == 1  # later rounds name the components that they touch
    dealt = [df for name, df in written if name in ("shared", "mixed", "renamed", "cells", "left")]
    assert dealt and all(df.select("key").distinct().count() <= 150 for df in dealt), names  # no rows of buckets with one member
