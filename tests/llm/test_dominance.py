"""Dominance counting (12) against all pairs."""

import datetime
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymeter.llm import dominance


def brute(rows):
    """(n, w) of every (slot, level, weight) by comparing all pairs."""
    out = []
    for s, v, _ in rows:
        above = [w for t, u, w in rows if None not in (s, v, t, u) and t <= s and u > v]
        out.append((None, None) if None in (s, v) else (len(above), sum(above)))
    return out


@pytest.mark.parametrize("tied", [True, False])
@pytest.mark.parametrize("slots", [1, 3, 40, 5000])
def test_sweep_equals_pairs(slots, tied):
    r = np.random.default_rng(slots)
    slot, level, w = np.sort(r.integers(0, slots, 1500)), r.integers(-9, 30, 1500), r.integers(0, 5, (1500, 2))
    over = (level[:, None] > level[None]) & ((slot[:, None] <= slot[None]) if tied else (slot[:, None] < slot[None]))
    assert (dominance.sweep(slot, level, w, tied) == over.T @ w).all()


@pytest.mark.parametrize("per_task", [7, 60, 10**6])
def test_counts_equal_pairs(spark, per_task):
    r = random.Random(per_task)
    rows = [(r.choice((0, 0, 0, r.randint(-50, 50))), r.choice((5, r.randint(-99, 99))), r.randint(0, 3)) for _ in range(300)]
    rows += [(0, 5, 1)] * 150 + [(None, 3, 1), (2, None, 1), (None, None, 2)]
    df = spark.createDataFrame([(i, *x, "c") for i, x in enumerate(rows)], "part int, slot long, level long, n int, tie string").repartition(4)
    got = dominance.counts_above(df, F.col("slot"), F.col("level"), F.col("n"), per_task).select("row.part", "n_above", "w_above").collect()
    assert [(x.n_above, x.w_above) for x in sorted(got)] == brute(rows)


def test_one_slot_of_many_levels_is_spread(spark):
    df = spark.range(4000).select(F.lit(3).alias("s"), F.col("id").alias("v"))
    got = dominance.counts_above(df, F.col("s"), F.col("v"), F.lit(1), 300).select("level", "n_above").collect()
    assert {x.level: x.n_above for x in got} == {i: 3999 - i for i in range(4000)}


def test_sales_in_any_session_zone_with_odd_values(spark):
    at = datetime.datetime
    sales = [
        (1, at(2024, 1, 1, 0, 59, 59), 10.995, "x"), (2, at(2024, 1, 1, 1), 10.99, "x"), (3, at(1969, 12, 31, 23, 59, 59), 99.0, "x"), (3, at(1969, 12, 31, 23, 59, 59), 99.0, "x"),
        (4, None, 5.0, "x"), (5, at(2024, 1, 1, 1), None, "x"), (None, at(2024, 3, 31, 2, 30), -0.5, "x"), (6, at(2024, 5, 5), float("nan"), "x"), (7, at(2024, 5, 5), 1e17, "x"), (8, at(2024, 5, 5), float("inf"), "x"),
    ]
    levels = [None if v is None or not abs(v) < 1e300 else int(np.floor(np.floor(100 * v + 0.5) / 100)) for _, _, v, _ in sales]
    hours = [None if t is None else int((t - at(1970, 1, 1)).total_seconds() // 3600) for _, t, _, _ in sales]
    weight = [1 if i is None else 1 + zlib.crc32(str(i).encode()) % 2 for i, *_ in sales]
    expect = sorted(((i, h, v, *c) for (i, *_), h, v, c in zip(sales, hours, levels, brute(list(zip(hours, levels, weight, strict=True))), strict=True)), key=str)
    df = spark.createDataFrame(sales, "sale_id long, sold_at timestamp_ntz, total double, slot string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "America/New_York", "Europe/Berlin"):
            spark.conf.set("spark.sql.session.timeZone", z)
            assert sorted((tuple(r) for r in dominance.sales_above(df, 3).collect()), key=str) == expect
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_no_sales(spark):
    df = spark.createDataFrame([], "sale_id long, sold_at timestamp_ntz, total double")
    assert dominance.sales_above(df).collect() == []
