"""Dominance counting: how many rows lie above each row (operator 12).

A row is above another if its slot is smaller or equal and its level strictly
larger. In the order (slot up, level down) the rows above a row are exactly the
earlier ones of a larger level, ties of slot included, which is what lets even a
single slot, with any share of the rows, be cut into partitions.

1. Range partitions by (slot, level down, hash), of at most some ``ROWS`` rows.
   Each is swept with a Fenwick tree over its own compressed levels; the rows of a
   slot are inserted together before they ask. This counts pairs inside a partition.
2. Each partition has a histogram (partition, level) of rows. Histograms are range
   partitioned by level into stripes, and a stripe is swept in the order of partitions
   with the same tree, asking before inserting. This counts rows of earlier
   partitions whose level lies in the same stripe.
3. What is left are rows of earlier partitions in higher stripes: suffixes of the level
   histograms, over a grid of partitions x stripes. A distributed scan takes running
   sums along the partitions for each stripe, and then down the stripes for each partition.

Every step works on Spark partitions; nothing goes to the driver but the number of
rows and of partitions, nothing is broadcast, and no task sees more than its
range. The grid has (rows / ``ROWS``) squared cells, 1e8 for 1e10 rows.

Defined cases: rows with a null slot or level are above none and their counts are
null; equal slots count as below or above by level alone; equal levels never
count; repeated rows, and rows that share an id, are rows each; a null weight counts as 0;
an empty table gives an empty result; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Table, bounded_batches

ROWS = 1_000_000  # of a range partition
CHUNK = 512  # rows of small slots that ask together


class Fenwick:
    """Running sums by compressed level, for several weights at once; levels are 0 to ``n`` - 1."""

    def __init__(self, n: int, weights: int):
        self.n = n
        self.tree = np.zeros((n + 1, weights), np.int64)
        self.total = np.zeros(weights, np.int64)

    def add(self, level: np.ndarray, weight: np.ndarray) -> None:
        at, w = level + 1, weight
        self.total += weight.sum(0)
        while len(at):
            np.add.at(self.tree, at, w)
            at = at + (at & -at)
            ok = at <= self.n
            at, w = at[ok], w[ok]

    def above(self, level: np.ndarray) -> np.ndarray:
        """Sums over strictly larger levels."""
        out = np.tile(self.total, (len(level), 1))
        at, who = level + 1, np.arange(len(level))
        while len(at):
            out[who] -= self.tree[at]
            at = at - (at & -at)
            ok = at > 0
            at, who = at[ok], who[ok]
        return out


def sweep(slot: np.ndarray, level: np.ndarray, weight: np.ndarray, tied: bool) -> np.ndarray:
    """For rows sorted by slot: sums of the weights of rows of a larger level and a smaller slot, or with ``tied`` an equal one too.

    Rows of a slot ask as one batch. Batches of small slots are put together up to
    CHUNK rows, and the pairs inside such a chunk are compared directly.
    """
    names, at = np.unique(level, return_inverse=True)
    tree = Fenwick(len(names), weight.shape[1])
    out = np.zeros(weight.shape, np.int64)
    ends = np.append(np.flatnonzero(np.diff(slot)) + 1, len(slot)) if len(slot) else np.zeros(0, np.int64)
    lo = k = 0
    while k < len(ends):
        last = max(k, int(np.searchsorted(ends, lo + CHUNK, "right")) - 1)
        hi = int(ends[last])
        rows = slice(lo, hi)
        if last == k:  # one slot
            if tied:
                tree.add(at[rows], weight[rows])
            out[rows] = tree.above(at[rows])
            if not tied:
                tree.add(at[rows], weight[rows])
        else:
            s, a = slot[rows], at[rows]
            over = (a[:, None] > a[None]) & ((s[:, None] <= s[None]) if tied else (s[:, None] < s[None]))
            out[rows] = tree.above(a) + over.T.astype(np.int64) @ weight[rows]
            tree.add(a, weight[rows])
        lo, k = hi, last + 1
    return out


def _swept(rows: DataFrame, slot: str, names: list[str], tied: bool) -> DataFrame:
    """The columns ``names`` of partitions sorted by ``slot``, and n_in and w_in: sums of n and w in the sweep of the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        weight = np.stack([t.column(c).to_numpy() for c in ("n", "w")], 1)
        sums = sweep(t.column(slot).to_numpy(), t.column("level").to_numpy(), weight, tied)
        t = t.select(names).append_column("n_in", pa.array(sums[:, 0])).append_column("w_in", pa.array(sums[:, 1]))
        yield from t.to_batches(max_chunksize=1 << 16)

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", n_in long, w_in long")


def counts_above(rows: DataFrame, slot: Column, level: Column, weight: Column, rows_per_task: int = ROWS) -> DataFrame:
    """(row, slot, level, n_above, w_above): each input row as a struct, the rows above it and the sum of their weights.

    slot, level and weight are columns of whole numbers.
    """
    spark = rows.sparkSession
    bounded_batches(spark, records=1 << 14)
    row = F.struct(*(F.col(f"`{c}`") for c in rows.columns))
    all_rows = rows.select(row.alias("row"), slot.cast("long").alias("slot"), level.cast("long").alias("level"), F.coalesce(weight.cast("long"), F.lit(0)).alias("w"))
    known = F.col("slot").isNotNull() & F.col("level").isNotNull()
    some = all_rows.where(known).withColumn("n", F.lit(1).cast("long"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-some.count() // rows_per_task))

    # 1: inside partitions; rows of one slot and level are spread by their place in the input
    ranged = some.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, "slot", F.desc("level"), "tie")
    ranged = ranged.sortWithinPartitions("slot").withColumn("part", F.spark_partition_id())
    inside = Table(_swept(ranged, "slot", ["row", "slot", "level", "w", "part"], tied=True), "above-inside")

    # 2: earlier partitions, same stripe of levels
    bars = inside.df.groupBy("part", "level").agg(F.count("*").alias("n"), F.sum("w").alias("w"))
    striped = bars.repartitionByRange(parts, "level").sortWithinPartitions("part").withColumn("stripe", F.spark_partition_id())
    same = Table(_swept(striped, "part", ["part", "level", "stripe", "n", "w"], tied=False), "above-stripes")

    # 3: earlier partitions, higher stripes
    cells = same.df.groupBy("part", "stripe").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    wide, high = (x or 0 for x in same.df.agg(F.max("part") + 1, F.max("stripe") + 1).first())
    grid = spark.range(wide * high).select((F.col("id") % max(wide, 1)).cast("int").alias("part"), F.floor(F.col("id") / max(wide, 1)).cast("int").alias("stripe"))
    grid = grid.join(cells, ["part", "stripe"], "left")
    before = Window.partitionBy("stripe").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    higher = Window.partitionBy("part").orderBy(F.desc("stripe")).rowsBetween(Window.unboundedPreceding, -1)
    for over in (before, higher):
        grid = grid.select("part", "stripe", *(F.coalesce(F.sum(c).over(over), F.lit(0)).alias(c) for c in "nw"))

    up = grid.select("part", "stripe", F.col("n").alias("n_up"), F.col("w").alias("w_up"))
    earlier = same.df.join(up, ["part", "stripe"]).select("part", "level", (F.col("n_in") + F.col("n_up")).alias("n_out"), (F.col("w_in") + F.col("w_up")).alias("w_out"))
    counted = inside.df.join(earlier, ["part", "level"]).select("row", "slot", "level", (F.col("n_in") + F.col("n_out")).alias("n_above"), (F.col("w_in") + F.col("w_out")).alias("w_above"))
    none = F.lit(None).cast("long")
    return counted.unionByName(all_rows.where(~known).select("row", "slot", "level", none.alias("n_above"), none.alias("w_above")))


def hour_slot(ts: Column, kind: str) -> Column:
    """Hours since 1970 of a timestamp, taken as UTC in any session zone; kind: its type."""
    if kind == "timestamp":
        return F.floor(F.unix_seconds(ts) / F.lit(3600))
    local = ts.cast("timestamp_ntz")
    return F.unix_date(local.cast("date")).cast("long") * 24 + F.hour(local)


def unit_level(total: Column) -> Column:
    """floor(floor(100 * total + 0.5) / 100) in double arithmetic; null where total isn't finite."""
    cents = total * 100 + 0.5
    whole = F.when(F.abs(total) < 1e13, F.floor(cents).cast("double")).otherwise(cents)  # larger doubles are whole
    return F.when(F.abs(total) < float("inf"), F.floor(whole / 100))


def sales_above(sales: DataFrame, rows_per_task: int = ROWS) -> DataFrame:
    """(sale_id, slot, level, n_sales, n_rows) of every sale; a sale without an id stands for one row."""
    weight = F.coalesce(F.crc32(F.col("sale_id").cast("string").cast("binary")) % 2, F.lit(0)) + 1
    slot = hour_slot(F.col("sold_at"), dict(sales.dtypes)["sold_at"])
    got = counts_above(sales.select("sale_id", "sold_at", "total"), slot, unit_level(F.col("total").cast("double")), weight, rows_per_task)
    return got.select("row.sale_id", "slot", "level", F.col("n_above").alias("n_sales"), F.col("w_above").alias("n_rows"))
