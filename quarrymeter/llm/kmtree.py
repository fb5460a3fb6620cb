"""Nearest neighbours by largest inner product in a hierarchical k-means tree (operator 11).

The tree is fitted on a bounded sample: nodes are cut by k-means into ``BRANCH``
children until they hold at most ``LEAF`` sampled vectors. Every row of the table
is indexed: it goes down to the child of the nearest centre, to one leaf.

A query walks the tree best bin first: a priority queue holds nodes under the
bound q.centre + slack * |q| * spread, the best one is taken, and either its
children are queued or, at a leaf, it is visited. How many leaves are visited is
calibrated: ``CALIBRATION`` queries are answered by brute force over all rows, and
visits are widened, for each of a few slacks, until ``TARGET`` of their true
neighbours lie in visited leaves; the slack that reads the fewest rows is taken.

Leaves are dealt to tasks in bins of some ``BLOCK`` vectors; a larger leaf is
split into blocks, and the queries of a bin into parts of some ``ASKS``, so a task
never holds more. Visits widen in rounds, after ``ROUNDS`` leaves each: what a
query has found so far is its floor, the score that a neighbour in further leaves
must reach, so that little is sent on. A block answers a query with one list.

Exact copies are folded: the k + 1 smallest ids of a vector stand for all its
rows, since no list needs more, and equal queries are searched once.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components, and rows with a null id, take no part; vectors of other lengths are
never neighbours; a query isn't its own neighbour, but other rows are, also with
its vector or its id; rows that repeat both id and vector count once; equal scores go to the
smaller id; fewer candidates than k give fewer ranks; an empty table, or none
besides a query, gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Table, bounded_batches, unskewed

SAMPLE, SAMPLE_NUMBERS = 32_768, 1 << 22  # rows, and components in all, on which trees are fitted
BRANCH, LEAF, STEPS = 8, 32, 8
CALIBRATION, TARGET, SLACKS = 256, 0.95, (1.0, 3.0, 5.0, 8.0)
BLOCK, ASKS, ROUNDS, CHUNK = 2048, 16_384, (8, 128), 512


# -------------------------------------------------------------------- tree
@dataclass
class Tree:
    """Nodes in depth-first order, so that leaves of one parent are neighbours."""

    centres: np.ndarray  # nodes x length
    spread: np.ndarray  # standard deviation of a component inside each node
    children: list[list[int]]
    leaf: np.ndarray  # number of the leaf, -1 for inner nodes
    slack: float = SLACKS[0]
    visits: int = 1 << 30

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def route(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every vector."""
        out = np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if not self.children[node]:
                out[rows] = self.leaf[node]
                continue
            kids = self.children[node]
            to = nearest(x[rows], self.centres[kids])
            todo += [(kid, rows[to == j]) for j, kid in enumerate(kids)]
        return out

    def order(self, q: np.ndarray, visits: int, slack: float) -> np.ndarray:
        """(queries x visits) leaves in the order of their visits."""
        bound = q @ self.centres.T + slack * np.linalg.norm(q, axis=1)[:, None] * self.spread
        visits = min(visits, self.leaves)
        out = np.empty((len(q), visits), np.int32)
        for i, row in enumerate(bound):
            key = (-row).tolist()
            queue = [(key[0], 0)]
            found = 0
            while found < visits:
                _, node = heapq.heappop(queue)
                if kids := self.children[node]:
                    for kid in kids:
                        heapq.heappush(queue, (key[kid], kid))
                else:
                    out[i, found] = self.leaf[node]
                    found += 1
        return out


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centres.T - 0.5 * (centres * centres).sum(1), axis=1)


def k_means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Cluster of every row."""
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(STEPS):
        to = nearest(x, centres)
        for j in range(k):
            own = to == j
            if own.any():
                centres[j] = x[own].mean(0)
    return nearest(x, centres)


def fit_tree(x: np.ndarray, branch: int = BRANCH, leaf: int = LEAF) -> Tree:
    """Hierarchical k-means over the rows of x."""
    rng = np.random.default_rng(11)
    centres, spread, children = [], [], []

    def grow(rows: np.ndarray) -> int:
        node = len(centres)
        own = x[rows]
        centres.append(own.mean(0))
        spread.append(float(np.sqrt(own.var(0).mean())))
        children.append([])
        if len(rows) > leaf:
            to = k_means(own, min(branch, len(rows)), rng)
            parts = [rows[to == j] for j in np.unique(to)]
            if len(parts) > 1:
                children[node] = [grow(p) for p in parts]
        return node

    grow(np.arange(len(x)))
    ends = np.array([not c for c in children])
    return Tree(np.array(centres), np.array(spread), children, np.where(ends, np.cumsum(ends) - 1, -1))


def single_leaf(d: int) -> Tree:
    """For a length that the sample doesn't hold."""
    return Tree(np.zeros((1, d)), np.zeros(1), [[]], np.zeros(1, np.int64))


def matrices(batch: pa.RecordBatch | pa.Table, column: str = "vector") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, vectors as doubles) for each length of a list column without nulls."""
    col = batch.column(column)
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    start = col.offsets.to_numpy()
    flat, size = col.values.to_numpy(zero_copy_only=False), np.diff(start)
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        yield at, np.stack([flat[start[i] : start[i] + d] for i in at]).astype(float)


# ------------------------------------------------------------------ search
def usable(v: Column) -> Column:
    return F.coalesce((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))


def _distinct(rows: DataFrame, k: int) -> DataFrame:
    """(rep, digest, vector, length, asks, ids): each vector once, with its k + 1 smallest ids."""
    one = rows.groupBy("digest").agg(F.first("vector").alias("vector"), F.max("asks").alias("asks"))
    rank = F.row_number().over(Window.partitionBy("digest").orderBy("vec_id"))
    low = rows.select("digest", "vec_id").distinct().withColumn("nth", rank).where(F.col("nth") <= k + 1)
    ids = low.groupBy("digest").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return one.join(ids, "digest").select(F.monotonically_increasing_id().alias("rep"), "digest", "vector", F.size("vector").alias("length"), "asks", "ids")


def _fit(reps: DataFrame) -> dict[int, Tree]:
    """A tree for each length in a sample of the vectors with the smallest digests."""
    widest = reps.agg(F.max("length")).first()[0] or 1
    sample = reps.orderBy("digest").limit(max(1, min(SAMPLE, SAMPLE_NUMBERS // widest))).select("vector").toArrow()  # bounded rows
    return {x.shape[1]: fit_tree(x) for _, x in matrices(sample)} if sample.num_rows else {}


def _index(reps: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    """Every row with its leaf."""
    held = reps.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = np.zeros(b.num_rows, np.int32)
            for at, x in matrices(b):
                tree = held.value.get(x.shape[1])
                leaf[at] = tree.route(x) if tree else 0
            yield b.append_column("leaf", pa.array(leaf))

    return reps.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in reps.dtypes) + ", leaf int")


def _truth(indexed: DataFrame, asked: list, k: int) -> dict[int, list]:
    """By brute force over all rows: for each query number [(score, rep, leaf, rows)] of its k + 1 best vectors."""
    spark = indexed.sparkSession
    by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for d in {len(r.vector) for r in asked}:
        at = [i for i, r in enumerate(asked) if len(r.vector) == d]
        by_length[d] = np.array(at), np.array([asked[i].vector for i in at], float)
    held = spark.sparkContext.broadcast(by_length)  # at most CALIBRATION queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}
        for b in batches:
            rest = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "leaf", "rows")], 1)
            for at, x in matrices(b):
                if x.shape[1] not in held.value:
                    continue
                number, q = held.value[x.shape[1]]
                s = q @ x.T
                for i, row in zip(number.tolist(), s, strict=True):
                    top = np.argsort(-row, kind="stable")[: k + 1]
                    new = np.column_stack([row[top], rest[at[top]]])
                    both = np.concatenate([best[i], new]) if i in best else new
                    best[i] = both[np.argsort(-both[:, 0], kind="stable")[: k + 1]]
        for i, rows in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), i, np.int32)), pa.array(rows[:, 0].copy()), *(pa.array(rows[:, j].astype(np.int64)) for j in (1, 2, 3))], ["q", "score", "rep", "leaf", "rows"])

    # rep, leaf and rows are carried as doubles, exact below 2**53
    told = indexed.select("rep", "leaf", F.size("ids").alias("rows"), "vector").mapInArrow(run, "q int, score double, rep long, leaf long, rows long")
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "rep"))
    out: dict[int, list] = {}
    for r in told.withColumn("nth", nth).where(F.col("nth") <= k + 1).collect():  # at most CALIBRATION * (k + 1) rows
        out.setdefault(r.q, []).append((r.score, r.rep, r.leaf, r.rows))
    return out


def calibrate(indexed: DataFrame, trees: dict[int, Tree], k: int, target: float = TARGET) -> dict[int, float]:
    """Set visits and slack of each tree; gives the recall by length that the calibration queries had."""
    asked = indexed.where("asks").orderBy(F.desc("digest")).limit(CALIBRATION).select("rep", "vector").collect()
    truth = _truth(indexed, asked, k) if asked else {}
    reached = {}
    for d, tree in trees.items():
        own = [i for i, r in enumerate(asked) if len(r.vector) == d and i in truth]
        if not own:
            continue
        q = np.array([asked[i].vector for i in own], float)
        plans = []
        for slack in SLACKS:
            place = np.empty((len(q), tree.leaves), np.int32)
            np.put_along_axis(place, tree.order(q, tree.leaves, slack), np.arange(tree.leaves, dtype=np.int32)[None], 1)
            hits = np.zeros(tree.leaves)
            for row, i in enumerate(own):
                left = k
                for _, rep, leaf, rows in sorted(truth[i], key=lambda t: (-t[0], t[1])):
                    n = min(left, rows - (rep == asked[i].rep))
                    hits[place[row, leaf]] += n
                    left -= n
            share = np.cumsum(hits) / max(hits.sum(), 1)
            visits = int(np.searchsorted(share, target - 1e-12)) + 1 if hits.sum() else tree.leaves
            plans.append((visits, slack, float(share[min(visits, tree.leaves) - 1])))
        tree.visits, tree.slack, reached[d] = min(plans)
    return reached


def _bins(indexed: DataFrame) -> tuple[dict[int, np.ndarray], DataFrame]:
    """Bin of each leaf by length, and (length, leaf, bin, blocks); at most as many rows as leaves."""
    count = indexed.groupBy("length", "leaf").count().collect()
    by_length: dict[int, dict[int, int]] = {}
    for r in count:
        by_length.setdefault(r.length, {})[r.leaf] = r["count"]
    rows, of = [], {}
    for d, sizes in by_length.items():
        bin_, held = 0, 0
        of[d] = np.full(max(sizes) + 1, -1, np.int32)
        for leaf in sorted(sizes):
            n = sizes[leaf]
            if held and held + n > BLOCK:
                bin_, held = bin_ + 1, 0
            of[d][leaf] = bin_
            rows.append([d, leaf, bin_, 1])
            held += n
            rows[-1][3] = -(-n // BLOCK)
    return of, indexed.sparkSession.createDataFrame(rows, "length int, leaf int, bin int, blocks int")


def _walk(asks: DataFrame, trees: dict[int, Tree], bins: dict[int, np.ndarray]) -> DataFrame:
    """(rep, length, bin, round, leaves): the leaves that each query visits in each round, by bin."""
    held = asks.sparkSession.sparkContext.broadcast((trees, bins))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, bins = held.value
        for b in batches:
            rep = b.column("rep").to_numpy()
            for at, x in matrices(b):
                d = x.shape[1]
                tree = trees.get(d) or single_leaf(d)
                for i in range(0, len(at), 64):
                    order = tree.order(x[i : i + 64], tree.visits, tree.slack)
                    q = np.repeat(rep[at[i : i + 64]], order.shape[1])
                    turn = np.tile(np.searchsorted(ROUNDS, np.arange(order.shape[1]), "right").astype(np.int32), len(order))
                    leaf = order.ravel()
                    ok = leaf < len(bins[d])
                    bin_ = np.where(ok, bins[d][np.where(ok, leaf, 0)], -1)
                    ok = bin_ >= 0  # leaves without rows
                    q, turn, leaf, bin_ = q[ok], turn[ok], leaf[ok], bin_[ok]
                    by = np.lexsort((leaf, turn, bin_, q))
                    q, turn, leaf, bin_ = q[by], turn[by], leaf[by], bin_[by]
                    cut = np.flatnonzero(np.r_[True, (q[1:] != q[:-1]) | (bin_[1:] != bin_[:-1]) | (turn[1:] != turn[:-1])]) if len(q) else np.zeros(0, np.int64)
                    ends = pa.array(np.append(cut, len(q)).astype(np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(q[cut]), pa.array(np.full(len(cut), d, np.int32)), pa.array(bin_[cut]), pa.array(turn[cut]), pa.ListArray.from_arrays(ends, pa.array(leaf))],
                        ["rep", "length", "bin", "round", "leaves"],
                    )

    return asks.select("rep", "vector").mapInArrow(run, "rep long, length int, bin int, round int, leaves array<int>")


#: far is the negative score, so that entries sort from the nearest on
NEAR = pa.struct([("far", pa.float64()), ("low", pa.int64()), ("cand", pa.int64()), ("ids", pa.list_(pa.int64()))])
FOUND = "q long, near array<struct<far: double, low: long, cand: long, ids: array<bigint>>>"


def _compare(k: int):
    """Best vectors of one block for each query of one part, in the leaves that it visits and not below its floor."""

    def run(key, asks: pa.Table, rows: pa.Table) -> pa.Table:
        none = pa.table({"q": pa.array([], pa.int64()), "near": pa.array([], pa.list_(NEAR))})
        if not asks.num_rows or not rows.num_rows:
            return none
        (_, x), (_, q) = next(matrices(rows)), next(matrices(asks))
        leaf = rows.column("leaf").to_numpy()
        names, at_leaf = np.unique(leaf, return_inverse=True)
        lists = asks.column("leaves").combine_chunks()
        asker = np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy()))
        wanted = lists.flatten().to_numpy()
        place = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
        there = names[place] == wanted
        visits = np.zeros((len(q), len(names)), bool)
        visits[asker[there], place[there]] = True
        floor = asks.column("floor").to_numpy()
        number, low = asks.column("rep").to_numpy(), rows.column("low").to_numpy()
        who, which, score = [], [], []
        for i in range(0, len(q), CHUNK):
            s = q[i : i + CHUNK] @ x.T
            near = 1e-12 * (1 + np.abs(s))
            s = np.where(visits[i : i + CHUNK][:, at_leaf] & (s >= floor[i : i + CHUNK, None] - near), s, -np.inf)
            if s.shape[1] > k + 1:
                last = np.partition(s, -(k + 1), axis=1)[:, -(k + 1), None]
                s = np.where(s >= last - near, s, -np.inf)
            a, b = np.nonzero(s > -np.inf)
            exact = np.concatenate([(q[i + a[j : j + 8192]] * x[b[j : j + 8192]]).sum(1) for j in range(0, len(a), 8192)]) if len(a) else np.zeros(0)
            by = np.lexsort((low[b], -exact, a))
            a, b, exact = a[by], b[by], exact[by]
            nth = np.arange(len(a)) - np.searchsorted(a, a)
            keep = nth <= k
            who.append(i + a[keep])
            which.append(b[keep])
            score.append(exact[keep])
        a, b = np.concatenate(who), np.concatenate(which)
        first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
        entries = pa.StructArray.from_arrays([pa.array(-np.concatenate(score)), pa.array(low[b]), pa.array(rows.column("rep").to_numpy()[b]), rows.column("ids").combine_chunks().take(pa.array(b))], fields=list(NEAR))
        return pa.table({"q": number[a[first]], "near": pa.ListArray.from_arrays(pa.array(np.append(first, len(a)).astype(np.int32)), entries)})

    return run


def _visit(asks: DataFrame, indexed: DataFrame, parts: DataFrame, k: int) -> DataFrame:
    """Compares queries (rep, vector, length, bin, leaves, floor) with the rows of the leaves that they visit."""
    count = asks.groupBy("length", "bin").agg(F.ceil(F.count("*") / ASKS).cast("int").alias("pieces"))  # as many rows as bins
    bins = F.broadcast(parts.groupBy("length", "bin").agg(F.max("blocks").alias("blocks")).join(count, ["length", "bin"]))
    split = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    left = asks.join(bins, ["length", "bin"]).withColumn("piece", dealt("pieces")).withColumn("block", split("blocks"))
    right = indexed.join(F.broadcast(parts), ["length", "leaf"]).drop("blocks").join(bins, ["length", "bin"]).withColumn("block", dealt("blocks")).withColumn("piece", split("pieces"))
    at = ["length", "bin", "block", "piece"]
    left = left.select(*at, "rep", "vector", "leaves", "floor")
    right = right.select(*at, "rep", "vector", "leaf", "ids", F.col("ids")[0].alias("low"))
    return left.groupBy(*at).cogroup(right.groupBy(*at)).applyInArrow(_compare(k), FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k + 1 nearest entries of each query in one sorted list."""
    return found.groupBy("q").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"))


def neighbours(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for every row of which ``is_query`` holds."""
    spark: SparkSession = vectors.sparkSession
    bounded_batches(spark)
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    v = F.col("vector")
    digest = F.concat_ws("-", F.hex(F.xxhash64(v)), F.hex(F.xxhash64(F.lit(7), v)))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(v)).withColumn("digest", digest)
    reps = Table(_distinct(rows, k), "tree-reps")
    trees = _fit(reps.df)
    indexed = Table(_index(reps.df, trees), "tree-index")
    reps.drop()
    calibrate(indexed.df, trees, k, target)
    bins, parts = _bins(indexed.df)
    # read apart from the rows that it is compared with, so that Spark can tell their columns apart
    asks = spark.read.schema(indexed.df.schema).parquet(indexed.path).where("asks").select("rep", "vector")
    walked = Table(_walk(asks, trees, bins), "tree-walks")
    here = indexed.df.select("rep", "length", "leaf", "vector", "ids")

    best = None
    for turn in range(len(ROUNDS) + 1):
        now = walked.df.where(F.col("round") == turn)
        reach = F.lit(None).cast("double")
        if best is not None:
            now = now.join(best.df.select(F.col("q").alias("rep"), F.try_element_at("near", F.lit(k + 1))["far"].alias("far")), "rep", "left")
            reach = -F.col("far")
        now = now.join(asks, "rep").withColumn("floor", F.coalesce(reach, F.lit(float("-inf"))))
        found = _visit(now, here, parts, k)
        best = Table(_best(found if best is None else best.df.unionByName(found), k), "tree-best")

    entry = F.flatten(F.transform("near", lambda e: F.transform(e["ids"], lambda i: F.struct(e["far"].alias("far"), i.alias("id"), e["cand"].alias("cand")))))
    lists = best.df.select("q", F.slice(F.sort_array(entry), 1, k + 1).alias("near"))
    named = indexed.df.where("asks").select("digest", F.col("rep").alias("q")).join(lists, "q").select("digest", "q", "near")
    asked = Table(rows.where("asks").select(F.col("vec_id").alias("query_id"), "digest").distinct(), "tree-queries")
    told = unskewed(asked.df, Table(named, "tree-named").df, "digest")
    others = F.slice(F.filter("near", lambda e: ~((e["cand"] == F.col("q")) & (e["id"] == F.col("query_id")))), 1, k)
    return told.select("query_id", F.posexplode(others).alias("nth", "e")).select("query_id", (F.col("nth") + 1).alias("rank"), F.col("e.id").alias("vec_id"), (-F.col("e.far")).alias("score"))
