"""Benchmark decontamination by size-partitioned MinHash containment (operator 5).

Texts are words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; an item is the set
of its shingles of five words (fewer where the item has fewer words). Items are
partitioned by size. Those of at most ``SMALLEST`` shingles are found exactly:
containment allows an item of n shingles to miss m, so one of any m + 1 of its
shingles is in the document, and every shingle of a document is looked up among
those. Above, class s holds the items with at most s shingles and more
than s/2. For class s a document is cut into windows of 2s shingles, one every
s shingles, so items are compared with pieces of their own size however
long the document is. Item and windows get MinHash values under the same
permutations; one equal value makes (document, item) a candidate. Containment
of at least 0.8 spread over any windows is missed with a probability of some
1e-4 at most, and of 1e-6 where it lies together. Candidates are verified by exact
containment: shared shingles over the item's shingles, on the whole document.

The items' sets are broadcast in groups of a checked size: a benchmark above
``GROUP_SHINGLES`` shingles is searched in several passes.

Defined cases: null and empty items or documents match nothing; repeated items
with one id are merged into one set of shingles, and null item ids match
nothing; repeated documents each get their rows, and documents that share an id
are compared each on its own; a very long document is compared whole; containment
at exactly the threshold counts; other columns are not read, whatever their names
(``keep_clean`` leaves them as they are); an empty benchmark gives an empty
result, and so do no documents.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, bounded_batches, on_release, pieces, runs_hash, unique_per_doc, words_of, working

SHINGLE = 5
THRESHOLD = 0.8
PERMUTATIONS = 32
SMALLEST = 8
GROUP_SHINGLES = 4_000_000
_rng = np.random.default_rng(51)
_MUL = _rng.integers(0, 2**62, PERMUTATIONS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles inside documents, in order, and their documents."""
    h, doc = runs_hash(words.hash, k), words.doc_of()
    if not len(h):
        return h, np.zeros(0, np.int64)
    inside = doc[: len(h)] == doc[k - 1 :]
    return h[inside] + np.uint64(k), doc[: len(h)][inside]


def needed(n: int, threshold: float) -> int:
    """Shared shingles that an item of n shingles needs, one at least."""
    return max(1, math.ceil(threshold * n - 1e-9))


class Index:
    """A group of items, by shingle length: shingles of small ones, and MinHash values of others by size class."""

    def __init__(self, items: list[tuple[int, np.ndarray, int]], threshold: float = THRESHOLD):
        # items: (item id, sorted shingle hashes, shingle length)
        self.items, self.threshold = items, threshold
        self.parts: dict[int, list[int]] = {}
        for i, (item, _, _) in enumerate(items):
            self.parts.setdefault(item, []).append(i)
        self.groups: dict[tuple[int, int], list[int]] = {}
        small: dict[int, list[tuple[int, int]]] = {}
        for i, (_, s, k) in enumerate(items):
            if len(s) <= SMALLEST:
                small.setdefault(k, []).extend((h, i) for h in s[: len(s) - needed(len(s), threshold) + 1])
                continue
            c = 2 * SMALLEST
            while c < len(s):
                c *= 2
            self.groups.setdefault((k, c), []).append(i)
        self.small = {}
        for k, rows in small.items():
            rows.sort()
            keys, first = np.unique(np.array([h for h, _ in rows], np.uint64), return_index=True)
            self.small[k] = keys, np.append(first, len(rows)), np.array([i for _, i in rows])
        self.tables = {}
        for key, members in self.groups.items():
            mins = np.array([[(items[i][1] * m).min() for i in members] for m in _MUL])
            order = mins.argsort(1)
            self.tables[key] = [(row[o], np.array(members)[o]) for row, o in zip(mins, order, strict=True)]

    def candidates(self, words: Words) -> set[tuple[int, int]]:
        """(document, item) pairs with a looked-up shingle, or with an equal MinHash value in some window."""
        found: set[tuple[int, int]] = set()
        for k in {*self.small, *(key[0] for key in self.tables)}:
            h, doc = shingles(words, k)
            if not len(h):
                continue
            if k in self.small:
                keys, first, who = self.small[k]
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = np.flatnonzero(keys[at] == h)
                for pair in np.unique(doc[hit] * len(keys) + at[hit]):
                    d, j = divmod(int(pair), len(keys))
                    found.update((d, int(i)) for i in who[first[j] : first[j + 1]])
            classes = sorted(c for kk, c in self.tables if kk == k)
            if not classes:
                continue
            start = np.searchsorted(doc, np.arange(len(words.doc) - 1))
            place = np.arange(len(h)) - start[doc]
            block = np.flatnonzero(place % classes[0] == 0)
            owner = doc[block]
            for p, mul in enumerate(_MUL):
                low = np.minimum.reduceat(h * mul, block)
                size, own = classes[0], owner
                for c in classes:
                    while size < c:
                        # join neighbouring blocks of a document, two and two
                        n = np.arange(len(own)) - np.searchsorted(own, own)
                        head = np.flatnonzero(n % 2 == 0)
                        low, own, size = np.minimum.reduceat(low, head), own[head], size * 2
                    window = low.copy()
                    same = own[1:] == own[:-1]
                    window[:-1] = np.where(same, np.minimum(low[:-1], low[1:]), low[:-1])
                    keys, who = self.tables[k, c][p]
                    at = np.searchsorted(keys, window)
                    hit = np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == window)
                    for w in hit:
                        j = at[w]
                        while j < len(keys) and keys[j] == window[w]:
                            found.add((int(own[w]), int(who[j])))
                            j += 1
        return found

    def matches(self, words: Words) -> list[tuple[int, int, int, int]]:
        """(document, item id, shared, item shingles) of the verified pairs, one for each document and item.

        An item whose texts give shingles of several lengths is one set: what is
        shared is added up over the lengths. Containment of the whole means
        that of one length at least, so candidates of any length will do.
        """
        found = sorted({(d, self.items[i][0]) for d, i in self.candidates(words)})
        out, sets = [], {}
        for d, item in found:
            shared = total = 0
            for i in self.parts[item]:
                _, s, k = self.items[i]
                if (d, k) not in sets:
                    if len(sets) > 64:
                        sets.clear()
                    h = words.hash[words.doc[d] : words.doc[d + 1]]
                    sets[d, k] = np.unique(runs_hash(h, k) + np.uint64(k))
                shared += int(np.isin(s, sets[d, k], assume_unique=True).sum())
                total += len(s)
            if shared >= needed(total, self.threshold):
                out.append((d, item, shared, total))
        return out


_indexes: dict[tuple[str, float], Index] = {}
on_release("decontaminate", _indexes.clear)


def _index(name: str, held, threshold: float) -> Index:
    """The index of a broadcast group of items, made once for each Python worker."""
    working("decontaminate")
    if (name, threshold) not in _indexes:
        if len(_indexes) > 1:
            _indexes.clear()
        _indexes[name, threshold] = Index(held.value, threshold)
    return _indexes[name, threshold]


def _item_sets(rows: list[tuple[int, str]]) -> list[tuple[int, np.ndarray, int]]:
    by_id: dict[int, list[str]] = {}
    for i, t in rows:
        if i is not None and t:
            by_id.setdefault(i, []).append(t)
    out = []
    for i, texts in sorted(by_id.items()):
        for k in range(1, SHINGLE + 1):
            own = [t for t in texts if min(SHINGLE, len(t.encode().split())) == k]
            if own:
                h, d = shingles(words_of(pa.array(own), True), k)
                out.append((i, unique_per_doc(h, np.zeros(len(h), np.int64))[0], k))
    return out


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles) of all pairs with enough containment."""
    spark = docs.sparkSession
    bounded_batches(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.size(F.split("text", r"[ \t-\r]+")))).first()[0] or 0
    n_groups = max(1, -(-total // GROUP_SHINGLES))
    out = None
    for g in range(n_groups):
        rows = items if n_groups == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(n_groups)) == g)
        held = spark.sparkContext.broadcast(_item_sets([(r.item_id, r.text) for r in rows.toLocalIterator()]))  # about GROUP_SHINGLES at most

        def run(batches, held=held, name=uuid.uuid4().hex):
            index = _index(name, held, threshold)
            for batch in batches:
                for b in pieces(batch):
                    ids = b.column("doc_id")
                    got = index.matches(words_of(b.column("text"), True)) if index.items else []
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array([m[0] for m in got], pa.int64())), pa.array([m[1] for m in got], pa.int64()), pa.array([m[2] for m in got], pa.int64()), pa.array([m[3] for m in got], pa.int64())], ["doc_id", "item_id", "shared", "item_shingles"])

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, item_id long, shared long, item_shingles long")
        out = part if out is None else out.unionByName(part)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that contain no benchmark item; one pass for a benchmark of usual size."""
    spark = docs.sparkSession
    bounded_batches(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.size(F.split("text", r"[ \t-\r]+")))).first()[0] or 0
    n_groups = max(1, -(-total // GROUP_SHINGLES))
    for g in range(n_groups):
        rows = items if n_groups == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(n_groups)) == g)
        held = spark.sparkContext.broadcast(_item_sets([(r.item_id, r.text) for r in rows.toLocalIterator()]))

        def run(batches, held=held, name=uuid.uuid4().hex):
            index = _index(name, held, threshold)
            for batch in batches:
                for b in pieces(batch):
                    keep = np.ones(b.num_rows, bool)
                    if index.items:
                        keep[[m[0] for m in index.matches(words_of(b.column("text"), True))]] = False
                    yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
