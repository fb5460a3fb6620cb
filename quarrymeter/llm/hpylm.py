"""Hierarchical Pitman-Yor language model over words (operator 4).

Every word is a restaurant whose customers are the words that follow it; all
restaurants share one parent, a Pitman-Yor process over the vocabulary with a
uniform base. Tables of a restaurant are the customers of the parent.

Where things are computed. A slice of documents becomes sorted lists of its
distinct word pairs with the documents that hold them, cut into buckets by
context and shuffled once. A bucket adds up its pairs, keeps its seating in a
file of the shared folder, and reports its words; word parts add those up, sit
the parent's customers and answer with the global figures of each word. A round
is some sweeps of the buckets' restaurants and one such exchange, so the seating
itself is never shuffled. Predictive probabilities are averaged over the kept
rounds. Last, the slices are made again, a bucket scores its pairs, and returns
sums for documents, packed by slice. The driver sees a few sums and the figures
of at most ``HEAVY`` contexts.

Sampling. The number of tables of a word in a restaurant is drawn from its
conditional given the others, (generalised Stirling number of its customers)
times (probability of so many new tables); seats within tables integrate out.
Above ``EXACT`` customers the tables are drawn customer by customer in blocks,
because the Stirling numbers' table grows with the square of the customers.
Words of one restaurant with equal numbers of customers are drawn together.
The parent's customers are the sampled tables of all restaurants. Its own tables
are drawn in the same way in each round, and the next sweeps work under a draw
of the parent's probabilities, given which the restaurants are independent; what
the parent leaves to its base is spread evenly. Scores use the parent's predictive
probabilities. Restaurants start with one table a word. Discounts come from counts
of counts.

Every draw is a function of its round, context and word alone, so scores don't
depend on the number of buckets or partitions, nor on which attempt of a task won.

Frequent contexts (found on a bounded sample of documents, by their share of the
corpus) are split over all
buckets by following word; their customers and tables are added up over the
buckets in every exchange and stand still within a round.

Defined cases: null and empty texts are one end token, a very long text is cut
into nothing smaller than itself; a null id counts as training and not held out;
repeated rows count as often as they occur and score equally; rows that share an
id get a row each; columns other than id and text are not read, whatever their
names; without training tokens scores are those of the uniform base; an empty
table gives an empty result.
"""

from __future__ import annotations

import gc
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, Table, bounded_batches, crc_mod, delete_path, mix, pieces, put_file, read_file, scratch_path, words_of

END, START = U64(0x1F0E4D2C3B5A6978), U64(0x5C6D7E8F90A1B2C3)
EXACT = 256
BURN, SAMPLES = 1, 3
FIRST_SWEEPS = 3
STRENGTH = 0.5
SLICE_BYTES = 8 << 20
BUCKET_CHARS = 12_000_000
HEAVY, HEAVY_SHARE, HEAVY_CHARS, HEAVY_SAMPLE = 1 << 16, 0.001, 3_000_000, 2000
_ZSTD = pa.Codec("zstd", 1)
MICRO, NANO = 1e7, 1e9  # log10 probabilities are added up as whole ten-millionths, and those of the base as billionths, so that sums are the same in any order
GRAIN = 1 << 12  # draws of the parent are kept as multiples of 1 / GRAIN, so that their sum is exact


def pairs_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(context, word, document) of all tokens of a slice, and tokens of each document."""
    w = words_of(text, True)
    n = w.counts + 1
    last = np.cumsum(n) - 1
    word = np.empty(int(n.sum()), U64)
    inner = np.ones(len(word), bool)
    inner[last] = False
    word[last], word[inner] = END, w.hash
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[last - n + 1] = START
    return context, word, np.repeat(np.arange(len(n)), n), n


def bucket_of(context: np.ndarray, word: np.ndarray, heavy: np.ndarray, buckets: int) -> np.ndarray:
    split = np.isin(context, heavy)
    return (np.where(split, mix(context ^ (word * U64(0xD1342543DE82EF95))), mix(context)) % U64(buckets)).astype(np.int64)


def squeeze(x: np.ndarray) -> bytes:
    """An array of small numbers, compressed; its width and length come first."""
    raw = x.tobytes()
    return bytes([x.itemsize]) + len(raw).to_bytes(7, "little") + _ZSTD.compress(raw, asbytes=True)


def unsqueeze(raw: pa.Buffer) -> np.ndarray:
    head = raw.slice(0, 8).to_pybytes()
    return np.frombuffer(_ZSTD.decompress(raw.slice(8), int.from_bytes(head[1:], "little"), asbytes=True), f"u{head[0]}")


def _small(x: np.ndarray) -> np.ndarray:
    """Counts in the narrowest type that holds the largest."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def ordered(part: np.ndarray, word: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """The columns sorted by bucket, context, word and document.

    The context of a word is the one before it, or START. Contexts and words come as
    ranks, with the hashes of the ranks last, so that a row is one whole number
    where it fits, and is sorted as such.
    """
    names, w = np.unique(word, return_inverse=True)
    names = np.insert(names, np.searchsorted(names, START), START)
    begin = int(np.searchsorted(names, START))
    w += w >= begin
    c = np.empty_like(w)
    c[1:] = w[:-1]
    c[np.flatnonzero(np.diff(doc, prepend=-1))] = begin
    n, d = len(names), int(doc.max(initial=0)) + 1
    left, right = part * n + c, w * d + doc
    if (int(part.max(initial=0)) + 1) * n * n * d < 2**62:
        both = left * (n * d) + right
        both.sort()
        left, right = np.divmod(both, n * d)
    else:
        order = np.lexsort((right, left))
        left, right = left[order], right[order]
    p, c = np.divmod(left, n)
    w, doc = np.divmod(right, d)
    return p, c, w, doc, names


def _slices(heavy: np.ndarray, buckets: int):
    def run(batches):
        part_id, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for b in pieces(batch, limit=SLICE_BYTES):
                context, word, doc, n = pairs_of(b.column("text"))
                train = b.column("train").to_numpy(zero_copy_only=False).astype(bool)
                part = bucket_of(context, word, heavy, buckets)
                p, c, w, d, names = ordered(part, word, doc)
                del part, context, word, doc
                same_pair = np.concatenate([[False], (p[1:] == p[:-1]) & (c[1:] == c[:-1]) & (w[1:] == w[:-1])])
                entry = np.flatnonzero(~(same_pair & np.concatenate([[False], d[1:] == d[:-1]])))
                times = np.diff(np.concatenate([entry, [len(d)]]))
                pair = np.flatnonzero(~same_pair[entry])
                held = np.diff(np.concatenate([pair, [len(entry)]]))
                at = entry[pair]
                new = np.flatnonzero(np.concatenate([[True], (c[at][1:] != c[at][:-1]) | (p[at][1:] != p[at][:-1])]))
                follow = np.diff(np.concatenate([new, [len(at)]]))
                name, number = (part_id << 32) + number, number + 1
                rows = {k: [] for k in ("bucket", "context", "follow", "vocab", "word", "held", "doc", "times")}
                low = np.searchsorted(p[at][new], np.arange(buckets + 1))
                small = np.uint16 if b.num_rows < 65536 else np.uint32
                for k in range(buckets):
                    if low[k] == low[k + 1]:
                        continue
                    cs = slice(low[k], low[k + 1])
                    ps = slice(new[low[k]], new[low[k + 1]] if low[k + 1] < len(new) else len(at))
                    es = slice(pair[ps.start], pair[ps.stop] if ps.stop < len(pair) else len(entry))
                    ranks = w[at[ps]]
                    own = np.unique(ranks)
                    rows["bucket"].append(k)
                    rows["context"].append(names[c[at[new[cs]]]].tobytes())
                    rows["follow"].append(squeeze(follow[cs].astype(np.uint32)))
                    rows["vocab"].append(names[own].tobytes())
                    rows["word"].append(squeeze(np.searchsorted(own, ranks).astype(np.uint16 if len(own) <= 65536 else np.uint32)))
                    rows["held"].append(squeeze(held[ps].astype(small)))
                    rows["doc"].append(squeeze(d[entry[es]].astype(small)))
                    rows["times"].append(squeeze(_small(times[es])))
                k = len(rows["bucket"])
                blob = lambda x: pa.array(x, pa.binary())
                # documents of the slice travel once, with its first bucket
                ids_col = pa.array([b.column("doc_id").to_pylist()] + [None] * (k - 1), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows["bucket"], pa.int32()), pa.array([name] * k, pa.int64()), *(blob(rows[x]) for x in ("context", "follow", "vocab", "word", "held", "doc", "times")), blob([np.packbits(train).tobytes()] * k), pa.array([b.num_rows] * k, pa.int32()), ids_col, blob([n.astype(np.uint32).tobytes()] + [None] * (k - 1))],
                    ["bucket", "slice", "context", "follow", "vocab", "word", "held", "doc", "times", "train", "n_docs", "ids", "tokens"],
                )

    return run


SLICE_SCHEMA = "bucket int, slice long, context binary, follow binary, vocab binary, word binary, held binary, doc binary, times binary, train binary, n_docs int, ids array<long>, tokens binary"


class Bucket:
    """The pairs of one bucket, added up over all slices."""

    def __init__(self, batches, docs: bool):
        self.rows = []
        ctx, word, count = [], [], []
        for b in batches:
            for i in range(b.num_rows):
                get = lambda n, kind, b=b, i=i: np.frombuffer(b.column(n)[i].as_buffer(), kind)
                n_docs = b.column("n_docs")[i].as_py()
                squeezed = lambda n, b=b, i=i: unsqueeze(b.column(n)[i].as_buffer())
                w = get("vocab", U64)[squeezed("word")]
                held, doc, times = squeezed("held").astype(np.int64), squeezed("doc"), squeezed("times")
                train = np.unpackbits(get("train", np.uint8))[:n_docs].astype(bool)
                ctx.append(np.repeat(get("context", U64), squeezed("follow")))
                word.append(w)
                count.append(np.add.reduceat(times * train[doc].astype(np.int64), np.cumsum(held) - held))
                if docs:
                    self.rows.append((b.column("slice")[i].as_py(), n_docs, held, doc, times, b.column("ids")[i].as_py(), get("tokens", np.uint32) if b.column("tokens")[i].is_valid else None))
        ctx, word, count = np.concatenate(ctx), np.concatenate(word), np.concatenate(count).astype(np.int64)
        _, first, self.back = np.unique(mix(ctx * U64(0x2545F4914F6CDD1D) + word), return_index=True, return_inverse=True)
        self.sizes = [len(r[2]) for r in self.rows]
        self.count = np.bincount(self.back, count, len(first)).astype(np.int64)
        self.words, self.word = np.unique(word[first], return_inverse=True)
        self.contexts, self.context = np.unique(ctx[first], return_inverse=True)


def _word_part(words: np.ndarray, parts: int) -> np.ndarray:
    return (mix(words + U64(3)) % U64(parts)).astype(np.int64)


def _pack(x: np.ndarray) -> bytes:
    """Counts in the fewest bytes that hold the largest."""
    return _small(x).tobytes()


def _unpack(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"u{max(1, len(raw) // max(1, n))}").astype(np.int64)


# ------------------------------------------------------------------- draws
def uniform(key: np.ndarray, *salt: int) -> np.ndarray:
    """A number in (0, 1) for each key, the same for the same key and salt."""
    x = key
    for s in salt:
        x = mix(x + U64(0x9E3779B97F4A7C15 * (s + 1) & 0xFFFFFFFFFFFFFFFF))
    return ((x >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


def normal(key: np.ndarray, *salt: int) -> np.ndarray:
    return np.sqrt(-2 * np.log(uniform(key, *salt, 0))) * np.cos(2 * np.pi * uniform(key, *salt, 1))


def gamma(shape: np.ndarray, key: np.ndarray, salt: int) -> np.ndarray:
    """A gamma draw for each key (Marsaglia and Tsang; shapes below one by the power of a uniform)."""
    out = np.zeros(len(shape))
    left = np.flatnonzero(shape > 0)
    a = np.where(shape < 1, shape + 1, shape) - 1 / 3
    attempt = 0
    while len(left):
        d, k = a[left], key[left]
        x = normal(k, salt, 2 + attempt)
        v = np.maximum(1 + x / np.sqrt(9 * d), 1e-12) ** 3
        ok = np.log(uniform(k, salt, 500 + attempt)) < x * x / 2 + d - d * v + d * np.log(v)
        out[left[ok]] = (d * v)[ok]
        left = left[~ok]
        attempt += 1
    small = np.flatnonzero((shape > 0) & (shape < 1))
    out[small] *= uniform(key[small], salt, 999) ** (1 / shape[small])
    return out


def poisson(mean: np.ndarray, key: np.ndarray, *salt: int) -> np.ndarray:
    """By the cumulative sum up to a mean of 30, then by the normal of that mean."""
    out = np.maximum(0, np.rint(mean + np.sqrt(mean) * normal(key, *salt)))
    at = np.flatnonzero(mean < 30)
    u, p, k = uniform(key[at], *salt), np.exp(-mean[at]), 0
    total, got = p.copy(), np.zeros(len(at))
    while k < 120:
        more = u > total
        if not more.any():
            break
        got += more
        k += 1
        p = p * mean[at] / k
        total += p
    out[at] = got
    return out


@lru_cache(8)
def log_stirling(discount: float) -> np.ndarray:
    """log of generalised Stirling numbers, [customers, tables] up to EXACT."""
    out = np.full((EXACT + 1, EXACT + 2), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(1, EXACT + 1)
    with np.errstate(divide="ignore"):
        for c in range(1, EXACT):
            out[c + 1, 1:-1] = np.logaddexp(out[c, :-2], out[c, 1:-1] + np.log(np.maximum(c - t * discount, 0)))
    return out[:, :-1]


def seat(count: np.ndarray, context: np.ndarray, total: np.ndarray, still: np.ndarray, parent: np.ndarray, discount: float, strength: float, tables: np.ndarray, key: np.ndarray, *salt: int, told: np.ndarray | None = None) -> None:
    """One Gibbs sweep over the tables of each pair, in place.

    total: tables of each restaurant. still: restaurants whose total doesn't
    follow the sweep, because other buckets hold a part of it; what it holds of a
    pair is ``told``, the tables that the pair had in the last exchange. Pairs go by their
    number of customers, and small numbers in four lots by key; within such a
    group all see the same totals, whatever else the bucket holds.
    """
    total, told = total.astype(np.int64), tables.copy() if told is None else told
    move = ~still
    others = lambda e: total[context[e]] - np.where(still[context[e]], told[e], tables[e])
    order = np.argsort(count, kind="stable")
    cuts = np.searchsorted(count[order], np.arange(2, EXACT + 2))
    stirling = log_stirling(round(discount, 6))
    for c in range(2, EXACT + 1):
        every = order[cuts[c - 2] : cuts[c - 1]]
        if not len(every):
            continue
        lots = [every[(key[every] & U64(3)) == lot] for lot in range(4)] if c <= 8 else [every]
        for at in lots:
            new = np.empty(len(at), np.int64)
            wide = max(1, (1 << 19) // c)
            for i in range(0, len(at), wide):
                e = at[i : i + wide]
                rest = others(e)
                grow = np.log(np.maximum(strength + discount * (rest[:, None] + np.arange(c)), 1e-300)) + np.log(parent[e])[:, None]
                weight = np.cumsum(grow, 1) + stirling[c, 1 : c + 1]
                weight = np.cumsum(np.exp(weight - weight.max(1, keepdims=True)), 1)
                new[i : i + wide] = 1 + (weight[:, :-1] < (uniform(key[e], *salt) * weight[:, -1])[:, None]).sum(1)
            np.add.at(total, context[at], (new - tables[at]) * move[context[at]])
            tables[at] = new
    e = order[cuts[-1] :]
    if len(e):
        rest = others(e)
        new, done, block = np.ones(len(e)), np.ones(len(e)), 0
        while True:
            step = np.minimum(np.maximum(1, np.floor(done / 8)), count[e] - done)
            if not (step > 0).any():
                break
            open_ = (strength + discount * (rest + new)) * parent[e]
            p = open_ / (open_ + np.maximum(done + step / 2 - discount * new, 1e-9))
            new = np.minimum(new + np.minimum(poisson(step * p, key[e], *salt, block), step), count[e])
            done, block = done + step, block + 1
        tables[e] = new.astype(np.int64)


def gibbs(count: np.ndarray, context: np.ndarray, n_contexts: int, parent: np.ndarray, discount: float, strength: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean tables of each pair and of each restaurant over some samples, under one parent."""
    tables = (count > 0).astype(np.int64)
    mean, kept, key = np.zeros(len(count)), 8, mix(np.arange(len(count)).astype(U64))
    for number in range(kept + 4):
        seat(count, context, np.bincount(context, tables, n_contexts), np.zeros(n_contexts, bool), parent, discount, strength, tables, key, seed, number)
        if number >= 4:
            mean += tables / kept
    return mean, np.bincount(context, mean, n_contexts)


def _discount(n1: float, n2: float) -> float:
    return float(np.clip(n1 / (n1 + 2 * n2) if n1 + n2 else 0.5, 0.1, 0.95))


# ------------------------------------------------------------------ seating
@dataclass
class Figures:
    """Of the whole corpus after a round: a few numbers, and customers and tables of the split restaurants."""

    tokens: int
    types: int
    discount: float
    top: float
    customers: int  # of the parent
    tables: int  # of the parent
    drawn: int  # sum of the parent's draw, in GRAIN; 0: none yet
    rest: float  # what that draw leaves to the base, in GRAIN
    split: dict[int, tuple[int, int]]


class Seats:
    """Seating of the restaurants of one bucket: tables of each pair, and what is known of its words.

    Pairs are in ``order`` of those of ``Bucket``, by context and word, which packs well. p: sum of the predictive probabilities so far.
    """

    KEPT = ("words", "contexts", "word", "step", "count", "tables", "seen", "p")

    def __init__(self, k: Bucket):
        at = self.order(k)
        self.words, self.contexts, self.word, self.context, self.count = k.words, k.contexts, k.word[at], k.context[at], k.count[at]
        self.tables = (self.count > 0).astype(np.int64)
        self.seen = np.bincount(k.word, k.count, len(k.words)).astype(np.int64)
        self.c0, self.t0 = np.bincount(k.word, self.tables_of(k), len(k.words)).astype(np.int64), np.zeros(len(k.words), np.int64)
        self.drawn, self.p = None, None

    @staticmethod
    def tables_of(k: Bucket) -> np.ndarray:
        return (k.count > 0).astype(np.int64)

    @staticmethod
    def order(k: Bucket) -> np.ndarray:
        return np.lexsort((k.word, k.context))

    def write(self, path: str) -> None:
        """The state, as one file of the shared folder."""
        self.step = np.diff(self.context, prepend=0)
        out = {}
        for name in self.KEPT:
            x = getattr(self, name)
            if x is not None:
                small = x if name in ("words", "contexts") else x.astype(np.float32) if name == "p" else _small(x)
                raw = small.tobytes()
                out[name] = small.dtype.str, len(raw), _ZSTD.compress(raw, asbytes=True)
        put_file(path, pickle.dumps(out))

    @classmethod
    def read(cls, path: str, answers: list[dict], parts: int) -> Seats:
        """From the file of the last round and the answers to its reports."""
        self = cls.__new__(cls)
        stored = pickle.loads(read_file(path))
        for name in cls.KEPT:
            value = None
            if name in stored:
                kind, size, raw = stored.pop(name)
                value = np.frombuffer(_ZSTD.decompress(raw, size, asbytes=True), kind)
                if value.dtype.kind == "u" and name not in ("words", "contexts"):
                    value = value.astype(np.int64)
            setattr(self, name, value)
        self.context = np.cumsum(self.step)
        del self.step
        self.p = self.p.astype(float) if self.p is not None else None
        answers = sorted(answers, key=lambda r: r["part"])
        order = np.lexsort((self.words, _word_part(self.words, parts)))

        def told(name: str) -> np.ndarray:
            got = np.concatenate([_unpack(r[name], r["words_n"]) for r in answers])
            out = np.empty(len(order), got.dtype)
            out[order] = got
            return out

        self.c0, self.t0 = told("t"), told("t0")
        self.drawn = told("drawn") if answers[0]["drawn"] is not None else None
        if answers[0]["c"] is not None:
            self.seen = told("c")
        return self

    def split(self, now: Figures) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Customers and tables of each restaurant, and whether other buckets hold a part of it."""
        n = len(self.contexts)
        customers, tables, still = np.bincount(self.context, self.count, n), np.bincount(self.context, self.tables, n), np.zeros(n, bool)
        if now.split:
            names = np.array(sorted(now.split), np.int64).view(U64)
            for i in np.flatnonzero(np.isin(self.contexts, names)):
                customers[i], tables[i] = now.split[int(self.contexts[i : i + 1].view(np.int64)[0])]
                still[i] = True
        return customers, tables, still

    def parent(self, now: Figures) -> np.ndarray:
        """Predictive probability of each word in the parent."""
        return (np.maximum(self.c0 - now.top * self.t0, 0) + (STRENGTH + now.top * now.tables) / (now.types + 1)) / (STRENGTH + now.customers)

    def predict(self, now: Figures) -> np.ndarray:
        """Adds the predictive probabilities of this state to p."""
        customers, spread, _ = self.split(now)
        pw = self.parent(now)[self.word]
        c = customers[self.context]
        p = np.where(c > 0, (self.count - now.discount * self.tables + (STRENGTH + now.discount * spread[self.context]) * pw) / (STRENGTH + c), pw)
        self.p = p if self.p is None else self.p + p
        return self.p

    def sweep(self, now: Figures, number: int, times: int) -> None:
        """New tables of every pair with several customers, given the parent."""
        pw = self.parent(now) if self.drawn is None else (self.drawn + now.rest / (now.types + 1)) / (now.drawn + now.rest)
        _, total, still = self.split(now)
        at = np.flatnonzero(self.count > 1)
        context, word, tables = self.context[at], self.word[at], self.tables[at]
        told = tables.copy()
        key = mix(self.contexts[context] ^ (self.words[word] * U64(0xD1342543DE82EF95)))
        for i in range(times):
            before = tables.copy()
            seat(self.count[at], context, total, still, pw[word], now.discount, STRENGTH, tables, key, number, i, told=told)
            np.add.at(total, context, (tables - before) * ~still[context])
        self.tables = self.tables.copy()
        self.tables[at] = tables

    def reports(self, bucket: int, heavy: np.ndarray, parts: int, first: bool) -> Iterator[pa.RecordBatch]:
        """Reports of the bucket's words to their parts, and of split restaurants to the parts of their names."""
        t = np.bincount(self.word, self.tables, len(self.words)).astype(np.int64)
        part = _word_part(self.words, parts)
        order = np.lexsort((self.words, part))
        low = np.searchsorted(part[order], np.arange(parts + 1))
        n = len(self.contexts)
        total_c, total_t = (np.bincount(self.context, x, n).astype(np.int64) for x in (self.count, self.tables))
        out: dict[int, dict] = {}
        for p in np.flatnonzero(np.diff(low)):
            at = order[low[p] : low[p + 1]]
            out[int(p)] = {"bucket": bucket, "part": int(p), "words_n": len(at), "words": self.words[at].tobytes(), "c": _pack(self.seen[at]) if first else None, "t": _pack(t[at]), "t0": _pack(self.t0[at]), "split": []}
        mine = np.flatnonzero(np.isin(self.contexts, heavy))
        for i, p in zip(mine, _word_part(self.contexts[mine], parts), strict=True):
            row = out.setdefault(int(p), {"bucket": bucket, "part": int(p), "words_n": 0, "words": b"", "c": b"" if first else None, "t": b"", "t0": b"", "split": []})
            row["split"].append({"context": int(self.contexts[i : i + 1].view(np.int64)[0]), "c": int(total_c[i]), "t": int(total_t[i])})
        rows = list(out.values())
        rows[0] |= {"n1": int((self.count == 1).sum()), "n2": int((self.count == 2).sum())}
        kind = pa.schema([*((x, pa.int32()) for x in ("bucket", "part", "words_n")), *((x, pa.binary()) for x in ("words", "c", "t", "t0")), ("n1", pa.int64()), ("n2", pa.int64()), ("split", SPLIT)])
        for i in range(0, len(rows), 64):
            yield pa.RecordBatch.from_pylist(rows[i : i + 64], kind)


SPLIT = pa.list_(pa.struct([(x, pa.int64()) for x in ("context", "c", "t")]))
REPORT_SCHEMA = "bucket int, part int, words_n int, words binary, c binary, t binary, t0 binary, n1 long, n2 long, split array<struct<context:long,c:long,t:long>>"
SUMS = ("tokens", "types", "customers", "tops", "t1", "t2", "n1", "n2", "drawn_sum")
ANSWER_SCHEMA = "bucket int, part int, words_n int, c binary, t binary, t0 binary, drawn binary, split array<struct<context:long,c:long,t:long>>, " + ", ".join(f"{x} long" for x in SUMS)


def _start(heavy: np.ndarray, parts: int, folder: str):
    """First seating of a bucket: one table a word in each restaurant."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = key[0].as_py()
        k = Seats(Bucket(batches, False))
        k.write(f"{folder}/0/{bucket}")
        yield from k.reports(bucket, heavy, parts, True)

    return run


def _round(heavy: np.ndarray, parts: int, folder: str, now: Figures, number: int):
    """The sweeps of one round of a bucket; states after the first BURN rounds count."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = key[0].as_py()
        k = Seats.read(f"{folder}/{number - 1}/{bucket}", [r for b in batches for r in b.to_pylist()], parts)
        if number - 1 > BURN:
            k.predict(now)
        k.sweep(now, number, FIRST_SWEEPS if number == 1 else 1)
        k.write(f"{folder}/{number}/{bucket}")
        yield from k.reports(bucket, heavy, parts, False)

    return run


def _answer(now: Figures | None, number: int):
    """Global figures of the words of one part, for each bucket that asked; sums of the part."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["bucket"])
        words, back = np.unique(np.concatenate([np.frombuffer(r["words"], U64) for r in rows]), return_inverse=True)
        got = lambda x: np.concatenate([_unpack(r[x], r["words_n"]) for r in rows])
        sum_of = lambda x: np.bincount(back, got(x), len(words)).astype(np.int64)
        c = sum_of("c") if now is None else None
        t, drawn = sum_of("t"), None
        t0 = (t > 0).astype(np.int64)
        if now is not None:
            before = np.zeros(len(words), np.int64)
            before[back] = got("t0")
            t0 = np.where(t > 0, np.clip(before, 1, t), 0)
            seat(t, np.zeros(len(t), np.int64), np.array([now.tables]), np.ones(1, bool), np.full(len(t), 1 / (now.types + 1)), now.top, STRENGTH, t0, words, number, 7)
            drawn = np.rint(gamma(np.maximum(t - now.top * t0, 0), words, number) * GRAIN).astype(np.int64)
        split: dict[int, list[int]] = {}
        for s in (s for r in rows for s in r["split"]):
            own = split.setdefault(s["context"], [0, 0])
            own[0] += s["c"]
            own[1] += s["t"]
        cuts = np.cumsum([r["words_n"] for r in rows])
        sums = {"tokens": 0 if c is None else int(c.sum()), "types": int((t > 0).sum()), "customers": int(t.sum()), "tops": int(t0.sum()), "t1": int((t == 1).sum()), "t2": int((t == 2).sum()), "drawn_sum": 0 if drawn is None else int(drawn.sum())}
        sums |= {x: sum(r[x] or 0 for r in rows) for x in ("n1", "n2")}
        zero = {x: 0 for x in sums}
        first = {"split": [{"context": k, "c": v[0], "t": v[1]} for k, v in sorted(split.items())]} | sums
        out = []
        for r, end in zip(rows, cuts, strict=True):
            at = back[end - r["words_n"] : end]
            out.append({"bucket": r["bucket"], "part": key[0].as_py(), "words_n": r["words_n"], "c": None if c is None else _pack(c[at]), "t": _pack(t[at]), "t0": _pack(t0[at]), "drawn": None if drawn is None else _pack(drawn[at])} | (zero if out else first))
        kind = pa.schema([*((x, pa.int32()) for x in ("bucket", "part", "words_n")), *((x, pa.binary()) for x in ("c", "t", "t0", "drawn")), ("split", SPLIT), *((x, pa.int64()) for x in SUMS)])
        for i in range(0, len(out), 64):
            yield pa.RecordBatch.from_pylist(out[i : i + 64], kind)

    return run


def _score(parts: int, folder: str, now: Figures):
    """Sums of one bucket for the documents of each slice."""
    kind = pa.schema([("slice", pa.int64()), ("score", pa.binary()), ("base", pa.binary()), ("known", pa.binary()), ("ids", pa.list_(pa.int64())), ("tokens", pa.binary()), ("N", pa.int64())])

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        rows = right.to_pylist()
        if not left.num_rows or not rows:
            return kind.empty_table()
        k, seats = Bucket(left.to_batches(), True), Seats.read(f"{folder}/{BURN + SAMPLES}/{key[0].as_py()}", rows, parts)
        at = Seats.order(k)
        if not (np.array_equal(k.words, seats.words) and np.array_equal(k.word[at], seats.word) and np.array_equal(k.count[at], seats.count)):
            raise RuntimeError("documents changed between the passes")
        del left, right, rows
        value = np.empty(len(at))
        value[at] = np.rint(np.log10(np.maximum(seats.predict(now) / SAMPLES, 1e-300)) * -MICRO)
        N, V, wc = now.tokens, now.types, seats.seen
        base = np.rint(np.log10((wc + 0.5) / (N + 0.5 * (V + 1))) * -NANO)[k.word]
        known = (wc > 0)[k.word]
        del seats
        sums: dict[str, list] = {n: [] for n in ("slice", "score", "base", "known", "ids", "tokens", "N")}
        start = 0
        for (name, n_docs, held, doc, times, ids, tokens), size in zip(k.rows, k.sizes, strict=True):
            e = np.repeat(k.back[start : start + size], held)
            start += size
            sums["slice"].append(name)
            for n, v in (("score", value), ("base", base), ("known", known)):
                sums[n].append(squeeze(_small(np.bincount(doc, v[e] * times, n_docs).astype(np.int64))))
            sums["ids"].append(ids)
            sums["tokens"].append(tokens.tobytes() if tokens is not None else None)
            sums["N"].append(N)
        return pa.Table.from_arrays([pa.array(sums["slice"], pa.int64()), *(pa.array(sums[n], pa.binary()) for n in ("score", "base", "known")), pa.array(sums["ids"], pa.list_(pa.int64())), pa.array(sums["tokens"], pa.binary()), pa.array(sums["N"], pa.int64())], list(sums))

    return run


def _collect(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of all buckets of one slice, a row a document."""
    total, ids, tokens, N = None, None, None, 0
    for b in batches:
        for r in b.to_pylist():
            v = np.stack([unsqueeze(pa.py_buffer(r[n])).astype(np.int64) for n in ("score", "base", "known")])
            total = v if total is None else total + v
            N = r["N"]
            if r["ids"] is not None:
                ids, tokens = r["ids"], np.frombuffer(r["tokens"], np.uint32)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tokens.astype(np.int64)), pa.array(total[2]), pa.array([N] * len(ids), pa.int64()), pa.array(total[1] / -NANO), pa.array(total[0] / -MICRO)], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def _heavy_contexts(docs: DataFrame, chars: int) -> np.ndarray:
    """Contexts that would be a large part of a bucket, by a bounded sample; they only steer where pairs are computed."""

    def count(batches):
        for batch in batches:
            for b in pieces(batch):
                c, _, _, _ = pairs_of(b.column("text"))
                v, n = np.unique(c, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(n)], ["c", "n"])

    picked = docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(HEAVY_SAMPLE).distinct()
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").mapInArrow(lambda it: count(it), "c long, n long").groupBy("c").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    top = rows.select("c", "n", total.alias("total")).where(F.col("n") >= min(HEAVY_SHARE, HEAVY_CHARS / max(1, chars)) * F.col("total")).orderBy(F.desc("n"), "c").limit(HEAVY).collect()
    return np.array(sorted(r.c for r in top if r.n > 20), np.int64).view(U64)


def _figures(told: DataFrame, before: Figures | None, number: int) -> Figures:
    """One row of sums, and a row for each of the split restaurants."""
    split = {r.context: (r.c, r.t) for r in told.select(F.explode("split").alias("h")).select("h.*").collect()}
    s = told.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in SUMS]).first()
    if before:
        rest = float(np.random.default_rng(number).gamma(STRENGTH + before.top * s.tops)) * GRAIN
        return replace(before, customers=s.customers, tables=s.tops, drawn=s.drawn_sum, rest=rest, split=split)
    return Figures(s.tokens, s.types, _discount(s.n1, s.n2), _discount(s.t1, s.t2), s.customers, s.tops, 0, 0.0, split)


def score_documents(docs: DataFrame, fold_of: int = 5, held: int = 1, buckets: int | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): one row a document."""
    spark = docs.sparkSession
    bounded_batches(spark, records=4000, size=16 << 20)
    out_of = F.coalesce(crc_mod(F.col("doc_id"), fold_of) == held, F.lit(False))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("train", ~out_of)
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chars = src.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = buckets or max(usual, chars // BUCKET_CHARS + 1)
    parts = max(min(usual, buckets), buckets // 16)  # a part's words come from all buckets, so parts grow with them
    heavy, folder = _heavy_contexts(src, chars), scratch_path(spark, "seats")
    slices = src.mapInArrow(_slices(heavy, buckets), SLICE_SCHEMA)
    reports, now, told = slices.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_start(heavy, parts, folder), REPORT_SCHEMA), None, None
    for number in range(BURN + SAMPLES + 1):
        if number:
            reports = told.df.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_round(heavy, parts, folder, now, number), REPORT_SCHEMA)
        new = Table(reports.groupBy("part").applyInArrow(_answer(now, number), ANSWER_SCHEMA), "parent")
        if number:
            told.drop()
            delete_path(spark, f"{folder}/{number - 1}")
        told = new
        now = _figures(told.df, now, number)
        # the round's shuffle files go when the driver collects its garbage
        gc.collect()
        spark._jvm.System.gc()
    partial = slices.repartition(buckets, "bucket").groupBy("bucket").cogroup(told.df.repartition(buckets, "bucket").groupBy("bucket")).applyInArrow(_score(parts, folder, now), "slice long, score binary, base binary, known binary, ids array<long>, tokens binary, N long")
    rows = partial.groupBy("slice").applyInArrow(_collect, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return rows.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), fold_of) == held, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
