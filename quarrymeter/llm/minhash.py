"""Near-duplicate documents by min-max hashing (operator 3).

A document's set holds its distinct k-word shingles (words
``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased; with fewer than k words the whole
sequence is the one shingle). Under each of ``PERMUTATIONS`` permutations both
the minimum and the maximum are kept, so one hash evaluation gives two signature
values, each equal for two sets with a probability of their similarity. Bands of
``ROWS`` values take their rows from different permutations; at similarity 0.8 a
pair shares no band with a probability of some 1e-7.

Documents with equal sets are folded first. Then links are looked for in three
rounds; after each, pairs are confirmed on full sets and components formed:
every member of a band's bucket with the bucket's two leaders; in buckets that
still hold several components, every member with its closest members of other
components in its block of the bucket; and where several components are left, all
pairs across them, on full sets that come to the bucket, so only links are given out. So
no link between components is lost, while pairs inside a component are never
listed. A pair that shares several buckets is given out by the first.

Only bands whose bucket has several members are dealt. A bucket of one block that
the second round has searched keeps for the last only the members of pairs that were
left out, because a member has more candidates than pairs are given out. Later rounds
name the components that their links touch; documents take these names at the end.

In buckets of several blocks the last round isn't all with all. Shingles that more
than ``RARE`` members of such buckets hold are common. A linked pair whose common
shingles alone can't reach the threshold shares a rare one, and is found by an
index of rare shingles, cut to the prefix in which two such sets must meet. What is
left are pairs that common shingles alone may link: members outside their bucket's
largest component for which such a partner may exist ask, and only they are copied
to the blocks of the members that may answer.

Texts are read again for confirmation, but only those that a fixed-size bit set
of wanted ids lets through are shuffled.

Defined cases: null, empty and blank texts have an empty set, link with nothing
and are their own component; a null id gives a null component and is kept;
repeated rows get equal results; rows that share an id are told apart by their sets;
a very long text is one set, compared whole; pairs at exactly the threshold link;
other columns are not read, whatever their names; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, Table, Words, as_long, bounded_batches, bloom_has, bloom_keep, bloom_of, components, few_components, frequent, mix, pieces, runs_hash, unique_per_doc, unskewed, words_of, working

PERMUTATIONS = 100
ROWS = 5
BLOCK = 512
BLOCK_ITEMS = 3_000_000
SALTS, HOT_PAIRS = 16, 400
RARE = 32
#: So many links are settled in one task, more in rounds of joins; so many new names are broadcast.
FEW_LINKS = 200_000
FEW_NAMES = 50_000
#: Roles of a bucket's rows: in a bucket of one block all meet; else askers meet those at home, of which some ask elsewhere.
ALL, ASKS, HOME, HOME_ASKS = range(4)
_rng = np.random.default_rng(31)
_MUL = _rng.integers(0, 2**62, PERMUTATIONS, dtype=np.int64).astype(U64) * U64(2) + U64(1)
#: Estimates lie within four standard deviations of the similarity above this distance from the threshold.
SLACK = 0.12


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all documents, sorted inside each, and set offsets."""
    counts, doc = words.counts, words.doc_of()
    h = runs_hash(words.hash, k)
    inside = doc[: len(h)] == doc[k - 1 :] if len(h) else np.zeros(0, bool)
    values, owner = [h[inside]], [doc[: len(h)][inside]]
    for n in range(1, k):  # the whole sequence of a shorter document
        short = np.flatnonzero(counts == n)
        if len(short):
            first = words.doc[:-1][short]
            fold = runs_hash(words.hash, n)[first]
            values.append(mix(fold + U64(1000 + n)))
            owner.append(short)
    v, d = unique_per_doc(np.concatenate(values), np.concatenate(owner))
    return v, np.searchsorted(d, np.arange(len(counts) + 1))


def signatures(v: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(documents with shingles x 2*PERMUTATIONS): minima, then maxima."""
    first = off[:-1][np.diff(off) > 0]
    out = np.empty((2 * PERMUTATIONS, len(first)), U64)
    for i, m in enumerate(_MUL):
        x = v * m
        out[i], out[PERMUTATIONS + i] = np.minimum.reduceat(x, first), np.maximum.reduceat(x, first)
    return np.ascontiguousarray(out.T)


def bands_of(sig: np.ndarray) -> np.ndarray:
    parts = sig.reshape(len(sig), -1, ROWS)
    h = parts[:, :, 0]
    for r in range(1, ROWS):
        h = mix(h) + parts[:, :, r] * U64(0x9E3779B97F4A7C15)
    return mix(mix(h) + np.arange(h.shape[1]).astype(U64))


def set_keys(v: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One 64-bit key of each set."""
    size = np.diff(off)
    full = size > 0
    first = off[:-1][full]
    key = np.zeros(len(size), U64)
    if len(first):
        key[full] = mix(np.add.reduceat(mix(v + U64(11)), first) ^ mix(np.bitwise_xor.reduceat(mix(v + U64(29)), first) + size[full].astype(U64)))
    return key


def _sign(k: int):
    def run(batches):
        working("minhash")
        for batch in batches:
            for b in pieces(batch):
                v, off = shingle_sets(words_of(b.column("text"), True), k)
                size = np.diff(off)
                full = np.flatnonzero(size)
                sig = signatures(v, off)
                bands, short = as_long(bands_of(sig)), (sig >> U64(30)).astype(np.uint8)
                at = np.full(b.num_rows, -1)
                at[full] = np.arange(len(full))
                rows = [bands[i] if i >= 0 else None for i in at]
                raw = [short[i].tobytes() if i >= 0 else None for i in at]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size.astype(np.int64)), pa.array(as_long(set_keys(v, off))), pa.array(rows, pa.list_(pa.int64())), pa.array(raw, pa.binary())], ["doc_id", "n", "key", "bands", "sig"])

    return run


def _sets(k: int):
    def run(batches):
        working("minhash")
        for batch in batches:
            for b in pieces(batch):
                v, off = shingle_sets(words_of(b.column("text"), True), k)
                same = as_long(set_keys(v, off)) == b.column("key").to_numpy()
                raw = [v[off[i] : off[i + 1]].tobytes() for i in np.flatnonzero(same)]
                yield pa.RecordBatch.from_arrays([b.column("key").filter(pa.array(same)), pa.array(raw, pa.binary())], ["key", "items"])

    return run


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= percent * union."""
    if len(x) > len(y):
        x, y = y, x
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirm(percent: int, more: list[str]):
    def run(batches):
        for b in batches:
            left, right = b.column("left"), b.column("right")
            ok = np.array([similar(np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64), percent) for x, y in zip(left, right, strict=True)], bool)
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([b.column(c).filter(keep) for c in ("ka", "kb", *more)], ["a", "b", *more])

    return run


def _cross(percent: int, closest: int | None):
    """Work of one cell of one bucket, between members of different components.

    With ``closest``: pairs (a, b) of each member with so many others, those with
    the highest estimates, and rows (a, null) of the members of pairs that this leaves
    out. Without: links (a, b) confirmed on full sets, one for each member and
    component that it links with. Both come with the cell's bucket and the components (ca, cb).
    """
    least = percent / 100 - SLACK

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = pa.Table.from_batches(batches)
        band = key[1].as_py()
        col = lambda n: b.column(n).to_numpy()
        k, n, comp, role, common = col("key"), col("n"), col("comp"), col("role"), col("common")
        sig = np.stack([np.frombuffer(x.as_buffer(), np.uint8) for x in b.column("sig")])
        tags = b.column("bands").combine_chunks().values.to_numpy().reshape(len(k), -1) if closest is None else None
        items = [np.frombuffer(x.as_buffer(), U64) for x in b.column("items")] if closest is None else []
        names, count = np.unique(comp, return_counts=True)
        # members of the largest component are met from the other side, or inside the component
        asks = np.where(role == ALL, comp != names[count.argmax()], (role == ASKS) | (role == HOME_ASKS))
        home = np.flatnonzero(role != ASKS)
        out = []
        pair = lambda i, j: (k[i], k[j], comp[i], comp[j]) if k[i] < k[j] else (k[j], k[i], comp[j], comp[i])
        left = np.zeros(len(k), bool)
        for i in np.flatnonzero(asks & ((role == ALL) | (role == ASKS))):
            near = home[(comp[home] != comp[i]) & ((100 + percent) * np.minimum(common[home], common[i]) >= percent * (n[home] + n[i]))]
            if closest is None:
                near = near[~asks[near] | (k[near] > k[i])]
            if not len(near):
                continue
            guess = (sig[near] == sig[i]).mean(1)
            near, guess = near[guess >= least], guess[guess >= least]
            order = np.argsort(-guess, kind="stable")
            if closest is not None:
                out += [pair(i, j) for j in near[order[:closest]]]
                if len(near) > closest:
                    left[i] = left[near] = True
                continue
            near = near[order]
            if band:  # the first bucket that a pair shares looks at it
                near = near[~(tags[near, :band] == tags[i, :band]).any(1)]
            linked: set[int] = set()
            for j in near:
                if comp[j] not in linked and similar(items[i], items[j], percent):
                    linked.add(comp[j])
                    out.append(pair(i, j))
        cols = list(zip(*sorted(set(out)), strict=True)) if out else [[], [], [], []]
        one, *rest = ([*map(int, c)] for c in cols)
        more = k[left].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in ([key[0].as_py()] * (len(one) + len(more)), one + more, *(c + [None] * len(more) for c in rest))], ["h", "a", "b", "ca", "cb"])

    return run


#: What ``_cross`` gives out.
CROSSED = "h long, a long, b long, ca long, cb long"


def _shared(bits: bytes, spark: SparkSession):
    """(key, n, band, h) of the bands that the bit set lets through."""
    held = spark.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            h = b.column("bands").flatten().to_numpy()
            bands = len(h) // b.num_rows
            at = np.flatnonzero(bloom_has(held.value, h))
            row = pa.array(at // bands)
            yield pa.RecordBatch.from_arrays([b.column("key").take(row), b.column("n").take(row), pa.array((at % bands).astype(np.int32)), pa.array(h[at])], ["key", "n", "band", "h"])

    return run


def _holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many sets of a batch hold each shingle."""
    for b in batches:
        items, count = np.unique(np.concatenate([np.zeros(0, U64), *(np.frombuffer(x.as_buffer(), U64) for x in b.column("items"))]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(as_long(items)), pa.array(count)], ["item", "count"])


def _split(percent: int, often, few):
    """The number of common shingles of each set, and the prefix of its rare ones."""

    def run(batches):
        working("minhash")
        for b in batches:
            common, rare = [], []
            for x in b.column("items"):
                items = as_long(np.frombuffer(x.as_buffer(), U64))
                hot = bloom_has(often.value, items)
                left = items[~hot]
                left = left[bloom_has(few.value, left)]
                # a linked pair that isn't left to the cells shares so many of them at least; sets are sorted
                least = max(1, -(-(percent * len(items) - 100 * int(hot.sum())) // 100))
                common.append(int(hot.sum()))
                rare.append(left[: max(0, len(left) - least + 1)])
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(common, pa.int64()), pa.array(rare, pa.list_(pa.int64()))], ["key", "common", "rare"])

    return run


def _common_and_rare(sets: DataFrame, percent: int) -> DataFrame:
    """(key, common, rare) of the sets (key, items).

    Two sets link only if ``(100 + percent) * least(common) >= percent * (n + n)``, or if both prefixes hold one shingle.
    The bit sets may take a rare shingle for a common one, or one of a single set for a rare one, alike in all sets; neither loses a link.
    """
    spark = sets.sparkSession
    held = Table(sets.select("items").mapInArrow(_holders, "item long, count long").groupBy("item").agg(F.sum("count").alias("count")).where("count > 1"), "holders")
    often, few = (spark.sparkContext.broadcast(bloom_of(held.df.where(w).select("item"))) for w in (f"count > {RARE}", f"count <= {RARE}"))
    out = Table(sets.select("key", "items").mapInArrow(_split(percent, often, few), "key long, common long, rare array<long>"), "common").df
    held.drop()
    return out


def _cells(large: DataFrame, percent: int) -> DataFrame:
    """Members (h, band, key, n, comp, common) of the buckets of several blocks, dealt to cells of bounded rows and bytes.

    Members outside the largest component that may link by common shingles ask;
    those that may answer are at home. Rows are some (askers * blocks at home + home * blocks of askers).
    """
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_ITEMS)).cast("int")
    # whether a partner of this size, or of the smallest that sizes allow, is in reach
    may = lambda n: f"100 * {100 + percent} * common >= {percent} * (100 * n + greatest(100 * {n}, {percent} * n))"
    parts = large.groupBy("h", "comp").agg(F.count("*").alias("count"), F.min("n").alias("n0"))
    of = parts.groupBy("h").agg(F.max(F.struct("count", "comp"))["comp"].alias("major"), F.min("n0").alias("n0"))
    at = Table(large.join(of, "h").select("*", (F.col("comp") != F.col("major")).alias("minor")).withColumn("asks", F.col("minor") & F.expr(may("n0"))), "large").df
    asked = at.where("asks").groupBy("h").agg(F.min("n").alias("n1"), blocks.alias("down"))
    home = Table(at.join(asked, "h").where(may("n1")), "home").df
    across = home.groupBy("h").agg(blocks.alias("across"))
    deal = lambda c: F.pmod(F.xxhash64("key"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    row = lambda df, role: df.select("h", "band", "row", "col", "key", "comp", role.alias("role"), "common")
    asking = at.where("asks").join(asked, "h").join(across, "h").withColumn("row", deal("down")).withColumn("col", every("across"))
    there = home.join(across, "h").withColumn("col", deal("across")).withColumn("row", every("down"))
    return row(asking, F.lit(ASKS)).union(row(there, F.when(F.col("asks"), HOME_ASKS).otherwise(HOME)))


def _sets_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(key, items) of the wanted (doc_id, key)."""
    texts = bloom_keep(docs, "doc_id", bloom_of(wanted.select("doc_id"))).join(wanted, "doc_id")
    return texts.select("key", "text").mapInArrow(_sets(k), "key long, items binary").groupBy("key").agg(F.first("items").alias("items"))


def _verify(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b) of the pairs (ka, kb, a, b) whose full sets are similar enough, with the pairs' other columns."""
    more = [c for c in pairs.columns if c not in ("ka", "kb", "a", "b")]
    wanted = pairs.select(F.col("a").alias("doc_id"), F.col("ka").alias("key")).union(pairs.select("b", "kb")).distinct()
    sets = Table(_sets_of(docs, wanted, k), "sets").df
    # the leader of a large group is in many pairs: its set is dealt to SALTS places, and so are its pairs
    hot = {c: frequent(pairs, c, 4 * SALTS, HOT_PAIRS) for c in ("ka", "kb")}
    salt = lambda c, other: F.when(F.col(c).isin(*hot[c]), F.pmod(F.xxhash64(other), F.lit(SALTS))).otherwise(0) if hot[c] else F.lit(0).cast("long")
    places = lambda c: F.when(F.col("key").isin(*hot[c]), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))) if hot[c] else F.array(F.lit(0))
    side = lambda c, name: sets.select(F.col("key").alias(c), F.col("items").alias(name), F.explode(places(c).cast("array<long>")).alias("salt"))
    one = pairs.select("ka", "kb", *more, salt("ka", "kb").alias("salt")).join(side("ka", "left"), ["ka", "salt"]).drop("salt")
    two = one.withColumn("salt", salt("kb", "ka")).join(side("kb", "right"), ["kb", "salt"])
    return two.select("ka", "kb", *more, "left", "right").mapInArrow(_confirm(percent, more), ", ".join(f"{c} long" for c in ("a", "b", *more)))


def _components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, component) of the nodes, or of the ends of the written edges (a, b)."""
    if edges.count() <= FEW_LINKS:
        got = few_components(edges)
        return got if nodes is None else nodes.join(got, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    if nodes is None:
        nodes = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    return components(nodes, edges)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", with_key: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row for each row of the input; ``with_key`` adds the keys of its set and of its group, null without words."""
    bounded_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = Table(src.mapInArrow(_sign(k), "doc_id long, n long, key long, bands array<long>, sig binary"), "signed")
    rows = Table(signed.df.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("key")).alias("key")), "rows").df
    good = signed.df.where("n > 0 and doc_id is not null")
    reps = Table(good.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), "reps").df
    signed.drop()
    nodes = reps.select(F.col("key").alias("id"))
    tested: list[DataFrame] = []

    def confirm(found: DataFrame) -> DataFrame | None:
        """Links (a, b) among new pairs (ka, kb), with the components of both where the pairs have them; None where there is nothing new."""
        for old in tested:
            found = found.join(old.select("ka", "kb"), ["ka", "kb"], "left_anti")
        side = lambda key, rep, n: reps.select(F.col("key").alias(key), F.col("rep").alias(rep), F.col("n").alias(n))
        fit = found.join(side("ka", "a", "na"), "ka").join(side("kb", "b", "nb"), "kb").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
        pairs = Table(fit.select("ka", "kb", "a", "b", *[c for c in ("ca", "cb") if c in found.columns]), "pairs").df
        tested.append(pairs)
        return None if pairs.isEmpty() else Table(_verify(src, pairs, k, percent), "links").df

    def merged(links: DataFrame | None) -> DataFrame | None:
        """(comp, top) of the components that links (ca, cb) join, None where there are none.

        Links bring the components of their ends, so no member is read.
        """
        if links is None:
            return None
        across = Table(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "across").df
        if across.isEmpty():
            return None
        return Table(_components(across), "top").df.select(F.col("id").alias("comp"), F.col("component").alias("top"))

    def renamed(mixed: DataFrame, top: DataFrame | None) -> DataFrame:
        """Members of the buckets that still hold several components, by their new names."""
        if top is not None:
            told = mixed.join(F.broadcast(top), "comp", "left") if top.count() <= FEW_NAMES else unskewed(mixed, top, "comp")
            mixed = told.select("h", "band", "blocks", "key", "n", F.coalesce("top", "comp").alias("comp"))
        mixed = Table(mixed, "renamed").df
        still = mixed.groupBy("h").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("h")
        return Table(mixed.join(still, "h", "left_semi"), "mixed").df

    def followed(names: DataFrame | None, top: DataFrame | None) -> DataFrame | None:
        """(comp, top) of two renamings, the second by names that the first has given."""
        if names is None or top is None:
            return top if names is None else names
        after = names.join(top.select(F.col("comp").alias("top"), F.col("top").alias("later")), "top", "left").select("comp", F.coalesce("later", "top").alias("top"))
        return Table(after.union(top.join(names, "comp", "left_anti").select("comp", "top")), "names").df

    member = reps.select("key", F.explode("bands").alias("h"))
    lead = Table(member.groupBy("h").agg(F.min("key").alias("one"), F.max("key").alias("two")).where("one <> two"), "lead").df
    # most buckets have one member: only the others' rows are dealt, once
    shared = reps.select("key", "n", "bands").mapInArrow(_shared(bloom_of(lead.select("h")), docs.sparkSession), "key long, n long, band int, h long")
    shared = Table(shared.join(lead, "h"), "shared").df
    near = shared.select("key", F.explode(F.array("one", "two")).alias("lead")).where("lead <> key")
    links = confirm(near.select(F.least("key", "lead").alias("ka"), F.greatest("key", "lead").alias("kb")).distinct())
    comp = names = None
    signs = reps.select("key", "n", "sig", "bands")
    if links is not None:
        comp = Table(_components(links, nodes), "components").df
        at = Table(shared.select("h", "band", "key", "n").join(comp.select(F.col("id").alias("key"), F.col("component").alias("comp")), "key"), "shared").df
        size = F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_ITEMS)
        several = at.groupBy("h").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("size"), F.ceil(size).cast("int").alias("blocks")).where("c0 <> c1 and size > 2")
        mixed = Table(at.join(several.select("h", "blocks"), "h").select("h", "band", "blocks", "key", "n", "comp"), "mixed").df
        whole = lambda df, block: df.select("h", "band", F.lit(0).alias("row"), block.alias("col"), "key", "comp", F.lit(ALL).alias("role"), F.col("n").alias("common"))
        # rows of signatures only for members of these buckets
        some = bloom_keep(signs, "key", bloom_of(mixed.select("key")))
        full = whole(mixed, F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).join(some.select("key", "n", "sig"), "key")
        found = Table(full.groupBy("h", "band", "row", "col").applyInArrow(_cross(percent, 2), CROSSED), "found").df
        top = merged(confirm(found.where("b is not null").select(F.col("a").alias("ka"), F.col("b").alias("kb"), "ca", "cb").distinct()))
        names = followed(names, top)
        # a bucket of one block was searched whole: only the members of pairs that were left out are searched again
        rest = found.where("b is null").select("h", F.col("a").alias("key"))
        mixed = mixed.where("blocks > 1").unionByName(mixed.where("blocks = 1").join(rest, ["h", "key"], "left_semi"))
        mixed = renamed(mixed, top)
        if not mixed.isEmpty():
            wanted = mixed.select("key").distinct().join(reps.select("key", F.col("rep").alias("doc_id")), "key").select("doc_id", "key")
            sets = Table(_sets_of(src, Table(wanted, "wanted").df, k), "sets").df
            cells = None
            if not mixed.where("blocks > 1").isEmpty():
                inside = mixed.where("blocks > 1").select("key", "n", "comp").distinct()
                told = _common_and_rare(sets.join(inside.select("key"), "key", "left_semi"), percent)
                at = told.select("key", F.explode("rare").alias("item")).join(inside, "key")
                side = lambda x: at.select("item", *[F.col(c).alias(f"{c}_{x}") for c in ("key", "n", "comp")])
                fit = f"key_a < key_b and comp_a <> comp_b and 100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"
                top = merged(confirm(side("a").join(side("b"), "item").where(fit).select(F.col("key_a").alias("ka"), F.col("key_b").alias("kb"), F.col("comp_a").alias("ca"), F.col("comp_b").alias("cb")).distinct()))
                if top is not None:
                    names = followed(names, top)
                    mixed = renamed(mixed, top)
                cells = _cells(mixed.where("blocks > 1").join(told.select("key", "common"), "key"), percent)
            dealt = whole(mixed.where("blocks = 1"), F.lit(0))
            dealt = Table(dealt.union(cells) if cells is not None else dealt, "cells").df
            some = bloom_keep(signs, "key", bloom_of(dealt.select("key")))
            full = dealt.join(some, "key").join(sets, "key")
            late = Table(full.groupBy("h", "band", "row", "col").applyInArrow(_cross(percent, None), CROSSED).select("a", "b", "ca", "cb"), "links").df
            if not late.isEmpty():
                names = followed(names, merged(late))

    if comp is None:
        comp = nodes.select("id", F.col("id").alias("component"))
    named = Table(comp.withColumnRenamed("id", "key").join(reps.select("key", "rep"), "key"), "named").df
    least = named.groupBy("component").agg(F.min("rep").alias("rep")).withColumn("top", F.col("component"))
    if names is not None:  # components of the first round take the names of the later ones before their rows are read
        least = least.drop("top").join(names.withColumnRenamed("comp", "component"), "component", "left").withColumn("top", F.coalesce("top", "component"))
    least = Table(least, "least").df
    least = least.join(least.groupBy("top").agg(F.min("rep").alias("component_id")), "top").select("component", "top", "component_id")
    out = unskewed(rows, unskewed(named, least, "component").select("key", F.col("top").alias("component"), "component_id"), "key")
    comp_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    key = ["key", "component"] if with_key else []
    return out.select("doc_id", "n_shingles", comp_id.alias("component_id"), F.coalesce(F.col("doc_id") == comp_id, F.lit(True)).alias("kept"), *key)


def _with_key(k: int, name: str):
    def run(batches):
        working("minhash")
        for batch in batches:
            for b in pieces(batch):
                v, off = shingle_sets(words_of(b.column(b.schema.get_field_index("text")), True), k)
                key = pa.array(as_long(set_keys(v, off)), mask=np.diff(off) == 0)
                yield pa.RecordBatch.from_arrays([*b.columns, key], [*b.schema.names, name])

    return run


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents with one of each group of near-duplicates: the one with the smallest id, and of rows with that id the one with the smallest set key.

    Rows are told apart by id and set, so a row goes only if its own text is a
    copy: different texts that share an id both stay, and of rows with one id
    and equal sets the one with the smallest text stays. Rows with a null id or
    without words all stay. Only documents that a bit set of the ids in
    question lets through are shuffled. Columns stay as they are.
    """
    KEY = "_set_key" + "_" * sum(c.startswith("_set_key") for c in docs.columns)  # noqa: N806
    found = Table(near_duplicates(docs, k, percent, with_key=True).select("doc_id", "key", "component"), "classes").df.where("doc_id is not null and key is not null")
    rows = found.groupBy("doc_id", "key", "component").count()
    best = found.groupBy("component").agg(F.min(F.struct("doc_id", "key")).alias("best"))
    decided = Table(unskewed(Table(rows, "rows").df, best, "component").select("doc_id", "key", "count", (F.struct("doc_id", "key") != F.col("best")).alias("goes")), "decided").df
    bits = bloom_of(decided.where("goes or count > 1").select("doc_id").distinct())
    rest = bloom_keep(docs, "doc_id", bits, outside=True)
    kind = T.StructType([*docs.schema.fields, T.StructField(KEY, T.LongType())])
    some = bloom_keep(docs, "doc_id", bits).mapInArrow(_with_key(k, KEY), kind)
    gone = decided.where("goes").select(F.col("doc_id").alias("_gone_id"), F.col("key").alias(KEY))
    left = some.join(gone, (F.col("doc_id") == F.col("_gone_id")) & (some[KEY] == gone[KEY]), "left_anti")
    one = left.where(F.col(KEY).isNotNull()).groupBy("doc_id", KEY).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.col("text")).alias("_row")).select("_row.*")
    return one.union(left.where(F.col(KEY).isNull()).drop(KEY)).union(rest)
