"""Language identification by a linear-chain CRF over words (operator 7).

Each word has affix features (first and last one to three bytes), byte n-grams
inside word borders and a lexicon feature (the word itself), hashed into one
weight table with a weight for each language. Learned transitions link
neighbouring words; a chain is a whole document. Forward-backward gives every
word its label probabilities, also in text that switches languages
(``word_spans``); a document's language is the one with the largest summed
probability over its words with letters.

Fitting takes, for each language, at most ``MAX_DOCS`` documents (smallest hash
of the id; ``MAX_SAMPLE`` in all; of more than ``MAX_LANGS`` languages the most
frequent), as whole texts with every word labelled with the document's language,
and as many again of chains that switch between runs of words of two documents,
from which transitions between languages are learned. Prediction reads every word
of every document. The model's size is fixed by the number of languages, so it is
broadcast.

Defined cases: a null text or one without letters gives ``und`` and score 0; so
does every text if nothing can be learned, as from an empty table; a very long
text is one chain; equal sums give the language that comes first; repeated rows
give equal results; null languages are left out of fitting; columns other than
id, text and (in fitting) lang are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, bounded_batches, crc_mod, mix, pieces, text_bytes, words_of

MAX_DOCS, MAX_SAMPLE, MAX_LANGS = 300, 4000, 200
BATCH_WORDS = 8_192
FEW_LABELS = 16
SLOTS = 1 << 16
EPOCHS, UPDATES, RATE, DECAY = 4, 100, 0.15, 1e-6

_ALPHA = np.zeros(256, bool)
_ALPHA[65:91] = _ALPHA[97:123] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Crf:
    langs: list[str]
    weight: np.ndarray  # SLOTS x languages
    move: np.ndarray  # languages x languages
    start: np.ndarray


def word_features(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature slots of the words and the offset of each word's first slot."""
    size = end - start
    if not len(size):
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    width = size + 2
    off = np.concatenate([[0], np.cumsum(width)])
    text = np.zeros(int(off[-1]), np.uint64)
    inner = np.repeat(off[:-1] + 1 - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    text[inner] = _LOWER[buf[np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())]].astype(np.uint64) + np.uint64(3)
    text[off[:-1]], text[off[1:] - 1] = np.uint64(1), np.uint64(2)
    word = np.repeat(np.arange(len(size)), width)
    slots, owners = [], []
    code = text.copy()
    for n in (2, 3, 4):
        code = code[:-1] * np.uint64(263) + text[n - 1 :]
        ok = word[: len(code)] == word[n - 1 :]
        slots.append(mix(code[ok] + np.uint64(n << 48)))
        owners.append(word[: len(code)][ok])
    # affixes: first and last one to three bytes, and the whole word
    for n in (1, 2, 3):
        for side, at in ((0, off[:-1] + 1), (1, off[1:] - 1 - np.minimum(n, size))):
            code = np.zeros(len(size), np.uint64)
            for k in range(n):
                inside = k < size
                code = code * np.uint64(263) + np.where(inside, text[np.minimum(at + k, len(text) - 1)], 0)
            slots.append(mix(code + np.uint64((10 + 2 * n + side) << 48)))
            owners.append(np.arange(len(size)))
    fold = np.zeros(len(size), np.uint64)
    power = np.multiply.accumulate(np.full(int(width.max()), 0x100000001B3, np.uint64))
    fold = np.add.reduceat(text * power[np.arange(len(text)) - off[:-1][word]], off[:-1])
    slots.append(mix(fold + np.uint64(1 << 60)))
    owners.append(np.arange(len(size)))
    slot, owner = np.concatenate(slots), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return (slot[order] % np.uint64(SLOTS)).astype(np.int64), np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(size)))])


def messages(e: np.ndarray, offsets: np.ndarray, move: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages of all words of chains with these offsets, each scaled to one.

    Every chain behind its first word is cut into pieces that are gone through
    side by side. What a piece does to a message is a matrix, so messages pass
    along the pieces of a chain before each piece is filled in: exact, in some
    steps of the square root of the longest chain. With many labels these
    matrices cost more than they save, and a chain is one piece.
    """
    k = e.shape[1]
    alpha, beta = np.empty_like(e), np.ones_like(e)
    size = np.diff(offsets)
    full = np.flatnonzero(size)
    first, rest = offsets[:-1][full], size[full] - 1
    scaled = lambda x: x / x.sum(1, keepdims=True)
    alpha[first] = scaled(begin * e[first]) if len(first) else 0
    longest = int(rest.max(initial=0))
    if not longest:
        return alpha, beta
    cut = max(1, int(np.sqrt(longest))) if k <= FEW_LABELS else longest
    n = -(-rest // cut)  # pieces of each chain
    chain = np.repeat(np.arange(len(n)), n)
    number = np.arange(len(chain)) - (np.cumsum(n) - n)[chain]
    start, length = first[chain] + 1 + number * cut, np.minimum(cut, rest[chain] - number * cut)
    order = np.argsort(-length, kind="stable")
    row = np.empty_like(order)
    row[order] = np.arange(len(order))
    start, length = start[order], length[order]
    live = len(length) - np.searchsorted(length[::-1], np.arange(cut), "right")  # pieces that reach a step
    several = n.max() > 1
    does = np.tile(np.eye(k), (len(start), 1, 1)) if several else None
    for t in range(cut if several else 0):
        m = live[t]
        x = (does[:m] @ move) * e[start[:m] + t][:, None, :]
        does[:m] = x / x.sum((1, 2), keepdims=True)
    by_pieces = np.argsort(-n, kind="stable")
    base, have = (np.cumsum(n) - n)[by_pieces], n[by_pieces]
    still = len(have) - np.searchsorted(have[::-1], np.arange(int(n.max())), "right")  # chains that have a piece
    enter, leave = np.empty((len(start), k)), np.empty((len(start), k))
    now = alpha[first[by_pieces]]
    for j, m in enumerate(still):
        at = row[base[:m] + j]
        enter[at] = now[:m]
        if several:
            now[:m] = scaled((now[:m, None, :] @ does[at])[:, 0])
    now = np.ones((len(first), k))
    for j in range(len(still) - 1, -1, -1):
        m = still[j]
        at = row[base[:m] + j]
        leave[at] = now[:m]
        if several:
            now[:m] = scaled((does[at] @ now[:m, :, None])[:, :, 0])
    back = np.ascontiguousarray(move.T)
    a, b = enter, leave
    for t in range(cut):
        m = live[t]
        at = start[:m] + t
        a = scaled((a[:m] @ move) * e[at])
        alpha[at] = a
        at = start[:m] + length[:m] - 1 - t
        beta[at] = b = b[:m]
        b = scaled((e[at] * b) @ back)
        beta[at - 1] = b  # the word before; a later piece of the chain gives its last word the same
    return alpha, beta


def forward_backward(emit: np.ndarray, offsets: np.ndarray, crf: Crf, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Label probabilities of each word of chains with these offsets; with ``pairs`` also the expected transitions."""
    e = np.exp(emit - emit.max(1, keepdims=True))
    move = np.exp(crf.move)
    alpha, beta = messages(e, offsets, move, np.exp(crf.start))
    post = alpha * beta
    post /= post.sum(1, keepdims=True)
    if not pairs:
        return post, None
    inner = np.ones(len(e), bool)
    inner[offsets[:-1][np.diff(offsets) > 0]] = False
    after = np.flatnonzero(inner)
    right = e[after] * beta[after]
    norm = ((alpha[after - 1] @ move) * right).sum(1, keepdims=True)
    return post, move * (alpha[after - 1].T @ (right / norm))


def _emit(weight: np.ndarray, slot: np.ndarray, off: np.ndarray) -> np.ndarray:
    out = np.empty((len(off) - 1, weight.shape[1]))
    for k in range(weight.shape[1]):
        out[:, k] = np.add.reduceat(weight[slot, k], off[:-1]) if len(off) > 1 else 0
    return out


def switched(chains: list[tuple[str, list[str]]], rng: np.random.Generator) -> list[tuple[list[str], list[str]]]:
    """(labels, words) of chains that switch: runs of two to twenty words of two chains in turn."""
    out = []
    for i in range(len(chains)):
        both = [chains[i], chains[int(rng.integers(len(chains)))]]
        labels, words, place = [], [], [0, 0]
        for turn in range(int(rng.integers(2, 7))):
            lang, text = both[turn % 2]
            n = int(rng.integers(2, 21))
            run = text[place[turn % 2] : place[turn % 2] + n]
            place[turn % 2] += n
            labels += [lang] * len(run)
            words += run
        out.append((labels, words))
    return out


def fit(texts: list[tuple[str, str]], seed: int = 3) -> Crf | None:
    """CRF from (language, text) pairs, by Adagrad on the log-likelihood."""
    split = [(lang, t.encode("utf-8", "replace").split()) for lang, t in texts]
    split = [(lang, w) for lang, w in split if w]
    if not split:
        return None
    langs = sorted({x[0] for x in split})
    k = len(langs)
    at_lang = {x: i for i, x in enumerate(langs)}
    rng = np.random.default_rng(seed)
    chains = [([lang] * len(w), w) for lang, w in split] + switched(split, rng)
    chains = [(np.array([at_lang[x] for x in labels]), b" ".join(w).decode("utf-8", "replace")) for labels, w in chains]
    crf = Crf(langs, np.zeros((SLOTS, k)), np.zeros((k, k)), np.zeros(k))
    sums = [np.full_like(v, 1e-3) for v in (crf.weight, crf.move, crf.start)]
    # chains of like length go together; a small sample is gone through more often
    chains.sort(key=lambda c: len(c[0]))
    total = np.cumsum([len(c[0]) for c in chains])
    cuts = np.unique(np.concatenate([[0], np.searchsorted(total, np.arange(BATCH_WORDS, total[-1], BATCH_WORDS)) + 1, [len(chains)]]))
    for _ in range(max(EPOCHS, -(-UPDATES // (len(cuts) - 1)))):
        for i in rng.permutation(len(cuts) - 1):
            part = chains[cuts[i] : cuts[i + 1]]
            w = words_of(pa.array([p[1] for p in part]), False)
            label = np.concatenate([p[0] for p in part])
            first = w.doc[:-1]
            _, at, back = np.unique(w.hash, return_index=True, return_inverse=True)
            slot, off = word_features(w.buf, w.start[at], w.end[at])
            emit = _emit(crf.weight, slot, off)[back]
            post, pair = forward_backward(emit, w.doc, crf, True)
            post[np.arange(len(label)), label] -= 1
            diff = np.stack([np.bincount(back, post[:, c], len(at)) for c in range(k)], 1)
            seen = np.zeros((k, k))
            inner = np.ones(len(label), bool)
            inner[first] = False
            j = np.flatnonzero(inner)
            np.add.at(seen, (label[j - 1], label[j]), 1)
            owner = np.repeat(np.arange(len(at)), np.diff(off))
            grads = [np.stack([np.bincount(slot, diff[owner, c], SLOTS) for c in range(k)], 1), pair - seen, post[first].sum(0)]
            for v, g, s in zip((crf.weight, crf.move, crf.start), grads, sums, strict=True):
                g = g / len(label) * 50 + DECAY * v
                s += g * g
                v -= RATE * g / np.sqrt(s)
    return Crf(langs, crf.weight.astype(np.float32), crf.move, crf.start)


def train(docs: DataFrame, fold_of: int = 4, held: int = 2) -> Crf | None:
    """CRF from documents whose crc32(id) modulo ``fold_of`` is not ``held``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    ids = docs.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang")).where("_id is not null and _lang is not null").where(crc_mod(F.col("_id"), fold_of) != held)
    langs = ids.groupBy("_lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "_lang").limit(MAX_LANGS).collect()
    if not langs:
        return None
    # a hash below the cut takes some three times as many rows as are wanted, wherever they lie
    cuts = spark.createDataFrame([(r._lang, min(int(min(1.0, (3 * MAX_DOCS + 30) / r.n) * 2**64) - 2**63, 2**63 - 1)) for r in langs], "_lang string, _cut long")
    low = ids.withColumn("_h", F.xxhash64("_id")).join(F.broadcast(cuts), "_lang").where("_h <= _cut").select("_lang", "_h", "_id").distinct().collect()
    by_lang: dict[str, list] = {}
    for r in sorted(low):
        by_lang.setdefault(r._lang, []).append(r._id)
    picked = [i for rank in range(MAX_DOCS) for own in by_lang.values() if rank < len(own) for i in [own[rank]]][:MAX_SAMPLE]
    wanted = spark.createDataFrame([(i,) for i in sorted(set(picked))], "_id long")
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), F.col("text").alias("text")).join(F.broadcast(wanted), "_id").where("_lang is not null and text is not null").select("_lang", "text")
    rows = sorted((r._lang, r.text) for r in texts.toLocalIterator())
    return fit([r for r in rows if r[0] in by_lang])


def _has_letter(words: Words, texts: pa.Array) -> np.ndarray:
    """Whether each document has a letter; only texts without ASCII letters are looked at one by one."""
    alpha = np.concatenate([[0], np.cumsum(_ALPHA[words.buf])])
    counts = words.counts
    some = np.zeros(len(counts), bool)
    full = np.flatnonzero(counts)
    some[full] = alpha[words.end[words.doc[1:][full] - 1]] > alpha[words.start[words.doc[:-1][full]]]
    for i in full[~some[full]]:
        some[i] = any(c.isalpha() for c in texts[int(i)].as_py())
    return some


def word_probabilities(crf: Crf, words: Words) -> np.ndarray:
    """Label probabilities of each word."""
    _, at, back = np.unique(words.hash, return_index=True, return_inverse=True)
    emit = _emit(crf.weight, *word_features(words.buf, words.start[at], words.end[at]))[back]
    return forward_backward(emit, words.doc, crf)[0]


def predict(crf: Crf | None, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    w = words_of(texts, False)
    n = len(texts)
    if crf is None or not len(w.start):
        return ["und"] * n, np.zeros(n)
    post = word_probabilities(crf, w)
    alpha = np.concatenate([[0], np.cumsum(_ALPHA[w.buf] | (w.buf >= 128))])
    lettered = alpha[w.end] > alpha[w.start]
    doc = w.doc_of()
    total = np.stack([np.bincount(doc[lettered], post[lettered, k], n) for k in range(len(crf.langs))], 1)
    best = total.argmax(1)
    share = total[np.arange(n), best] / np.maximum(total.sum(1), 1e-12)
    ok = _has_letter(w, texts) & (total.sum(1) > 0)
    return [crf.langs[b] if o else "und" for b, o in zip(best, ok, strict=True)], np.where(ok, np.clip(share, 0, 1), 0.0)


def word_spans(docs: DataFrame, crf: Crf | None) -> DataFrame:
    """(doc_id, spans): runs of words of one language in every document, with byte offsets and mean probability."""
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(crf)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("words", pa.int64()), ("lang", pa.string()), ("probability", pa.float64())]))

    def run(batches):
        for batch in batches:
            for b in pieces(batch):
                w = words_of(b.column("text"), False)
                spans: list[list[dict]] = [[] for _ in range(b.num_rows)]
                if held.value is not None and len(w.start):
                    post = word_probabilities(held.value, w)
                    best, doc = post.argmax(1), w.doc_of()
                    new = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (doc[1:] != doc[:-1])]))
                    _, off = text_bytes(b.column("text"))
                    for s, e in zip(new, np.append(new[1:], len(best)), strict=True):
                        d = doc[s]
                        spans[d].append({"start": int(w.start[s] - off[d]), "stop": int(w.end[e - 1] - off[d]), "words": int(e - s), "lang": held.value.langs[best[s]], "probability": float(post[s:e, best[s]].mean())})
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, spans array<struct<start:long,stop:long,words:long,lang:string,probability:double>>")


def identify(docs: DataFrame, crf: Crf | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every document, in one pass."""
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(crf)

    def run(batches):
        for batch in batches:
            for b in pieces(batch):
                lang, score = predict(held.value, b.column("text"))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
