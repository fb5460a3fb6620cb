"""Byte-level BPE by backtracking longest matches (operator 10).

A text is cut into pieces by the tokenizer's split pattern. For a piece, an
Aho-Corasick automaton over the vocabulary gives the longest token that starts
where the encoder stands. It walks left to right, takes the longest token that is
compatible with the token before it, falls back to the next shorter prefix
token, and steps back where nothing fits, remembering dead positions, so every
position is left at most once: time is linear in the piece. Two neighbouring
tokens are compatible if merging by rank would not have joined across their
border; a chain of compatible tokens is exactly what the merges give.

Decoding gathers bytes through an offset table over the concatenated vocabulary.

Defined cases: null text counts as empty (no ids, empty decoded text); strings
of added tokens inside a text become their ids, as the tokenizers library does
unless told otherwise; repeated rows give repeated results; extra columns are
left out of the result; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, on_release, pieces, working

#: Split pattern of the byte-level tokenizer family (fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: What is kept encoded: a young generation and the one before it, so that frequent words stay when room is made.
#: A word that is one piece is kept as a chunk only, so the pieces are those of other chunks and of texts with runs of white space.
CACHE_PIECES = 100_000
CACHE_CHUNKS = 400_000
_PAIR_MEMO = 300_000


def byte_chars() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in vocabulary files: printable Latin-1
    bytes stand for themselves, the others for code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in plain}
    rest = (b for b in range(256) if b not in set(plain))
    return chars | {chr(256 + i): b for i, b in enumerate(rest)}


def gather(ids: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated table entries of the ids, and the length of each."""
    first = offsets[ids]
    length = offsets[ids + 1] - first
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return data[np.repeat(first - ends + length, length) + np.arange(total)], length


class BacktrackingBPE:
    """Encoder and decoder for one vocabulary file. Internal ids follow merge rank."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        to_byte = byte_chars()
        raw = lambda s: bytes(to_byte[c] for c in s)
        names = sorted(to_byte, key=to_byte.get)
        index = {n: i for i, n in enumerate(names)}
        self.left, self.right = list(range(256)), list(range(256))
        self.pair: dict[int, int] = {}
        for m in merges:
            a, b = m if isinstance(m, list) else m.split(" ")
            if a + b in index:
                raise ValueError("two merges give one token; ranks alone can't order this vocabulary")
            new = len(names)
            names.append(a + b)
            index[a + b] = new
            self.left.append(index[a])
            self.right.append(index[b])
            self.pair[index[a] << 32 | index[b]] = new
        self.token = [raw(n) for n in names]
        self.size = [len(t) for t in self.token]
        by_bytes = {t: i for i, t in enumerate(self.token)}
        self.shorter = [next((by_bytes[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in by_bytes), -1) for t in self.token]
        self.auto = ahocorasick.Automaton()
        for i, t in enumerate(self.token):
            self.auto.add_word(t.decode("latin-1"), i)
        self.auto.make_automaton()
        self.out = np.array([vocab[n] for n in names], np.uint32)
        self.raw = [i.tobytes() for i in self.out]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added = {k: np.array([v], np.uint32).tobytes() for k, v in added.items()}
        self.added_split = regex.compile("(" + "|".join(regex.escape(k) for k in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.split = regex.compile(SPLIT)
        entries = {int(o): t for o, t in zip(self.out, self.token, strict=True)} | {v: k.encode() for k, v in added.items()}
        table = [entries.get(i, b"") for i in range(max(entries) + 1)]
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in table])]).astype(np.int64)
        self.data = np.frombuffer(b"".join(table), np.uint8)
        digits = [b"%d," % i for i in range(len(table))]
        self.digit_offsets = np.concatenate([[0], np.cumsum([len(t) for t in digits])]).astype(np.int64)
        self.digit_data = np.frombuffer(b"".join(digits), np.uint8)
        self.memo: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}
        self.older_cache: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.older_chunks: dict[str, bytes] = {}
        self.byte_id = [by_bytes[bytes([i])] for i in range(256)]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging by rank leaves the border between tokens a and b open."""
        key = a << 32 | b
        known = self.memo.get(key)
        if known is None:
            if len(self.memo) > _PAIR_MEMO:
                self.memo.clear()
            known = self.memo[key] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        # Undo the later of the two tokens' last merges until both are bytes.
        # A pair at the border that would have merged earlier than the merge
        # just undone means that the merges would have taken it.
        before = 1 << 62
        while True:
            joined = self.pair.get(a << 32 | b)
            if joined is not None and joined < before:
                return False
            if a > b:
                before, part = a, self.right[a]
                if part == a:
                    return True
                a = part
                continue
            if self.left[b] == b:
                if self.right[a] == a:
                    return True
                before, a = a, self.right[a]
            else:
                before, b = b + 1, self.left[b]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Internal ids of one piece."""
        n = len(piece)
        if n == 1:
            return [self.byte_id[piece[0]]]
        sizes, shorter, memo, compatible, longest = self.size, self.shorter, self.memo, self.compatible, self.auto.iter_long
        text = piece.decode("latin-1")
        # bytes are tokens too, so longest matches follow each other without gaps; they are looked up again only after a shorter token
        ahead = longest(text)
        dead = None
        out: list[int] = []
        pos, token, before = 0, next(ahead)[1], -1
        while True:
            end = pos + sizes[token]
            if dead is None or not dead[end]:
                fits = True
                if before >= 0:
                    fits = memo.get(before << 32 | token)
                    if fits is None:
                        fits = compatible(before, token)
                if fits:
                    out.append(token)
                    if end == n:
                        return out
                    if ahead is None:
                        ahead = longest(text, end)
                    pos, before, token = end, token, next(ahead)[1]
                    continue
            ahead = None
            token = shorter[token]
            while token < 0:
                if dead is None:
                    dead = bytearray(n + 1)
                dead[pos] = 1
                token = out.pop()
                pos -= sizes[token]
                token = shorter[token]
                before = out[-1] if out else -1

    def piece_ids(self, piece: str) -> bytes:
        got = self.cache.get(piece)
        if got is None:
            got = self.older_cache.get(piece)
            if got is None:
                got = self._new(piece)
            if 2 * len(self.cache) >= CACHE_PIECES:
                self.older_cache, self.cache = self.cache, {}
            self.cache[piece] = got
        return got

    def _new(self, piece: str) -> bytes:
        """Ids of a piece that isn't kept."""
        raw = self.raw
        return b"".join([raw[i] for i in self.encode_piece(piece.encode("utf-8", "surrogatepass"))])

    def _cut(self, text: str) -> bytes:
        return b"".join(map(self.piece_ids, self.split.findall(text)))

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a chunk that its caller keeps: where it is one piece, that isn't kept a second time."""
        if not chunk[1:].isalpha():  # a space and letters are one piece
            found = self.split.findall(chunk)
            if len(found) > 1:
                return b"".join(map(self.piece_ids, found))
        return self._new(chunk)

    def _plain(self, text: str) -> bytes:
        """Ids of a text without added tokens.

        The split pattern always cuts before a single space that stands between
        two characters that aren't white space, so such chunks are encoded once
        and kept. A text in which a chunk is empty or has white space at an end
        is cut by the pattern as a whole.
        """
        first, *rest = text.split(" ")
        got = list(map(self.chunks.get, rest))
        if None in got:
            for i, chunk in enumerate(rest):
                if got[i] is None:
                    known = self.older_chunks.get(chunk)
                    if known is None:
                        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
                            return self._cut(text)
                        known = self._chunk(" " + chunk)
                    got[i] = known
                    if 2 * len(self.chunks) >= CACHE_CHUNKS:
                        self.older_chunks, self.chunks = self.chunks, {}
                    self.chunks[chunk] = known
        if rest and (not first or first[0].isspace() or first[-1].isspace()):
            return self._cut(text)
        return self._cut(first) + b"".join(got)

    def encode(self, text: str) -> np.ndarray:
        """Token ids of a whole text."""
        if self.added_split is None or not any(k in text for k in self.added):
            return np.frombuffer(self._plain(text), np.uint32)
        parts = self.added_split.split(text)
        return np.frombuffer(b"".join([self.added[p] if p in self.added else self._plain(p) for p in parts]), np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        return gather(ids, self.data, self.offsets)[0].tobytes().decode("utf-8", "replace")


_loaded: dict[str, BacktrackingBPE] = {}
on_release("bpe", _loaded.clear)


def tokenizer(path: str) -> BacktrackingBPE:
    """One tokenizer for each Python worker and file."""
    working("bpe")
    if path not in _loaded:
        _loaded[path] = BacktrackingBPE(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>): the ids of every text, one row a row."""

    bounded_batches(docs.sparkSession)

    def run(batches):
        bpe = tokenizer(vocab_path)
        for batch in batches:
            for b in pieces(batch):
                ids = [bpe.encode(t or "").astype(np.int32) for t in b.column("text").to_pylist()]
                off = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(off), pa.array(flat))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, vocab_path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""

    def run(batches):
        bpe = tokenizer(vocab_path)
        for b in batches:
            texts = [bpe.decode(np.asarray(x or [], np.int64)) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def roundtrip_digests(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode, decode, digest, in one pass over the texts."""

    bounded_batches(docs.sparkSession)

    def run(batches):
        bpe = tokenizer(vocab_path)
        for batch in batches:
            for b in pieces(batch):
                count, sha, back = [], [], []
                for t in b.column("text").to_pylist():
                    ids = bpe.encode(t or "").astype(np.int64)
                    count.append(len(ids))
                    sha.append(hashlib.sha256(gather(ids, bpe.digit_data, bpe.digit_offsets)[0][:-1]).hexdigest())
                    back.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(count, pa.int64()), pa.array(sha), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
