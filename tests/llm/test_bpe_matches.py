"""BPE (10): longest matches are read only where the encoder stands, with equal ids."""

import random

import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

from quarrymeter.llm import bpe

BYTE = public_tokenizers.path("byte_bpe_50k.json")


class Counted:
    """The automaton, with the matches that its walks have given out."""

    def __init__(self, auto):
        self.auto, self.n = auto, 0

    def _told(self, walk):
        for x in walk:
            self.n += 1
            yield x

    def iter(self, *a):
        return self._told(self.auto.iter(*a))

    def iter_long(self, *a):
        return self._told(self.auto.iter_long(*a))


@pytest.fixture(scope="module")
def mine():
    return bpe.BacktrackingBPE(BYTE)


def words(seed, n):
    r = random.Random(seed)
    parts = ["th", "er", "ing", "eau", "que", "é", "ç", "sch", "ung", "ß", "a", "e", "x", "q", "ion", "中", "😀", "й"]
    return ["".join(r.choice(parts) for _ in range(r.randint(1, 12))) for _ in range(n)]


def test_a_piece_reads_few_matches(mine, monkeypatch):
    auto = Counted(mine.auto)
    monkeypatch.setattr(mine, "auto", auto)
    ids = sum(len(mine.encode_piece(f" {w}".encode())) for w in words(1, 2000))
    assert ids <= auto.n <= 1.5 * ids


def test_longest_matches_have_no_gaps(mine):
    known = {t.decode("latin-1"): i for i, t in enumerate(mine.token)}
    for w in words(2, 2000):
        text = f" {w}".encode().decode("latin-1")
        for start in (0, len(text) // 2):
            at = start
            for last, token in mine.auto.iter_long(text, start):
                end = next(e for e in range(len(text), at, -1) if text[at:e] in known)
                assert (last + 1, token) == (end, known[text[at:end]])
                at = end
            assert at == len(text)


def test_words_equal_library(mine):
    tok = Tokenizer.from_file(BYTE)
    for w in [*words(3, 4000), "ofheedtiwh", "\x1cab", "ab\x1c", "\x85", "x ", "　y", "ªº", "ʰⅣ", "אְב", "áb"]:
        for text in (w, f"x {w} y", f" {w}"):
            assert mine.encode(text).tolist() == tok.encode(text, add_special_tokens=False).ids, text


def test_letters_of_python_are_letters_of_the_pattern():
    letter = regex.compile(r"\p{L}")
    space = regex.compile(r"\s")
    for c in map(chr, range(0x110000)):
        assert not c.isalpha() or letter.match(c), c
        assert c.isspace() or not space.match(c), c
