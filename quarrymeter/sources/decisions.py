"""Decisions of each function in Go, Java, JavaScript and Rust sources, by a lexer and a stack of open brackets.

No grammar is installed for these languages, so a file is read as tokens: one
pattern a language takes comments, strings, characters and words in one pass from
the left, so what stands inside a string or a comment is never a token. A stack
holds open brackets and open functions; a decision belongs to the innermost open function.
A function that only wraps others, and decides nothing itself, is left out.

Decisions count as a syntax tree of the language has nodes for them: the keyword and its
statement are two, so ``if`` weighs 2; weights by language are below. Brackets that
don't match, or a text that ends inside a bracket, don't parse.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

LANGUAGES = {".go": "go", ".java": "java", ".js": "js", ".jsx": "js", ".mjs": "js", ".cjs": "js", ".rs": "rust"}

#: What a keyword counts in each language. Else clauses, defaults and match arms have nodes of their own in some.
WEIGHTS = {
    "go": {"if": 2, "for": 2, "switch": 1, "select": 1, "case": 1},
    "java": {"if": 2, "for": 2, "while": 2, "switch": 2, "case": 1, "try": 2, "catch": 2, "finally": 1},
    "js": {"if": 2, "else": 1, "for": 2, "while": 2, "switch": 2, "case": 2, "default": 1, "try": 2, "catch": 2, "finally": 1},
    "rust": {"if": 2, "else": 1, "for": 2, "while": 2, "loop": 2, "match": 3},
}
_BLOCK = r"/\*(?:[^*]|\*(?!/))*\*/"
_LINE = r"//[^\n]*"
_QUOTED = r'"(?:[^"\\\n]|\\.)*"'
_WORD = r"[A-Za-z_$][A-Za-z0-9_$]*"
_SIGNS = r"=>|->|\?\.|\?\?|::|&&|\|\||[^\s]"
_PATTERNS = {
    "go": re.compile(rf"(?P<skip>{_BLOCK}|{_LINE})|(?P<text>`[^`]*`|{_QUOTED}|'(?:[^'\\\n]|\\.)+')|(?P<word>{_WORD})|(?P<number>\d[\w.]*)|(?P<sign>:=|{_SIGNS})", re.S),
    "java": re.compile(rf'(?P<skip>{_BLOCK}|{_LINE})|(?P<text>"""(?:[^"\\]|\\.|"(?!""))*"""|{_QUOTED}|\'(?:[^\'\\\n]|\\.)+\')|(?P<word>{_WORD})|(?P<number>\d[\w.]*)|(?P<sign>{_SIGNS})', re.S),
    "js": re.compile(rf"(?P<skip>{_BLOCK}|{_LINE})|(?P<text>{_QUOTED}|'(?:[^'\\\n]|\\.)*')|(?P<word>#?{_WORD})|(?P<number>\d[\w.]*)|(?P<sign>`|{_SIGNS})", re.S),
    "rust": re.compile(rf"(?P<skip>{_LINE})|(?P<text>b?r(?P<hash>#*)\".*?\"(?P=hash)|b?\"(?:[^\"\\]|\\.)*\"|b?'(?:[^'\\\n]|\\[^\n]+?)')|(?P<life>'[A-Za-z_]\w*)|(?P<word>(?:r#)?{_WORD})|(?P<number>\d[\w]*(?:\.\d[\w]*)?)|(?P<sign>\.\.=|\.\.|{_SIGNS})", re.S),
}
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_CHARS = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, ")]}"
#: Words after which a slash begins a pattern and not a division.
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "await", "yield"}
_NOT_METHODS = {"if", "for", "while", "switch", "catch", "synchronized", "try", "return", "new", "super", "this", "function", "with"}


class Unparsed(Exception):
    pass


def tokens(text: str, language: str) -> Iterator[tuple[str, str]]:
    """(kind, token) of words, signs, numbers and texts; a template's expressions are tokens, its characters are not."""
    pattern = _PATTERNS[language]
    at, last = 0, ("sign", ";")
    braces: list[int] = []  # open braces inside each template's expression
    while at < len(text):
        if language == "rust" and text.startswith("/*", at):
            depth = 0
            for m in re.finditer(r"/\*|\*/", text[at:]):
                depth += 1 if m[0] == "/*" else -1
                if not depth:
                    break
            if depth:
                raise Unparsed
            at += m.end()
            continue
        if language == "js" and text[at] == "/" and text[at : at + 2] not in ("//", "/*"):
            value = last[0] in ("number", "text") or (last[0] == "word" and last[1] not in _BEFORE_REGEX) or last[1] in (")", "]", "}")
            if not value and (m := _REGEX.match(text, at)):
                at, last = m.end(), ("text", m[0])
                yield last
                continue
        m = pattern.match(text, at)
        if m is None:  # white space
            at += 1
            continue
        kind, token = m.lastgroup, m[0]
        at = m.end()
        if kind == "hash":
            kind = "text"
        if kind in ("skip", "life"):
            continue
        if language == "js" and (token == "`" or (token == "}" and braces and braces[-1] == 0)):
            if token == "}":
                braces.pop()
                yield "sign", ")"
            at = _CHARS.match(text, at).end()
            if at >= len(text):
                raise Unparsed
            if text[at] == "`":
                at, last = at + 1, ("text", "`")
                yield last
            else:
                at, last = at + 2, ("sign", "(")
                braces.append(0)
                yield last
            continue
        if braces and token in "{}":
            braces[-1] += 1 if token == "{" else -1
        last = (kind, token)
        yield last


class _Function:
    def __init__(self, name: str, depth: int, body: bool):
        self.name, self.depth, self.body, self.count, self.wraps = name, depth, body, 0, False


def decisions(text: str, language: str) -> list[tuple[str, int]] | None:
    """(function, decisions) of a source in the order of their starts; None if it doesn't parse."""
    try:
        return _count(list(tokens(text, language)), language)
    except Unparsed:
        return None


def _signature_end(ts: list, i: int) -> int:
    """Place after the bracket that closes the one at i."""
    depth = 0
    while i < len(ts):
        if ts[i][0] == "sign":
            depth += (ts[i][1] in _OPEN) - (ts[i][1] in _CLOSE)
            if not depth:
                return i + 1
        i += 1
    raise Unparsed


def _body(ts: list, i: int, language: str) -> int | None:
    """Place of the brace that opens the body of a function whose parameters end before i; None if it has no body."""
    while i < len(ts):
        kind, t = ts[i]
        if kind == "sign" and t == "{":
            if language == "go" and ts[i - 1][1] in ("interface", "struct"):  # a type in the result
                i = _signature_end(ts, i)
                continue
            return i
        if kind == "sign" and t in (";", "}", ")"):
            return None
        if language == "java" and not (kind == "word" or t in (".", ",", "@", "[", "]", "<", ">")):
            return None
        if language == "js":
            return None
        if language == "go" and kind == "word" and t == "func" and ts[i - 1][1] not in ("(", ","):
            # a type of a function in the result has no body of its own
            i = _signature_end(ts, i + 1)
            continue
        i = _signature_end(ts, i) if kind == "sign" and t in "([" else i + 1
    return None


def _starts(ts: list, language: str) -> dict[int, tuple[str, bool]]:
    """Functions by the place where their body begins: (name, whether in braces)."""
    out: dict[int, tuple[str, bool]] = {}
    for i, (kind, t) in enumerate(ts):
        follows = ts[i + 1] if i + 1 < len(ts) else ("", "")
        at = None
        if language == "go" and (kind, t) == ("word", "func"):
            j, name = i + 1, "func"
            if follows[1] == "(" and i + 2 < len(ts):  # receiver or parameters
                j = _signature_end(ts, j)
                if j + 1 < len(ts) and ts[j][0] == "word" and ts[j + 1][1] in ("(", "["):
                    name, j = ts[j][1], j + 1
                    j = _signature_end(ts, j)
            elif follows[0] == "word":
                name, j = follows[1], i + 2
                while j < len(ts) and ts[j][1] in ("[", "("):
                    done = ts[j][1] == "("
                    j = _signature_end(ts, j)
                    if done:
                        break
            at = _body(ts, j, language)
        elif language == "rust" and (kind, t) == ("word", "fn") and follows[0] == "word":
            name = follows[1]
            at = _body(ts, i + 2, language)
        elif language == "rust" and t in ("|", "||") and kind == "sign" and (i == 0 or ts[i - 1][1] in ("(", ",", "=", "{", ";", "=>", "move", "return", "[")):
            name, j = "closure", i + 1
            if t == "|":
                while j < len(ts) and ts[j][1] != "|":
                    j = _signature_end(ts, j) if ts[j][1] in _OPEN else j + 1
                j += 1
            if j < len(ts) and ts[j][1] == "->":
                while j < len(ts) and ts[j][1] != "{":
                    j += 1
            if j < len(ts):
                out[j] = (name, ts[j][1] == "{")
            continue
        elif language in ("java", "js") and kind == "sign" and t == ("->" if language == "java" else "=>"):
            if follows[1] and not (language == "java" and _in_switch(ts, i)):
                out[i + 1] = ("lambda" if language == "java" else "arrow", follows[1] == "{")
            continue
        elif language == "js" and (kind, t) == ("word", "function"):
            if follows[1] == "*":
                continue  # a generator isn't a function of its own
            j = i + 1 + (follows[0] == "word")
            name = follows[1] if follows[0] == "word" else "function"
            if j < len(ts) and ts[j][1] == "(":
                at = _body(ts, _signature_end(ts, j), language)
        elif language in ("java", "js") and kind == "word" and follows[1] == "(" and t not in _NOT_METHODS:
            before = ts[i - 1] if i else ("", "")
            if before[1] not in (".", "new", "function", "*" if language == "java" else "."):
                name, at = t, _body(ts, _signature_end(ts, i + 1), language)
        if at is not None:
            out[at] = (name, True)
    return out


def _in_switch(ts: list, i: int) -> bool:
    """Whether an arrow of Java ends a case label."""
    depth = 0
    for j in range(i - 1, -1, -1):
        t = ts[j][1]
        depth += (t in _CLOSE) - (t in _OPEN)
        if depth < 0 or (depth == 0 and t in (";", "->")):
            return False
        if depth == 0 and t in ("case", "default"):
            return True
    return False


def _count(ts: list, language: str) -> list[tuple[str, int]]:
    starts = _starts(ts, language)
    weights = WEIGHTS[language]
    brackets: list[str] = []
    open_: list[_Function] = []
    found: list[_Function] = []
    matches: list[int] = []  # depth of the block of each open match of Rust
    heads: list[int] = []  # depth of each match whose block hasn't begun

    def close(end: bool) -> None:
        """Expressions end where their level does."""
        while open_ and not open_[-1].body and (len(brackets) < open_[-1].depth or (end and len(brackets) == open_[-1].depth)):
            open_.pop()

    for i, (kind, t) in enumerate(ts):
        if kind == "sign" and (t in _CLOSE or t in (",", ";")):
            close(True)
        if i in starts:
            name, braces = starts[i]
            if open_:
                open_[-1].wraps = True
            f = _Function(name, len(brackets), braces)
            open_.append(f)
            found.append(f)
        own = open_[-1] if open_ else None
        if kind == "sign" and t in _OPEN:
            if t == "{" and heads and heads[-1] == len(brackets):
                heads.pop()
                matches.append(len(brackets) + 1)
            brackets.append(_OPEN[t])
        elif kind == "sign" and t in _CLOSE:
            if not brackets or brackets.pop() != t:
                raise Unparsed
            if matches and len(brackets) < matches[-1]:
                matches.pop()
            close(False)
            if open_ and open_[-1].body and len(brackets) == open_[-1].depth and t == "}":
                open_.pop()
        elif own is not None:
            if kind == "word":
                before = ts[i - 1][1] if i else ""
                if t in weights and before != "." and not (t == "for" and i + 1 < len(ts) and ts[i + 1][1] == "<") and not (language == "js" and i + 1 < len(ts) and ts[i + 1][1] == ":" and t != "default"):
                    own.count += weights[t]
                if language == "go" and t == "for":
                    own.count += _clauses(ts, i)
                if language == "go" and t == "switch":
                    own.count += _type_switch(ts, i)
                if language == "rust" and t == "match":
                    heads.append(len(brackets))
            elif t == "?" and language in ("java", "js", "rust"):
                # of Java a question mark in a type is no decision
                own.count += not (language == "java" and ts[i - 1][1] in ("<", ",") )
            elif t == "=>" and language == "rust" and matches and len(brackets) == matches[-1]:
                own.count += 2  # an arm and its pattern
    if brackets:
        raise Unparsed
    return [(f.name, f.count) for f in found if f.count or not f.wraps]


def _clauses(ts: list, i: int) -> int:
    """1 for a loop with three clauses."""
    depth = 0
    for kind, t in ts[i + 1 :]:
        if kind == "sign":
            if t == "{" and not depth:
                return 0
            depth += (t in _OPEN) - (t in _CLOSE)
            if t == ";" and not depth:
                return 1
    return 0


def _type_switch(ts: list, i: int) -> int:
    """1 more for a switch over a type."""
    for j in range(i + 1, len(ts)):
        if ts[j][1] == "{":
            return 0
        if ts[j][1] == "type" and ts[j - 1][1] == "(":
            return 1
    return 0


@udtf(returnType="function string, decisions int")
class SourceDecisions:
    """``source_decisions(ext, text)``: rows of (function, decisions); none for other languages and texts that don't parse."""

    def eval(self, ext: str, text: str):
        if text is not None and ext in LANGUAGES:
            yield from decisions(text, LANGUAGES[ext]) or ()


def register(spark: SparkSession) -> None:
    spark.udtf.register("source_decisions", SourceDecisions)
