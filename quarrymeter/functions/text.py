"""Column builders for texts: lines, redaction, prose rules, names, versions, JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..vocab import GENERATED_HEADS, TECHNOLOGIES

LINE_CAP = 50_000
def line_count(text: Column, cap: int = LINE_CAP) -> Column:
    """Non-blank lines; the cap where the text has as many lines, blank ones included."""
    n = lambda end: (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(end), F.lit("")))) / len(end)
    lines = 1 + n("\n") + n("\r") - n("\r\n")
    full = F.regexp_count(text, F.lit(r"\S[^\r\n]*+"))  # from the first character of a line that isn't blank to its end
    return F.when(text.isNull(), F.lit(0)).when(lines >= cap, F.lit(cap)).otherwise(full)


def bounded(text: Column, characters: int = 16384) -> Column:
    """The beginning of a text."""
    return F.substring(text, 1, characters)


def matching_lines(text: Column, pattern: str) -> Column:
    """Lines that a pattern fits, without white space at their ends."""
    return F.transform(F.filter(F.split(text, "\n"), lambda x: x.rlike(pattern)), lambda x: F.regexp_replace(x, r"\s+$", ""))


def newline_count(text: Column) -> Column:
    """Newline characters, the other definition of size."""
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def is_generated(text: Column, head: int = 500) -> Column:
    top = F.lower(F.substring(text, 1, head))
    out = F.substring(text, 1, head).contains(" eslint-disable */")
    for m in GENERATED_HEADS:
        out = out | top.contains(m)
    return F.coalesce(out, F.lit(False))


#: What redaction removes, in order: (label, pattern, replacement, a sign that must be there).
REDACTIONS = (
    ("a filesystem path", r"\b(?:[\w.\-]+[/\\])+[\w.\-]+\b", "[path]", r"[/\\]"),
    ("a filename", r"\b[\w\-]+\.(?:py|js|jsx|mjs|cjs|ts|tsx|go|java|rb|php|cs|rs|kt|kts|swift|scala|c|cc|cpp|h|hpp|m|mm|sh|sql|yml|yaml|toml|json)\b", "[file]", r"\."),
    ("an object hash", r"\b[0-9a-f]{7,40}\b", "[revision]", r"[0-9a-f]{7}"),
    ("a function call", r"\b\w+\([^)]{0,80}\)", "[function]", r"\("),
    ("a declaration", r"(?:^|\n)[ \t]*(?:def|class)\s+\w+\s*[(:].*", "[declaration]", r"def|class"),
    ("an import statement", r"(?:^|\n)[ \t]*import\s+[\w.]+.*", "[import]", "import"),
    ("an import statement", r"(?:^|\n)[ \t]*from\s+[\w.]+\s+import\b.*", "[import]", "import"),
    ("a function declaration", r"\bfunction\s+\w+\s*\([^)]*\)", "[function]", "function"),
    ("code punctuation", r"[{}]|=>|->|::|`", "", None),
    ("a snake_case identifier", r"\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b", "[identifier]", "_"),
    ("a camelCase identifier", r"\b[a-z]+(?:[A-Z][a-z0-9]*)+\b", "[identifier]", "[a-z][A-Z]"),
)
PASCAL = r"\b(?!(?:" + "|".join(TECHNOLOGIES) + r")\b)[A-Z][a-z]+(?:[A-Z][a-z0-9]*)+\b"
TITLE = r"^[A-Z][a-z]{2,}$"
#: What a scrub removes beyond that, (label, pattern, replacement).
SCRUBS = (("an email address", r"\b[\w.\-+]+@[\w.\-]+\.[A-Za-z]{2,}\b", "[email]"), ("an uppercase identifier", r"\b(?:[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+|[A-Z][A-Z0-9]+)\b", "[identifier]"))
LONGEST = 2000


def redacted(text: Column) -> Column:
    """struct(text, labels): a text on one line without what could name its origin, and what was removed, sorted.

    Each rule is applied once, to what the rules before it left; a rule fired if
    the text has changed. Rules whose sign isn't there are not tried.
    """
    rules = [*REDACTIONS, ("a class name", PASCAL, "[identifier]", "[a-z][A-Z]")]
    state = lambda text, before, labels: F.struct(text.alias("text"), before.alias("before"), labels.alias("labels"))

    def apply(t: Column, i: Column) -> Column:
        out = t
        for k, (_, pattern, by, sign) in enumerate(rules):
            fits = i == 2 * k
            out = F.when(fits & t.rlike(sign) if sign else fits, F.regexp_replace(t, "(?U)" + pattern, by)).otherwise(out) if k else F.when(fits & t.rlike(sign), F.regexp_replace(t, "(?U)" + pattern, by)).otherwise(t)
        return out

    # even steps change the text, odd ones note whether they did
    names = F.array(*[F.lit(n) for n, *_ in rules])
    step = lambda a, i: F.when(i % 2 == 0, state(apply(a["text"], i), a["text"], a["labels"])).when(a["text"] != a["before"], state(a["text"], a["text"], F.concat(a["labels"], F.array(F.element_at(names, ((i + 1) / 2).cast("int")))))).otherwise(a)
    line = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    done = F.aggregate(F.sequence(F.lit(0), F.lit(2 * len(rules) - 1)), state(line, line, F.array().cast("array<string>")), step)
    title = lambda a: a["text"].rlike(TITLE) & ~a["text"].isin(*TECHNOLOGIES)
    single = F.transform(F.array(done), lambda a: F.struct(F.when(title(a), "[identifier]").otherwise(a["text"]).alias("text"), F.when(title(a), F.concat(a["labels"], F.array(F.lit("a proper name")))).otherwise(a["labels"]).alias("labels")))
    tidy = lambda t: F.regexp_replace(F.trim(F.regexp_replace(t, r"\s{2,}", " ")), r"(\[\w+\])(\s+\1)+", "$1")
    out = F.transform(single, lambda a: F.struct(_cut(tidy(a["text"])).alias("text"), F.array_sort(F.array_distinct(a["labels"])).alias("labels")))
    return out[0]


def _cut(text: Column) -> Column:
    """A text of more than LONGEST characters, cut at a word."""
    head = F.regexp_replace(F.regexp_replace(F.substring(text, 1, LONGEST), " [^ ]*$", ""), "[ ,;:]+$", "")
    return F.when(F.length(text) <= LONGEST, text).otherwise(F.concat(head, F.lit("...")))


def redact(text: Column) -> Column:
    return redacted(text)["text"]


def scrub(text: Column) -> Column:
    """Redaction, and then addresses and upper-case identifiers."""
    out = redact(text)
    for _, pattern, by in SCRUBS:
        out = F.regexp_replace(out, "(?U)" + pattern, by)
    return out


def first_leak(text: Column) -> Column:
    """Label of the first rule that still fits a text, null where it is clean."""
    out = F.when(F.lit(False), F.lit(""))
    for label, pattern, _, sign in REDACTIONS:
        out = out.when(text.rlike(sign) & text.rlike("(?U)" + pattern) if sign else text.rlike(pattern), label)
    out = out.when(text.rlike("(?U)" + PASCAL), "a class name").when(text.rlike(TITLE) & ~text.isin(*TECHNOLOGIES), "a proper name")
    for label, pattern, _ in SCRUBS:
        out = out.when(text.rlike("(?U)" + pattern), label)
    return out


#: Why a sentence may not go out, in order, (reason, pattern).
REFUSALS = (
    ("path separator", r"[/\\]"), ("url", r"https?:|\bwww\."), ("address", "@"), ("dotted identifier", r"[A-Za-z_]\w*\.[A-Za-z_]"), ("file extension", r"(?:^|\s)\.[A-Za-z0-9]{1,6}\b"), ("snake_case identifier", r"[A-Za-z0-9]+_[A-Za-z0-9]+"),
    ("camelCase identifier", r"\b[a-z]+[A-Z][A-Za-z0-9]*\b"), ("quoted string", r"[\"`]|'[^']{1,80}'"), ("code punctuation", r"[{}\[\]<>=|*#$]|::|->|=>"), ("object hash", r"\b[0-9a-f]{7,}\b"), ("acronym", r"\b[A-Z]{2,}[A-Z0-9]*\b"),
)
#: A capitalised word that neither begins a sentence nor names a public technology.
CAPITAL = r"(?<=[^.!?\s])\s*(?<![A-Za-z'’-])(?!(?:" + "|".join(TECHNOLOGIES) + r")(?![A-Za-z'’-]))[A-Z][A-Za-z'’-]*"


def sentence_verdict(text: Column, max_words: int = 40, own_words: tuple[str, ...] = ()) -> Column:
    """Why a sentence may not go out, by the first rule that applies; 'ok' if none does.

    ``own_words`` are this engine's own terms: they mark a text as its own, are
    not held against it, and let it use round brackets.
    """
    line = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    probe = line
    for w in sorted(own_words, key=len, reverse=True):
        probe = F.replace(probe, F.lit(w), F.lit("ok"))
    out = F.when(line == "", "empty").when(F.size(F.split(line, " ")) > max_words, "too long")
    for reason, pattern in REFUSALS if own_words else (*REFUSALS, ("parentheses", "[()]")):
        out = out.when(probe.rlike("(?U)" + pattern), reason)
    return out.when(probe.rlike(CAPITAL), "capitalised name").otherwise("ok")


def dependency_name(raw: Column) -> Column:
    """Normal form of a package name, null where it isn't one; separators of scopes, modules and coordinates stay."""
    bare = F.regexp_replace(F.trim(raw), r"^[\"']+|[\"']+$", "")
    name = F.regexp_replace(F.translate(F.lower(bare), "_", "-"), r"/+$", "")
    return F.when(name.rlike(r"^[@a-z0-9][a-z0-9./:@+-]*$"), name)


def requirement_name(line: Column) -> Column:
    """Package of a requirement line; options, comments, addresses and paths give null."""
    bare = F.regexp_replace(F.trim(line), r"^[\"']+|[\"']+$", "")
    got = F.regexp_extract(bare, r"^([A-Za-z0-9][A-Za-z0-9._-]*)", 1)
    return F.when(~bare.rlike(r"^(-|#|http|git\+|file:|\.|/)") & (got != ""), dependency_name(got))


def keyword_pattern(word: str) -> str:
    """Pattern of a keyword that stands between separators of a dependency name; a trailing * allows any ending of its segment."""
    safe = "".join("\\" + c if c in ".+*?^$()[]{}|\\" else c for c in word.rstrip("*"))
    return f"(^|[/:.]){safe}{'[a-z0-9+-]*' if word.endswith('*') else ''}($|[/:.])"


#: What wraps a CI command without being one.
CI_WRAPPER = (
    r"(?i)^\s*(?:[A-Za-z_][A-Za-z0-9_]*=\S*\s+)*(?:sudo\s+|time\s+|nice\s+|exec\s+|xvfb-run(?:\s+-\S+)*\s+|env\s+(?:\S+=\S*\s+)*"
    r"|(?:poetry|pipenv|uv|hatch|pdm|rye)\s+run\s+(?:--\S+\s+)*|bundle\s+exec\s+|npx\s+(?:--\S+\s+)*|pnpm\s+(?:exec|dlx)\s+|yarn\s+dlx\s+)*"
)


def substituted(block: Column, env: Column) -> Column:
    """``${{ env.NAME }}`` filled in from a map of variables; unknown names give nothing, and without variables all stays."""
    names = F.array_distinct(F.regexp_extract_all(block, F.lit(r"\$\{\{\s*([A-Za-z0-9_.-]+)\s*\}\}"), F.lit(1)))
    quoted = lambda n: F.concat(F.lit(r"\$\{\{\s*"), F.replace(n, F.lit("."), F.lit(r"\.")), F.lit(r"\s*\}\}"))
    safe = lambda v: F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    value = lambda n: F.coalesce(F.try_element_at(env, F.regexp_replace(n, r"(?i)^env\.", "")), F.lit(""))
    return F.when(env.isNull(), block).otherwise(F.aggregate(names, block, lambda text, n: F.regexp_replace(text, quoted(n), safe(value(n)))))


def ci_commands(block: Column) -> Column:
    """Commands of a CI step: split at newlines, ; && ||, without comments, wrappers and variables before them."""
    parts = F.split(block, r"[\n;]|&&|\|\|")
    clean = F.transform(parts, lambda x: F.trim(F.regexp_replace(F.trim(x), CI_WRAPPER, "")))
    return F.filter(clean, lambda x: (x != "") & ~x.startswith("#"))


def slug(text: Column, longest: int = 40) -> Column:
    """A short name: plain characters only, blanks as hyphens; null where nothing is left."""
    plain = F.trim(F.regexp_replace(text, r"[^A-Za-z0-9 ._+-]", ""))
    return F.nullif(F.substring(F.regexp_replace(plain, r"\s+", "-"), 1, longest), F.lit(""))


def clean_commands(commands: Column, most: int = 20) -> Column:
    """Redacted commands on one line, the first 200 characters of each; blank ones go."""
    line = lambda x: F.substring(F.trim(F.regexp_replace(x, r"\s+", " ")), 1, 200)
    return F.slice(F.filter(F.transform(F.filter(commands, lambda x: F.coalesce(F.trim(x), F.lit("")) != ""), lambda x: redact(line(x))), lambda x: x != ""), 1, most)


def prose(text: Column, fallback: Column) -> Column:
    """Redacted prose of at most 1,200 characters, or a fallback where none is left."""
    said = redact(F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, 1200))
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", fallback).when(said == "", fallback).otherwise(said)


def error_tails(stdout: Column, stderr: Column, tail: int = 400, longest: int = 900) -> Column:
    """Redacted ends of both streams, standard error first; '' where both are blank."""
    end = lambda label, x: F.when(F.trim(F.coalesce(x, F.lit(""))) != "", F.concat(F.lit(f"{label} tail: "), F.right(F.trim(x), F.lit(tail))))
    both = F.concat_ws(" | ", end("standard error", stderr), end("standard output", stdout))
    return F.when(both == "", "").otherwise(F.substring(redact(both), 1, longest))


def envelope_error(stdout: Column) -> Column:
    """Error text inside a reply's JSON envelope: its result where it is marked as an error, or its error's message; '' otherwise."""
    got = lambda p: F.get_json_object(stdout, p)
    return F.when(got("$.is_error") == "true", F.coalesce(got("$.result"), stdout)).when(got("$.error").isNotNull(), F.coalesce(got("$.error.message"), F.lit(""))).otherwise("")


def markdown_cell(text: Column) -> Column:
    """A table cell: bars can't break the table."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("|"), F.lit("\\|"))


def version_parts(text: Column) -> Column:
    """Up to three numbers of the first version in a text, as array<int>; null without one."""
    got = F.regexp_extract(text, r"[0-9]{1,9}(\.[0-9]{1,9})?(\.[0-9]{1,9})?", 0)
    return F.when(got != "", F.transform(F.split(got, r"\."), lambda x: x.cast("int")))


def json_in(text: Column) -> Column:
    """JSON out of a reply: the whole text, else a fenced block, else the widest braces. VARIANT, null if none parses."""
    fence = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    wide = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.nullif(fence, F.lit(""))), F.try_parse_json(F.nullif(wide, F.lit(""))))


def notebook_code(data: Column) -> Column:
    """Source of the code cells of a notebook, joined by newlines."""
    kind = "struct<cells:array<struct<cell_type:string,source:array<string>>>>"
    cells = F.filter(F.from_json(data, kind)["cells"], lambda c: c["cell_type"] == "code")
    return F.array_join(F.transform(cells, lambda c: F.array_join(c["source"], "")), "\n")
