"""Output boundary: every column is declared with the kind of value that it may hold; what isn't declared fails the write.

A kind gives an expression for the value that goes out and one for what is
wrong with a value, so a document is checked and cleaned in one projection.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import sentence_verdict
from ..vocab import LANGUAGES
from .classify import CLASSES
from .detectors import IAC_COUNTERS

#: Task types, and tokens by pattern.
TASK_TYPES = ("net_new", "agentic", "bug_repair", "repo_evolution")
TOKENS = {
    "digest": r"[0-9a-f]{64}", "handle": r"repo-[0-9a-f]{12}", "timestamp": r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?", "ratio": r"\d+:\d+|0 tests", "version": r"[A-Za-z0-9][A-Za-z0-9._@+-]{0,80}",
    "model": r"[A-Za-z0-9][A-Za-z0-9._:/-]{0,80}", "repository": r"[A-Za-z0-9][A-Za-z0-9._-]{0,99}(?:/[A-Za-z0-9][A-Za-z0-9._-]{0,99}){0,3}",
}
#: What a kind is counted as in a review.
GROUPS = {"number": "numbers", "boolean": "booleans", "enum": "enums", "token": "enums", "digest": "identity", "handle": "identity", "timestamp": "timestamps", "tagged": "task_ideas", "sentence": "sentences", "note": "notes", "list": "enums", "map": "numbers"}


@dataclass(frozen=True)
class Kind:
    """What one declared field may hold. ``name`` is a key of GROUPS or a token of TOKENS."""

    name: str
    vocabulary: tuple[str, ...] = ()
    fold: bool = False  # values outside the vocabulary become 'other'
    words: int = 40
    own_words: tuple[str, ...] = ()
    item: Kind | None = None
    reason: str = ""  # of a field that is declared and never collected

    @property
    def group(self) -> str:
        return "withheld" if self.name == "withheld" else GROUPS.get(self.name, "enums")

    def value(self, c: Column) -> Column:
        """What goes out: sentences that may not are dropped, unknown map keys fold into 'other' and add up."""
        if self.name == "withheld":
            return F.lit(None)
        if self.name == "enum" and self.fold:
            return F.when(c.isNull() | c.isin(*self.vocabulary), c).otherwise("other")
        if self.name in TOKENS:
            return F.nullif(c, F.lit(""))
        if self.name in ("sentence", "note"):
            line = F.trim(F.regexp_replace(c, r"\s+", " "))
            return F.when(c.isNull(), c).when(sentence_verdict(c, self.words, self.own_words) == "ok", line).otherwise("")
        if self.name == "tagged":
            return F.when(c.isNull() | (sentence_verdict(F.regexp_extract(c, r"(?s)^[^:]*: (.*)$", 1), self.words) == "ok"), c).otherwise("")
        if self.name == "list":
            out = F.transform(c, self.item.value)
            return F.filter(out, lambda x: x != "") if self.item.name in ("sentence", "tagged", "note") else out
        if self.name == "map":
            folded = F.transform(F.map_entries(c), lambda e: F.struct(F.when(e["key"].isin(*self.vocabulary), e["key"]).otherwise("other").alias("k"), e["value"].alias("v")))
            keys = F.array_distinct(F.transform(folded, lambda e: e["k"]))
            add = lambda k: F.aggregate(F.filter(folded, lambda e: e["k"] == k), F.lit(0.0), lambda a, e: a + e["v"].cast("double"))
            return F.when(c.isNotNull(), F.map_from_arrays(keys, F.transform(keys, add)))
        return c

    def wrong(self, c: Column) -> Column:
        """What is wrong with a value, null where nothing is; null itself is always allowed."""
        if self.name == "number":
            return F.when(c.cast("double").isin(float("inf"), float("-inf")) | F.isnan(c.cast("double")), "not finite")
        if self.name == "enum" and not self.fold:
            return F.when(c.isNotNull() & ~c.isin(*self.vocabulary), "outside the vocabulary")
        if self.name in TOKENS:
            return F.when((c != "") & ~c.rlike(f"^(?:{TOKENS[self.name]})$"), f"no {self.name}")
        if self.name == "tagged":
            return F.when(c.isNotNull() & ~F.regexp_extract(c, r"(?s)^([^:]*): ", 1).isin(*self.vocabulary), "undeclared tag")
        if self.name == "list":
            return F.try_element_at(F.filter(F.transform(c, self.item.wrong), lambda x: x.isNotNull()), F.lit(1)) if self.item.name in ("enum", "tagged", *TOKENS) else F.lit(None).cast("string")
        return F.lit(None).cast("string")


NUMBER, BOOLEAN, SENTENCE, NOTE = Kind("number"), Kind("boolean"), Kind("sentence"), Kind("note", words=120, own_words=("--no-llm", "--no-mine", "llm_disabled", "mine_disabled", "CLI", "JSON"))
TAGGED = Kind("tagged", TASK_TYPES)
_VOCABULARY = tuple(dict.fromkeys([*LANGUAGES.values(), *IAC_COUNTERS, "Unknown"]))


def enum(*vocabulary: str, fold: bool = False) -> Kind:
    return Kind("enum", vocabulary, fold)


def listed(item: Kind) -> Kind:
    return Kind("list", item=item)


def counted(*keys: str) -> Kind:
    return Kind("map", keys)


def withheld(reason: str) -> Kind:
    return Kind("withheld", reason=reason)


_no_table = withheld("no provider table is read")
#: The flat row: its columns in order, each with its kind.
ROW = {
    "id": withheld("given by the platform"), "codebase_id": withheld("given by the platform"), "service_id": withheld("given by the platform"), "repo_digest": Kind("digest"), "real_repo_name": withheld("names stay with their owner"), "fake_repo_name": Kind("handle"),
    "status": enum("measured", "partial"), "skip_reason": enum("llm_disabled", "mine_disabled", "lanes_unavailable", "lanes_timed_out"), "measured_at": Kind("timestamp"), "loc": NUMBER, "zip_bytes": _no_table, "excluded_loc": _no_table, "languages": counted(*_VOCABULARY),
    "primary_language": enum(*_VOCABULARY, fold=True), "frontend_pct": _no_table, "backend_pct": _no_table, "test_loc": _no_table, "test_code_files": NUMBER, "test_spec_files": NUMBER, "test_ratio": NUMBER, "test_source_ratio": Kind("ratio"),
    "test_framework": listed(Kind("enum", (), True)), "has_ci": BOOLEAN, "ci_present": BOOLEAN, "ci_runs_tests": BOOLEAN, "detected_frameworks": listed(Kind("enum", (), True)), "commit_count": NUMBER, "author_count": NUMBER, "first_commit_at": Kind("timestamp"), "last_commit_at": Kind("timestamp"),
    "active_days": NUMBER, "span_days": NUMBER, "commits_by_month": listed(NUMBER), "pr_count": _no_table, "issue_count": _no_table, "repo_class": enum(*CLASSES), "is_likely_demo": BOOLEAN, "quality_score": withheld("no longer given"), "build_ok": BOOLEAN, "testable_at_head": BOOLEAN, "capacity": NUMBER,
}


@dataclass(frozen=True)
class Spec:
    """A document's declared fields."""

    fields: dict[str, Kind]
    extra: tuple[str, ...] = field(default=())  # columns that are carried along unchecked, such as a key

    def problems(self, df: DataFrame) -> DataFrame:
        """(extra columns, field, problem): values that a write would refuse."""
        self._declared(df)
        found = [F.struct(F.lit(n).alias("field"), k.wrong(F.col(f"`{n}`")).alias("problem")) for n, k in self.fields.items() if n in df.columns and k.name != "withheld"]
        return df.select(*self.extra, F.explode(F.array(*found)).alias("p")).select(*self.extra, "p.*").where("problem is not null")

    def enforce(self, df: DataFrame) -> DataFrame:
        """The document as it may go out; a value that its kind refuses fails the job when it is read."""
        self._declared(df)
        checked = lambda n, k: F.when(k.wrong(F.col(f"`{n}`")).isNotNull(), F.raise_error(F.concat(F.lit(f"refusing to write {n}: "), k.wrong(F.col(f"`{n}`"))))).otherwise(k.value(F.col(f"`{n}`")))
        typed = {f.name: f.dataType for f in df.schema.fields}
        out = [checked(n, k).cast(T.MapType(T.StringType(), T.DoubleType()) if k.name == "map" else typed[n]).alias(n) if k.name != "withheld" else F.lit(None).cast("string").alias(n) for n, k in self.fields.items() if n in df.columns or k.name == "withheld"]
        return df.select(*self.extra, *out)

    def _declared(self, df: DataFrame) -> None:
        unknown = set(df.columns) - set(self.fields) - set(self.extra)
        if unknown:
            raise ValueError(f"not declared: {sorted(unknown)}")

    def review(self, df: DataFrame) -> DataFrame:
        """(kind, fields, present, missing): how many values of each kind a document holds, and how many are null."""
        rows = [F.struct(F.lit(k.group).alias("kind"), F.lit(n).alias("name"), (F.col(f"`{n}`").isNotNull() if n in df.columns and k.name != "withheld" else F.lit(False)).alias("there")) for n, k in self.fields.items()]
        long = df.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
        return long.groupBy("kind").agg(F.countDistinct("name").alias("fields"), F.sum(F.col("there").cast("int")).alias("present"), F.sum((~F.col("there")).cast("int")).alias("missing"))

    def withheld(self) -> dict[str, str]:
        return {n: k.reason for n, k in self.fields.items() if k.name == "withheld"}

    def keys(self) -> set[str]:
        """Names of fields, and words of closed vocabularies."""
        return set(self.fields) | {w for k in self.fields.values() for w in (*k.vocabulary, *(("other",) if k.vocabulary else ()))}
