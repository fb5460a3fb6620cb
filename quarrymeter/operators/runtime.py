"""Runtime versions: what a tree declares, specs to windows, containment, resolution with nearest floor."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW_TYPE = "array<struct<low:array<int>,high:array<int>>>"
#: Specs that constrain nothing, release names of a lane, parts of a bare version that bind it.
ANY = ("", "*", "x", "latest", "current", "node", "system", "stable", "default")
NODE_NAMES = {"argon": 4, "boron": 6, "carbon": 8, "dubnium": 10, "erbium": 12, "fermium": 14, "gallium": 16, "hydrogen": 18, "iron": 20, "jod": 22, "krypton": 24}
PRECISION = {"python": 2, "ruby": 2, "go": 2, "rust": 2, "node": 1, "java": 1, "dotnet": 1}
#: A Java release level and the first JDK that no longer builds it (levels up to 7, and 8).
JAVA_ENDS = {7: 20, 8: 25}
_CLAUSE = re.compile(r"(>=|<=|==|!=|~=|\^|~|>|<|=)?\s*v?([0-9][0-9.]*[0-9x*]?|\d)")


def numbers(text: str) -> list[int]:
    """Up to three numbers of the first version in a text."""
    m = re.search(r"\d+(?:\.\d+){0,2}", text or "")
    return [int(x) for x in m[0].split(".")] if m else []


def _after(v: list[int], place: int) -> list[int]:
    """The first version above all that agree with v up to a place."""
    head = (v + [0] * (place + 1))[: place + 1]
    return [*head[:-1], head[-1] + 1]


def _window(low: list[int] | None, high: list[int] | None) -> dict:
    return {"low": low, "high": high}


def _line(v: list[int]) -> dict:
    """The window of one release line."""
    return _window(v, _after(v, len(v) - 1))


def _java(text: str) -> list[dict]:
    level = numbers(text)
    if len(level) > 1 and level[0] == 1:
        level = level[1:]  # 1.8 and 8 are the same
    if not level:
        return []
    end = next((top for limit, top in JAVA_ENDS.items() if level[0] <= limit), None)
    return [_window(level[:1], [end] if end else None)]


def _range(branch: str) -> dict | None:
    """Window of clauses that all hold; null ends are open."""
    low = high = None
    seen = False
    for op, raw in _CLAUSE.findall(branch):
        v = numbers(raw)
        if not v:
            continue
        seen = True
        last = len(v) - 1
        if op in (">=", ">"):
            bound = v if op == ">=" else _after(v, last)
            low = bound if low is None else max(low, bound)
        elif op in ("<", "<="):
            bound = v if op == "<" else _after(v, last)
            high = bound if high is None else min(high, bound)
        elif op == "^":
            low, high = v, _after(v, 1 if v[0] == 0 and last else 0)
        elif op in ("~", "~="):
            low, high = v, _after(v, min(1, last))
        elif op != "!=":
            low, high = v, _after(v, last)
    return _window(low, high) if seen else None


def windows_of(spec: str | None, lane: str = "", floor: bool = False) -> list[dict]:
    """Windows [low, high) that a declaration allows; an empty list where nothing constrains it.

    A bare version is a pin that binds as far as its lane's releases are
    compatible, or with ``floor`` a minimum. '||' separates alternatives; clauses
    of one alternative narrow the same window.
    """
    text = (spec or "").strip().strip("\"'")
    if text in ANY:
        return []
    if lane == "node":
        name = text.lower().replace("lts/", "").strip()
        if name in NODE_NAMES:
            return [_line([NODE_NAMES[name]])]
        if text.lower().startswith("lts"):
            return []
    if lane == "java":
        return _java(text)
    if not re.search(r"[><=^~*|]|\bx\b|\.x", text):
        v = numbers(text)
        if not v:
            return []
        base = v[: max(PRECISION.get(lane, 2), 2 if v[0] == 0 else 0)]
        return [_window(base, None) if floor else _line(base)]
    return [w for w in map(_range, text.split("||")) if w]


def display(spec: str | None, lane: str = "", floor: bool = False) -> str:
    """The ask as one plain token."""
    windows = windows_of(spec, lane, floor)
    if not windows:
        return re.sub(r"[^A-Za-z0-9._@+-]", "", spec or "")[:40] or "any"
    low, high = windows[0]["low"], windows[-1]["high"]
    word = lambda v: ".".join(map(str, v)) if v else ""
    if low and high == _after(low, len(low) - 1):
        return word(low)
    return f"{word(low)}-{word(high)}" if low and high else word(low) or (f"to-{word(high)}" if high else "any")


def with_windows(rows: DataFrame, spec: str, to: str = "windows", lane: str | None = None, floor: str | None = None) -> DataFrame:
    """Adds the windows of a spec column and the ask as a token, ``requested`` (Arrow batches; the grammar has no column form)."""

    @F.pandas_udf(f"struct<windows:{WINDOW_TYPE},requested:string>")
    def parse(s: pd.Series, lanes: pd.Series, floors: pd.Series) -> pd.DataFrame:
        keys = list(zip(s.where(s.notna(), None), lanes, floors, strict=True))
        known = {k: (windows_of(*k), display(*k)) for k in set(keys)}
        return pd.DataFrame({"windows": [known[k][0] for k in keys], "requested": [known[k][1] for k in keys]})

    got = parse(F.col(spec), F.col(lane) if lane else F.lit(""), F.coalesce(F.col(floor), F.lit(False)) if floor else F.lit(False))
    out = rows.withColumn("_w", got)
    return out.withColumn(to, F.when(F.col(spec).isNotNull(), F.col("_w.windows"))).withColumn("requested", F.col("_w.requested")).drop("_w")


def contains(version: Column, windows: Column) -> Column:
    """Whether a version (array<int>) lies in one of the windows; no windows allow all."""
    cut = lambda bound: F.slice(version, 1, F.size(bound))
    inside = F.exists(windows, lambda w: (w["low"].isNull() | (cut(w["low"]) >= w["low"])) & (w["high"].isNull() | (cut(w["high"]) < w["high"])))
    return F.when(windows.isNull(), F.lit(None)).when(F.size(windows) == 0, F.lit(True)).otherwise(inside)


def declarations(files: DataFrame) -> DataFrame:
    """(repo, lane, spec, source, floor): what the files of every root ask for, the most specific source of each lane.

    Every source is a column expression over one file; the order of SOURCES decides.
    """
    t = F.col("text")
    first_line = F.try_element_at(F.filter(F.transform(F.split(t, r"\r\n|\r|\n"), lambda x: F.trim(F.regexp_replace(x, "#.*$", ""))), lambda x: x != ""), F.lit(1))
    group = lambda p: F.nullif(F.trim(F.regexp_extract(t, "(?im)" + p, 1)), F.lit(""))
    json = lambda p: F.get_json_object(t, p)
    channel = F.coalesce(group(r"channel\s*=\s*[\"']([^\"']+)"), F.when(~t.contains("=") & ~t.contains("["), F.trim(F.regexp_extract(t, r"^\s*([^\r\n]+)", 1))))
    gradle = ("build.gradle", "build.gradle.kts", "gradle.properties")
    #: (lane, files, spec, source, is a floor), the most specific first.
    sources = (
        ("node", (".nvmrc",), first_line, ".nvmrc", False), ("node", (".node-version",), first_line, ".node-version", False), ("node", ("package.json",), json("$.engines.node"), "package.json engines", False), ("node", ("package.json",), json("$.volta.node"), "package.json volta", False),
        ("python", (".python-version",), first_line, ".python-version", False), ("python", ("pyproject.toml",), group(r"^\s*requires-python\s*=\s*[\"']([^\"']+)"), "pyproject requires-python", False),
        ("python", ("pyproject.toml",), group(r"^\s*python\s*=\s*[\"']([^\"']+)"), "pyproject poetry python", False), ("python", ("setup.py",), group(r"python_requires\s*=\s*[\"']([^\"']+)"), "setup.py python_requires", False),
        ("python", ("setup.cfg",), group(r"^\s*python_requires\s*=\s*(.+)$"), "setup.cfg python_requires", False), ("python", ("runtime.txt",), group(r"python-([0-9.]+)"), "runtime.txt", False),
        ("go", ("go.mod",), group(r"^\s*go\s+([0-9][0-9.]*)"), "go.mod go", True), ("rust", ("rust-toolchain.toml", "rust-toolchain"), channel, "rust-toolchain", False), ("rust", ("Cargo.toml",), group(r"^\s*rust-version\s*=\s*[\"']([^\"']+)"), "Cargo.toml rust-version", True),
        ("ruby", (".ruby-version",), first_line, ".ruby-version", False), ("ruby", ("Gemfile",), group(r"^\s*ruby\s+[\"']([^\"']+)"), "Gemfile ruby", False),
        *[("java", ("pom.xml",), group(f"<{tag}>([^<]+)<"), f"pom.xml {name}", False) for tag, name in ((r"maven\.compiler\.release", "compiler release"), (r"maven\.compiler\.source", "compiler source"), (r"java\.version", "java version"), ("release", "release"), ("source", "source"))],
        ("java", gradle, group(r"JavaLanguageVersion\.of\((\d+)"), "gradle toolchain", False), ("java", gradle, group(r"(?:source|target)Compatibility\s*=?\s*[\"']?(?:JavaVersion\.VERSION_)?([0-9_.]+)"), "gradle compatibility", False),
        ("dotnet", ("global.json",), json("$.sdk.version"), "global.json sdk", False),
    )
    made = F.array(*[F.when(F.col("path").isin(*names), F.struct(F.lit(lane).alias("lane"), F.substring(spec, 1, 60).alias("spec"), F.lit(src).alias("source"), F.lit(flr).alias("floor"), F.lit(i).alias("priority"))) for i, (lane, names, spec, src, flr) in enumerate(sources)])
    by_file = files.where(~F.col("path").contains("/")).select("repo", "path", F.explode(F.array_compact(made)).alias("d")).select("repo", "path", "d.*")
    #: Names of lanes in .tool-versions.
    alias = F.create_map(*[F.lit(x) for kv in {"nodejs": "node", "node": "node", "python": "python", "golang": "go", "go": "go", "rust": "rust", "ruby": "ruby", "java": "java", "dotnet": "dotnet", "dotnet-core": "dotnet"}.items() for x in kv])
    words = files.where("path = '.tool-versions'").select("repo", "path", F.posexplode(F.split(t, "\n")).alias("line", "x")).withColumn("w", F.split(F.trim(F.regexp_replace("x", "#.*$", "")), r"\s+")).where("size(w) > 1")
    tools = words.select("repo", "path", F.try_element_at(alias, F.lower(F.col("w")[0])).alias("lane"), F.regexp_replace(F.col("w")[1], r"(?i)^[a-z-]+-", "").alias("spec"), F.lit(".tool-versions").alias("source"), F.lit(False).alias("floor"), (F.lit(len(sources)) + F.col("line")).alias("priority"))
    every = by_file.unionByName(tools).where("lane is not null and trim(spec) <> ''")
    best = F.min_by(F.struct(F.trim("spec").alias("spec"), "source", "floor"), F.struct("priority", "path"))
    return every.groupBy("repo", "lane").agg(best.alias("d")).select("repo", "lane", "d.*")


def resolve(declared: DataFrame, candidates: DataFrame) -> DataFrame:
    """For each declaration (id, lane, windows): the default candidate if allowed, else the one nearest the floor, newest first.

    candidates: (lane, version array<int>, is_default). A lane is one key for a
    large part of all declarations, so distinct (lane, windows) are resolved, and
    the answers joined back; candidates are a host's few runtimes.
    """
    asked = declared.select("lane", "windows").distinct()
    hit = asked.join(candidates, "lane").where(contains(F.col("version"), F.col("windows")))
    low = F.try_element_at("windows", F.lit(1))["low"]
    nearest = F.when(low.isNotNull(), F.slice("version", 1, F.size(low)))
    newest = F.transform("version", lambda x: -x)
    w = Window.partitionBy("lane", "windows").orderBy(F.desc("is_default"), F.asc_nulls_last(nearest), newest)
    best = hit.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("lane", "windows", "version", "is_default")
    best = best.select(F.col("lane").alias("_l"), F.col("windows").alias("_w"), "version", "is_default")
    return declared.join(best, F.col("lane").eqNullSafe(F.col("_l")) & F.col("windows").eqNullSafe(F.col("_w")), "left").drop("_l", "_w").withColumn("satisfied", F.col("version").isNotNull())


def summary(records: DataFrame, by: str) -> DataFrame:
    """(key, lanes, requested, used, unsatisfied) over (key, project, lane, requested, used, satisfied): the first record of each lane."""
    first = records.groupBy(by, "lane").agg(F.min_by(F.struct("project", "requested", "used", "satisfied"), "project").alias("r"))
    ordered = lambda value: F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(F.col("r.project").alias("p"), F.col("lane").alias("l"), value.alias("v"))))), lambda x: x["v"])
    at = lambda c: F.concat("lane", F.lit("@"), c)
    return first.groupBy(by).agg(ordered(F.col("lane")).alias("lanes"), ordered(at(F.col("r.requested"))).alias("requested"), ordered(at(F.col("r.used"))).alias("used"), ordered(F.when(~F.col("r.satisfied"), F.col("lane"))).alias("unsatisfied"))


def first_of_lane(declarations: DataFrame) -> DataFrame:
    """Declaration with the best priority of each repo and lane."""
    w = Window.partitionBy("repo", "lane").orderBy("priority", "spec")
    return declarations.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
