"""Source trees: file scan, manifests, CI files, decisions for each function.

Files are read by a data source of their own, because Spark's file readers leave
out hidden files; folders that are skipped are pruned before they are listed.
"""

from __future__ import annotations

import ast
import json
import os
import re
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringEndsWith, StringStartsWith

from ..functions.paths import CI_CONFIG, KEPT_DOT_DIRS, SKIP_DIRS, extension
from ..functions.text import ci_commands, dependency_name, requirement_name, substituted
from ..operators import lines
from ..vocab import CI_FILES
from . import decisions as brackets
from .git import listed, pushdown


#: Larger files aren't parsed for decisions.
PARSED_BYTES = 1_000_000


class _Folder(InputPartition):
    def __init__(self, root: str, below: str, deep: bool):
        super().__init__((root, below))
        self.root, self.below, self.deep = root, below, deep


class TreeReader(DataSourceReader):
    """Walks a tree folder by folder; each folder of the root is a partition, and so are the root's own files."""

    def __init__(self, options: dict):
        self.roots = listed(options, "roots", "root")
        self.everything = str(options.get("everything", "false")).lower() == "true"
        self.most = int(options.get("maxlength", 2**31 - 1))
        self.content = str(options.get("content", "true")).lower() == "true"
        self.only: dict[str, set] = {}
        self.starts: list[str] = []
        self.ends: list[str] = []

    def _entries(self, store, folder: str) -> list:
        from pyarrow import fs

        found = store.get_file_info(fs.FileSelector(folder, recursive=False, allow_not_found=True))
        plain = lambda f: not (isinstance(store, fs.LocalFileSystem) and os.path.islink(f.path))
        return sorted((f for f in found if plain(f)), key=lambda f: f.base_name)

    def _enters(self, name: str, below: str) -> bool:
        """Whether a folder (its name, and its path below the root) is listed."""
        if not (name != ".git" if self.everything else name in KEPT_DOT_DIRS or not (name in SKIP_DIRS or name.startswith("."))):
            return False
        inside = f"{below}/"
        meets = lambda p: p.startswith(inside) or inside.startswith(p)
        return all(map(meets, self.starts)) and ("path" not in self.only or any(p.startswith(inside) for p in self.only["path"] if p))

    def _takes(self, path: str) -> bool:
        return path in self.only.get("path", (path,)) and all(map(path.startswith, self.starts)) and all(map(path.endswith, self.ends))

    def partitions(self):
        out = []
        for root in self.roots:
            if root not in self.only.get("repo", (root,)):
                continue
            store, base = _store(root)
            out.append(_Folder(root, "", False))
            out += [_Folder(root, f.base_name, True) for f in self._entries(store, base) if f.is_file is False and self._enters(f.base_name, f.base_name)]
        return out

    def read(self, partition: _Folder):
        store, base = _store(partition.root)
        todo = [f"{base}/{partition.below}".rstrip("/")]
        while todo:
            for f in self._entries(store, todo.pop()):
                below = f.path[len(base) :].lstrip("/")
                if not f.is_file:
                    if partition.deep and self._enters(f.base_name, below):
                        todo.append(f.path)
                    continue
                if not self._takes(below):
                    continue
                if not self.content:
                    yield partition.root, below, f.size
                    continue
                content = None
                if (f.size or 0) <= self.most:
                    with store.open_input_file(f.path) as x:
                        content = x.read()
                yield partition.root, below, f.size, content


class FilteredTreeReader(TreeReader):
    """Takes filters in; Spark refuses such a reader where filter pushdown is off."""

    def pushFilters(self, filters):
        """Takes equalities and lists on repo and path, and beginnings and ends of path; all others stay with Spark."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in ("repo", "path") and isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only[name] = self.only[name] & values if name in self.only else values
            elif name == "path" and isinstance(f, StringStartsWith):
                self.starts.append(f.value)
            elif name == "path" and isinstance(f, StringEndsWith):
                self.ends.append(f.value)
            elif not (name in ("repo", "path") and isinstance(f, IsNotNull)):  # these columns never are null
                yield f


class TreeSource(DataSource):
    """``tree``: (repo, path, size, content) of all files below the folders ``roots``, a JSON array or names separated by commas.

    Folders that are left out by name are never listed; ``everything`` reads all
    but ``.git``. Links are not followed. Files above ``maxlength`` bytes (2 GB)
    keep their row with null content. Where ``content`` is false there is no such
    column and no file is opened. With the option ``pushdown`` (and Spark's
    ``spark.sql.python.filterPushdown.enabled``) filters on repo and path are taken in: folders
    that can't hold a wanted path aren't listed, and files that aren't wanted aren't opened.
    """

    @classmethod
    def name(cls):
        return "tree"

    def schema(self):
        return "repo string, path string, size long" + (", content binary" if str(self.options.get("content", "true")).lower() == "true" else "")

    def reader(self, schema):
        options = dict(self.options)
        return FilteredTreeReader(options) if options.get("pushdown") == "true" else TreeReader(options)


def _store(root: str):
    from pyarrow import fs

    if "://" in root:
        store, path = fs.FileSystem.from_uri(root)
        return store, path.rstrip("/")
    return fs.LocalFileSystem(), os.path.abspath(root)


def scan(spark: SparkSession, roots: str | list[str], everything: bool = False, content: bool = True) -> DataFrame:
    """(repo, path, ext, size, content) of all files below the roots, relative paths; with ``everything`` also those in skipped folders, without ``content`` no file is opened."""
    spark.dataSource.register(TreeSource)
    told = {"roots": json.dumps([roots] if isinstance(roots, str) else roots), "everything": str(everything).lower(), "content": str(content).lower(), "pushdown": pushdown(spark)}
    return spark.read.format("tree").options(**told).load().withColumn("ext", extension(F.col("path")))


def as_text(files: DataFrame) -> DataFrame:
    """Adds ``text``; bytes that aren't UTF-8 are replaced."""
    return files.withColumn("text", F.make_valid_utf8(F.col("content").cast("string")))


# ------------------------------------------------------------- state readers
def make_recipes(text: str) -> dict[str, list[str]]:
    """Commands of each Makefile target: its indented lines up to the next line that is neither indented, blank nor a comment."""
    out: dict[str, list[str]] = {}
    now = None
    for line in text.splitlines():
        if m := re.match(r"^([A-Za-z0-9_./-]+)\s*:(?!=)", line):
            now = m[1]
            out.setdefault(now, [])
        elif now and line.startswith(("\t", "    ")):
            out[now].append(line.strip().lstrip("@-+").strip())
        elif line.strip() and not line.startswith("#"):
            now = None
    return out


def _json(text: str) -> dict:
    try:
        got = json.loads(text)
    except ValueError:
        return {}
    return got if isinstance(got, dict) else {}


def _toml(text: str) -> dict:
    try:
        return tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return {}


def _tables(d: dict, *path: str) -> list[dict]:
    """The table at a path of keys, in a list; empty where there is none. '*' stands for every key."""
    found = [d]
    for key in path:
        found = [v for x in found if isinstance(x, dict) for v in (x.values() if key == "*" else [x.get(key)])]
    return [x for x in found if isinstance(x, (dict, list))]


def manifest_names(path: str, text: str) -> list[tuple[str, str, bool]]:
    """(ecosystem, name, is a requirement line) of the dependencies in a manifest of the root; unreadable ones give none."""
    keys = lambda eco, tables: [(eco, k, False) for t in tables if isinstance(t, dict) for k in t]
    specs = lambda lists: [("pypi", x, True) for v in lists if isinstance(v, list) for x in v if isinstance(x, str)]
    found = lambda eco, pattern, g=1: [(eco, m[g], False) for m in re.finditer(pattern, text, re.M)]
    if path == "package.json":
        return keys("npm", [t for f in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies") for t in _tables(_json(text), f)])
    if path in ("requirements.txt", "requirements-dev.txt"):
        return [("pypi", x.partition("#")[0], True) for x in text.splitlines()]
    if path == "pyproject.toml":
        d = _toml(text)
        lists = [x for p in (("project", "dependencies"), ("project", "optional-dependencies", "*"), ("dependency-groups", "*"), ("build-system", "requires")) for x in _tables(d, *p)]
        poetry = [x for p in (("dependencies",), ("dev-dependencies",), ("group", "*", "dependencies")) for x in _tables(d, "tool", "poetry", *p)]
        return specs(lists) + keys("pypi", poetry)
    if path == "Pipfile":
        return keys("pypi", [t for f in ("packages", "dev-packages") for t in _tables(_toml(text), f)])
    if path == "setup.py":
        blocks = re.findall(r"(?:install|extras|setup|tests)_requires?\s*=\s*[\[{](.*?)[\]}]", text, re.S)
        return [("pypi", x, True) for b in blocks for x in re.findall(r"[\"']([^\"'\n]+)[\"']", b)]
    if path == "go.mod":
        return found("go", r"^\s*(?:require\s+)?([a-z0-9][a-z0-9.-]*\.[a-z]{2,}/\S+)\s+v\d")
    if path == "Cargo.toml":
        d = _toml(text)
        return keys("cargo", [t for p in (("dependencies",), ("dev-dependencies",), ("build-dependencies",), ("workspace", "dependencies")) for t in _tables(d, *p)])
    if path == "Gemfile":
        return found("gem", r"^\s*gem\s+['\"]([^'\"]+)['\"]")
    if path == "composer.json":
        return keys("composer", [t for f in ("require", "require-dev") for t in _tables(_json(text), f)])
    if path == "pom.xml":
        return found("maven", r"<(groupId|artifactId)>\s*([^<\s]+)\s*</\1>", 2)
    if path in ("build.gradle", "build.gradle.kts"):
        return found("maven", r"['\"]([A-Za-z0-9_.-]+:[A-Za-z0-9_.-]+)(?::[^'\"]*)?['\"]")
    return []


#: YAML manifests, the ecosystem of each and the sections that hold its dependencies.
YAML_MANIFESTS = {"environment.yml": ("pypi", ("dependencies", "pip")), "environment.yaml": ("pypi", ("dependencies", "pip")), "pubspec.yaml": ("pub", ("dependencies", "dev_dependencies"))}


def _line_manifests(root: DataFrame) -> DataFrame:
    """(repo, ecosystem, raw, line) of the manifests that are read line by line."""
    path = F.col("path")
    sections, ecosystem = F.lit(None).cast("array<string>"), F.lit(None).cast("string")
    for name, (eco, parts) in YAML_MANIFESTS.items():
        sections = F.when(path == name, F.array(*map(F.lit, parts))).otherwise(sections)
        ecosystem = F.when(path == name, eco).otherwise(ecosystem)
    entries = lines.yaml_section_entries(root.where(path.isin(*YAML_MANIFESTS)), ["repo", "path"], sections)
    cfg = lines.setup_cfg_entries(root.where(path == "setup.cfg"), ["repo", "path"])
    return entries.select("repo", ecosystem.alias("ecosystem"), F.col("entry").alias("raw"), F.lit(False).alias("line")).unionByName(cfg.select("repo", F.lit("pypi").alias("ecosystem"), F.col("entry").alias("raw"), F.lit(True).alias("line")))


def dependencies(files: DataFrame) -> DataFrame:
    """Distinct (repo, ecosystem, name) over the manifests of every repository's root."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(r, e, n, q) for r, p, t in zip(b.repo, b.path, b.text, strict=True) if t for e, n, q in manifest_names(p, t)]
            yield pd.DataFrame(rows, columns=["repo", "ecosystem", "raw", "line"])

    root = files.where(~F.col("path").contains("/")).select("repo", "path", "text")
    raw = root.where(~F.col("path").isin("setup.cfg", *YAML_MANIFESTS)).mapInPandas(run, "repo string, ecosystem string, raw string, line boolean").unionByName(_line_manifests(root))
    name = F.when(F.col("line"), requirement_name(F.col("raw"))).otherwise(dependency_name(F.col("raw")))
    return raw.select("repo", "ecosystem", name.alias("name")).where("name is not null").distinct()


# ---------------------------------------------------------------------- CI
#: Keys that hold commands, and guards that are constantly false.
CI_KEYS = ("run", "script", "before_script", "after_script", "commands", "command")
CI_OFF = ("false", "${{ false }}", "${{false}}", "0", "no", "off")
_JENKINS = re.compile(r"\b(?:sh|bat|powershell)\s*(?:\(\s*)?(?:'''(.*?)'''|\"\"\"(.*?)\"\"\"|'([^']*)'|\"([^\"]*)\")", re.S)


def ci_steps(path: str, text: str) -> list[tuple[str, str, str]] | None:
    """(kind, name, value) of a CI file: run blocks, used actions and variables. None where it can't be read."""
    if path.rsplit("/", 1)[-1].lower().startswith("jenkinsfile"):
        return [("run", "", next(filter(None, m.groups()), "")) for m in _JENKINS.finditer(text)]
    import yaml

    try:
        doc = yaml.safe_load(text)
    except yaml.YAMLError:
        return None
    off = lambda guard: guard is False or (isinstance(guard, str) and guard.strip().lower() in CI_OFF)
    out: list[tuple[str, str, str]] = []

    def commands(x) -> list[str]:
        if isinstance(x, dict):
            x = x.get("command")
        return [x] if isinstance(x, str) else [s for y in x for s in commands(y)] if isinstance(x, list) else []

    def walk(x, live: bool) -> None:
        for y in x if isinstance(x, list) else ():
            walk(y, live)
        if not isinstance(x, dict):
            return
        live = live and not off(x.get("if")) and not off(x.get("when"))
        for k, v in x.items():
            key = k.lower() if isinstance(k, str) else ""
            if k == "env" and isinstance(v, dict):
                out.extend(("env", str(n), str(w)) for n, w in v.items() if isinstance(w, (str, int, float, bool)))
            if live and key in CI_KEYS:
                out.extend(("run", "", c) for c in commands(v))
            elif live and key == "uses" and isinstance(v, str):
                out.append(("uses", "", v))
            else:
                walk(v, live)

    walk(doc, True)
    return out


#: What a CI command, or an action, does (from its beginning); builds that skip the tests; texts that deploy.
CI_COMMANDS = {
    "tests": (
        r"(?i)^(?:pytest|py\.test|tox|nox|behave|robot|python[0-9.]*\s+-m\s+(?:pytest|unittest|nose2|tox|nox)|python[0-9.]*\s+setup\.py\s+test|jest|vitest|mocha|ava|karma|jasmine|tap|(?:npm|yarn|pnpm|bun)\s+(?:-\S+\s+)*(?:run\s+)?(?:test|tests)\b"
        r"|go\s+test|gotestsum|cargo\s+(?:test|nextest\s+run)|(?:\./)?gradlew?(?:\.bat)?\s+.*\b(?:test|check|build)\b|(?:\./)?mvnw?\s+.*\b(?:test|verify|install)\b|make\s+.*\b(?:test|tests|check|coverage)\b|just\s+.*\b(?:test|check)\b"
        r"|rspec|rake\s+(?:test|spec)|minitest|phpunit|\S*vendor/bin/phpunit|composer\s+(?:run-script\s+)?test|dotnet\s+test|ctest|bazel\s+test|ninja\s+test|swift\s+test|playwright\s+test|cypress\s+run|coverage\s+run|pytest-\S+)\b"
    ),
    "lint": (
        r"(?i)^(?:eslint|pylint|ruff|flake8|golangci-lint|clippy|cargo\s+clippy|rubocop|black|isort|prettier|shellcheck|stylelint|standardrb|credo|swiftlint|ktlint|(?:npm|yarn|pnpm|bun)\s+(?:-\S+\s+)*(?:run\s+)?lint"
        r"|pre-commit\s+run|make\s+.*\blint\b|tox\s+.*\blint\b|nox\s+.*\blint\b)\b"
    ),
    "typecheck": r"(?i)^(?:tsc|mypy|pyright|pyre|flow\s+check|(?:npm|yarn|pnpm|bun)\s+(?:-\S+\s+)*(?:run\s+)?type[-:]?check|make\s+.*\btype.?check\b|tox\s+.*\b(?:mypy|type)\b|python[0-9.]*\s+-m\s+(?:mypy|pyright|pyre|ty)\b)\b",
}
CI_ACTIONS = {
    "lint": r"(?i)^(?:golangci/golangci-lint-action|reviewdog/action-|github/super-linter|super-linter/super-linter|psf/black|astral-sh/ruff-action|chartboost/ruff-action|pre-commit/action|rubocop/|wearerequired/lint-action)",
    "typecheck": r"(?i)^(?:jakebailey/pyright-action|tsuyoshicho/action-mypy|jpetrucciani/mypy-check)",
}
CI_SKIPS_TESTS = r"(?i)-DskipTests|-Dmaven\.test\.skip|(^|\s)-x\s+test\b|--no-run\b"
CI_DEPLOYS = r"(?i)\bdeploy\b|\brelease\b|\bpublish\b|\bpush.*ecr\b|\bpush.*registry\b"
#: Commands that hand over to a Makefile target, a package script or a shell script.
MAKE_CALL = r"(?i)^make(?:\s+-\S+|\s+\S+=\S*)*\s+([A-Za-z0-9_./-]+)"
SCRIPT_CALL = r"(?i)^(?:npm|yarn|pnpm|bun)\s+(?:-\S+\s+)*(?:run(?:-script)?\s+)?([A-Za-z0-9:_-]+)"
SHELL_CALL = r"^(?:(?:ba|z|k|da)?sh\s+(?:-\S+\s+)*)?(\.?/?[A-Za-z0-9_./-]+\.(?:sh|bash))\b"


def called(command: Column) -> Column:
    """What a command hands over to, as a key of ``recipes``; null where it does the work itself."""
    to = lambda kind, pattern: F.concat(F.lit(kind), F.regexp_extract(command, pattern, 1))
    script = F.concat(F.lit("sh:"), F.regexp_replace(F.regexp_extract(command, SHELL_CALL, 1), r"^[./]+", ""))
    return F.when(command.rlike(MAKE_CALL), to("make:", MAKE_CALL)).when(command.rlike(SCRIPT_CALL), to("npm:", SCRIPT_CALL)).when(command.rlike(SHELL_CALL), script)


def recipes(files: DataFrame) -> DataFrame:
    """(repo, called, body): bodies of Makefile targets, package scripts and shell scripts, as arrays of commands."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(r, p, k, "\n".join(v)) for r, p, t in zip(b.repo, b.path, b.text, strict=True) for k, v in make_recipes(t or "").items() if v]
            yield pd.DataFrame(rows, columns=["repo", "path", "target", "lines"])

    names = ("Makefile", "makefile", "GNUmakefile")
    made = files.where(F.col("path").isin(*names)).select("repo", "path", F.substring("text", 1, 262144).alias("text")).mapInPandas(run, "repo string, path string, target string, lines string")
    order = F.array_position(F.array(*map(F.lit, names)), F.col("path"))
    made = made.groupBy("repo", "target").agg(F.min_by("lines", order).alias("lines")).select("repo", F.concat(F.lit("make:"), "target").alias("called"), "lines")
    scripts = files.where("path = 'package.json'").select("repo", F.explode(F.from_json(F.get_json_object("text", "$.scripts"), "map<string,string>")).alias("k", "lines")).select("repo", F.concat(F.lit("npm:"), "k").alias("called"), "lines")
    shell = files.where(F.col("path").rlike(r"\.(sh|bash)$")).select("repo", F.concat(F.lit("sh:"), "path").alias("called"), F.substring("text", 1, 131072).alias("lines"))
    return made.unionByName(scripts).unionByName(shell).select("repo", "called", ci_commands(F.col("lines")).alias("body"))


def ci_read(files: DataFrame) -> DataFrame:
    """(repo, path, ok, kind, name, value) of all CI files; a row without kind says whether a file could be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r, p, t in zip(b.repo, b.path, b.text, strict=True):
                got = ci_steps(p, t or "")
                rows += [(r, p, got is not None, None, None, None), *((r, p, True, *x) for x in got or ())]
            yield pd.DataFrame(rows, columns=["repo", "path", "ok", "kind", "name", "value"])

    return files.select("repo", "path", F.substring("text", 1, 16384).alias("text")).mapInPandas(run, "repo string, path string, ok boolean, kind string, name string, value string")


def ci_flags(files: DataFrame) -> DataFrame:
    """(repo, ci_systems, ci_tests, ci_lint, ci_typecheck, ci_deploy, ci_method) of every repository with CI files.

    files: (repo, path, text) of all files. Commands that hand over to a recipe of
    the same repository are followed two levels deep; a body that settles what
    a command does stands in its place. A flag is null where nothing could be read.
    """
    ci = files.where(F.col("path").rlike(CI_CONFIG))
    read = ci_read(ci)
    env = read.where("kind = 'env'").groupBy("repo", "path").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("name", "value")))).alias("env"))
    blocks = read.where("kind = 'run'").join(env, ["repo", "path"], "left")
    top = blocks.select("repo", F.explode(ci_commands(substituted(F.col("value"), F.col("env")))).alias("c0")).distinct()
    bodies = recipes(files)
    hand = lambda level: bodies.select("repo", F.col("called").alias(f"k{level}"), F.col("body").alias(f"body{level}"))
    settles = lambda c: F.coalesce(c.rlike("|".join(f"(?:{p})" for p in CI_COMMANDS.values())), F.lit(False))
    none = F.array().cast("array<string>")
    one = top.withColumn("k0", called(F.col("c0"))).join(hand(0), ["repo", "k0"], "left").select("repo", "c0", F.explode_outer("body0").alias("c1"))
    two = one.withColumn("k1", called(F.col("c1"))).join(hand(1), ["repo", "k1"], "left").withColumn("body1", F.coalesce("body1", none))
    inner = F.when(F.col("c1").isNull(), none).when(F.exists("body1", settles), F.col("body1")).otherwise(F.concat(F.array("c1"), "body1"))
    per = two.withColumn("inner", inner).groupBy("repo", "c0").agg(F.flatten(F.collect_list("inner")).alias("body"))
    done = per.select("repo", F.explode(F.when(F.exists("body", settles), F.col("body")).otherwise(F.concat(F.array("c0"), "body"))).alias("cmd"))
    hit = lambda k: F.col("cmd").rlike(CI_COMMANDS[k]) & (~F.col("cmd").rlike(CI_SKIPS_TESTS) if k == "tests" else F.lit(True))
    runs = done.groupBy("repo").agg(*[F.max(hit(k)).alias(k) for k in CI_COMMANDS])
    uses = read.groupBy("repo").agg(F.max("ok").alias("ok"), *[F.max((F.col("kind") == "uses") & F.col("value").rlike(p)).alias(f"uses_{k}") for k, p in CI_ACTIONS.items()])
    names = F.create_map(*[F.lit(x) for kv in CI_FILES for x in kv])
    order = F.create_map(*[F.lit(x) for i, (_, n) in enumerate(CI_FILES) for x in (n, i)])
    system = F.coalesce(F.try_element_at(names, F.col("path")), F.lit("GitHub Actions"))
    systems = ci.groupBy("repo").agg(
        F.transform(F.array_sort(F.collect_set(F.struct(F.coalesce(F.try_element_at(order, system), F.lit(99)).alias("o"), system.alias("s")))), lambda x: x["s"]).alias("ci_systems"),
        F.max(F.substring("text", 1, 16384).rlike(CI_DEPLOYS)).alias("ci_deploy"),
    )
    known = lambda k: F.when(F.col("ok"), F.coalesce(F.col(k), F.lit(False)) | (F.coalesce(F.col(f"uses_{k}"), F.lit(False)) if k in CI_ACTIONS else F.lit(False)))
    out = systems.join(uses, "repo", "left").join(runs, "repo", "left")
    return out.select("repo", "ci_systems", *[known(k).alias(f"ci_{k}") for k in CI_COMMANDS], "ci_deploy", F.when(F.col("ok"), "parsed").otherwise("parser_unavailable").alias("ci_method"))


def python_decisions(text: str) -> list[tuple[str, int]] | None:
    """(function, decisions) of Python source; None if it doesn't parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return None
    branch = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.BoolOp, ast.match_case, ast.Assert)
    out = []

    def count(node) -> int:
        n = 0
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                continue
            n += isinstance(child, branch) + count(child)
        return n

    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out.append((node.name, count(node)))
    return out


def function_decisions(files: DataFrame) -> DataFrame:
    """(repo, path, parsed, function, decisions); files that don't parse or exceed PARSED_BYTES keep one row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r, p, e, t in zip(b.repo, b.path, b.ext, b.text, strict=True):
                got = None if t is None else python_decisions(t) if e == ".py" else brackets.decisions(t, brackets.LANGUAGES[e]) if e in brackets.LANGUAGES else None
                rows += [(r, p, False, None, None)] if got is None else [(r, p, True, f, n) for f, n in got]
            yield pd.DataFrame(rows, columns=["repo", "path", "parsed", "function", "decisions"]).astype({"decisions": "Int32"})

    return files.select("repo", "path", "ext", F.when(F.col("size") <= PARSED_BYTES, F.col("text")).alias("text")).mapInPandas(run, "repo string, path string, parsed boolean, function string, decisions int")


def job_history(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the jobs in a folder (one job.json each), newest first; a time that can't be read is null and comes last."""
    jobs = spark.read.option("multiLine", True).json(f"{folder.rstrip('/')}/*/job.json")
    return jobs.withColumn("created", F.try_to_timestamp("created_at")).orderBy(F.desc_nulls_last("created"), "id")


def measured(spark: SparkSession, path: str) -> DataFrame:
    """Tree documents that were written before, as JSON."""
    return spark.read.json(path)
