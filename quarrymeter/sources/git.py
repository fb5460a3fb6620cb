"""Git history as a Spark data source, read at once or as a stream.

    spark.dataSource.register(GitSource)
    spark.read.format("git").option("repo", path).option("relation", "commits").load()
    spark.readStream.format("git").option("repo", path).option("history", folder).load()

Relations: commits, graph, commit_files, refs, trees, tags, status. ``repos`` lists several
repositories, as a JSON array or separated by commas: each is a partition.
History is read with fixed argument lists, record by record as git writes it, with
NUL between fields, which no name, subject or path can hold. The limit (20,000 commits
unless told otherwise, 0 for none) is passed to git; a tip that an anonymising tool
has added is left out where ``peel`` is set, unless it is the only commit.

``graph`` has the parents of every commit of all refs, without a limit, for
``operators.graph``; ``trees`` has figures of the trees of the commits in the option ``shas``.
``status`` has a row for each repository, so that one that git can't read is told apart
from an empty one. Both give no rows elsewhere; any other failure of git fails the read.

Filters by equality on ``repo``, and on ``ref``, ``tag`` or ``sha`` where git can look them up, are
taken into the source where its option ``pushdown`` is true, which needs Spark's
``spark.sql.python.filterPushdown.enabled``; ``read`` sets the one by the other. Repositories
that they leave out are not opened, and git is asked for the refs or commits named only.
"""

from __future__ import annotations

import hashlib
import json
import re
import subprocess
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition, IsNotNull

from ..functions.paths import ANONYMISER

SCHEMAS = {
    "commits": "repo string, sha string, author_name string, author_email string, author_ts timestamp, author_date string, subject string, parents array<string>, ord long",
    "graph": "repo string, sha string, parents array<string>",
    "commit_files": "repo string, sha string, path string, additions long, deletions long, is_binary boolean",
    "refs": "repo string, ref string, sha string",
    "trees": "repo string, sha string, files long, top_dirs long, last_commit string",
    "tags": "repo string, tag string, sha string",
    "status": "repo string, status string, detail string, head string, reachable long, peeled boolean, remote string",
}
LIMIT = 20_000
#: Seconds that one short git command may take; a command that takes longer fails the read instead of giving no rows.
PATIENCE = 3600
_COMMIT = ("%H", "%an", "%ae", "%at", "%ad", "%s", "%P")


def _command(repo: str, args: tuple[str, ...]) -> list[str]:
    return ["git", "-c", "core.quotepath=off", "-c", "safe.directory=*", "-C", repo, *args]


def try_git(repo: str, *args: str) -> tuple[int, str, str]:
    """Exit status, output and error text of a git command with a short answer."""
    out = subprocess.run(_command(repo, args), capture_output=True, timeout=PATIENCE)
    return out.returncode, out.stdout.decode("utf-8", "replace"), out.stderr.decode("utf-8", "replace")


def run_git(repo: str, *args: str) -> str:
    """Output of git, empty if it fails; the relation ``status`` says why."""
    code, out, _ = try_git(repo, *args)
    return out if code == 0 else ""


def _readable(repo: str) -> bool:
    """Whether there is a repository whose HEAD is a commit; ``status`` tells the other cases apart."""
    return not try_git(repo, "rev-parse", "--verify", "--quiet", "HEAD^{commit}")[0]


@contextmanager
def _running(repo: str, *args: str):
    """The output pipe of a git command that may write much. A failure is an error, but for repositories without commits."""
    with subprocess.Popen(_command(repo, args), stdout=subprocess.PIPE, stderr=subprocess.PIPE) as p:
        ended = False
        try:
            yield p.stdout
            ended = True
        finally:
            if not ended:
                p.kill()
            err = p.stderr.read().decode("utf-8", "replace")
    if p.returncode and _readable(repo):
        raise RuntimeError(f"git {args[0]} failed in {repo}: {err.strip()[:400]}")


def records(repo: str, *args: str, size: int = 1 << 16) -> Iterator[str]:
    """NUL-ended records of a git command, as they come."""
    with _running(repo, *args) as out:
        rest = b""
        while block := out.read(size):
            *whole, rest = (rest + block).split(b"\0")
            for r in whole:
                yield r.decode("utf-8", "replace")
        if rest.strip():
            yield rest.decode("utf-8", "replace")


def lines(repo: str, *args: str) -> Iterator[str]:
    """Lines of a git command, as they come."""
    with _running(repo, *args) as out:
        for line in out:
            yield line.decode("utf-8", "replace").rstrip("\n")


def anonymised(name: str, email: str, subject: str) -> bool:
    """The signature of an anonymising tool, as in ``functions.paths.is_anonymiser``."""
    return any(re.search(p, x) for p, x in zip(ANONYMISER, (email, name, subject), strict=True))


def commit_rows(repo: str, *args: str) -> Iterator[tuple]:
    """Rows of the relation ``commits`` from a git log over ``args``."""
    row = []
    n = 0
    for field in records(repo, "log", "-z", "--date=short", "--format=" + "%x00".join(_COMMIT), *args, "--"):
        row.append(field)
        if len(row) == len(_COMMIT):
            sha, name, mail, at, day, subject, parents = row
            yield repo, sha, name, mail, datetime.fromtimestamp(int(at), timezone.utc), day, subject, parents.split(), n
            row, n = [], n + 1


def listed(options: dict, many: str, one: str) -> list[str]:
    """A list option: a JSON array, or names separated by commas; or the single one."""
    told = options.get(many)
    if told is None:
        return [options[one]] if options.get(one) else []
    return list(json.loads(told)) if told.lstrip().startswith("[") else [x for x in told.split(",") if x]


class _Repo(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class GitReader(DataSourceReader):
    #: Columns by whose equality git itself can select, for each relation.
    SELECTS = {"commits": ("repo",), "graph": ("repo",), "commit_files": ("repo", "sha"), "refs": ("repo", "ref"), "trees": ("repo", "sha"), "tags": ("repo", "tag"), "status": ("repo",)}

    def __init__(self, options: dict):
        self.repos = listed(options, "repos", "repo")
        self.relation = options.get("relation", "commits")
        self.limit = int(options.get("limit", LIMIT))
        self.ref = options.get("ref", "HEAD")
        self.peel = str(options.get("peel", "false")).lower() == "true"
        self.shas = listed(options, "shas", "sha")
        self.only: dict[str, set] = {}

    def partitions(self):
        return [_Repo(p) for p in self.repos if p in self.only.get("repo", (p,))]

    def read(self, partition: _Repo) -> Iterator[tuple]:
        return getattr(self, f"_{self.relation}")(partition.path)

    def _peeled(self, repo: str) -> bool:
        """Whether the tip bears the signature of an anonymising tool and history is left below it."""
        if not self.peel or self.ref != "HEAD":
            return False
        tip = run_git(repo, "log", "-1", "--format=%an%x00%ae%x00%s", "HEAD").strip("\n").split("\0")
        count = run_git(repo, "rev-list", "--count", "HEAD").strip()
        return len(tip) == 3 and count.isdigit() and int(count) > 1 and anonymised(*tip)

    def _range(self, repo: str) -> list[str]:
        limit = [f"--max-count={self.limit}"] if self.limit else []
        return limit + (["--all"] if self.ref == "--all" else ["HEAD~1" if self._peeled(repo) else self.ref])

    def _known(self, repo: str, shas: set[str]) -> list[str]:
        """Those of the named commits that lie in the range; full names only, so nothing else is looked up."""
        named = sorted(s for s in shas if s and re.fullmatch(r"[0-9a-f]{40,64}", s))
        inside = set(lines(repo, "rev-list", *self._range(repo), "--")) if named else set()
        return [s for s in named if s in inside]

    def _status(self, repo: str):
        code, head, err = try_git(repo, "rev-parse", "HEAD")
        if try_git(repo, "rev-parse", "--git-dir")[0]:
            yield repo, "not_a_repository", err.strip()[:400], None, None, None, None
            return
        count = run_git(repo, "rev-list", "--count", "HEAD").strip()
        remote = run_git(repo, "config", "--get", "remote.origin.url").strip() or None
        yield repo, "empty" if code else "ok", None if not code else err.strip()[:400], None if code else head.strip(), int(count) if count.isdigit() else None, self._peeled(repo), remote

    def _commits(self, repo: str):
        return commit_rows(repo, *self._range(repo))

    def _graph(self, repo: str):
        for line in lines(repo, "rev-list", "--all", "--parents"):
            sha, *parents = line.split()
            yield repo, sha, parents

    def _commit_files(self, repo: str):
        chosen = self._range(repo)
        if "sha" in self.only:
            known = self._known(repo, self.only["sha"])
            if not known:
                return
            chosen = ["--no-walk=unsorted", *known]
        sha = None
        for token in records(repo, "log", "-z", "--format=%H", "--no-merges", "--no-renames", "--numstat", *chosen, "--"):
            parts = token.lstrip("\n").split("\t", 2)
            if len(parts) == 3:
                a, d, path = parts
                yield repo, sha, path, int(a) if a.isdigit() else 0, int(d) if d.isdigit() else 0, a == "-"
            elif parts[0]:
                sha = parts[0]

    def _refs(self, repo: str):
        """Every ref and the commit it names, through annotated tags."""
        chosen = sorted(r for r in self.only.get("ref", ()) if r)
        if "ref" in self.only and not chosen:
            return
        for line in lines(repo, "for-each-ref", "--format=%(refname)%09%(objecttype)%09%(objectname)%09%(*objectname)", *chosen):
            ref, kind, sha, target = (line.split("\t") + [""])[:4]
            if ref in self.only.get("ref", (ref,)):
                yield repo, ref, target if kind == "tag" and target else sha

    def _trees(self, repo: str):
        """Files, folders at the top and day of the named commits: each is a walk of its tree."""
        count = lambda *a: sum(1 for x in records(repo, *a) if x)
        for sha in sorted(set(self.shas) & self.only.get("sha", set(self.shas))):
            if try_git(repo, "cat-file", "-e", f"{sha}^{{commit}}")[0]:
                continue
            yield repo, sha, count("ls-tree", "-r", "-z", "--name-only", sha), count("ls-tree", "-d", "-z", "--name-only", sha), run_git(repo, "log", "-1", "--format=%cs", sha).strip() or None

    def _tags(self, repo: str):
        """Tags that the ref reaches, with the commits that they name."""
        if not _readable(repo):
            return
        ref = "HEAD~1" if self._peeled(repo) else self.ref
        merged = [] if ref == "--all" else ["--merged", ref]
        for line in lines(repo, "for-each-ref", "--format=%(refname:short)%09%(objecttype)%09%(objectname)%09%(*objectname)", "refs/tags", *merged):
            tag, kind, sha, target = (line.split("\t") + [""])[:4]
            if tag in self.only.get("tag", (tag,)):
                yield repo, tag, target if kind == "tag" and target else sha


class FilteredGitReader(GitReader):
    """Takes filters in; Spark refuses such a reader where filter pushdown is off."""

    def pushFilters(self, filters):
        """Takes equalities and lists on the columns that git can look up; all others stay with Spark."""
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In, IsNotNull)) and len(f.attribute) == 1 else None
            if name not in self.SELECTS[self.relation]:
                yield f
                continue
            if isinstance(f, IsNotNull):  # these columns never are
                continue
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.only[name] = self.only[name] & values if name in self.only else values


class _Span(InputPartition):
    def __init__(self, repo: str, new: list[str], old: list[str]):
        super().__init__((repo, new, old))
        self.repo, self.new, self.old = repo, new, old


class GitStreamReader(DataSourceStreamReader):
    """New commits of all refs. An offset is the tips of each repository; a batch
    is what the tips at its end reach and no tip that was ever delivered does.

    The tips of committed batches are noted in the folder ``history``, a small file each, because an
    offset knows only the tips of its own time: where a ref is forced back to an
    older commit, and later to the one it had, nothing is delivered again. Without
    that folder only the tips of the offset before are known. Objects that git has
    removed since can't be held against new ones.
    """

    def __init__(self, options: dict):
        self.repos = listed(options, "repos", "repo")
        self.history = options.get("history")

    def initialOffset(self) -> dict:
        return {r: [] for r in self.repos}

    def latestOffset(self) -> dict:
        return {r: sorted(set(run_git(r, "for-each-ref", "--format=%(objectname)").split() + run_git(r, "rev-parse", "HEAD").split()[:1])) for r in self.repos}

    def partitions(self, start: dict, end: dict):
        seen = self._seen()
        out = []
        for repo, tips in sorted(end.items()):
            old = sorted({*start.get(repo, ()), *seen.get(repo, ())})
            new = sorted({*tips} - {*old})
            if new:
                out.append(_Span(repo, new, old))
        return out

    def read(self, partition: _Span) -> Iterator[tuple]:
        there = lambda s: not try_git(partition.repo, "cat-file", "-e", f"{s}^{{commit}}")[0]
        new, old = (list(filter(there, x)) for x in (partition.new, partition.old))
        return commit_rows(partition.repo, *new, "--not", *old) if new else iter(())

    def _store(self):
        from .tree import _store

        return _store(self.history)

    def _seen(self) -> dict[str, set[str]]:
        from pyarrow import fs

        seen: dict[str, set[str]] = {}
        if self.history:
            store, base = self._store()
            for f in store.get_file_info(fs.FileSelector(base, allow_not_found=True)):
                if f.path.endswith(".json"):
                    with store.open_input_file(f.path) as x:
                        for repo, tips in json.loads(x.read()).items():
                            seen.setdefault(repo, set()).update(tips)
        return seen

    def commit(self, end: dict) -> None:
        if not self.history:
            return
        store, base = self._store()
        text = json.dumps(end, sort_keys=True).encode()
        name = f"{base}/{hashlib.sha256(text).hexdigest()}"
        store.create_dir(base, recursive=True)
        with store.open_output_stream(f"{name}.tmp") as f:
            f.write(text)
        store.move(f"{name}.tmp", f"{name}.json")


class GitSource(DataSource):
    @classmethod
    def name(cls):
        return "git"

    def schema(self):
        return SCHEMAS[self.options.get("relation", "commits")]

    def reader(self, schema):
        options = dict(self.options)
        return FilteredGitReader(options) if options.get("pushdown") == "true" else GitReader(options)

    def streamReader(self, schema):
        if self.options.get("relation", "commits") != "commits":
            raise ValueError("only the relation commits is a stream")
        return GitStreamReader(dict(self.options))


def pushdown(spark: SparkSession) -> str:
    """Whether Python sources may take filters in, as an option."""
    return str(spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).lower()


def read(spark: SparkSession, repos: list[str], relation: str = "commits", **options: str) -> DataFrame:
    """A relation of the repositories."""
    spark.dataSource.register(GitSource)
    return spark.read.format("git").options(repos=json.dumps(repos), relation=relation, pushdown=pushdown(spark), **options).load()
