"""Column builders for paths, URLs and people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab
from ..vocab import any_of

#: Four definitions of a test file stay separate on purpose: tree, commit, history and structure.
TREE_TEST = any_of(vocab.TREE_TEST_FILES)
COMMIT_TEST = any_of(vocab.COMMIT_TEST_FILES, True)
HISTORY_TEST = "(?i)" + vocab.HISTORY_TEST
STRUCTURE_TEST = "(?i)" + vocab.STRUCTURE_TEST
FIXTURE = any_of(vocab.FIXTURE_FILES, True)
CI_CONFIG = r"(^|/)(\.github/workflows)/[^/]+\.ya?ml$|" + any_of([f"^{f.replace('.', chr(92) + '.')}$" for f, _ in vocab.CI_FILES])
#: Beginnings of CI folders and files, at the root or below any folder.
CI_PREFIX = r"(?i)(^|/)(\.github/|\.gitlab|\.circleci/)"
BOT = any_of(vocab.BOT_AUTHORS, True)
SKIP_DIRS, KEPT_DOT_DIRS = vocab.SKIP_DIRS, vocab.KEPT_DOT_DIRS


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def top_dir(path: Column) -> Column:
    """First segment; null for files of the root."""
    return F.when(path.contains("/"), F.substring_index(path, "/", 1))


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; a leading dot alone is part of the name."""
    return F.lower(F.regexp_extract(base_name(path), r"[^.](\.[A-Za-z0-9]+)$", 1))


def folder(path: Column) -> Column:
    """Folder of a path, '' for the root."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def depth(path: Column) -> Column:
    """Number of folders above a file."""
    return F.size(F.split(path, "/")) - 1


def in_skipped_dir(path: Column, skipped: tuple[str, ...] = SKIP_DIRS, kept: tuple[str, ...] = KEPT_DOT_DIRS) -> Column:
    """Whether one of the folders above a file is left out by name, or as a dot-folder that isn't kept."""
    dirs = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.exists(dirs, lambda s: (s.isin(*skipped) | s.startswith(".")) & ~s.isin(*kept))


def is_code(path: Column) -> Column:
    """Whether a file counts as source, by its extension."""
    return extension(path).isin(*[e for e in vocab.LANGUAGES if e not in vocab.NOT_CODE])


def language(path: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in vocab.LANGUAGES.items() for x in kv])
    return F.when(is_code(path), F.try_element_at(names, extension(path)))


def is_ci_config(path: Column) -> Column:
    return path.rlike(CI_PREFIX)


def is_bot(name: Column, email: Column) -> Column:
    return F.concat_ws(" ", name, email).rlike(BOT)


def commit_file_kind(path: Column) -> Column:
    """test, test_infra, docs, schema or impl. Schema files count as implementation too."""
    return (
        F.when(path.rlike(any_of(vocab.TEST_INFRA_FILES, True)), "test_infra").when(path.rlike(COMMIT_TEST), "test")
        .when(path.rlike(any_of(vocab.DOCS_FILES, True)), "docs").when(path.rlike(any_of(vocab.SCHEMA_FILES, True)), "schema").otherwise("impl")
    )


def subject_kind(subject: Column) -> Column:
    """repair before noise before feature: a revert is noise as work, and a repair as a signal."""
    like = lambda p: subject.rlike("(?i)" + p)
    return F.when(like(vocab.REPAIR_SUBJECT), "repair").when(like(vocab.NOISE_SUBJECT), "noise").when(like(vocab.FEATURE_SUBJECT), "feature").otherwise("neutral")


def is_credential(path: Column) -> Column:
    """Whether the name of a file has the form of a credential's."""
    return F.lower(base_name(path)).rlike(any_of([glob_pattern(g) for g in vocab.CREDENTIAL_GLOBS]))


def ref_kind(ref: Column) -> Column:
    return F.when(ref.startswith("refs/heads/"), "local").when(ref.startswith("refs/remotes/"), "remote").when(ref.startswith("refs/tags/"), "tag").otherwise("other")


#: Signs of an anonymising commit (domain of the address, name, subject).
ANONYMISER = (r"(?i)(^|[@.])anonymizer\.local$", r"(?i)anonymiz", r"(?i)\banonymiz\w*\s+(repo|repository|code)\b")


def is_anonymiser(name: Column, email: Column, subject: Column) -> Column:
    """Whether a commit bears the signature of an anonymising tool, by address, name or subject."""
    return F.coalesce(email.rlike(ANONYMISER[0]), F.lit(False)) | F.coalesce(name.rlike(ANONYMISER[1]), F.lit(False)) | F.coalesce(subject.rlike(ANONYMISER[2]), F.lit(False))


def ancestors(path: Column) -> Column:
    """All folders above a path, the root '' included: makes containment an equi-join."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def url_path(url: Column) -> Column:
    """Path of a URL with one to four segments, without query and fragment; null otherwise."""
    bare = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"(\.git)?/*$", "")
    path = F.regexp_extract(bare, r"^(?:[a-z+]+://[^/]+/|[^/@ ]+@[^/:]+:)(.+)$", 1)
    n = F.size(F.split(path, "/"))
    return F.when((path != "") & n.between(1, 4), path)


def remote_name(url: Column) -> Column:
    """owner/name of a git remote that names a host; null for local paths and odd spellings."""
    bare = F.regexp_replace(F.trim(url), r"\.git$", "")
    with_scheme = F.regexp_extract(bare, r"^[^:]*://([^/:][^/]*)/(.*)$", 2)
    like_scp = F.regexp_extract(bare, r"^(?![/.~])(?:[^/:]*@)?([^/:@]{2,}):(.*)$", 2)
    path = F.when(bare.contains("://"), F.when(~bare.rlike("(?i)^file://"), with_scheme)).otherwise(like_scp)
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    fit = F.size(parts).between(1, 4) & F.forall(parts, lambda s: s.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,99}$"))
    return F.when(fit, F.array_join(parts, "/"))


def glob_pattern(glob: str) -> str:
    """Regular expression of a shell glob."""
    out = ""
    for c in glob:
        out += "[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if c in ".+^$()[]{}|\\" else c
    return f"^{out}$"


def iac_type(path: Column, text: Column, in_chart: Column, chart_above: Column) -> Column:
    """Infrastructure type of a file by positive identification, null where nothing fits.

    in_chart: the file's own folder holds a chart; chart_above: the folder before its ``templates/`` does.
    """
    name, ext, head = F.lower(base_name(path)), extension(path), F.substring(text, 1, 4096)
    low = F.lower(head)
    has = low.contains
    playbook = head.rlike(r"(^|\n)hosts:") | has("ansible.builtin.") | has("\nbecome:") | has("gather_facts:") | has("\nvars_files:")
    tasks = F.concat(F.lit("/"), path).rlike(r"/(roles|playbooks)/|playbooks/[^/]*$") & (head.rlike(r"(^|\n)- name:") | has("\ntasks:"))
    yaml = (
        F.when(name.isin("chart.yaml", "chart.yml") | (name.startswith("values") & in_chart) | chart_above, "Helm")
        .when(name.startswith("docker-compose") | name.startswith("compose."), "Docker Compose")
        .when(has("apiversion:") & has("kind:"), "Kubernetes")  # a kind that isn't known counts too
        .when(has("awstemplateformatversion") | (has("resources:") & has("aws::")), "CloudFormation")
        .when(head.rlike(r"(^|\n)services:") & (has("image:") | has("build:") | has("container_name:")), "Docker Compose")
        .when(playbook | tasks, "Ansible")
    )
    return (
        F.when(name.rlike(r"^dockerfile(\.|$)|\.dockerfile$"), "Dockerfile").when(ext.isin(".tf", ".tfvars", ".hcl"), "Terraform").when(~ext.isin(".yaml", ".yml", ".json") | is_ci_config(path), F.lit(None))
        .when(ext == ".json", F.when(has("awstemplateformatversion") | has('"aws::'), "CloudFormation")).otherwise(yaml)
    )
