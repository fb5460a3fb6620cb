"""Islands of lines give what the readers in Python give."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quarrymeter.operators import lines
from quarrymeter.sources import tree

YAML = [
    "dependencies:\n  a: 1\n    x: 2\n  b:\nother:\n  c: 1\n",
    "name: e\ndependencies:\n  - python=3.8\n  # no\n\n  - pip:\n    - flask>=2 # c\n    - x\n  - after\nchannels:\n - d\n",
    "dependencies:\n- flush-left\n  - deep\ndependencies:\n\ta: 1\r\n\tb<2\x0b  c: 3\n", "pip::\n  a!=1\n", "x: 1\n  y:\n", "", "\n\n", "#dependencies:\n  a\n", "dependencies:", " dependencies:\n  in: 1\n end: 2\n   no: 3", "dependencies:\n\u00a0 - nb\u00a0sp\n",
]
CFG = [
    "[options]\ninstall_requires =\n    a>=1\n    b\n\n    # c\nzip_safe = 1\n  d\nsetup_requires=e; f\n  g\n", "install_requires = x\n", "  install_requires=\n y\nno\n z\n", "", "install_requires_not =\n a\n", "setup_requires\t= a\n\tb\ninstall_requires = c\n d", "install_requires =\r\n a\r\n\r\nq\r\n b",
]


def yaml_block_keys(text: str, sections: set[str]) -> list[str]:
    """Entries below the named sections of a simple YAML mapping, by indent alone; a version after a name is cut off."""
    out, depth = [], None
    for line in text.splitlines():
        bare = line.strip()
        if not bare or bare.startswith("#"):
            continue
        indent = len(line) - len(line.lstrip())
        if depth is not None and indent <= depth:
            depth = None
        if bare.endswith(":") and bare.rstrip(":") in sections:
            depth = indent
        elif depth is not None:
            out.append(re.split(r"[=<>!~\s:]", bare.lstrip("- ").partition("#")[0], maxsplit=1)[0])
    return out


def setup_cfg_requirements(text: str) -> list[str]:
    """Requirement lines of install_requires and setup_requires in setup.cfg."""
    out, inside = [], False
    for line in text.splitlines():
        if m := re.match(r"^\s*(?:install_requires|setup_requires)\s*=(.*)", line):
            inside = True
            out.append(m[1])
        elif inside and line.strip() and not line[:1].isspace():
            inside = False
        elif inside:
            out.append(line)
    return out


def noise(r, words):
    return "".join(r.choice(words) for _ in range(r.randint(1, 40)))


@pytest.mark.parametrize("kind", ["yaml", "cfg"])
def test_islands_equal_the_readers(spark, kind):
    r = random.Random(7)
    if kind == "yaml":
        texts = YAML + [noise(r, ["dependencies:", "pip:", "\n", "\n", "\n", " ", "  ", "- a=1", "b: 2", "#", "\t", "x"]) for _ in range(300)]
    else:
        texts = CFG + [noise(r, ["install_requires", "setup_requires", "=", "\n", "\n", "\n", " ", "a>1", "b", "\t", "\r"]) for _ in range(300)]
    df = spark.createDataFrame([(i, "k", t) for i, t in enumerate(texts)] + [(-1, "k", None)], "id int, nr_of string, text string").repartition(3)
    if kind == "yaml":
        found = lines.yaml_section_entries(df, ["id"], F.array(F.lit("dependencies"), F.lit("pip")))
        expect = {i: x for i, t in enumerate(texts) if (x := yaml_block_keys(t, {"dependencies", "pip"}))}
    else:
        found = lines.setup_cfg_entries(df, ["id"])
        expect = {i: x for i, t in enumerate(texts) if (x := setup_cfg_requirements(t))}
    got = {}
    for x in found.orderBy("id", "nr").collect():
        got.setdefault(x.id, []).append(x.entry)
    assert got == expect


def test_manifests_that_are_read_by_lines(spark):
    rows = [("r", "environment.yml", YAML[1]), ("r", "pubspec.yaml", "dev_dependencies:\n  mocktail: ^1\ndependencies:\n  http: any\n"), ("s", "setup.cfg", CFG[0]), ("s", "sub/setup.cfg", CFG[1]), ("s", "package.json", '{"dependencies": {"left-pad": "1"}}')]
    got = {tuple(x) for x in tree.dependencies(spark.createDataFrame(rows, "repo string, path string, text string")).collect()}
    assert got == {("r", "pypi", "python"), ("r", "pypi", "flask"), ("r", "pypi", "x"), ("r", "pypi", "pip"), ("r", "pypi", "after"), ("r", "pub", "mocktail"), ("r", "pub", "http"), ("s", "pypi", "a"), ("s", "pypi", "b"), ("s", "pypi", "e"), ("s", "pypi", "g"), ("s", "npm", "left-pad")}
