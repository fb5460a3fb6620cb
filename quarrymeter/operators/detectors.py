"""What the files of a repository show: frameworks, dependencies, linters, tests, documentation, infrastructure, demonstrations.

Relation: files(repo, path, text). ``root_facts`` gathers the few named files
that the detectors read (their first 16,384 characters) and the folders that
they ask for in one grouped pass; every detector is then a projection of that
row. Its size is bounded by the fixed names, not by the repository.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions import paths
from ..functions.text import bounded, is_generated, keyword_pattern, line_count
from .classify import CLASSES

DIRS = ("spec", "test", "cmd", "playbooks", ".devcontainer", ".github/ISSUE_TEMPLATE", ".github/workflows", "src/router", "src")
EXTRA = (
    "package.json", "pyproject.toml", "requirements.txt", "Pipfile", "setup.py", "setup.cfg", "go.mod", "Cargo.toml", "Gemfile", "composer.json", "pytest.ini", "tox.ini", ".rspec", "phpunit.xml", "phpunit.xml.dist", "Pulumi.yaml", "ansible.cfg", "playbook.yml",
    "Dockerfile", "Dockerfile.dev", "Dockerfile.development", "Dockerfile.local", "docker-compose.yml", "docker-compose.yaml", "devcontainer.json", "flake.nix", "shell.nix", "renovate.json", ".renovaterc", ".renovaterc.json", ".github/dependabot.yml", ".github/dependabot.yaml",
    ".github/PULL_REQUEST_TEMPLATE.md", ".github/pull_request_template.md", ".github/issue_template.md", "src/App.js", "src/App.tsx", "src/logo.svg", "src/App.vue", "public/favicon.ico", "pages/index.js", "pages/api/hello.js", "main.go", "src/main.rs", "src/lib.rs",
)
NAMED = tuple(dict.fromkeys([*EXTRA, *(f for f, _ in vocab.FRAMEWORK_FILES), *(f for f, _ in vocab.CI_FILES), *vocab.LINT_FILES, *(f for f, _ in vocab.TEST_FILES), *vocab.README_FILES, *vocab.CHANGELOG_FILES, *vocab.CONTRIBUTING_FILES, *vocab.ENV_EXAMPLES]))


def root_facts(files: DataFrame) -> DataFrame:
    """(repo, root map of name to text, dirs): the named files and folders that are there."""
    named = F.col("path").isin(*NAMED)
    entry = F.when(named, F.struct("path", F.coalesce(bounded(F.col("text")), F.lit("")).alias("text")))
    return files.groupBy("repo").agg(
        F.map_from_entries(F.array_distinct(F.collect_list(entry))).alias("root"),
        F.array_compact(F.array(*[F.max(F.when(F.col("path").startswith(f"{d}/"), F.lit(d))) for d in DIRS])).alias("dirs"),
    )


def has(name: str) -> Column:
    return F.map_contains_key("root", F.lit(name))


def text_of(name: str) -> Column:
    """Text of a named file, '' where it isn't there."""
    return F.coalesce(F.try_element_at("root", F.lit(name)), F.lit(""))


def has_dir(name: str) -> Column:
    return F.array_contains("dirs", name)


def any_file(names) -> Column:
    return reduce(lambda a, b: a | b, [has(n) for n in names])


def first_file(names) -> Column:
    """The first of some names that is there, else null."""
    return F.coalesce(*[F.when(has(n), F.lit(n)) for n in names])


def _listed(*pairs: tuple[Column, str]) -> Column:
    """The names whose condition holds, in order, each once."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in pairs])))


def npm_dependencies() -> Column:
    """Names in dependencies and devDependencies of the root's package.json."""
    keys = lambda f: F.coalesce(F.map_keys(F.from_json(F.get_json_object(text_of("package.json"), f"$.{f}"), "map<string,string>")), F.array().cast("array<string>"))
    return F.array_union(keys("dependencies"), keys("devDependencies"))


def frameworks(facts: DataFrame, deps: DataFrame) -> DataFrame:
    """(repo, frameworks): by files of the root, then by declared PyPI names, then by the root's npm names, in a fixed order."""
    pypi = deps.where("ecosystem = 'pypi'").where(F.col("name").isin(*[n for n, _ in vocab.FRAMEWORK_PYPI])).groupBy("repo").agg(F.collect_set("name").alias("pypi"))
    f = facts.join(pypi, "repo", "left").withColumn("npm", npm_dependencies())
    by_file = _listed(*[(has(m), n) for m, n in vocab.FRAMEWORK_FILES])
    by_pypi = _listed(*[(F.coalesce(F.array_contains("pypi", k), F.lit(False)), n) for k, n in vocab.FRAMEWORK_PYPI])
    react = F.array_contains("npm", "react") & ~F.arrays_overlap(by_file, F.array(*map(F.lit, ("Next.js", "Remix", "Gatsby"))))
    trpc = F.get_json_object(text_of("package.json"), "$.dependencies").contains("trpc") | F.get_json_object(text_of("package.json"), "$.devDependencies").contains("trpc")
    cond = lambda k, n: F.coalesce(trpc, F.lit(False)) | F.array_contains("npm", k) if n == "tRPC" else F.array_contains("npm", k)
    by_npm = _listed((react, "React"), *[(cond(k, n), n) for k, n in vocab.FRAMEWORK_NPM])
    return f.select("repo", F.array_distinct(F.concat(by_file, by_pypi, by_npm)).alias("frameworks"))


def project_type(facts: DataFrame, found: DataFrame) -> DataFrame:
    """(repo, project_type) by the first rule that applies."""
    f = facts.join(found, "repo")
    any_of = lambda names: F.arrays_overlap("frameworks", F.array(*map(F.lit, names)))
    get = lambda path: F.get_json_object(text_of("package.json"), path)
    library = has("package.json") & (F.coalesce(get("$.private"), F.lit("")) != "true") & (F.coalesce(get("$.main"), F.lit("")) != "") & ~any_of(vocab.APP_FRAMEWORKS)
    native = F.when(has("main.go") | has_dir("cmd"), "CLI / service").when(has("src/main.rs") | has("src/lib.rs"), F.when(text_of("src/main.rs").contains("fn main()"), "CLI").otherwise("library")).otherwise("unknown")
    kind = (
        F.when(library, "library").when(any_of((*vocab.APP_FRAMEWORKS, "React", "Vue CLI")), "web app").when(any_of(vocab.SERVICE_FRAMEWORKS), "API service").when(any_of(("Flutter/Dart",)), "mobile")
        .when(any_of(("Terraform", "Helm", "Fly.io")), "infrastructure").when(any_of(("Rust (Cargo)", "Go Modules")), native).otherwise("unknown")
    )
    return f.select("repo", kind.alias("project_type"))


# -------------------------------------------------------------- dependencies
def lock_counts(files: DataFrame) -> DataFrame:
    """(repo, lockfiles, transitive): one file of each lock format (the shallowest, then by name), and the packages that they hold."""
    base = paths.base_name(F.col("path"))
    locks = files.where(base.isin(*vocab.LOCK_FILES) & ~F.col("path").rlike(r"node_modules|\.git"))
    one = locks.groupBy("repo", base.alias("lock")).agg(F.min_by(F.struct("path", "text"), F.struct(paths.depth(F.col("path")), F.col("path"))).alias("f")).select("repo", "lock", "f.path", F.substring("f.text", 1, 1_000_000).alias("t"))
    t, lock = F.col("t"), F.col("lock")
    times = lambda s: F.regexp_count(t, F.lit(s))
    keys = lambda p: F.size(F.map_keys(F.from_json(F.get_json_object(t, p), "map<string,string>")))
    specs = F.regexp_extract(t, r"(?s)(?:^|\n)\s*specs:\s*(\n.*)", 1)
    n = (
        F.when(lock == "package-lock.json", F.coalesce(keys("$.packages"), keys("$.dependencies"), F.lit(0))).when(lock == "yarn.lock", times("\n\n")).when(lock == "pnpm-lock.yaml", times("\n  /")).when(lock.isin("poetry.lock", "Cargo.lock"), times(r"\[\[package\]\]"))
        .when(lock == "go.sum", F.floor(times("\n") / 2)).when(lock == "Gemfile.lock", F.regexp_count(specs, F.lit(r"\n  (?!  )"))).otherwise(0)
    )
    order = F.array_position(F.array(*map(F.lit, vocab.LOCK_FILES)), lock)
    return one.groupBy("repo").agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), "path"))), lambda x: x["path"]).alias("lockfiles"), F.sum(n.cast("long")).alias("transitive"))


def direct_dependencies(facts: DataFrame) -> DataFrame:
    """(repo, runtime, dev, managers, update_tool): counts of package.json and go.mod, package managers of the root, update tooling."""
    pkg = text_of("package.json")
    n = lambda f: F.coalesce(F.size(F.map_keys(F.from_json(F.get_json_object(pkg, f"$.{f}"), "map<string,string>"))), F.lit(0))
    lines = F.transform(F.split(text_of("go.mod"), "\n"), F.trim)
    lines = F.transform(lines, lambda x: F.regexp_replace(x, r"^\t+", ""))
    block = F.aggregate(
        lines, F.struct(F.lit(False).alias("inside"), F.lit(0).alias("n")),
        lambda a, x: F.when(x.startswith("require ("), F.struct(F.lit(True).alias("inside"), a["n"].alias("n")))
        .when(a["inside"] & (x == ")"), F.struct(F.lit(False).alias("inside"), a["n"].alias("n")))
        .when((a["inside"] & (x != "") & ~x.startswith("//")) | (~a["inside"] & x.startswith("require ")), F.struct(a["inside"].alias("inside"), (a["n"] + 1).alias("n")))
        .otherwise(a),
        lambda a: a["n"],
    )
    python = any_file(("pyproject.toml", "requirements.txt", "Pipfile", "setup.py", "setup.cfg"))
    managers = _listed((has("package.json"), "npm/yarn/pnpm"), (python, "pip/poetry/uv"), (has("go.mod"), "Go modules"), (has("Cargo.toml"), "Cargo"), (has("Gemfile"), "Bundler"), (has("composer.json"), "Composer"))
    tool = F.when(any_file((".github/dependabot.yml", ".github/dependabot.yaml")), "Dependabot").when(any_file(("renovate.json", ".renovaterc", ".renovaterc.json")), "Renovate").otherwise("none")
    return facts.select("repo", (n("dependencies") + F.when(has("go.mod"), block).otherwise(0)).alias("runtime"), n("devDependencies").alias("dev"), managers.alias("managers"), tool.alias("update_tool"))


def keyword_hits(deps: DataFrame) -> DataFrame:
    """(repo, hits array of struct(group, keyword)): keywords that a dependency name of their ecosystem holds between separators.

    The keywords are a fixed list, so names are tested against one pattern for each
    group and ecosystem first, and only those that fit are joined with keywords.
    """
    spark = deps.sparkSession
    rows = [(g, e, k.rstrip("*"), keyword_pattern(k)) for g, by in vocab.CLASS_KEYWORDS.items() for e, words in by.items() for k in words.split()]
    known = F.broadcast(spark.createDataFrame(rows, "grp string, eco string, keyword string, pattern string"))
    some = F.col("name").rlike("|".join(f"(?:{p})" for *_, p in rows))
    hit = deps.where(some).join(known, ((F.col("eco") == "any") | (F.col("eco") == F.col("ecosystem"))) & F.rlike("name", F.col("pattern")))
    return hit.groupBy("repo").agg(F.array_sort(F.collect_set(F.struct(F.col("grp").alias("group"), "keyword"))).alias("hits"))


# ------------------------------------------------------------ infrastructure
def with_iac(files: DataFrame) -> DataFrame:
    """Adds ``iac``, the infrastructure type; charts are looked up by folder with equi-joins."""
    base = F.lower(paths.base_name(F.col("path")))
    charts = files.where(base.isin("chart.yaml", "chart.yml")).select("repo", paths.folder(F.col("path")).alias("dir")).distinct()
    slashed = F.concat(F.lit("/"), F.col("path"))
    above = F.when(slashed.contains("/templates/"), F.regexp_replace(F.substring_index(slashed, "/templates/", 1), r"^/+", ""))
    f = files.withColumn("_dir", paths.folder(F.col("path"))).withColumn("_above", above)
    f = f.join(charts.select("repo", F.col("dir").alias("_dir"), F.lit(True).alias("_in")), ["repo", "_dir"], "left").join(charts.select("repo", F.col("dir").alias("_above"), F.lit(True).alias("_up")), ["repo", "_above"], "left")
    kind = paths.iac_type(F.col("path"), F.col("text"), F.coalesce("_in", F.lit(False)), F.coalesce("_up", F.lit(False)))
    return f.withColumn("iac", kind).drop("_dir", "_above", "_in", "_up")


def iac_files(files: DataFrame) -> DataFrame:
    """Infrastructure files that count: no tests, fixtures or generated files, at least one line."""
    path = F.col("path")
    plain = files.where(~path.rlike(paths.TREE_TEST) & ~path.rlike(paths.FIXTURE) & ~is_generated(F.col("text")))
    return with_iac(plain).where("iac is not null").withColumn("loc", line_count(F.col("text"))).where("loc > 0")


#: Names of the counters of a type.
IAC_COUNTERS = {"Terraform": "terraform", "Kubernetes": "k8s", "Docker Compose": "docker_compose", "Helm": "helm", "Ansible": "ansible", "CloudFormation": "cloudformation", "Dockerfile": "dockerfile"}


def iac_counters(iac: DataFrame) -> DataFrame:
    """(repo, iac_loc, iac_files, and lines and files of each type), with the types by lines."""
    per = iac.groupBy("repo", "iac").agg(F.sum("loc").alias("loc"), F.count("*").alias("n"))
    of = lambda c, t: F.sum(F.when(F.col("iac") == t, F.col(c)).otherwise(0))
    columns = [x for t, name in IAC_COUNTERS.items() for x in (of("loc", t).alias(f"{name}_loc"), of("n", t).alias(f"{name}_files"))]
    ranked = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("loc")).alias("o"), "iac"))), lambda x: x["iac"])
    return per.groupBy("repo").agg(F.sum("loc").alias("iac_loc"), F.sum("n").alias("iac_files"), *columns, ranked.alias("iac_types"))


# --------------------------------------------------------------- class signals
def class_signals(files: DataFrame, facts: DataFrame, found: DataFrame, hits: DataFrame, iac: DataFrame) -> DataFrame:
    """One row a repository of the figures that class terms are made of."""
    name, ext = F.lower(paths.base_name(F.col("path"))), paths.extension(F.col("path"))
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    code = paths.is_code(F.col("path")) & ~is_generated(F.col("text"))
    css = ext.isin(".css", ".scss", ".sass", ".less")
    web = paths.language(F.col("path")).isin(*vocab.WEB_LANGUAGES)
    # lines are counted once a file, and only of files that some sum takes in
    counted = files.select("repo", "path", name.alias("name"), ext.alias("ext"), code.alias("code"), web.alias("web"), F.when(code | css, line_count(F.col("text"))).alias("loc"))
    name, ext, code, web, loc = (F.col(c) for c in ("name", "ext", "code", "web", "loc"))
    per = counted.groupBy("repo").agg(
        n(ext == ".ipynb").alias("notebooks"), n(ext.isin(".tsx", ".jsx", ".vue", ".svelte")).alias("ui_components"), n(ext == ".sql").alias("sql_files"), n(ext.isin(".parquet", ".avro", ".orc", ".feather")).alias("data_files"),
        n(name.rlike(r"^dockerfile(\.|$)")).alias("dockerfiles"), F.sum(F.when(ext.isin(".css", ".scss", ".sass", ".less"), loc).otherwise(0)).alias("css_loc"), F.sum(F.when(code, loc).otherwise(0)).alias("total_loc"),
        F.sum(F.when(code & web, loc).otherwise(0)).alias("web_loc"), F.sum(F.when(code & (ext == ".sql"), loc).otherwise(0)).alias("sql_loc"),
    )
    out = per.join(facts, "repo").join(found, "repo", "left").join(hits, "repo", "left").join(iac_counters(iac), "repo", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    any_hit = lambda words: F.exists(F.coalesce("hits", F.array().cast("array<struct<group:string,keyword:string>>")), lambda h: (h["group"] == "infra_libs") & h["keyword"].isin(*words))
    is_framework = lambda x: F.coalesce(F.array_contains("frameworks", x), F.lit(False))
    css = F.bround(F.col("css_loc") / (F.greatest("total_loc", F.lit(1)) + F.col("css_loc")), 4)
    groups = [F.size(F.filter(F.transform(F.coalesce("hits", F.array().cast("array<struct<group:string,keyword:string>>")), lambda h: h["group"]), F.lit(g).eqNullSafe)).alias(f"n_{g}") for g in vocab.CLASS_KEYWORDS]
    overlap = lambda names: F.size(F.array_intersect(F.coalesce("frameworks", F.array().cast("array<string>")), F.array(*map(F.lit, names))))
    # counts of the infrastructure scan stand over plain ones; presence is either
    return out.select(
        "repo", "notebooks", "ui_components", "sql_files", "sql_loc", "data_files", "dockerfiles", "css_loc", "total_loc", css.alias("css_ratio"), F.coalesce(F.col("web_loc") / F.nullif("total_loc", F.lit(0)), F.lit(0.0)).alias("web_share"),
        zero("terraform_files").alias("terraform_files"), ((zero("terraform_files") > 0) | is_framework("Terraform")).alias("terraform_present"), zero("k8s_files").alias("k8s_files"), zero("cloudformation_files").alias("cloudformation_files"),
        (is_framework("Helm") | has("Chart.yaml") | (zero("helm_files") > 0)).alias("helm_present"), (has("Pulumi.yaml") | any_hit(("pulumi", "@pulumi"))).alias("pulumi_present"),
        (any_file(("ansible.cfg", "playbook.yml")) | has_dir("playbooks") | any_hit(("ansible", "ansible-core")) | (zero("ansible_files") > 0)).alias("ansible_present"),
        (zero("iac_loc") - zero("dockerfile_loc")).alias("plain_iac_loc"), overlap(vocab.FRONTEND_FRAMEWORKS).alias("frontend_markers"), overlap(vocab.BACKEND_FRAMEWORKS).alias("backend_markers"), *groups,
    )


def class_terms(signals: DataFrame, project_types: DataFrame) -> DataFrame:
    """Long form (repo, class, term, value) of the named terms of seven classes, each capped and rounded to three places."""
    s = signals.join(project_types, "repo", "left")
    c = F.col
    cap = lambda x, per, most: F.least(x.cast("double") * F.lit(per), F.lit(most))
    yes = lambda flag, v: F.when(flag, F.lit(v)).otherwise(F.lit(0.0))
    group = lambda g, per, most: cap(c(f"n_{g}"), per, most)
    iac_share = F.coalesce(c("plain_iac_loc") / F.nullif(c("total_loc"), F.lit(0)), F.lit(0.0))
    #: Weights and caps of the terms.
    terms = {
        "frontend": {"dep_keywords": group("frontend_frameworks", 1.5, 6.0), "ui_components": cap(c("ui_components"), 0.1, 5.0), "css": cap(c("css_ratio") * 20.0, 1.0, 3.0), "frameworks": cap(c("frontend_markers"), 1.0, 3.0)},
        "backend": {"dep_keywords": group("backend_frameworks", 1.5, 6.0), "orm_db": group("orm_db", 1.0, 4.0), "frameworks": cap(c("backend_markers"), 1.0, 3.0), "project_type": yes(c("project_type") == "API service", 3.0)},
        "ml": {"dep_keywords": group("ml_libs", 2.0, 8.0), "notebooks": cap(c("notebooks"), 0.3, 4.0), "experiment_tracking": group("experiment_tracking", 1.0, 4.0)},
        "ai_research": {"experiment_tracking": group("experiment_tracking", 2.0, 6.0), "notebooks": cap(c("notebooks"), 0.5, 5.0), "ml_libs": group("ml_libs", 1.0, 4.0)},
        "data_engineering": {"dep_keywords": group("data_eng", 2.5, 9.0), "sql_files": cap(c("sql_files"), 0.3, 4.0), "sql_loc": cap(c("sql_loc") / 200.0, 1.0, 3.0), "data_files": cap(c("data_files"), 0.5, 2.0)},
        "security": {"dep_keywords": group("security_libs", 3.0, 10.0)},
        "infra": {
            "terraform": yes(c("terraform_present"), 4.0) + cap(c("terraform_files"), 0.3, 4.0), "k8s": cap(c("k8s_files"), 0.5, 4.0), "helm": yes(c("helm_present"), 2.0), "pulumi": yes(c("pulumi_present"), 2.0), "ansible": yes(c("ansible_present"), 2.0),
            "dep_keywords": group("infra_libs", 1.0, 3.0), "dockerfiles": cap(c("dockerfiles"), 0.5, 1.5), "iac_share": cap(iac_share * 8.0, 1.0, 6.0), "cloudformation": cap(c("cloudformation_files"), 0.5, 2.0),
        },
    }
    # a repository without web material gets no frontend points for keywords and frameworks
    material = (c("ui_components") > 0) | (c("web_share") >= 0.10) | (c("css_ratio") >= 0.02)
    rows = [F.struct(F.lit(k).alias("class"), F.lit(t).alias("term"), F.round(v, 3).alias("value")) for k in CLASSES for t, v in terms[k].items()]
    long = s.select("repo", material.alias("material"), F.explode(F.array(*rows)).alias("t")).select("repo", "material", "t.*")
    return long.withColumn("counted", F.when((F.col("class") == "frontend") & F.col("term").isin("dep_keywords", "frameworks") & ~F.col("material"), F.lit(0.0)).otherwise(F.col("value")))


# ------------------------------------------------------------ other detectors
def lint(facts: DataFrame) -> DataFrame:
    """(repo, linters): tools whose configuration is there, sorted."""
    by_section = [(text_of("pyproject.toml").contains(f"[tool.{x}]"), x) for x in vocab.LINT_SECTIONS]
    found = _listed(*[(has(f), n) for f, n in vocab.LINT_FILES.items()], *by_section, (text_of("setup.cfg").contains("[flake8]"), "flake8"))
    return facts.select("repo", F.array_sort(found).alias("linters"))


def test_frameworks(facts: DataFrame) -> DataFrame:
    """(repo, test_frameworks, coverage_tool, coverage_threshold)."""
    pytest = reduce(lambda a, b: a | b, [text_of(f).contains("pytest") for f in ("pytest.ini", "pyproject.toml", "tox.ini", "setup.cfg")])
    found = _listed(
        *[(has(f), n) for f, n in vocab.TEST_FILES], (pytest, "pytest"), (has("go.mod"), "go test"), (has("Cargo.toml"), "cargo test"), (has(".rspec") | has_dir("spec"), "RSpec"), (has_dir("test") & has("Gemfile"), "Minitest"), (any_file(("phpunit.xml", "phpunit.xml.dist")), "PHPUnit"),
    )
    pkg, configs = text_of("package.json"), ("vitest.config.ts", "vitest.config.js", "jest.config.ts", "jest.config.js")
    by_config = F.coalesce(*[F.when(text_of(f).contains("coverage"), F.lit(f"configured in {f}")) for f in configs])
    python = F.when(text_of("pyproject.toml").contains("coverage") | text_of("pyproject.toml").contains("pytest-cov"), "pytest-cov")
    tool = F.coalesce(F.when(pkg.contains("c8") | pkg.contains('"coverage"'), "c8/v8").when(pkg.contains("nyc") | pkg.contains("istanbul"), "NYC/Istanbul").when(pkg.contains("lcov"), "lcov"), by_config, python)
    limits = [F.when(text_of(f).contains("coverage"), F.nullif(F.regexp_extract(text_of(f), r"(?s)threshold.*?lines.*?:.*?(\d+)", 1), F.lit("")).try_cast("int")) for f in reversed(configs)]
    return facts.select("repo", found.alias("test_frameworks"), tool.alias("coverage_tool"), F.coalesce(*limits).alias("coverage_threshold"))


def documentation(facts: DataFrame) -> DataFrame:
    """(repo, readme, readme_loc, readme_sections, changelog, contributing, pr_template, issue_template)."""
    readme = first_file(vocab.README_FILES)
    body = F.coalesce(F.try_element_at("root", readme), F.lit(""))
    sections = _listed(*[(F.lower(body).contains(x), x) for x in vocab.README_SECTIONS])
    return facts.select(
        "repo", readme.alias("readme"), F.when(readme.isNotNull(), line_count(body)).otherwise(0).alias("readme_loc"), sections.alias("readme_sections"), first_file(vocab.CHANGELOG_FILES).alias("changelog"), first_file(vocab.CONTRIBUTING_FILES).alias("contributing"),
        any_file((".github/PULL_REQUEST_TEMPLATE.md", ".github/pull_request_template.md")).alias("pr_template"), (has_dir(".github/ISSUE_TEMPLATE") | has(".github/issue_template.md")).alias("issue_template"),
    )


def demo_signals(facts: DataFrame, docs: DataFrame) -> DataFrame:
    """(repo, known_demo_app, template_readme, scaffold_fingerprint, boilerplate_readme, is_likely_demo, fired).

    A repository's name is never taken into account: only its contents are.
    """
    f = facts.join(docs.select("repo", "readme", "readme_loc"), "repo")
    body = F.substring(F.coalesce(F.try_element_at("root", F.col("readme")), F.lit("")), 1, 4096)
    scaffold = (any_file(("src/App.js", "src/App.tsx")) & has("src/logo.svg")) | (has("src/App.vue") & has("public/favicon.ico") & ~has_dir("src/router")) | (has("pages/index.js") & has("pages/api/hello.js"))
    known, template = body.rlike(vocab.KNOWN_DEMO), body.rlike(vocab.TEMPLATE_README)
    out = f.select("repo", known.alias("known_demo_app"), template.alias("template_readme"), scaffold.alias("scaffold_fingerprint"), (F.col("readme").isNull() | (F.col("readme_loc") < 12)).alias("boilerplate_readme"))
    c = F.col
    out = out.withColumn("is_likely_demo", c("known_demo_app") | c("template_readme") | c("scaffold_fingerprint"))
    return out.withColumn("fired", _listed(*[(c(x), x) for x in ("known_demo_app", "template_readme", "scaffold_fingerprint", "boilerplate_readme")]))


def reproducibility(facts: DataFrame) -> DataFrame:
    """(repo, has_dockerfile, has_compose, has_devcontainer, has_nix, env_example)."""
    return facts.select(
        "repo", any_file(("Dockerfile", "Dockerfile.dev", "Dockerfile.development", "Dockerfile.local")).alias("has_dockerfile"), any_file(("docker-compose.yml", "docker-compose.yaml")).alias("has_compose"),
        (has_dir(".devcontainer") | has("devcontainer.json")).alias("has_devcontainer"), any_file(("flake.nix", "shell.nix")).alias("has_nix"), first_file(vocab.ENV_EXAMPLES).alias("env_example"),
    )


def _first_sources(files: DataFrame, n: int) -> DataFrame:
    """The first 4,096 characters of a repository's first n source files that are no tests, by path."""
    path = F.col("path")
    code = files.where(paths.is_code(path) & ~path.rlike(paths.TREE_TEST) & ~path.contains(".env"))
    w = Window.partitionBy("repo").orderBy("path")
    return code.select("repo", "path", bounded(F.col("text"), 4096).alias("head")).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)


def hygiene(files: DataFrame) -> DataFrame:
    """(repo, dep_audit_in_ci, validation): audits named in CI files, validation libraries in the first 100 sources."""
    ci = files.where(F.col("path").rlike(paths.CI_CONFIG)).groupBy("repo").agg(F.max(bounded(F.col("text")).rlike(vocab.AUDIT_TEXT)).alias("dep_audit_in_ci"))
    some = _first_sources(files, 100).groupBy("repo").agg(F.array_compact(F.array(*[F.when(F.max(F.col("head").rlike(p)), F.lit(n)) for n, p in vocab.VALIDATION])).alias("validation"))
    out = files.select("repo").distinct().join(ci, "repo", "left").join(some, "repo", "left")
    return out.select("repo", F.coalesce("dep_audit_in_ci", F.lit(False)).alias("dep_audit_in_ci"), F.coalesce("validation", F.array().cast("array<string>")).alias("validation"))


def observability(files: DataFrame, facts: DataFrame) -> DataFrame:
    """(repo, logging, error_tracking, has_health, has_metrics): from manifests, and from the first 201 sources."""
    pkg, req, go = text_of("package.json"), F.concat(text_of("requirements.txt"), text_of("pyproject.toml")), text_of("go.mod")
    logging = F.coalesce(
        F.when(go.contains("zerolog"), "zerolog").when(go.contains("zap"), "zap").when(go.contains("logrus"), "logrus"), F.when(req.contains("structlog"), "structlog").when(req.contains("loguru"), "loguru"),
        *[F.when(pkg.contains(x), F.lit(x)) for x in ("pino", "winston", "bunyan", "log4js")],
    )
    tracking = F.coalesce(*[F.when(pkg.contains(x) | req.contains(x.replace("-", "_")), F.lit(x)) for x in vocab.ERROR_TRACKING])
    some = _first_sources(files, 201).groupBy("repo").agg(F.max(F.col("head").rlike(vocab.HEALTH_TEXT)).alias("has_health"), F.max(F.col("head").rlike(vocab.METRICS_TEXT)).alias("has_metrics"))
    out = facts.select("repo", logging.alias("logging"), tracking.alias("error_tracking")).join(some, "repo", "left")
    return out.withColumn("has_health", F.coalesce("has_health", F.lit(False))).withColumn("has_metrics", F.coalesce("has_metrics", F.lit(False)))


#: Files that ask for a package index, with the sign of it, and public indexes.
REGISTRY_FILES = {
    ".npmrc": r"(?i)registry\s*=|_authToken|_auth\s*=", ".yarnrc": r"(?i)registry\s+|registry\s*=", ".yarnrc.yml": r"(?i)npmRegistryServer|npmScopes", "pip.conf": r"(?i)index-url|extra-index-url", "pip/pip.conf": r"(?i)index-url|extra-index-url",
    "poetry.toml": r"(?i)\[\[?tool\.poetry\.source|url\s*=", "settings.xml": r"(?i)<repository|<server", "nuget.config": r"(?i)packageSources|<add\s", "gradle.properties": r"(?i)(repo|registry|artifactory|nexus).*(url|user|password)", ".netrc": r"(?i)machine\s+\S+",
}
PUBLIC_INDEX = r"(?i)registry\.npmjs\.org|registry\.yarnpkg\.com|pypi\.org|files\.pythonhosted\.org|repo\.maven\.apache\.org|repo1\.maven\.org|jcenter\.bintray|api\.nuget\.org|rubygems\.org|proxy\.golang\.org|crates\.io"


def private_registry(files: DataFrame) -> DataFrame:
    """(repo, private_registry): whether a file of the tree asks for a package index that isn't a public one."""
    body = F.substring("text", 1, 20000)
    sign = F.lit(False)
    for name, pattern in REGISTRY_FILES.items():
        sign = sign | ((F.col("path") == name) & body.rlike(pattern))
    hosts = F.regexp_extract_all(body, F.lit(r"https?://([^/\s\"']+)"), F.lit(1))
    private = sign & ((F.size(hosts) == 0) | F.exists(hosts, lambda h: ~h.rlike(PUBLIC_INDEX)))
    return files.groupBy("repo").agg(F.max(F.coalesce(private, F.lit(False))).alias("private_registry"))


def package_test(files: DataFrame) -> DataFrame:
    """(repo, path, has_test, runner) of every package.json: whether its test script is a real one, and the runner it names."""
    p = files.where(paths.base_name(F.col("path")) == "package.json")
    script = F.lower(F.coalesce(F.get_json_object("text", "$.scripts.test"), F.lit("")))
    keys = lambda f: F.coalesce(F.map_keys(F.from_json(F.get_json_object("text", f"$.{f}"), "map<string,string>")), F.array().cast("array<string>"))
    deps = F.concat(keys("dependencies"), keys("devDependencies"), keys("peerDependencies"))
    dep = lambda *names: F.arrays_overlap(deps, F.array(*map(F.lit, names)))
    runner = F.when(dep("vitest") | script.contains("vitest"), "vitest").when(dep("jest", "@jest/core", "react-scripts") | script.contains("jest"), "jest").when(dep("mocha") | script.contains("mocha"), "mocha").otherwise("unknown")
    return p.select("repo", "path", ((script != "") & ~script.contains("no test specified")).alias("has_test"), runner.alias("runner"))
