"""Literal inputs that the driver's tables lack: a source tree, logs, runner output, specs, sentences.

Each is spread over a driver table (a repository for each supplier, a log for
each event ...), so queries run on whole tables. The same rows go to Spark and,
as VALUES, to the SQL. They are inputs only: no rule is shared between the two.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .relations import table

#: (path, head, body, times): the text is head and then body, (times x (1 + repository % 3)) times; {n} is a number from 1 to 10.
FILES = [
    ("package.json", '{"name":"app","private":true,"main":"index.js","scripts":{"test":"jest --ci","lint":"eslint .","build":"tsc"},"dependencies":{"react":"^18.0.0","express":"4.{n}.0","@nestjs/core":"9","prisma":"5"},"devDependencies":{"jest":"29","next-tick":"1","c8":"7","pino":"8"},"engines":{"node":">=14 <21"},"workspaces":["packages/*"]}', "", 0),
    ("requirements.txt", "Flask==2.{n}\n# fastapi\nSQLAlchemy>=1.4\npsycopg2_binary\n-r other.txt\ntorch\nwandb ; python_version>'3'\nstructlog\n", "", 0),
    ("go.mod", "module example.com/x\n\ngo 1.{n}\n\nrequire (\n\tgithub.com/gin-gonic/gin v1.9.0\n\tgo.mongodb.org/mongo-driver v1.2.3\n\t// comment\n)\nrequire github.com/rs/zerolog v1.29.0\n", "", 0),
    ("Cargo.toml", '[package]\nname = "x"\nrust-version = "1.70"\n[workspace]\nmembers = ["crates/*"]\nexclude = ["crates/old"]\n[dependencies]\naxum = "0.6"\nserde = { version = "1" }\n', "", 0),
    ("Gemfile", "source 'https://rubygems.org'\nruby '3.1.{n}'\ngem 'rails'\ngem \"sinatra\", '~> 2'\n", "", 0),
    ("pom.xml", "<project><properties><java.version>1.8</java.version></properties><dependencies><dependency><groupId>org.springframework.boot</groupId><artifactId>spring-boot-starter</artifactId></dependency></dependencies></project>", "", 0),
    ("build.gradle", "dependencies { implementation 'redis.clients:jedis:4.{n}.0' }\njava { toolchain { languageVersion = JavaLanguageVersion.of(17) } }\n", "", 0),
    ("composer.json", '{"require":{"php":">=8","laravel/framework":"^10"},"require-dev":{"phpunit/phpunit":"^9"}}', "", 0),
    ("pyproject.toml", "[project]\nrequires-python = \">=3.9,<3.13\"\ndependencies = [\"pydantic>=2\", \"mlflow\"]\n[tool.ruff]\nline-length = 1{n}0\n[tool.pytest.ini_options]\naddopts = \"-q\"\n", "", 0),
    ("package-lock.json", '{"lockfileVersion":3,"packages":{"":{},"node_modules/a":{},"node_modules/b":{}}}', "", 0),
    ("web/yarn.lock", "# yarn\n\n", "pkg@1:\n  version 1\n\n", 4),
    ("pnpm-lock.yaml", "packages:\n", "\n  /a/1.0:\n    dev: true", 3),
    ("poetry.lock", "", "[[package]]\nname = \"x\"\n\n", 5),
    ("go.sum", "", "a v1 h1:x=\n", 7),
    ("Cargo.lock", "version = 3\n", "[[package]]\nname = \"y\"\n", 6),
    ("Gemfile.lock", "GEM\n  remote: x\n  specs:\n    rails (7)\n  after\n", "  more\n", 2),
    ("Makefile", "ci: build\n\t@pytest -q\n\tmake lint\n\nlint:\n\tflake8 src\nTEST := 1\n", "", 0),
    ("scripts/test.sh", "#!/bin/sh\nset -e\ncargo test --all\n", "", 0),
    (".github/workflows/ci.yml", "name: ci\nenv:\n  RUNNER: pytest\njobs:\n  a:\n    steps:\n      - uses: actions/checkout@v4\n      - run: ${{ env.RUNNER }} -x && echo {n}\n      - run: make lint\n      - run: npm run build\n", "", 0),
    (".github/workflows/off.yml", "jobs:\n  b:\n    if: false\n    steps:\n      - run: mypy .\n", "", 0),
    (".github/workflows/lint.yaml", "jobs:\n  c:\n    steps:\n      - uses: golangci/golangci-lint-action@v9\n      - run: mvn -DskipTests package\n      - run: pip-audit\n", "", 0),
    (".gitlab-ci.yml", "stages: [a]\ntest:\n  script:\n    - bash scripts/test.sh\n    - npm test\n  environment: deploy\n", "", 0),
    ("Jenkinsfile", "node { sh 'FOO=1 sudo mypy src'\n sh \"echo hi\" }\n", "", 0),
    (".github/dependabot.yml", "version: 2\n", "", 0),
    ("Dockerfile", "FROM x\n", "RUN y\n", 9),
    ("infra/main.tf", "# infra\n", "resource \"a\" \"b\" {}\n", 11),
    ("charts/web/Chart.yaml", "apiVersion: v2\nname: web\n", "", 0),
    ("charts/web/values-prod.yaml", "image: x\n", "a: 1\n", 2),
    ("charts/web/templates/deploy.yaml", "apiVersion: apps/v1\nkind: Deployment\n", "", 0),
    ("other/templates/page.yaml", "title: x\n", "", 0),
    ("deploy/k8s.yaml", "apiVersion: v1\nkind: \"Service\"\n", "x: 1\n", 4),
    ("deploy/crd.yaml", "apiVersion: x/v1\nkind: Widget\n", "", 0),
    ("docker-compose.override.yml", "version: 3\n", "", 0),
    ("stack/services.yaml", "services:\n  web:\n    image: x\n", "", 0),
    ("composer.yaml", "name: music\n", "", 0),
    ("cfn/template.json", '{"AWSTemplateFormatVersion":"2010","n":{n}}', "", 0),
    ("cfn/stack.yaml", "Resources:\n  B:\n    Type: AWS::S3::Bucket\n", "", 0),
    ("ansible/site.yml", "- name: x\n  gather_facts: no\n", "", 0),
    ("roles/x/tasks/main.yml", "- name: install\n  apt: x\n", "", 0),
    ("tasks/main.yml", "- name: not ansible\n", "", 0),
    ("README.md", "# Tool\n\nHow to install, run and test.\nThis is a sample of usage.\n", "\nMore words.\n", 4),
    ("CHANGES.md", "1.{n}\n", "", 0),
    ("CONTRIBUTING.rst", "Please.\n", "", 0),
    ("src/main.py", "import structlog\nfrom pydantic import BaseModel\n", "x = 1\n\n", 300),
    ("src/gen.py", "# DO NOT EDIT\n", "y = 2\n", 50),
    ("src/app.ts", "import { z } from 'zod';\nrouter.get('/health', ok);\n", "let a = 1;\r\n", 400),
    ("src/view.tsx", "export const A = 1;\n", "// x\n", 20),
    ("src/style.css", "a {}\n", "b {}\n", 30),
    ("src/util.h", "int a;\n", "int b;\n", 15),
    ("src/query.sql", "SELECT 1;\n", "SELECT 2;\n", 90),
    ("src/Main.java", "class Main {}\n", "// j\n", 25),
    ("tests/test_main.py", "def test():\n", "    assert 1\n", 40),
    ("tests/fixtures/data.py", "D = 1\n", "E = 2\n", 10),
    ("tests/big_test.py", "B = 1\n", "C = 2\n", 2000),
    ("notebooks/a.ipynb", '{"cells":[{"cell_type":"code","source":["a=1\\n","b=2"]},{"cell_type":"markdown","source":["x"]},{"cell_type":"code","source":["c={n}"]}]}', "", 0),
    ("data/x.parquet", "PAR1", "", 0),
    ("node_modules/lib/index.js", "module.exports = 1;\n", "a;\n", 5),
    (".devcontainer/devcontainer.json", "{}", "", 0),
    (".hidden/secret.py", "s = 1\n", "", 0),
    ("build/out.py", "o = 1\n", "", 0),
    ("packages/a/package.json", '{"name":"a","scripts":{"test":"echo \\"Error: no test specified\\" && exit 1"}}', "", 0),
    ("packages/b/package.json", '{"name":"b","scripts":{"test":"vitest"},"devDependencies":{"vitest":"1"}}', "", 0),
    ("crates/core/Cargo.toml", '[package]\nname = "core"\n', "", 0),
    ("crates/old/Cargo.toml", '[package]\nname = "old"\n', "", 0),
    ("services/api/pyproject.toml", "[project]\nname = \"api\"\n", "", 0),
    ("a/b/c/d/e/go.mod", "module deep\n", "", 0),
    ("app/App.csproj", "<Project/>", "", 0),
    (".nvmrc", "# pinned\nlts/hydrogen\n", "", 0),
    (".tool-versions", "nodejs 18.2.0\njava temurin-17.0.9\nruby 3.2.1 # x\n", "", 0),
    (".npmrc", "registry=https://npm.corp.example/\n_authToken=x\n", "", 0),
    ("pip.conf", "[global]\nindex-url = https://pypi.org/simple\n", "", 0),
    ("src/App.tsx", "app\n", "", 0),
    ("src/logo.svg", "<svg/>", "", 0),
    ("Pulumi.yaml", "name: x\n", "", 0),
    ("main.go", "package main\n", "func f() {}\n", 12),
    ("src/model.m", "#import <A.h>\n@interface B\n", "", 0),
    ("src/rule.pl", "parent(a,b) :- child(b,a).\n", "", 0),
    ("src/chip.v", "module a; endmodule\n", "", 0),
    (".eslintrc.json", "{}", "", 0),
    ("setup.cfg", "[flake8]\nmax = 1\n", "", 0),
    ("vitest.config.ts", "export default { coverage: { thresholds: { lines: 8{n} } } }\n", "", 0),
    ("spec/a_spec.rb", "describe {}\n", "it {}\n", 5),
    (".env.example", "A=1\n", "", 0),
    ("certs/server.pem", "-----\n", "", 0),
]

#: (output, exit status, timed out): one for each kind of failure, and some that two kinds could claim.
LOGS = [
    ("write: No space left on device", 1), ("FATAL: JavaScript heap out of memory", 134), ("Error: error:0308010C digital envelope", 1), ("Unsupported class file major version 65", 1), ("x requires a different Python: 3.12 not in '<3.9'", 1),
    ("npm WARN EBADENGINE Unsupported engine", 1), ("go.mod requires go >= 1.21", 1), ("Your Ruby version is 2.7.0, but your Gemfile specified 3.1", 1), ("error MSB3644: reference", 1), ("error: externally-managed-environment", 1),
    ("foo has invalid metadata: Expected matching RIGHT", 1), ("AttributeError: module 'collections' has no attribute 'Mapping'", 1), ("error: No module named 'distutils'", 1), ("bundle update --bundler", 1), ("Don't run Bundler as root", 1),
    ("Corepack is about to download x", 1), ("fatal error: zlib.h: No such file", 1), ("npm error code ENOTEMPTY", 1), ("Failed to launch Chrome", 1), ("Cannot connect to the Docker daemon", 1), ("Connection refused at localhost:5432", 1),
    ("getaddrinfo ENOTFOUND x", 1), ("gyp ERR! not ok\nsh: 1: cc: not found", 1), ("make: cargo: command not found", 127), ("ImportError while importing test module 'x'", 2), ("BackendUnavailable: Cannot import 'poetry.core.masonry.api'", 1),
    ("npm ERR! code E401", 1), ("go: unrecognized import path \"corp/x\"", 1), ("error MSB4025: bad project", 1), ("probe: no installable manifest", 1), ("Could not find or load GradleWrapperMain", 1), ("No url found for submodule path 'x'", 1),
    ("npm ci can only install packages when your package.json and package-lock.json are in sync", 1), ("The yarn.lock needs to be updated", 1), ("Your lock file does not satisfy", 1), ("ERROR: No matching distribution found for x", 1),
    ("npm ERR! ERESOLVE could not resolve", 1), ("404 Not Found - GET https://registry.npmjs.org/x", 1), ("Could not find artifact a:b:1", 1), ("Could not find gem 'x'", 1), ("error NU1101: Unable to find package", 1), ("Could not open requirements file", 1),
    ("error: cannot find symbol", 1), ("SyntaxError: invalid", 1), ("a.go:3:2: undefined: x", 1), ("error[E0308]: mismatched", 101), ("error TS2304: Cannot find name", 2), ("PHP Parse error: x", 255), ("Failed building wheel for x", 1),
    ("npm ERR! code ELIFECYCLE", 1), ("BUILD FAILURE", 1), ("all good", 0), ("   ", 1), ("could not read Username for 'https://corp'", 128), ("something odd happened", 1), ("ERESOLVE then BUILD FAILED", 1), ("Killed", 137),
]

#: (kind, output) of test runners; {n} is a number from 1 to 7.
RUNS = [
    ("pytest", "collected 1{n} items\n\n=== {n} passed, 2 failed, 1 skipped, 1 error in 1s ==="), ("pytest", "no tests ran in 0.1s"), ("pytest", "1{n} tests collected in 1s"), ("jest", "Tests:       {n} failed, 3 skipped, 9 passed, 2{n} total\nTime: 1"),
    ("jest", "nothing"), ("vitest", " Tests  {n} passed | 2 failed (9)"), ("mocha", "  {n} passing (1s)\n  2 pending\n  1 failing"), ("cargo", "test result: ok. {n} passed; 0 failed; 1 ignored\ntest result: FAILED. 2 passed; 3 failed; 0 ignored"),
    ("cargo", "error"), ("go", '{"Action":"run","Test":"A"}\n{"Action":"pass","Test":"A"}\n{"Action":"fail","Test":"B{n}"}\n{"Action":"pass","Package":"p"}\nplain\n{"Action":"skip","Test":"C"}'), ("dotnet", "Failed!:  1\nPassed!:  {n}\nSkipped:  2\nTotal:  1{n}"),
    ("phpunit", "OK ({n} tests, 9 assertions)"), ("phpunit", "Tests: 1{n}, Assertions: 20, Failures: 2, Skipped: 1."), ("rspec", "1{n} examples, 2 failures, 1 pending"), ("rspec", "0 examples"), ("other", "1 passed"),
]

#: (kind, output) of listings.
LISTINGS = [
    ("jest_files", "/a/x.test.ts\n/a/y.spec.js\nnot a file\nC:\\b\\z.cjs"), ("cargo_list", "a::b: test\nc: test  \nd: bench"), ("go_list", "TestA\n ExampleB\nok pkg\nBenchmarkC\nTest-D"), ("dotnet_list", "The following\n    A.B\n    C.D\n  x"),
    ("phpunit_list", "Available:\n - A::b\n  - C::d\n-x"), ("rspec_dry", "1{n} examples, 0 failures"), ("gradle_dry", "> Task :app:test SKIPPED\n> Task :lib:test\n> Task :x:testing\n> Task :y:build"), ("unknown", "x"),
]

#: (lane, spec, is a floor).
SPECS = [
    ("node", "lts/hydrogen", False), ("node", ">=14 <21", False), ("node", "16 || 18", False), ("node", "^0.10", False), ("node", "18.x", False), ("node", "=18.0.0", False), ("node", "lts/*", False), ("python", "3.9.7", False),
    ("python", "~=3.11", False), ("python", ">=3.8,<3.13", False), ("python", "*", False), ("go", "1.21.4", True), ("rust", "stable", False), ("rust", "1.70", True), ("ruby", "3.1.2", False), ("ruby", "> 2.7", False),
    ("java", "1.8", False), ("java", "7", False), ("java", "17.0.9", False), ("java", "none", False), ("dotnet", "6.0.100", False), ("node", "0.12.1", False), ("python", "!=3.9", False), ("node", "<=20", False), ("node", "~16.3", False),
]

#: Sentences of every kind that the boundary refuses, and some that it lets out.
SENTENCES = [
    "Add cursor pagination to a list endpoint backed by a relational store", "Rework the cache in src/main for speed", "See https: for more", "Ask ops@team about the queue", "Call module.method twice", "Parse every .json on start",
    "Rename user_name in the model", "Split parseTree into passes", "Return \"ok\" on success", "Wrap it in {braces}", "Revert commit deadbeef now", "Expose it over HTTP to clients", "Handle the case (rare) of overflow", "Move data to Acme before release",
    "Migrate storage to PostgreSQL safely", "Done. Then retry the write", "", "   ", " ".join(["word"] * 40), " ".join(["word"] * 41), "Teach Kubernetes manifests to roll back", "It isn't 'quoted text' here", "Use a->b instead", "Sort\nlines  before\tthe merge",
    "agentic: Build an importer for ledgers", "bug_repair: Fix src/a.py", "unknown: Do work",
]

#: Texts for redaction.
LEAKS = [
    "see src/app/main.py for {n}", "open config.yaml now", "at deadbeef1 it broke", "call do_thing(a, b) twice", "x\ndef foo(a): pass", "a => b :: c", "the user_name field", "a camelCase word", "class WidgetFactory is odd", "uses PostgreSQL and GraphQL", "Acme",
    "Python", "plain words only", "mail me at joe.bloggs@corp.example.org", "set MAX_RETRY_COUNT high", "Import duties are computed", "two parseTree splitTree words", "", "a  b   c",
]

#: (url): remotes of every spelling.
REMOTES = [
    "git@github.com:owner/name.git", "https://host/group/sub/name.git", "file:///home/joe/work/repo", "/srv/repo", "C:/src/repo", "ssh://git@host:22/owner/name", "https://host", "git://h/a/b/c/d/e", "host.example:team/proj", "https://h/own er/x", "../rel", "~/x:y", "", "https:///a/b", "git@h:a/b//c.git", "http://h/-bad/x",
]


def _values(rows: list[tuple], name: str, columns: str) -> str:
    """A VALUES list as a common table expression; the first column is the row's number."""
    cell = lambda v: str(v) if isinstance(v, (bool, int)) else "'" + v.replace("'", "''") + "'"
    return f"{name}(i, {columns}) AS (VALUES {', '.join('(' + ', '.join([str(i), *map(cell, r)]) + ')' for i, r in enumerate(rows))})"


def literal(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {columns}")


def tree(spark: SparkSession, sf: str) -> DataFrame:
    """(repo, path, text): two thirds of the fixture's files for each supplier.

    The suppliers are few bytes, so they are dealt to tasks before each becomes a
    tree, and by repository, so that what is grouped by it later stays where it
    is. What asks for paths only is decided on the fixture's rows, and a text is
    made once, by a generator, whatever filters follow.
    """
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.concat(F.lit("r"), F.col("s_suppkey")).alias("repo")).repartition(tasks, "repo")
    f = F.broadcast(literal(spark, FILES, "path string, head string, body string, times int"))
    j = s.join(f, F.pmod(s.k + f.i, F.lit(3)) != 0)
    text = F.concat("head", F.expr("repeat(body, times * cast(1 + k % 3 as int))"))
    return j.select("repo", "path", F.explode(F.array(F.replace(text, F.lit("{n}"), (F.col("k") % 10 + 1).cast("string")))).alias("text"))


def spread(spark: SparkSession, sf: str, source: str, key: str, rows: list[tuple], columns: str) -> DataFrame:
    """Row (key modulo their number) of a literal for each row of a driver table, with (id, n) and {n} filled in."""
    t = table(spark, sf, source).select(F.col(key).alias("id")).distinct()
    out = t.join(F.broadcast(literal(spark, rows, columns)), F.col("i") == F.col("id") % len(rows)).withColumn("n", F.col("id") % 7 + 1)
    for c, kind in out.dtypes:
        if kind == "string":
            out = out.withColumn(c, F.replace(c, F.lit("{n}"), F.col("n").cast("string")))
    return out


def spread_sql(source: str, key: str, rows: list[tuple], name: str, columns: str) -> str:
    """The same as a common table expression."""
    text = [c for c, v in zip(columns.split(", "), rows[0], strict=True) if isinstance(v, str)]
    picked = ", ".join(f"replace({c}, '{{n}}', (id % 7 + 1)::VARCHAR) AS {c}" if c in text else c for c in columns.split(", "))
    return f"{_values(rows, name + '_rows', columns)}, {name} AS (SELECT id, id % 7 + 1 AS n, i, {picked} FROM (SELECT DISTINCT {key} AS id FROM {source}) JOIN {name}_rows ON i = id % {len(rows)})"


TREE_SQL = f"""{_values(FILES, 'tree_rows', 'path, head, body, times')},
tree AS (SELECT 'r' || s_suppkey AS repo, path, replace(head || repeat(body, times * (1 + s_suppkey % 3)), '{{n}}', (s_suppkey % 10 + 1)::VARCHAR) AS text FROM supplier JOIN tree_rows ON (s_suppkey + i) % 3 <> 0),
root AS (SELECT repo, path, substr(text, 1, 16384) AS text FROM tree),
located AS (SELECT *, CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '' END AS dir, regexp_extract(path, '[^/]*$') AS base FROM tree),
kept AS (SELECT *, lower(regexp_extract(base, '.(\\.[A-Za-z0-9]+)$', 1)) AS ext FROM located WHERE NOT list_bool_or(list_transform(CASE WHEN dir = '' THEN ['x'] ELSE string_split(dir, '/') END,
  lambda d: (d IN ('node_modules','.git','vendor','dist','build','out','.cache','__pycache__','.pytest_cache','.mypy_cache','venv','.venv','env','.env','target','.next','.nuxt','.output','.turbo','coverage','.nyc_output','htmlcov','migrations','generated','gen','__generated__','.tox','eggs','*.egg-info')
    OR starts_with(d, '.')) AND d NOT IN ('.github','.gitlab','.circleci','.devcontainer')))),
counted AS (SELECT *, len(list_filter(string_split_regex(text, '\\r\\n|\\r|\\n'), lambda x: length(trim(x, ' ' || chr(9) || chr(13))) > 0)) AS loc,
  regexp_matches(lower(substr(text, 1, 500)), '// code generated|# do not edit|# this file is auto-generated|// auto-generated') OR contains(substr(text, 1, 500), ' eslint-disable */') AS generated,
  regexp_matches(path, '(?i)\\.(test|spec)\\.(ts|tsx|js|jsx|mjs)$') OR regexp_matches(path, '(?i)(^|/)test_[^/]+\\.py$') OR regexp_matches(path, '(?i)(^|/)[^/]+_test\\.(go|py|rb)$') OR regexp_matches(path, '(?i)(^|/)__tests__/')
   OR regexp_matches(path, '(?i)(^|/)tests?/') OR regexp_matches(path, '(?i)(^|/)spec/') OR regexp_matches(path, '[A-Z][^/]*Tests?\\.(java|kt|cs)$') OR regexp_matches(path, '(?i)\\.(test|spec)\\.rs$') AS test,
  regexp_matches(path, '(?i)(^|/)tests?/fixtures?/|(^|/)__snapshots__/|(^|/)__mocks__/|\\.snap$|\\.fixture\\.(json|ts|js|yaml)$') AS fixture FROM kept),
coded AS (SELECT c.*, l.language FROM counted c JOIN (VALUES ('.py','Python'),('.ts','TypeScript'),('.tsx','TypeScript'),('.js','JavaScript'),('.h','C/C++'),('.sql','SQL'),('.java','Java'),('.go','Go'),('.sh','Shell'),('.rb','Ruby'),('.rs','Rust'),('.c','C')) l(ext, language) USING (ext))
"""
