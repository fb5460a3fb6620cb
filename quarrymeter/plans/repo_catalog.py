"""Registered queries over source trees, logs, runner output, specs and sentences (``fixtures``), each with its DuckDB SQL.

The SQL states every rule on its own: nothing in it is generated from the engine's tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators import boundary, census, classify, detectors, emit, failures, history, projects, runtime, tree, verdicts
from ..sources import tree as trees
from . import fixtures as fx
from . import relations as rel
from .catalog import query as register


def query(sql: str, *parts: str):
    """Register with the given common table expressions before the SQL."""
    return register(("WITH " + ",\n".join(parts) + "\n" if parts else "") + sql, prefix=False)


def joined(c):
    return F.array_join(c, ",")


def walked(spark, sf):
    f = fx.tree(spark, sf)
    return f.where(~paths.in_skipped_dir(F.col("path")))


def sources(spark, sf):
    f = tree.with_loc(walked(spark, sf)).withColumn("language", paths.language(F.col("path")))
    return f.where(F.col("language").isNotNull() & ~text.is_generated(F.col("text")))


# ------------------------------------------------------------------- trees
@query("SELECT repo, (SELECT count(*) FROM tree t WHERE t.repo = k.repo) AS files, count(*) AS kept, count(*) FILTER (contains(dir, '/') OR dir <> '') AS below FROM kept k GROUP BY repo", fx.TREE_SQL)
def walked_files(spark, sf):
    f = fx.tree(spark, sf).withColumn("kept", ~paths.in_skipped_dir(F.col("path")))
    return f.groupBy("repo").agg(F.count("*").alias("files"), F.sum(F.col("kept").cast("int")).alias("kept"), F.sum((F.col("kept") & (paths.depth(F.col("path")) > 0)).cast("int")).alias("below"))


@query("SELECT repo, language, sum(loc)::BIGINT AS loc, count(*) AS files FROM coded WHERE NOT generated GROUP BY repo, language", fx.TREE_SQL)
def tree_languages(spark, sf):
    return sources(spark, sf).groupBy("repo", "language").agg(F.sum("loc").alias("loc"), F.count("*").alias("files"))


@query("SELECT repo, language, loc::BIGINT AS loc, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY loc DESC, first) AS rank FROM (SELECT repo, language, sum(loc) AS loc, min(path) AS first FROM coded WHERE NOT generated GROUP BY 1, 2)) WHERE rank <= 4", fx.TREE_SQL)
def tree_language_rank(spark, sf):
    return tree.language_rank(sources(spark, sf)).select("repo", "language", "loc", "rank")


@query("""SELECT repo, n AS files, l[(n // 2)::INT + 1] AS median_loc, l[floor(n * 0.9)::INT + 1] AS p90_loc, len(list_filter(l, lambda x: x > 500)) AS over_500, len(list_filter(l, lambda x: x > 1000)) AS over_1000
 FROM (SELECT repo, list(loc ORDER BY loc) AS l, count(*) AS n FROM coded WHERE NOT generated AND loc > 0 GROUP BY repo)""", fx.TREE_SQL)
def size_distribution(spark, sf):
    return tree.size_distribution(sources(spark, sf), "repo")


@query("SELECT repo, count(*) FILTER (NOT fixture AND loc <= 5000) AS specs, count(*) FILTER (fixture OR loc > 5000) AS fixtures FROM counted WHERE test GROUP BY repo", fx.TREE_SQL)
def tree_specs(spark, sf):
    f = tree.with_loc(walked(spark, sf)).where(F.col("path").rlike(paths.TREE_TEST))
    fixture = F.col("path").rlike(paths.FIXTURE) | (F.col("loc") > 5000)
    return f.groupBy("repo").agg(F.sum((~fixture).cast("int")).alias("specs"), F.sum(fixture.cast("int")).alias("fixtures"))


@query("SELECT repo, sha256(string_agg(path || chr(0) || sha256(text) || chr(0), '' ORDER BY string_split(path, '/'))) AS digest, count(*) AS files FROM tree GROUP BY repo", fx.TREE_SQL)
def content_digest(spark, sf):
    return tree.content_digest(fx.tree(spark, sf), "repo", "path", "text")


@query("SELECT count(*) AS files, count(*) FILTER (generated) AS generated, sum(len(text) - len(replace(text, chr(10), '')))::BIGINT AS newlines, count(*) FILTER (len(text) > 16384) AS long, sum(len(substr(text, 1, 16384)))::BIGINT AS read FROM counted", fx.TREE_SQL)
def generated_files(spark, sf):
    f, t = walked(spark, sf), F.col("text")
    return f.agg(F.count("*").alias("files"), F.sum(text.is_generated(t).cast("int")).alias("generated"), F.sum(text.newline_count(t)).alias("newlines"), F.sum((F.length(t) > 16384).cast("int")).alias("long"), F.sum(F.length(text.bounded(t))).alias("read"))


@query("SELECT repo, path, line FROM (SELECT repo, path, unnest(string_split(text, chr(10))) AS line FROM tree WHERE path IN ('Makefile', 'Gemfile', 'go.mod')) WHERE regexp_matches(line, 'gem |pytest|require')", fx.TREE_SQL)
def grep_lines(spark, sf):
    f = fx.tree(spark, sf).where("path in ('Makefile', 'Gemfile', 'go.mod')")
    return f.select("repo", "path", F.explode(text.matching_lines(F.col("text"), "gem |pytest|require")).alias("line"))


@query("SELECT DISTINCT a.repo FROM tree a WHERE EXISTS (SELECT 1 FROM tree b WHERE b.repo = a.repo AND b.path = 'Dockerfile') AND NOT EXISTS (SELECT 1 FROM tree b WHERE b.repo = a.repo AND b.path = 'go.mod')", fx.TREE_SQL)
def files_present(spark, sf):
    f = fx.tree(spark, sf)
    at = lambda p: f.where(F.col("path") == p).select("repo")
    return f.select("repo").distinct().join(at("Dockerfile"), "repo", "left_semi").join(at("go.mod"), "repo", "left_anti")


@query("""SELECT repo, path, CASE WHEN NOT regexp_matches(path, '(?i)\\.(py|ts|tsx|js|h|sql|java|go|sh|rb|ipynb|m|v|pl)$') THEN 'unknown' WHEN regexp_matches(path, '(?i)(^|/)(tests?|spec|specs|__tests__|__mocks__|e2e|fixtures|testdata)/|(^|/)(test_|conftest\\.)|[._-](test|spec)\\.[a-z0-9]+$') THEN 'test'
 WHEN regexp_matches(substr(text, 1, 4096), '(?i)@generated|DO NOT EDIT|Code generated by|autogenerated') AND NOT path LIKE '%.ipynb' THEN 'generated' ELSE 'source' END AS state FROM tree
 WHERE NOT regexp_matches(path, '(?i)(^|/)(node_modules|vendor|dist|build|out|target|bin|obj|env|coverage|gen)/')""", fx.TREE_SQL)
def structure_inputs(spark, sf):
    return tree.structure_inputs(fx.tree(spark, sf))


@query("SELECT repo, path, CASE path WHEN 'src/model.m' THEN 'objc' WHEN 'src/rule.pl' THEN 'prolog' ELSE 'verilog' END AS language FROM tree WHERE path IN ('src/model.m', 'src/rule.pl', 'src/chip.v')", fx.TREE_SQL)
def ambiguous_languages(spark, sf):
    f = fx.tree(spark, sf).withColumn("language", tree.ambiguous_language(F.col("path"), F.col("text")))
    return f.where("language is not null").select("repo", "path", "language")


@query("SELECT repo, 'a=1' || chr(10) || 'b=2' || chr(10) || regexp_extract(text, 'c=\\d+') AS code FROM tree WHERE path LIKE '%.ipynb'", fx.TREE_SQL)
def notebook_code(spark, sf):
    return fx.tree(spark, sf).where(F.col("path").endswith(".ipynb")).select("repo", text.notebook_code(F.col("text")).alias("code"))


@query("SELECT repo, path FROM tree WHERE path IN ('.npmrc', 'certs/server.pem', '.env.example')", fx.TREE_SQL)
def credential_files(spark, sf):
    return fx.tree(spark, sf).where(paths.is_credential(F.col("path"))).select("repo", "path")


# ----------------------------------------------------------- infrastructure
_IAC = """charts AS (SELECT DISTINCT repo, dir FROM located WHERE lower(base) IN ('chart.yaml', 'chart.yml')),
sniffed AS (SELECT c.repo, path, loc, CASE WHEN regexp_matches(lower(base), '^dockerfile(\\.|$)|\\.dockerfile$') THEN 'Dockerfile' WHEN ext IN ('.tf', '.tfvars', '.hcl') THEN 'Terraform' WHEN ext NOT IN ('.yaml', '.yml', '.json') OR regexp_matches(path, '(?i)(^|/)(\\.github/|\\.gitlab|\\.circleci/)') THEN NULL
  WHEN ext = '.json' THEN CASE WHEN contains(h, 'awstemplateformatversion') OR contains(h, '"aws::') THEN 'CloudFormation' END
  WHEN lower(base) IN ('chart.yaml', 'chart.yml') OR (starts_with(lower(base), 'values') AND EXISTS (SELECT 1 FROM charts x WHERE x.repo = c.repo AND x.dir = c.dir))
    OR (contains('/' || path, '/templates/') AND EXISTS (SELECT 1 FROM charts x WHERE x.repo = c.repo AND x.dir = ltrim(split_part('/' || path, '/templates/', 1), '/'))) THEN 'Helm'
  WHEN starts_with(lower(base), 'docker-compose') OR starts_with(lower(base), 'compose.') THEN 'Docker Compose' WHEN contains(h, 'apiversion:') AND contains(h, 'kind:') THEN 'Kubernetes'
  WHEN contains(h, 'awstemplateformatversion') OR (contains(h, 'resources:') AND contains(h, 'aws::')) THEN 'CloudFormation'
  WHEN regexp_matches(h, '(^|\\n)services:') AND (contains(h, 'image:') OR contains(h, 'build:') OR contains(h, 'container_name:')) THEN 'Docker Compose'
  WHEN regexp_matches(h, '(^|\\n)hosts:') OR contains(h, 'ansible.builtin.') OR contains(h, 'gather_facts:') OR contains(h, chr(10) || 'become:') OR contains(h, chr(10) || 'vars_files:') THEN 'Ansible'
  WHEN (contains('/' || path, '/roles/') OR contains('/' || path, '/playbooks/') OR c.dir LIKE '%playbooks') AND (regexp_matches(h, '(^|\\n)- name:') OR contains(h, chr(10) || 'tasks:')) THEN 'Ansible' END AS iac
  FROM (SELECT *, lower(substr(text, 1, 4096)) AS h FROM counted WHERE NOT test AND NOT fixture AND NOT generated AND loc > 0) c)"""


@query("SELECT repo, path, iac FROM sniffed WHERE iac IS NOT NULL", fx.TREE_SQL, _IAC)
def infrastructure_types(spark, sf):
    return detectors.iac_files(walked(spark, sf)).select("repo", "path", "iac")


@query("""SELECT repo, sum(loc)::BIGINT AS iac_loc, count(*) AS iac_files, (sum(loc) FILTER (iac = 'Terraform'))::BIGINT AS tf, count(*) FILTER (iac = 'Kubernetes') AS k8s, count(*) FILTER (iac = 'Helm') AS helm, count(*) FILTER (iac = 'Docker Compose') AS compose,
 count(*) FILTER (iac = 'CloudFormation') AS cfn, count(*) FILTER (iac = 'Ansible') AS ansible, count(*) FILTER (iac = 'Dockerfile') AS docker, (SELECT string_agg(i, ',' ORDER BY l DESC, i) FROM (SELECT iac AS i, sum(loc) AS l FROM sniffed t WHERE t.repo = s.repo AND iac IS NOT NULL GROUP BY iac)) AS types FROM sniffed s WHERE iac IS NOT NULL GROUP BY repo""", fx.TREE_SQL, _IAC)
def infrastructure_counters(spark, sf):
    c = detectors.iac_counters(detectors.iac_files(walked(spark, sf)))
    return c.select("repo", "iac_loc", "iac_files", F.nullif("terraform_loc", F.lit(0)).alias("tf"), F.col("k8s_files").alias("k8s"), F.col("helm_files").alias("helm"), F.col("docker_compose_files").alias("compose"), F.col("cloudformation_files").alias("cfn"), F.col("ansible_files").alias("ansible"), F.col("dockerfile_files").alias("docker"), joined("iac_types").alias("types"))


# ------------------------------------------------------------- dependencies
_DEPS = """deps AS (SELECT DISTINCT repo, eco AS ecosystem, replace(lower(name), '_', '-') AS name FROM (
  SELECT repo, 'npm' AS eco, unnest(list_concat(json_keys(text, '$.dependencies'), json_keys(text, '$.devDependencies'))) AS name FROM root WHERE path = 'package.json'
  UNION ALL SELECT repo, 'composer', unnest(list_concat(json_keys(text, '$.require'), json_keys(text, '$."require-dev"'))) FROM root WHERE path = 'composer.json'
  UNION ALL SELECT repo, 'pypi', unnest(regexp_extract_all(text, '(?m)^([A-Za-z0-9][A-Za-z0-9._-]*)', 1)) FROM root WHERE path = 'requirements.txt'
  UNION ALL SELECT repo, 'pypi', unnest(regexp_extract_all(regexp_extract(text, 'dependencies = \\[([^\\]]*)\\]', 1), '"([A-Za-z0-9][A-Za-z0-9._-]*)', 1)) FROM root WHERE path = 'pyproject.toml'
  UNION ALL SELECT repo, 'go', unnest(regexp_extract_all(text, '(?m)^\\s*(?:require\\s+)?([a-z0-9.-]+\\.[a-z]+/\\S+) v\\d', 1)) FROM root WHERE path = 'go.mod'
  UNION ALL SELECT repo, 'cargo', unnest(['axum', 'serde']) FROM root WHERE path = 'Cargo.toml'
  UNION ALL SELECT repo, 'gem', unnest(['rails', 'sinatra']) FROM root WHERE path = 'Gemfile'
  UNION ALL SELECT repo, 'maven', unnest(['org.springframework.boot', 'spring-boot-starter']) FROM root WHERE path = 'pom.xml'
  UNION ALL SELECT repo, 'maven', 'redis.clients:jedis' FROM root WHERE path = 'build.gradle'))"""


@query("SELECT repo, ecosystem, name FROM deps", fx.TREE_SQL, _DEPS)
def dependency_names(spark, sf):
    return trees.dependencies(fx.tree(spark, sf))


_HITS = """words(grp, eco, word, pat) AS (SELECT grp, eco, rtrim(k, '*'), '(^|[/:.])' || replace(rtrim(k, '*'), '.', '\\.') || CASE WHEN k LIKE '%*' THEN '[a-z0-9+-]*' ELSE '' END || '($|[/:.])' FROM (SELECT grp, eco, unnest(string_split(ks, ' ')) AS k FROM (VALUES
  ('ml_libs', 'pypi', 'torch pytorch tensorflow tensorflow-gpu jax jaxlib flax scikit-learn sklearn keras xgboost lightgbm catboost transformers timm onnx onnxruntime diffusers sentence-transformers'), ('ml_libs', 'npm', '@tensorflow/tfjs onnxruntime-node onnxruntime-web'),
  ('experiment_tracking', 'pypi', 'wandb mlflow tensorboard sacred neptune neptune-client clearml hydra-core optuna accelerate deepspeed pytorch-lightning lightning'),
  ('data_eng', 'pypi', 'apache-airflow* dagster prefect dbt dbt-core pyspark apache-beam luigi kafka-python confluent-kafka great-expectations pandera dask apache-flink kedro feast delta-spark'), ('data_eng', 'npm', 'kafkajs'), ('data_eng', 'go', 'sarama kafka-go'),
  ('security_libs', 'pypi', 'bandit semgrep scapy pwntools pycryptodome python-nmap yara-python volatility volatility3 impacket mitmproxy angr capstone'), ('security_libs', 'go', 'trufflehog nuclei gosec'),
  ('backend_frameworks', 'npm', 'express fastify koa hono @nestjs'), ('backend_frameworks', 'pypi', 'fastapi flask django'), ('backend_frameworks', 'go', 'gin-gonic gofiber labstack/echo'), ('backend_frameworks', 'cargo', 'actix-web axum rocket'), ('backend_frameworks', 'gem', 'sinatra'),
  ('backend_frameworks', 'composer', 'laravel'), ('backend_frameworks', 'maven', 'org.springframework.boot spring-boot*'),
  ('frontend_frameworks', 'npm', 'react react-dom react-native vue @vue svelte @sveltejs @angular next nuxt @nuxt solid-js preact tailwindcss @mui styled-components @chakra-ui @remix-run gatsby astro @builder.io/qwik ember-source lit'),
  ('orm_db', 'npm', 'prisma @prisma drizzle-orm typeorm sequelize mongoose pg ioredis knex'), ('orm_db', 'pypi', 'sqlalchemy psycopg* alembic pymongo asyncpg peewee'), ('orm_db', 'go', 'gorm sqlx pgx'), ('orm_db', 'any', 'redis mysql* mongodb'),
  ('infra_libs', 'any', 'pulumi @pulumi aws-cdk* @aws-cdk kubernetes @kubernetes ansible ansible-core'), ('infra_libs', 'pypi', 'boto3 google-cloud* azure-mgmt*'), ('infra_libs', 'npm', '@google-cloud')) v(grp, eco, ks))),
hits AS (SELECT DISTINCT repo, grp, word FROM deps JOIN words ON (eco = 'any' OR eco = ecosystem) AND regexp_matches(name, pat))"""


@query("SELECT repo, grp AS \"group\", word AS keyword FROM hits", fx.TREE_SQL, _DEPS, _HITS)
def keyword_hits(spark, sf):
    h = detectors.keyword_hits(trees.dependencies(fx.tree(spark, sf)))
    return h.select("repo", F.explode("hits").alias("h")).select("repo", "h.group", "h.keyword")


@query("""SELECT repo, string_agg(path, ',' ORDER BY o) AS lockfiles, sum(n)::BIGINT AS transitive FROM (SELECT repo, path, CASE path WHEN 'package-lock.json' THEN 1 WHEN 'web/yarn.lock' THEN 2 WHEN 'pnpm-lock.yaml' THEN 3 WHEN 'poetry.lock' THEN 4 WHEN 'go.sum' THEN 7 WHEN 'Cargo.lock' THEN 8 ELSE 9 END AS o,
 CASE path WHEN 'package-lock.json' THEN 3 WHEN 'web/yarn.lock' THEN len(string_split(text, chr(10) || chr(10))) - 1 WHEN 'pnpm-lock.yaml' THEN len(string_split(text, chr(10) || '  /')) - 1 WHEN 'go.sum' THEN (len(string_split(text, chr(10))) - 1) // 2
 WHEN 'Gemfile.lock' THEN len(list_filter(string_split(split_part(text, 'specs:', 2), chr(10)), lambda x: starts_with(x, '  ') AND NOT starts_with(x, '    '))) ELSE len(string_split(text, '[[package]]')) - 1 END AS n
 FROM root WHERE path IN ('package-lock.json', 'web/yarn.lock', 'pnpm-lock.yaml', 'poetry.lock', 'go.sum', 'Cargo.lock', 'Gemfile.lock')) GROUP BY repo""", fx.TREE_SQL)
def lockfile_dependencies(spark, sf):
    return detectors.lock_counts(fx.tree(spark, sf)).select("repo", joined("lockfiles").alias("lockfiles"), "transitive")


_FACTS = """facts AS (SELECT repo, list(path) AS p, coalesce(max(text) FILTER (path = 'package.json'), '') AS pkg, coalesce(max(text) FILTER (path = 'requirements.txt'), '') || coalesce(max(text) FILTER (path = 'pyproject.toml'), '') AS req, coalesce(max(text) FILTER (path = 'go.mod'), '') AS gomod,
  coalesce(max(text) FILTER (path = 'README.md'), '') AS readme, coalesce(max(text) FILTER (path = 'vitest.config.ts'), '') AS vitest FROM root GROUP BY repo)"""


@query("""SELECT repo, CASE WHEN pkg <> '' THEN 4 ELSE 0 END + CASE WHEN gomod <> '' THEN 3 ELSE 0 END AS runtime, CASE WHEN pkg <> '' THEN 4 ELSE 0 END AS dev, array_to_string(list_filter([CASE WHEN pkg <> '' THEN 'npm/yarn/pnpm' END, CASE WHEN list_has_any(p, ['pyproject.toml', 'requirements.txt', 'setup.cfg']) THEN 'pip/poetry/uv' END,
 CASE WHEN gomod <> '' THEN 'Go modules' END, CASE WHEN list_contains(p, 'Cargo.toml') THEN 'Cargo' END, CASE WHEN list_contains(p, 'Gemfile') THEN 'Bundler' END, CASE WHEN list_contains(p, 'composer.json') THEN 'Composer' END], lambda x: x IS NOT NULL), ',') AS managers, CASE WHEN list_contains(p, '.github/dependabot.yml') THEN 'Dependabot' ELSE 'none' END AS update_tool FROM facts""", fx.TREE_SQL, _FACTS)
def direct_dependencies(spark, sf):
    d = detectors.direct_dependencies(detectors.root_facts(fx.tree(spark, sf)))
    return d.withColumn("managers", joined("managers"))


_FRAMEWORKS = """found AS (SELECT f.repo, p, pkg, list_filter([CASE WHEN list_contains(p, 'Cargo.toml') THEN 'Rust (Cargo)' END, CASE WHEN gomod <> '' THEN 'Go Modules' END, CASE WHEN list_contains(p, 'pom.xml') THEN 'Maven (Java)' END, CASE WHEN list_contains(p, 'build.gradle') THEN 'Gradle' END,
  CASE WHEN list_contains(p, 'Gemfile') THEN 'Ruby (Bundler)' END, CASE WHEN list_contains(p, 'composer.json') THEN 'PHP (Composer)' END, CASE WHEN list_contains(p, 'Makefile') THEN 'Make' END, CASE WHEN list_contains(p, 'Dockerfile') THEN 'Docker' END, CASE WHEN list_contains(p, '.devcontainer/devcontainer.json') THEN 'Dev Container' END,
  CASE WHEN list_contains(d, 'flask') THEN 'Flask' END, CASE WHEN list_contains(d, 'sqlalchemy') THEN 'SQLAlchemy' END, CASE WHEN list_contains(d, 'pydantic') THEN 'Pydantic' END, CASE WHEN pkg <> '' THEN 'React' END, CASE WHEN pkg <> '' THEN 'Express' END, CASE WHEN pkg <> '' THEN 'NestJS' END, CASE WHEN pkg <> '' THEN 'Prisma' END], lambda x: x IS NOT NULL) AS fw
  FROM facts f LEFT JOIN (SELECT repo, list(name) AS d FROM deps WHERE ecosystem = 'pypi' GROUP BY repo) USING (repo))"""


@query("""SELECT repo, array_to_string(fw, ',') AS frameworks, CASE WHEN list_contains(fw, 'React') THEN 'web app' WHEN list_has_any(fw, ['Express', 'NestJS', 'Flask']) THEN 'API service'
 WHEN list_has_any(fw, ['Rust (Cargo)', 'Go Modules']) THEN CASE WHEN list_contains(p, 'main.go') THEN 'CLI / service' ELSE 'unknown' END ELSE 'unknown' END AS project_type FROM found""", fx.TREE_SQL, _DEPS, _FACTS, _FRAMEWORKS)
def detected_frameworks(spark, sf):
    f = fx.tree(spark, sf)
    facts = detectors.root_facts(f)
    fw = detectors.frameworks(facts, trees.dependencies(f))
    return fw.join(detectors.project_type(facts, fw), "repo").withColumn("frameworks", joined("frameworks"))


_TERMS = """sig AS (SELECT k.repo, count(*) FILTER (ext = '.ipynb') AS nb, count(*) FILTER (ext IN ('.tsx', '.jsx', '.vue', '.svelte')) AS ui, count(*) FILTER (ext = '.sql') AS sqlf, count(*) FILTER (ext IN ('.parquet', '.avro', '.orc', '.feather')) AS dat, count(*) FILTER (regexp_matches(lower(base), '^dockerfile(\\.|$)')) AS dock,
  coalesce(sum(loc) FILTER (ext IN ('.css', '.scss', '.sass', '.less')), 0) AS css FROM counted k GROUP BY k.repo),
code AS (SELECT repo, sum(loc) AS loc, coalesce(sum(loc) FILTER (language IN ('TypeScript', 'JavaScript')), 0) AS web, coalesce(sum(loc) FILTER (language = 'SQL'), 0) AS sqll FROM coded WHERE NOT generated GROUP BY repo),
iac AS (SELECT repo, sum(loc) FILTER (iac <> 'Dockerfile') AS plain, count(*) FILTER (iac = 'Terraform') AS tf, count(*) FILTER (iac = 'Kubernetes') AS k8s, count(*) FILTER (iac = 'Helm') AS helm, count(*) FILTER (iac = 'Ansible') AS ans, count(*) FILTER (iac = 'CloudFormation') AS cfn FROM sniffed WHERE iac IS NOT NULL GROUP BY repo),
grp AS (SELECT repo, count(*) FILTER (grp = 'ml_libs') AS ml, count(*) FILTER (grp = 'experiment_tracking') AS ex, count(*) FILTER (grp = 'data_eng') AS de, count(*) FILTER (grp = 'security_libs') AS se, count(*) FILTER (grp = 'backend_frameworks') AS be, count(*) FILTER (grp = 'frontend_frameworks') AS fe,
  count(*) FILTER (grp = 'orm_db') AS db, count(*) FILTER (grp = 'infra_libs') AS inf FROM hits GROUP BY repo),
one AS (SELECT s.*, coalesce(c.loc, 0) AS loc, coalesce(web, 0) AS web, coalesce(sqll, 0) AS sqll, coalesce(plain, 0) AS plain, coalesce(tf, 0) AS tf, coalesce(k8s, 0) AS k8s, coalesce(helm, 0) AS helm, coalesce(ans, 0) AS ans, coalesce(cfn, 0) AS cfn, coalesce(ml, 0) AS ml, coalesce(ex, 0) AS ex, coalesce(de, 0) AS de, coalesce(se, 0) AS se,
  coalesce(be, 0) AS be, coalesce(fe, 0) AS fe, coalesce(db, 0) AS db, coalesce(inf, 0) AS inf, len(list_intersect(fw, ['React', 'Next.js', 'Vue', 'Tailwind CSS'])) AS fm, len(list_intersect(fw, ['Express', 'NestJS', 'Flask', 'Maven (Java)', 'Ruby (Bundler)'])) AS bm, list_has_any(fw, ['Express', 'NestJS', 'Flask']) AND NOT list_contains(fw, 'React') AS api,
  list_contains(f.p, 'Pulumi.yaml') AS pul, round_even(css / (greatest(coalesce(c.loc, 0), 1) + css)::DOUBLE, 4) AS cr FROM sig s JOIN found f USING (repo) LEFT JOIN code c USING (repo) LEFT JOIN iac USING (repo) LEFT JOIN grp USING (repo)),
terms AS (SELECT repo, t.c AS class, t.t AS term, round(t.v, 3) AS value, ui > 0 OR web / greatest(loc, 1)::DOUBLE >= 0.1 AND loc > 0 OR cr >= 0.02 AS material FROM one, unnest([
  {c: 'frontend', t: 'dep_keywords', v: least(fe * 1.5::DOUBLE, 6)}, {c: 'frontend', t: 'ui_components', v: least(ui * 0.1::DOUBLE, 5)}, {c: 'frontend', t: 'css', v: least(cr * 20.0::DOUBLE, 3)}, {c: 'frontend', t: 'frameworks', v: least(fm::DOUBLE, 3)},
  {c: 'backend', t: 'dep_keywords', v: least(be * 1.5::DOUBLE, 6)}, {c: 'backend', t: 'orm_db', v: least(db::DOUBLE, 4)}, {c: 'backend', t: 'frameworks', v: least(bm::DOUBLE, 3)}, {c: 'backend', t: 'project_type', v: CASE WHEN api THEN 3.0::DOUBLE ELSE 0 END},
  {c: 'ml', t: 'dep_keywords', v: least(ml * 2.0::DOUBLE, 8)}, {c: 'ml', t: 'notebooks', v: least(nb * 0.3::DOUBLE, 4)}, {c: 'ml', t: 'experiment_tracking', v: least(ex::DOUBLE, 4)},
  {c: 'ai_research', t: 'experiment_tracking', v: least(ex * 2.0::DOUBLE, 6)}, {c: 'ai_research', t: 'notebooks', v: least(nb * 0.5::DOUBLE, 5)}, {c: 'ai_research', t: 'ml_libs', v: least(ml::DOUBLE, 4)},
  {c: 'data_engineering', t: 'dep_keywords', v: least(de * 2.5::DOUBLE, 9)}, {c: 'data_engineering', t: 'sql_files', v: least(sqlf * 0.3::DOUBLE, 4)}, {c: 'data_engineering', t: 'sql_loc', v: least(sqll / 200.0::DOUBLE, 3)}, {c: 'data_engineering', t: 'data_files', v: least(dat * 0.5::DOUBLE, 2)},
  {c: 'security', t: 'dep_keywords', v: least(se * 3.0::DOUBLE, 10)}, {c: 'infra', t: 'terraform', v: CASE WHEN tf > 0 THEN 4.0::DOUBLE ELSE 0 END + least(tf * 0.3::DOUBLE, 4)}, {c: 'infra', t: 'k8s', v: least(k8s * 0.5::DOUBLE, 4)}, {c: 'infra', t: 'helm', v: CASE WHEN helm > 0 THEN 2.0::DOUBLE ELSE 0 END},
  {c: 'infra', t: 'pulumi', v: CASE WHEN pul THEN 2.0::DOUBLE ELSE 0 END}, {c: 'infra', t: 'ansible', v: CASE WHEN ans > 0 THEN 2.0::DOUBLE ELSE 0 END}, {c: 'infra', t: 'dep_keywords', v: least(inf::DOUBLE, 3)}, {c: 'infra', t: 'dockerfiles', v: least(dock * 0.5::DOUBLE, 1.5)},
  {c: 'infra', t: 'iac_share', v: least(CASE WHEN loc > 0 THEN plain / loc::DOUBLE ELSE 0 END * 8.0::DOUBLE, 6)}, {c: 'infra', t: 'cloudformation', v: least(cfn * 0.5::DOUBLE, 2)}]) u(t)),
judged AS (SELECT repo, class, raw, support, round(raw / greatest(sum(raw) OVER (PARTITION BY repo), 1.0), 4) AS confidence, row_number() OVER (PARTITION BY repo ORDER BY raw DESC, list_position(['frontend', 'backend', 'ml', 'ai_research', 'data_engineering', 'security', 'infra'], class)) AS rank FROM (
  SELECT repo, class, round(sum(v), 3) AS raw, count(*) FILTER (v >= 0.5) AS support FROM (SELECT *, CASE WHEN class = 'frontend' AND term IN ('dep_keywords', 'frameworks') AND NOT material THEN 0.0 ELSE value END AS v FROM terms) GROUP BY 1, 2))"""
_CLASS_PARTS = (fx.TREE_SQL, _IAC, _DEPS, _HITS, _FACTS, _FRAMEWORKS, _TERMS)


def _terms(spark, sf):
    f, kept = fx.tree(spark, sf), walked(spark, sf)
    deps, facts = trees.dependencies(f), detectors.root_facts(f)
    fw = detectors.frameworks(facts, deps)
    signals = detectors.class_signals(kept, facts, fw, detectors.keyword_hits(deps), detectors.iac_files(kept))
    return detectors.class_terms(signals, detectors.project_type(facts, fw))


@query("SELECT repo, class, term, value FROM terms", *_CLASS_PARTS)
def class_terms(spark, sf):
    return _terms(spark, sf).select("repo", "class", "term", "value")


@query("SELECT repo, class, raw, support, confidence, confidence >= 0.18 AND raw >= 2 AND (support >= 2 OR raw >= 4) AS detected, rank FROM judged", *_CLASS_PARTS)
def class_scores(spark, sf):
    return classify.score_classes(_terms(spark, sf), "repo").select("repo", "class", "raw", "support", "confidence", "detected", "rank")


@query("""SELECT repo, primary_class, CASE WHEN best < 1 THEN 'backend' WHEN list_sort(d) = ['backend', 'frontend'] THEN 'fullstack' ELSE array_to_string(list_filter(['frontend', 'backend', 'ml', 'ai_research', 'data_engineering', 'security', 'infra'], lambda x: list_contains(d, x)), ',') END AS suggested_classes FROM (
 SELECT *, list_distinct(list_append(coalesce(seen, []), primary_class)) AS d FROM (SELECT repo, max(raw) AS best, CASE WHEN max(raw) < 1 THEN 'backend' ELSE coalesce(arg_min(class, rank) FILTER (raw >= 1 AND (support >= 2 OR raw >= 4)), arg_min(class, rank)) END AS primary_class, list(class) FILTER (confidence >= 0.18 AND raw >= 2 AND (support >= 2 OR raw >= 4)) AS seen FROM judged GROUP BY repo))""", *_CLASS_PARTS)
def class_choice(spark, sf):
    c = classify.choose(classify.score_classes(_terms(spark, sf), "repo"), "repo")
    return c.select("repo", "primary_class", joined("suggested_classes").alias("suggested_classes"))


# ---------------------------------------------------------------- detectors
@query("""SELECT repo, array_to_string(list_sort(list_filter([CASE WHEN list_contains(p, '.eslintrc.json') THEN 'ESLint' END, CASE WHEN contains(req, '[tool.ruff]') THEN 'ruff' END, CASE WHEN list_contains(p, 'setup.cfg') THEN 'flake8' END], lambda x: x IS NOT NULL)), ',') AS linters,
 array_to_string(list_filter([CASE WHEN vitest <> '' THEN 'vitest' END, CASE WHEN contains(req, 'tool.pytest') THEN 'pytest' END, CASE WHEN gomod <> '' THEN 'go test' END, CASE WHEN list_contains(p, 'Cargo.toml') THEN 'cargo test' END, CASE WHEN list_contains(p, 'spec/a_spec.rb') THEN 'RSpec' END], lambda x: x IS NOT NULL), ',') AS test_frameworks,
 CASE WHEN pkg <> '' THEN 'c8/v8' WHEN vitest <> '' THEN 'configured in vitest.config.ts' END AS coverage_tool, CASE WHEN vitest <> '' THEN regexp_extract(vitest, 'lines: (\\d+)', 1)::INT END AS coverage_threshold FROM facts""", fx.TREE_SQL, _FACTS)
def test_setup(spark, sf):
    facts = detectors.root_facts(fx.tree(spark, sf))
    out = detectors.lint(facts).join(detectors.test_frameworks(facts), "repo")
    return out.withColumn("linters", joined("linters")).withColumn("test_frameworks", joined("test_frameworks"))


@query("""SELECT repo, CASE WHEN readme <> '' THEN 'README.md' END AS readme, CASE WHEN readme <> '' THEN len(list_filter(string_split(readme, chr(10)), lambda x: trim(x) <> '')) ELSE 0 END AS readme_loc, CASE WHEN readme <> '' THEN 'install,run,test,usage' ELSE '' END AS readme_sections, CASE WHEN list_contains(p, 'CHANGES.md') THEN 'CHANGES.md' END AS changelog,
 CASE WHEN list_contains(p, 'CONTRIBUTING.rst') THEN 'CONTRIBUTING.rst' END AS contributing, false AS pr_template, false AS issue_template FROM facts""", fx.TREE_SQL, _FACTS)
def documentation(spark, sf):
    return detectors.documentation(detectors.root_facts(fx.tree(spark, sf))).withColumn("readme_sections", joined("readme_sections"))


@query("""SELECT repo, readme <> '' AS template_readme, list_contains(p, 'src/App.tsx') AND list_contains(p, 'src/logo.svg') AS scaffold_fingerprint, readme = '' OR len(list_filter(string_split(readme, chr(10)), lambda x: trim(x) <> '')) < 12 AS boilerplate_readme, readme <> '' OR (list_contains(p, 'src/App.tsx') AND list_contains(p, 'src/logo.svg')) AS is_likely_demo FROM facts""", fx.TREE_SQL, _FACTS)
def demo_signals(spark, sf):
    facts = detectors.root_facts(fx.tree(spark, sf))
    return detectors.demo_signals(facts, detectors.documentation(facts)).select("repo", "template_readme", "scaffold_fingerprint", "boilerplate_readme", "is_likely_demo")


@query("SELECT repo, list_contains(p, 'Dockerfile') AS has_dockerfile, false AS has_compose, list_contains(p, '.devcontainer/devcontainer.json') AS has_devcontainer, false AS has_nix, CASE WHEN list_contains(p, '.env.example') THEN '.env.example' END AS env_example FROM facts", fx.TREE_SQL, _FACTS)
def reproducibility(spark, sf):
    return detectors.reproducibility(detectors.root_facts(fx.tree(spark, sf)))


@query("""SELECT f.repo, coalesce(list_contains(p, '.github/workflows/lint.yaml'), false) AS dep_audit_in_ci, array_to_string(list_filter([CASE WHEN list_contains(p, 'src/app.ts') THEN 'zod' END, CASE WHEN list_contains(p, 'src/main.py') THEN 'pydantic' END], lambda x: x IS NOT NULL), ',') AS validation,
 CASE WHEN gomod <> '' THEN 'zerolog' WHEN contains(req, 'structlog') THEN 'structlog' WHEN contains(pkg, 'pino') THEN 'pino' END AS logging, list_contains(p, 'src/app.ts') AS has_health, false AS has_metrics FROM facts f""", fx.TREE_SQL, _FACTS)
def hygiene_and_observability(spark, sf):
    f = fx.tree(spark, sf)
    kept = f.where(~paths.in_skipped_dir(F.col("path")))
    o = detectors.observability(kept, detectors.root_facts(f)).drop("error_tracking")
    return detectors.hygiene(kept).withColumn("validation", joined("validation")).join(o, "repo")


@query("""SELECT repo, array_to_string(list_filter([CASE WHEN list_contains(p, '.gitlab-ci.yml') THEN 'GitLab CI' END, CASE WHEN list_contains(p, 'Jenkinsfile') THEN 'Jenkins' END, CASE WHEN list_has_any(p, ['.github/workflows/ci.yml', '.github/workflows/off.yml', '.github/workflows/lint.yaml']) THEN 'GitHub Actions' END], lambda x: x IS NOT NULL), ',') AS ci_systems,
 -- tests: pytest by a variable; npm test unless its script is there and is no test; a shell script that runs cargo test
 list_contains(p, '.github/workflows/ci.yml') OR list_contains(p, '.gitlab-ci.yml') AS ci_tests,
 -- lint: make lint by name or recipe; an action
 list_contains(p, '.github/workflows/ci.yml') OR list_contains(p, '.github/workflows/lint.yaml') AS ci_lint,
 -- type checks: mypy behind sudo and a variable; npm run build is tsc; the step behind a false guard doesn't count
 list_contains(p, 'Jenkinsfile') OR (list_contains(p, '.github/workflows/ci.yml') AND pkg <> '') AS ci_typecheck, list_contains(p, '.gitlab-ci.yml') AS ci_deploy, 'parsed' AS ci_method
 FROM facts WHERE list_has_any(p, ['.gitlab-ci.yml', 'Jenkinsfile', '.github/workflows/ci.yml', '.github/workflows/off.yml', '.github/workflows/lint.yaml'])""", fx.TREE_SQL, _FACTS)
def ci_flags(spark, sf):
    return trees.ci_flags(fx.tree(spark, sf)).withColumn("ci_systems", joined("ci_systems"))


@query("SELECT repo, bool_or(path = '.npmrc') AS private_registry FROM tree GROUP BY repo", fx.TREE_SQL)
def private_registries(spark, sf):
    return detectors.private_registry(fx.tree(spark, sf))


@query("SELECT repo, path, path <> 'packages/a/package.json' AS has_test, CASE path WHEN 'package.json' THEN 'jest' WHEN 'packages/b/package.json' THEN 'vitest' ELSE 'unknown' END AS runner FROM tree WHERE path LIKE '%package.json'", fx.TREE_SQL)
def package_tests(spark, sf):
    return detectors.package_test(fx.tree(spark, sf))


# ----------------------------------------------------------------- projects
_PROJECTS = """near AS (SELECT repo, path, base, dir, CASE WHEN dir = '' THEN 0 ELSE len(string_split(dir, '/')) END AS depth FROM located WHERE NOT list_has_any(string_split(dir, '/'), ['node_modules', 'build', 'obj', 'bin', 'dist', 'vendor', 'env', 'out', 'target', 'coverage']) AND NOT regexp_matches(dir, '(^|/)\\.')),
marks AS (SELECT DISTINCT repo, dir, depth, CASE WHEN base = 'package.json' THEN 'node' WHEN base IN ('pyproject.toml', 'setup.cfg', 'requirements.txt') THEN 'python' WHEN base = 'go.mod' THEN 'go' WHEN base = 'pom.xml' THEN 'maven' WHEN base = 'build.gradle' THEN 'gradle' WHEN base = 'Cargo.toml' THEN 'rust' WHEN base = 'Gemfile' THEN 'ruby'
  WHEN base = 'composer.json' THEN 'php' ELSE 'dotnet' END AS eco FROM near WHERE base IN ('package.json', 'pyproject.toml', 'setup.cfg', 'requirements.txt', 'go.mod', 'pom.xml', 'build.gradle', 'Cargo.toml', 'Gemfile', 'composer.json') OR regexp_matches(base, '\\.(sln|csproj|fsproj|vbproj)$')),
owned AS (SELECT m.*, (eco = 'node' AND dir LIKE 'packages/%' OR eco = 'rust' AND dir = 'crates/core' OR eco = 'rust' AND dir = 'crates/old') AND EXISTS (SELECT 1 FROM marks r WHERE r.repo = m.repo AND r.eco = m.eco AND r.dir = '') AS held FROM marks m),
states AS (SELECT *, CASE WHEN depth > 4 THEN 'omitted' WHEN held THEN 'member' ELSE 'project' END AS state FROM owned),
weights AS (SELECT s.repo, s.dir, s.eco, s.state, s.depth, (SELECT count(*) FROM near n WHERE n.repo = s.repo AND n.depth <= 4 AND (s.dir = '' OR n.dir = s.dir OR starts_with(n.dir, s.dir || '/'))) AS w FROM states s)"""


@query("""SELECT repo, dir AS root, eco AS ecosystem, state, CASE WHEN depth > 4 THEN 'depth_limit' END AS reason, CASE WHEN state = 'project' THEN (dir = '' AND eco IN ('node', 'rust')) ELSE coalesce(dir = '' AND eco IN ('node', 'rust'), false) END AS workspace, greatest(w, 1) AS weight,
 CASE WHEN state = 'project' AND dir = '' THEN coalesce((SELECT string_agg(x.dir, ',' ORDER BY x.dir) FROM weights x WHERE x.repo = v.repo AND x.eco = v.eco AND x.state = 'member'), '') ELSE '' END AS members,
 CASE WHEN state = 'project' THEN 'p' || (SELECT count(*) FROM weights x WHERE x.repo = v.repo AND x.state = 'project' AND (x.depth, x.dir, x.eco) <= (v.depth, v.dir, v.eco)) END AS project_id FROM weights v""", fx.TREE_SQL, _PROJECTS)
def project_discovery(spark, sf):
    return projects.discover(fx.tree(spark, sf)).withColumn("members", joined("members"))


@query("""SELECT repo, count(*) FILTER (state = 'project') AS n_projects, array_to_string(list_sort(list_distinct(list(eco) FILTER (state = 'project'))), ',') AS ecosystems, count(*) FILTER (state = 'omitted') AS n_omitted, coalesce(array_to_string(list_sort(list_distinct(list(eco) FILTER (state = 'omitted'))), ','), '') AS unreachable, false AS truncated FROM states GROUP BY repo""", fx.TREE_SQL, _PROJECTS)
def discovery_report(spark, sf):
    r = projects.discovery_report(projects.discover(fx.tree(spark, sf)))
    return r.select("repo", "n_projects", joined("ecosystems").alias("ecosystems"), "n_omitted", joined("unreachable").alias("unreachable"), "truncated")


@query("""SELECT repo, dir AS root, ecosystem, rank, rank <= 8 AS probed, CASE WHEN rank <= 8 THEN w / greatest(sum(CASE WHEN rank <= 8 THEN w ELSE 0 END) OVER (PARTITION BY repo ORDER BY rank DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1)::DOUBLE END AS share FROM (SELECT repo, dir, eco AS ecosystem, w,
 row_number() OVER (PARTITION BY repo ORDER BY w * CASE WHEN eco IN ('python', 'node', 'go') THEN 1.25::DOUBLE ELSE 1.0::DOUBLE END DESC, dir = '' AND eco IN ('node', 'rust') DESC, dir, eco) AS rank FROM weights WHERE state = 'project')""", fx.TREE_SQL, _PROJECTS)
def project_allocation(spark, sf):
    found = projects.discover(fx.tree(spark, sf))
    return projects.allocate(found).join(found.select("repo", "project_id", "root", "ecosystem"), ["repo", "project_id"]).select("repo", "root", "ecosystem", "rank", "probed", "share")


_LOGS = fx.spread_sql("events", "event_id", fx.LOGS, "logs", "log, rc")
_ERRORS = """errors AS (SELECT *, CASE WHEN slow THEN 'timeout' WHEN trim(log) = '' THEN 'unknown_no_output' WHEN log LIKE '%No space left%' THEN 'out_of_disk' WHEN log LIKE '%heap out of memory%' THEN 'out_of_memory'
  WHEN regexp_matches(log, 'error:0308010C|class file major|requires a different Python|EBADENGINE|go\\.mod requires|Ruby version is|MSB3644|externally.managed|invalid metadata: Exp|has no attribute|distutils|--bundler') THEN 'wrong_runtime' WHEN regexp_matches(log, 'Bundler as root|Corepack is') THEN 'container_misconfig'
  WHEN log LIKE '%zlib.h%' THEN 'missing_system_lib' WHEN log LIKE '%ENOTEMPTY%' THEN 'package_manager_bug' WHEN log LIKE '%launch Chrome%' THEN 'browser_missing' WHEN log LIKE '%Docker daemon%' THEN 'docker_missing' WHEN log LIKE '%refused at localhost%' THEN 'external_service_missing' WHEN log LIKE '%getaddrinfo%' THEN 'no_network'
  WHEN log LIKE '%gyp ERR!%' THEN 'native_build_failed' WHEN log LIKE '%command not found%' THEN 'toolchain_missing' WHEN log LIKE '%importing test module%' THEN 'test_dependency_missing' WHEN log LIKE '%BackendUnavailable%' THEN 'build_backend_missing' WHEN regexp_matches(log, 'E401|Username|unrecognized import') THEN 'private_registry'
  WHEN log LIKE '%MSB4025%' THEN 'broken_project_file' WHEN log LIKE 'probe:%' THEN 'no_installable_manifest' WHEN log LIKE '%GradleWrapper%' THEN 'missing_wrapper_jar' WHEN log LIKE '%submodule%' THEN 'missing_submodule' WHEN regexp_matches(log, 'npm ci can|yarn\\.lock needs|lock file does not') THEN 'broken_lockfile'
  WHEN regexp_matches(log, 'No matching dist|ERESOLVE|registry\\.npmjs|find artifact|find gem|NU1101') THEN 'dependency_resolution' WHEN log LIKE '%requirements file%' THEN 'broken_manifest' WHEN regexp_matches(log, 'find symbol|SyntaxError|undefined: x|E0308|TS2304|PHP Parse') THEN 'compile_error' WHEN log LIKE '%building wheel%' THEN 'build_backend_failed'
  WHEN log LIKE '%ELIFECYCLE%' THEN 'script_failed' WHEN log LIKE '%BUILD FAIL%' THEN 'build_failed' ELSE 'unclassified' END AS e FROM (SELECT *, id % 13 = 0 AS slow, id % 2 = 0 AS asks FROM logs))"""


@query("SELECT e AS error_class, count(*) AS n FROM errors GROUP BY e", _LOGS, _ERRORS)
def failure_classes(spark, sf):
    logs = fx.spread(spark, sf, "events", "event_id", fx.LOGS, "log string, rc int")
    return logs.groupBy(failures.error_class(F.col("log"), F.col("id") % 13 == 0).alias("error_class")).agg(F.count("*").alias("n"))


@query("""SELECT id, failure_class, CASE WHEN e = 'private_registry' THEN 'credentials' WHEN e IN ('external_service_missing', 'docker_missing', 'browser_missing', 'no_network') THEN 'external_service' WHEN failure_class = 'REPO_INTRINSIC' THEN 'repository' ELSE 'runner' END AS attribution,
 CASE WHEN failure_class = 'UNCLASSIFIED' THEN 'low' WHEN e IN ('unclassified', 'unknown_no_output') THEN 'medium' ELSE 'high' END AS confidence,
 CASE WHEN failure_class = 'ENVIRONMENT' THEN 'trivial' WHEN failure_class = 'TIMEOUT' THEN 'unknown' WHEN regexp_matches(log, 'E401') THEN 'infeasible' WHEN regexp_matches(log, '404 Not Found|No matching distribution') THEN 'substantial' WHEN regexp_matches(log, 'ERESOLVE|in sync|cannot find symbol|PHP Parse error') THEN 'moderate' ELSE 'unknown' END AS effort FROM (
 SELECT *, CASE WHEN e IN ('wrong_runtime', 'out_of_disk', 'out_of_memory', 'container_misconfig') THEN 'ENVIRONMENT' WHEN slow THEN 'TIMEOUT' WHEN log LIKE '%E401%' THEN CASE WHEN asks THEN 'REPO_INTRINSIC' ELSE 'ENVIRONMENT' END
 WHEN regexp_matches(log, 'command not found|zlib\\.h|getaddrinfo|onnection refused|building wheel') THEN 'ENVIRONMENT' WHEN regexp_matches(log, '404 Not|ERESOLVE|No matching dist|in sync|cannot find symbol|PHP Parse error') THEN 'REPO_INTRINSIC' WHEN e = 'private_registry' THEN CASE WHEN asks THEN 'REPO_INTRINSIC' ELSE 'ENVIRONMENT' END
 WHEN e IN ('toolchain_missing', 'native_build_failed', 'missing_system_lib', 'package_manager_bug', 'test_dependency_missing', 'build_backend_missing', 'missing_wrapper_jar', 'external_service_missing', 'docker_missing', 'browser_missing', 'no_network') THEN 'ENVIRONMENT' ELSE 'UNCLASSIFIED' END AS failure_class FROM errors)""", _LOGS, _ERRORS)
def failure_attribution(spark, sf):
    logs = fx.spread(spark, sf, "events", "event_id", fx.LOGS, "log string, rc int").withColumn("timed_out", F.col("id") % 13 == 0)
    return failures.attributed(logs, F.col("id") % 2 == 0).select("id", "failure_class", "attribution", "confidence", "effort")


@query("""SELECT id, n, CASE i WHEN 0 THEN 10 + n WHEN 1 THEN 0 WHEN 2 THEN 10 + n WHEN 3 THEN 20 + n WHEN 5 THEN n + 2 WHEN 6 THEN n + 3 WHEN 7 THEN n + 6 WHEN 9 THEN 3 WHEN 10 THEN 10 + n WHEN 11 THEN n WHEN 12 THEN 10 + n WHEN 13 THEN 10 + n END AS collected,
 CASE i WHEN 0 THEN n WHEN 3 THEN 9 WHEN 5 THEN n WHEN 6 THEN n WHEN 7 THEN n + 2 WHEN 9 THEN 1 WHEN 10 THEN n WHEN 11 THEN n WHEN 12 THEN 7 + n WHEN 13 THEN 7 + n END AS passed, CASE i WHEN 0 THEN 2 WHEN 3 THEN n WHEN 5 THEN 2 WHEN 6 THEN 1 WHEN 7 THEN 3 WHEN 9 THEN 1 WHEN 10 THEN 1 WHEN 11 THEN 0 WHEN 12 THEN 2 WHEN 13 THEN 2 END AS failed,
 CASE i WHEN 0 THEN 1 END AS errored, CASE i WHEN 0 THEN 1 WHEN 3 THEN 3 WHEN 6 THEN 2 WHEN 7 THEN 1 WHEN 9 THEN 1 WHEN 10 THEN 2 WHEN 12 THEN 1 WHEN 13 THEN 1 END AS skipped FROM runs""", fx.spread_sql("lineitem", "l_partkey", fx.RUNS, "runs", "kind, output"))
def runner_totals(spark, sf):
    r = fx.spread(spark, sf, "lineitem", "l_partkey", fx.RUNS, "kind string, output string")
    return r.withColumn("c", failures.runner_counts(F.col("kind"), F.col("output"))).select("id", "n", "c.*")


@query("SELECT kind, sum(CASE i WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 2 WHEN 4 THEN 2 WHEN 5 THEN 10 + n WHEN 6 THEN 2 ELSE 0 END)::BIGINT AS units FROM lists GROUP BY kind", fx.spread_sql("supplier", "s_suppkey", fx.LISTINGS, "lists", "kind, output"))
def listing_counts(spark, sf):
    r = fx.spread(spark, sf, "supplier", "s_suppkey", fx.LISTINGS, "kind string, output string")
    return r.groupBy("kind").agg(F.sum(failures.listing_count(F.col("kind"), F.col("output"))).alias("units"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN round(o_custkey % 100 + 0.5, 2) WHEN 1 THEN (o_custkey % 100)::DOUBLE WHEN 2 THEN o_custkey % 90 + 0.1 END AS pct, CASE o_orderkey % 4 WHEN 0 THEN o_custkey % 50 WHEN 1 THEN 7 END AS covered, CASE o_orderkey % 4 WHEN 0 THEN 60 WHEN 1 THEN 9 END AS total, round(o_custkey % 80 + 0.25, 2) AS scraped FROM orders""")
def coverage_reports(spark, sf):
    o = rel.table(spark, sf, "orders")
    m, c = F.col("o_orderkey") % 4, F.col("o_custkey")
    kind = F.when(m == 0, "coveragepy").when(m == 1, "istanbul").when(m == 2, "go").otherwise("none")
    report = (
        F.when(m == 0, F.format_string('{"totals":{"percent_covered":%d.5,"covered_lines":%d,"num_statements":60}}', c % 100, c % 50)).when(m == 1, F.format_string('{"total":{"lines":{"total":9,"covered":7,"pct":%d}}}', c % 100))
        .when(m == 2, F.format_string("ok\ntotal:\t(statements)\t%d.1%%\n", c % 90)).otherwise("{}")
    )
    log = F.format_string("x\nTOTAL   10   2   %d.25%%\nAll files | 3", c % 80)
    return o.select("o_orderkey", failures.coverage(kind, report).alias("c"), failures.coverage_in(log)["pct"].alias("scraped")).select("o_orderkey", "c.pct", "c.covered", "c.total", "scraped")


@query("SELECT l_orderkey, sum(l_partkey % 9 + 5)::BIGINT AS collected, sum(l_linenumber % 3)::BIGINT AS failed, sum(l_linenumber % 2)::BIGINT AS errored, 0::BIGINT AS skipped, greatest(0, sum(l_partkey % 9 + 5) - sum(l_linenumber % 3) - sum(l_linenumber % 2))::BIGINT AS passed FROM lineitem GROUP BY l_orderkey")
def junit_totals(spark, sf):
    li = rel.table(spark, sf, "lineitem")
    suites = li.select("l_orderkey", (F.col("l_partkey") % 9 + 5).cast("string").alias("tests"), (F.col("l_linenumber") % 3).cast("string").alias("failures"), (F.col("l_linenumber") % 2).cast("string").alias("errors"), F.lit(None).cast("string").alias("skipped"))
    return failures.junit_totals(suites, "l_orderkey")


_BUILD = """rec AS (SELECT DISTINCT l_suppkey % 5000 AS repo, l_orderkey || '-' || l_suppkey AS project, l_suppkey, l_orderkey FROM lineitem WHERE l_orderkey % 3 = 0),
recs AS (SELECT repo, project, CASE l_orderkey % 7 WHEN 0 THEN 'REPO_INTRINSIC' ELSE 'NONE' END AS fc, CASE l_orderkey % 5 WHEN 0 THEN 'runner' WHEN 1 THEN 'external_service' ELSE 'repository' END AS att, l_orderkey % 11 AS np, l_orderkey % 4 AS nf, CASE WHEN l_orderkey % 6 = 0 THEN (l_orderkey % 50)::DOUBLE END AS cov,
  CASE WHEN l_orderkey % 2 = 0 OR l_suppkey % 3 = 0 THEN 'passed' ELSE 'failed' END AS build, CASE WHEN l_orderkey % 9 = 0 THEN 'timed_out' ELSE 'passed' END AS resolve, CASE WHEN l_suppkey % 4 = 0 AND l_orderkey % 8 = 0 THEN 'skipped_budget' WHEN l_suppkey % 3 = 0 THEN 'passed' WHEN l_orderkey % 4 = 0 THEN 'no_tests' ELSE 'unavailable' END AS test FROM rec)"""


@query("""SELECT repo, CASE WHEN resolved = n THEN true WHEN unresolved > 0 THEN false END AS install_ok, reason, CASE reason WHEN 'all_built' THEN true WHEN 'intrinsic' THEN false END AS build_ok, CASE WHEN ran > 0 THEN CASE WHEN nf > 0 THEN 'tests_failed' ELSE 'tests_passed' END WHEN only_none THEN 'no_tests' WHEN only_skip THEN 'not_attempted' ELSE 'tests_did_not_run' END AS tests_status, cov AS coverage_pct,
 CASE WHEN NOT skip AND reason IN ('all_built', 'intrinsic') AND (ran > 0 OR NOT blocked) THEN (reason = 'all_built')::INT + (ran > 0)::INT + (np > 0)::INT + (coalesce(cov, 0) > 0)::INT END AS "index" FROM (SELECT *, CASE WHEN built = n AND gaps = 0 AND sk = 0 THEN 'all_built' WHEN built = n AND sk = 0 THEN 'not_covered' WHEN sk > 0 AND intr = 0 THEN 'budget'
 WHEN intr > 0 THEN 'intrinsic' WHEN lim > 0 OR gaps > 0 THEN 'limited' ELSE 'unattributed' END AS reason FROM (SELECT repo, count(*) AS n, count(*) FILTER (build = 'passed') AS built, count(*) FILTER (resolve = 'passed') AS resolved, count(*) FILTER (resolve <> 'passed' AND att = 'repository') AS unresolved, count(*) FILTER (fc = 'REPO_INTRINSIC') AS intr, count(*) FILTER (test = 'skipped_budget') AS sk,
 count(*) FILTER (build <> 'passed' AND (resolve = 'timed_out' OR test = 'skipped_budget' OR att IN ('runner', 'external_service'))) AS lim, count(*) FILTER (test = 'passed') AS ran, sum(np) AS np, sum(nf) AS nf, round(avg(cov), 2) AS cov, bool_and(test = 'no_tests') AS only_none, bool_and(test IN ('no_tests', 'skipped_budget')) AS only_skip, bool_or(test = 'skipped_budget') AS skip,
 bool_or(test IN ('unavailable', 'skipped_budget')) AS blocked, CASE WHEN repo % 10 = 0 THEN 1 ELSE 0 END AS gaps FROM recs GROUP BY repo))""", _BUILD)
def build_verdicts(spark, sf):
    li = rel.table(spark, sf, "lineitem").where("l_orderkey % 3 = 0").select("l_suppkey", "l_orderkey").distinct()
    o, s = F.col("l_orderkey"), F.col("l_suppkey")
    base = li.select((s % 5000).alias("repo"), F.concat_ws("-", o, s).alias("project_id"), "l_suppkey", "l_orderkey")
    records = base.select(
        "repo", "project_id", F.when(o % 7 == 0, "REPO_INTRINSIC").otherwise("NONE").alias("failure_class"), F.when(o % 5 == 0, "runner").when(o % 5 == 1, "external_service").otherwise("repository").alias("attribution"), (o % 11).alias("n_passed"), (o % 4).alias("n_failed"),
        F.when(o % 6 == 0, (o % 50).cast("double")).alias("coverage_pct"), F.lit(False).alias("repaired"),
    )
    build = F.when((o % 2 == 0) | (s % 3 == 0), "passed").otherwise("failed")
    test = F.when((s % 4 == 0) & (o % 8 == 0), "skipped_budget").when(s % 3 == 0, "passed").when(o % 4 == 0, "no_tests").otherwise("unavailable")
    one = lambda name, status: F.struct(F.lit(name).alias("phase"), status.alias("status"), F.when(status.isin("passed", "no_tests"), "repository").otherwise("runner").alias("attribution"))
    phases = base.select("repo", "project_id", F.explode(F.array(one("resolve", F.when(o % 9 == 0, "timed_out").otherwise("passed")), one("build", build), one("test", test))).alias("p")).select("repo", "project_id", "p.*", F.lit(False).alias("after_repair"))
    gaps = base.select("repo").distinct().select("repo", F.when(F.col("repo") % 10 == 0, F.array(F.lit("go"))).otherwise(F.array().cast("array<string>")).alias("unreachable"), F.lit(False).alias("truncated"))
    return projects.aggregate(records, phases, gaps).select("repo", "install_ok", "reason", "build_ok", "tests_status", "coverage_pct", "index")


@query("SELECT l_suppkey, count(*) AS candidates, count(*) FILTER (l_linenumber > 2) AS attempted, count(*) FILTER (l_linenumber > 2 AND l_returnflag = 'A') AS succeeded, count(*) FILTER (l_linenumber <= 2) AS refused, count(*) FILTER (l_linenumber > 2 AND l_returnflag = 'R') AS rejected_source_edit, round(coalesce(sum(l_quantity) FILTER (l_linenumber > 2), 0), 1) AS seconds, true AS offered FROM lineitem GROUP BY l_suppkey")
def repair_counters(spark, sf):
    li = rel.table(spark, sf, "lineitem")
    r = li.select("l_suppkey", (F.col("l_linenumber") > 2).alias("attempted"), (F.col("l_returnflag") == "A").alias("ok"), F.when(F.col("l_returnflag") == "R", "repair_modified_tracked_source").alias("reason_code"), F.col("l_quantity").alias("seconds"))
    return projects.repair_summary(r, "l_suppkey")


@query("SELECT s_suppkey AS repo, phase, ord, 'skipped_budget' AS status, 'runner' AS attribution FROM supplier, (VALUES (0, 'resolve'), (1, 'build'), (2, 'discover'), (3, 'test'), (4, 'coverage')) p(ord, phase)")
def skipped_records(spark, sf):
    p = rel.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("repo"), F.lit("p1").alias("project_id"))
    records = projects.blank_records(p).where("n_passed is null and failure_class = 'NONE'")
    return projects.skipped_phases(records, "run_budget_exhausted").select("repo", "phase", "ord", "status", "attribution")


# ------------------------------------------------------------------ runtimes
@query("""SELECT repo, lane, spec, source, floor FROM (SELECT *, row_number() OVER (PARTITION BY repo, lane ORDER BY o) AS r FROM (SELECT repo, 'node' AS lane, 'lts/hydrogen' AS spec, '.nvmrc' AS source, false AS floor, 1 AS o FROM root WHERE path = '.nvmrc' UNION ALL SELECT repo, 'node', '>=14 <21', 'package.json engines', false, 2 FROM root WHERE path = 'package.json'
 UNION ALL SELECT repo, 'python', '>=3.9,<3.13', 'pyproject requires-python', false, 3 FROM root WHERE path = 'pyproject.toml' UNION ALL SELECT repo, 'go', regexp_extract(text, 'go (1\\.\\d+)', 1), 'go.mod go', true, 4 FROM root WHERE path = 'go.mod' UNION ALL SELECT repo, 'rust', '1.70', 'Cargo.toml rust-version', true, 5 FROM root WHERE path = 'Cargo.toml'
 UNION ALL SELECT repo, 'ruby', regexp_extract(text, '3\\.1\\.\\d+'), 'Gemfile ruby', false, 6 FROM root WHERE path = 'Gemfile' UNION ALL SELECT repo, 'java', '1.8', 'pom.xml java version', false, 7 FROM root WHERE path = 'pom.xml' UNION ALL SELECT repo, 'java', '17', 'gradle toolchain', false, 8 FROM root WHERE path = 'build.gradle'
 UNION ALL SELECT repo, unnest(['node', 'java', 'ruby']), unnest(['18.2.0', '17.0.9', '3.2.1']), '.tool-versions', false, 9 FROM root WHERE path = '.tool-versions')) WHERE r = 1""", fx.TREE_SQL)
def runtime_declarations(spark, sf):
    return runtime.declarations(fx.tree(spark, sf))


_SPECS = fx.spread_sql("part", "p_partkey", fx.SPECS, "specs", "lane, spec, floor")
_HOST = """host(lane, v, o, d) AS (SELECT lane, lane_v, o, d FROM (VALUES ('node', '0.10.48', 10, false), ('node', '14.21.3', 1400, false), ('node', '16.3.1', 1603, false), ('node', '18.0.0', 1800, false), ('node', '18.17.0', 1817, false), ('node', '22.1.0', 2201, true), ('python', '3.8.18', 308, false), ('python', '3.9.18', 309, false), ('python', '3.11.4', 311, true),
  ('go', '1.22.1', 122, true), ('rust', '1.75.0', 175, true), ('ruby', '2.7.8', 207, false), ('ruby', '3.1.4', 301, true), ('java', '8', 8, false), ('java', '17.0.9', 17, true), ('java', '21.0.2', 21, false)) h(lane, lane_v, o, d))"""
HOST = [("node", [0, 10, 48], False), ("node", [14, 21, 3], False), ("node", [16, 3, 1], False), ("node", [18, 0, 0], False), ("node", [18, 17, 0], False), ("node", [22, 1, 0], True), ("python", [3, 8, 18], False), ("python", [3, 9, 18], False), ("python", [3, 11, 4], True),
        ("go", [1, 22, 1], True), ("rust", [1, 75, 0], True), ("ruby", [2, 7, 8], False), ("ruby", [3, 1, 4], True), ("java", [8], False), ("java", [17, 0, 9], True), ("java", [21, 0, 2], False)]


@query("""SELECT id, requested, picked FROM specs JOIN (VALUES (0, '18', '18.17.0'), (1, '14-21', '14.21.3'), (2, '16-19', '16.3.1'), (3, '0.10', '0.10.48'), (4, '18', '18.17.0'), (5, '18.0.0', '18.0.0'), (6, 'lts', '22.1.0'), (7, '3.9', '3.9.18'), (8, '3.11', '3.11.4'), (9, '3.8-3.13', '3.11.4'), (10, 'any', '3.11.4'), (11, '1.21', '1.22.1'), (12, 'stable', '1.75.0'),
 (13, '1.70', '1.75.0'), (14, '3.1', '3.1.4'), (15, '2.8', '3.1.4'), (16, '8-25', '17.0.9'), (17, '7-20', '17.0.9'), (18, '17', '17.0.9'), (19, 'none', '17.0.9'), (20, '6', NULL), (21, '0.12', NULL), (22, 'any', '3.11.4'), (23, 'to-21', '18.17.0'), (24, '16.3', '16.3.1')) e(i, requested, picked) USING (i)""", _SPECS)
def runtime_resolution(spark, sf):
    declared = fx.spread(spark, sf, "part", "p_partkey", fx.SPECS, "lane string, spec string, floor boolean")
    declared = runtime.with_windows(declared.select("id", "lane", "spec", "floor"), "spec", lane="lane", floor="floor")
    host = spark.createDataFrame(HOST, "lane string, version array<int>, is_default boolean")
    return runtime.resolve(declared, host).select("id", "requested", F.nullif(F.array_join(F.col("version").cast("array<string>"), "."), F.lit("")).alias("picked"))


@query("""SELECT l_orderkey, array_to_string(list(lane ORDER BY p, lane), ',') AS lanes, array_to_string(list(lane || '@' || q ORDER BY p, lane), ',') AS requested, coalesce(array_to_string(list(lane || '@' || u ORDER BY p, lane) FILTER (u IS NOT NULL), ','), '') AS used, coalesce(array_to_string(list(lane ORDER BY p, lane) FILTER (NOT ok), ','), '') AS unsatisfied FROM (
 SELECT l_orderkey, l_returnflag AS lane, min(o) AS p, arg_min(l_suppkey % 5, o) AS q, arg_min(CASE WHEN l_suppkey % 3 = 0 THEN -1 ELSE l_suppkey % 4 END, o) AS u0, arg_min(l_linestatus = 'O', o) AS ok, CASE WHEN u0 >= 0 THEN u0 END AS u FROM (SELECT l_orderkey, l_returnflag, l_suppkey, l_linenumber * 1000000000000 + l_partkey * 100000 + l_suppkey AS o, min(l_linestatus) AS l_linestatus FROM lineitem GROUP BY 1, 2, 3, 4) GROUP BY 1, 2) GROUP BY l_orderkey""")
def runtime_summary(spark, sf):
    s = F.col("l_suppkey")
    li = rel.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_returnflag", "l_linenumber", "l_partkey", "l_suppkey").agg(F.min("l_linestatus").alias("l_linestatus"))
    r = li.select("l_orderkey", (F.col("l_linenumber").cast("long") * 1000000000000 + F.col("l_partkey") * 100000 + s).alias("project"), F.col("l_returnflag").alias("lane"), (s % 5).cast("string").alias("requested"), F.when(s % 3 != 0, (s % 4).cast("string")).alias("used"), (F.col("l_linestatus") == "O").alias("satisfied"))
    out = runtime.summary(r, "l_orderkey")
    return out.select("l_orderkey", *[joined(c).alias(c) for c in ("lanes", "requested", "used", "unsatisfied")])


# ------------------------------------------------------------------ boundary
_ASCII = "regexp_replace(text, '[^\\x00-\\x7F]', ' ', 'g')"
_TECH = "(ClickHouse|PostgreSQL|MySQL|GraphQL|OpenAPI|JavaScript|TypeScript|WebSocket|GitHub|GitLab|TensorFlow|PyTorch|MongoDB|FastAPI|SvelteKit|NumPy|SciPy)"
_RULES_SQL = [
    ("a filesystem path", "\\b(?:[\\w.\\-]+[/\\\\])+[\\w.\\-]+\\b", "[path]"), ("a filename", "\\b[\\w\\-]+\\.(?:py|js|jsx|mjs|cjs|ts|tsx|go|java|rb|php|cs|rs|kt|kts|swift|scala|c|cc|cpp|h|hpp|m|mm|sh|sql|yml|yaml|toml|json)\\b", "[file]"), ("an object hash", "\\b[0-9a-f]{7,40}\\b", "[revision]"),
    ("a function call", "\\b\\w+\\([^)]{0,80}\\)", "[function]"), ("a declaration", "^[ \\t]*(?:def|class)\\s+\\w+\\s*[(:].*", "[declaration]"), ("an import statement", "^[ \\t]*import\\s+[\\w.]+.*", "[import]"), ("an import statement", "^[ \\t]*from\\s+[\\w.]+\\s+import\\b.*", "[import]"),
    ("a function declaration", "\\bfunction\\s+\\w+\\s*\\([^)]*\\)", "[function]"), ("code punctuation", "[{}]|=>|->|::|`", ""), ("a snake_case identifier", "\\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\\b", "[identifier]"), ("a camelCase identifier", "\\b[a-z]+(?:[A-Z][a-z0-9]*)+\\b", "[identifier]"),
]


def _steps(source: str) -> str:
    """Redaction as one common table expression a rule; technologies are hidden behind a digit while class names are looked for."""
    out = [f"r0 AS (SELECT id, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS t, [] AS l FROM ({source}))"]
    for i, (label, pattern, by) in enumerate(_RULES_SQL):
        out.append(f"r{i + 1} AS (SELECT id, regexp_replace(t, '{pattern}', '{by}', 'g') AS t, CASE WHEN regexp_matches(t, '{pattern}') THEN list_append(l, '{label}') ELSE l END AS l FROM r{i})")
    n = len(_RULES_SQL)
    out.append(f"h AS (SELECT id, regexp_replace(t, '\\b{_TECH}\\b', '0\\1', 'g') AS t, l FROM r{n})")
    out.append("c AS (SELECT id, regexp_replace(regexp_replace(t, '\\b[A-Z][a-z]+(?:[A-Z][a-z0-9]*)+\\b', '[identifier]', 'g'), '\\b0" + _TECH + "\\b', '\\1', 'g') AS t, CASE WHEN regexp_matches(t, '\\b[A-Z][a-z]+(?:[A-Z][a-z0-9]*)+\\b') THEN list_append(l, 'a class name') ELSE l END AS l FROM h)")
    out.append("e AS (SELECT id, CASE WHEN regexp_full_match(t, '[A-Z][a-z]{2,}') AND t NOT IN ('Python', 'Java', 'Rust', 'Docker') THEN '[identifier]' ELSE t END AS t, CASE WHEN regexp_full_match(t, '[A-Z][a-z]{2,}') AND t NOT IN ('Python', 'Java', 'Rust', 'Docker') THEN list_append(l, 'a proper name') ELSE l END AS l FROM c)")
    tidy = "trim(regexp_replace(t, '\\s{2,}', ' ', 'g'))"
    for k in ("path", "file", "revision", "function", "declaration", "import", "identifier"):
        tidy = f"regexp_replace({tidy}, '(\\[{k}\\])(\\s+\\[{k}\\])+', '[{k}]', 'g')"
    out.append(f"tidy AS (SELECT id, {tidy} AS t, array_to_string(list_sort(list_distinct(l)), ',') AS labels FROM e)")
    out.append("done AS (SELECT id, CASE WHEN len(t) <= 2000 THEN t ELSE regexp_replace(regexp_replace(substr(t, 1, 2000), ' [^ ]*$', ''), '[ ,;:]+$', '') || '...' END AS t, labels FROM tidy)")
    return ", ".join(out)


@query("SELECT id AS doc_id, sha256(t) AS redacted_sha, labels FROM done", _steps(f"SELECT doc_id AS id, {_ASCII} AS t FROM documents"))
def redaction(spark, sf):
    d = rel.table(spark, sf, "documents").select("doc_id", text.redacted(F.regexp_replace("text", r"[^\x00-\x7F]", " ")).alias("r"))
    return d.select("doc_id", F.sha2(F.col("r.text").cast("binary"), 256).alias("redacted_sha"), joined("r.labels").alias("labels"))


@query("SELECT id, t AS redacted, labels, regexp_replace(regexp_replace(t, '\\b[\\w.\\-+]+@[\\w.\\-]+\\.[A-Za-z]{2,}\\b', '[email]', 'g'), '\\b(?:[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+|[A-Z][A-Z0-9]+)\\b', '[identifier]', 'g') AS scrubbed FROM done", fx.spread_sql("customer", "c_custkey", [(x,) for x in fx.LEAKS], "leaks", "t"), _steps("SELECT id, t FROM leaks"))
def redaction_cases(spark, sf):
    f = fx.spread(spark, sf, "customer", "c_custkey", [(x,) for x in fx.LEAKS], "t string")
    return f.select("id", text.redacted(F.col("t")).alias("r"), text.scrub(F.col("t")).alias("scrubbed")).select("id", F.col("r.text").alias("redacted"), joined("r.labels").alias("labels"), "scrubbed")


@query("""SELECT 't' AS field, label, count(*) AS n FROM (SELECT id, CASE i WHEN 0 THEN 'a filesystem path' WHEN 1 THEN 'a filename' WHEN 2 THEN 'an object hash' WHEN 3 THEN 'a function call' WHEN 4 THEN 'a function call' WHEN 5 THEN 'code punctuation' WHEN 6 THEN 'a snake_case identifier' WHEN 7 THEN 'a camelCase identifier' WHEN 8 THEN 'a class name'
 WHEN 9 THEN NULL WHEN 10 THEN 'a proper name' WHEN 13 THEN 'an email address' WHEN 14 THEN 'an uppercase identifier' WHEN 16 THEN 'a camelCase identifier' END AS label FROM leaks) WHERE label IS NOT NULL GROUP BY label""", fx.spread_sql("customer", "c_custkey", [(x,) for x in fx.LEAKS], "leaks", "t"))
def leak_report(spark, sf):
    return emit.leak_report(fx.spread(spark, sf, "customer", "c_custkey", [(x,) for x in fx.LEAKS], "t string"), ["t"])


_SENTENCES = fx.spread_sql("orders", "o_orderkey", [(x,) for x in fx.SENTENCES], "said", "s")
_VERDICTS = """verdicts(i, verdict) AS (VALUES (0, 'ok'), (1, 'path separator'), (2, 'url'), (3, 'address'), (4, 'dotted identifier'), (5, 'file extension'), (6, 'snake_case identifier'), (7, 'camelCase identifier'), (8, 'quoted string'), (9, 'code punctuation'), (10, 'object hash'), (11, 'acronym'), (12, 'parentheses'), (13, 'capitalised name'), (14, 'ok'), (15, 'ok'), (16, 'empty'),
  (17, 'empty'), (18, 'ok'), (19, 'too long'), (20, 'ok'), (21, 'quoted string'), (22, 'code punctuation'), (23, 'ok'), (24, 'capitalised name'), (25, 'path separator'), (26, 'capitalised name'))"""


@query("SELECT i, verdict, count(*) AS n FROM said JOIN verdicts USING (i) GROUP BY 1, 2", _SENTENCES, _VERDICTS)
def sentence_verdicts(spark, sf):
    s = fx.spread(spark, sf, "orders", "o_orderkey", [(x,) for x in fx.SENTENCES], "s string")
    return s.groupBy("i", text.sentence_verdict(F.col("s")).alias("verdict")).agg(F.count("*").alias("n"))


@query("""SELECT role, verdict, count(*) AS n FROM (SELECT role, CASE WHEN t = '' THEN 'empty' WHEN len(string_split(t, ' ')) > 40 THEN 'too long' WHEN regexp_matches(t, '[/\\\\]') THEN 'path separator' WHEN regexp_matches(t, 'https?:|\\bwww\\.') THEN 'url' WHEN contains(t, '@') THEN 'address' WHEN regexp_matches(t, '[A-Za-z_]\\w*\\.[A-Za-z_]') THEN 'dotted identifier' WHEN regexp_matches(t, '(?:^|\\s)\\.[A-Za-z0-9]{1,6}\\b') THEN 'file extension'
 WHEN regexp_matches(t, '[A-Za-z0-9]+_[A-Za-z0-9]+') THEN 'snake_case identifier' WHEN regexp_matches(t, '\\b[a-z]+[A-Z][A-Za-z0-9]*\\b') THEN 'camelCase identifier' WHEN regexp_matches(t, '["`]|''[^'']{1,80}''') THEN 'quoted string' WHEN regexp_matches(t, '[{}\\[\\]<>=|*#$]|::|->|=>') THEN 'code punctuation' WHEN regexp_matches(t, '\\b[0-9a-f]{7,}\\b') THEN 'object hash' WHEN regexp_matches(t, '\\b[A-Z]{2,}[A-Z0-9]*\\b') THEN 'acronym'
 WHEN regexp_matches(t, '[()]') THEN 'parentheses' WHEN regexp_matches(regexp_replace(regexp_replace(t, '[.!?]\\s*[A-Z]', '. x', 'g'), '^[A-Z]', 'x'), '(^|[^A-Za-z''-])[A-Z]') THEN 'capitalised name' ELSE 'ok' END AS verdict FROM (SELECT role, trim(regexp_replace(regexp_replace(unnest(string_split(text, chr(10))), '[^\\x00-\\x7F]', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM conversations)) GROUP BY 1, 2""")
def conversation_sentences(spark, sf):
    c = rel.table(spark, sf, "conversations").select("role", F.explode(F.split("text", "\n")).alias("t"))
    return c.groupBy("role", text.sentence_verdict(F.regexp_replace("t", r"[^\x00-\x7F]", " ")).alias("verdict")).agg(F.count("*").alias("n"))


@query("SELECT i, url, name FROM urls JOIN (VALUES (0, 'owner/name'), (1, 'group/sub/name'), (2, NULL), (3, NULL), (4, NULL), (5, 'owner/name'), (6, NULL), (7, NULL), (8, 'team/proj'), (9, NULL), (10, NULL), (11, NULL), (12, NULL), (13, NULL), (14, NULL), (15, NULL)) e(i, name) USING (i)", fx.spread_sql("pages", "page_id", [(x,) for x in fx.REMOTES], "urls", "url"))
def remote_names(spark, sf):
    u = fx.spread(spark, sf, "pages", "page_id", [(x,) for x in fx.REMOTES], "url string")
    return u.select("i", "url", paths.remote_name(F.col("url")).alias("name"))


@query("SELECT p_brand, regexp_replace(regexp_replace(p_name, '\\s+', '-', 'g'), '[^A-Za-z0-9._+-]', '', 'g')[1:40] AS slug, '`' || p_brand || '` \\| ' || p_size AS cell, CASE WHEN p_size % 3 = 0 THEN 'none given' ELSE lower(p_type) || ' words' END AS said FROM part")
def cleaned_prose(spark, sf):
    p = rel.table(spark, sf, "part")
    said = F.when(F.col("p_size") % 3 == 0, F.lit("  ")).otherwise(F.concat(F.lower("p_type"), F.lit("  words")))
    return p.select("p_brand", text.slug(F.col("p_name")).alias("slug"), text.markdown_cell(F.concat(F.lit("`"), "p_brand", F.lit("` | "), "p_size")).alias("cell"), text.prose(said, F.lit("none given")).alias("said"))


@query("SELECT p_partkey, p_size || ',' || (p_partkey % 10) || CASE WHEN p_partkey % 2 = 0 THEN ',' || (p_partkey % 3) ELSE '' END AS numbers FROM part")
def version_numbers(spark, sf):
    p, k = rel.table(spark, sf, "part"), F.col("p_partkey")
    said = F.concat(F.lit("release v"), "p_size", F.lit("."), k % 10, F.when(k % 2 == 0, F.concat(F.lit("."), k % 3, F.lit("-rc"))).otherwise(" beta"))
    return p.select("p_partkey", joined(text.version_parts(said).cast("array<string>")).alias("numbers"))


SPEC = boundary.Spec(
    {"size": boundary.NUMBER, "brand": boundary.enum("Brand#1", "Brand#2", "Brand#3", fold=True), "kind": boundary.enum("PROMO", "SMALL", "ECONOMY", "LARGE", "STANDARD", "MEDIUM"), "idea": boundary.TAGGED, "line": boundary.SENTENCE, "loc": boundary.counted("Python", "Go"), "handle": boundary.Kind("handle"), "author": boundary.withheld("nobody is named")},
    ("id",),
)


def _documents(spark, sf):
    p, k = rel.table(spark, sf, "part"), F.col("p_partkey")
    idea = F.when(k % 3 == 0, "agentic: Build an importer for ledgers").when(k % 3 == 1, "agentic: Fix src/a.py").otherwise("stray: Do work")
    line = F.when(k % 2 == 0, "Rework the  cache").otherwise("Open the file x.py")
    loc = F.create_map(F.lit("Python"), k % 5, F.lit("Cobol"), k % 7, F.lit("Fortran"), F.lit(1).cast("long"))
    handle = F.when(k % 5 == 0, "repo-0123456789ab").when(k % 5 == 1, "").otherwise(F.lit("somewhere"))
    return p.select(k.alias("id"), F.col("p_size").alias("size"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), idea.alias("idea"), line.alias("line"), loc.alias("loc"), handle.alias("handle"), F.lit("joe").alias("author"))


@query("""SELECT field, problem, count(*) AS n FROM (SELECT 'idea' AS field, 'undeclared tag' AS problem FROM part WHERE p_partkey % 3 = 2 UNION ALL SELECT 'handle', 'no handle' FROM part WHERE p_partkey % 5 > 1 UNION ALL SELECT 'kind', 'outside the vocabulary' FROM part WHERE p_type NOT IN ('PROMO', 'SMALL', 'ECONOMY', 'LARGE', 'STANDARD', 'MEDIUM')) GROUP BY 1, 2""")
def boundary_problems(spark, sf):
    return SPEC.problems(_documents(spark, sf)).groupBy("field", "problem").agg(F.count("*").alias("n"))


@query("""SELECT p_partkey AS id, p_size AS size, CASE WHEN p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') THEN p_brand ELSE 'other' END AS brand, CASE WHEN p_partkey % 3 = 0 THEN 'agentic: Build an importer for ledgers' ELSE '' END AS idea, CASE WHEN p_partkey % 2 = 0 THEN 'Rework the cache' ELSE '' END AS line, (p_partkey % 5)::DOUBLE AS python, (p_partkey % 7 + 1)::DOUBLE AS other,
 CASE WHEN p_partkey % 5 = 0 THEN 'repo-0123456789ab' END AS handle, NULL::VARCHAR AS author FROM part WHERE p_partkey % 3 <> 2 AND p_partkey % 5 < 2 AND p_type IN ('PROMO', 'SMALL', 'ECONOMY', 'LARGE', 'STANDARD', 'MEDIUM')""")
def boundary_output(spark, sf):
    d = _documents(spark, sf)
    bad = SPEC.problems(d).select("id").distinct()
    out = SPEC.enforce(d.join(bad, "id", "left_anti"))
    return out.select("id", "size", "brand", "idea", "line", F.col("loc")["Python"].alias("python"), F.col("loc")["other"].alias("other"), "handle", "author")


@query("SELECT kind, fields, present, missing FROM (SELECT count(*) AS n, count(*) FILTER (p_partkey % 5 <> 1 OR true) AS h FROM part), (VALUES ('numbers', 2, 2), ('enums', 2, 2), ('task_ideas', 1, 1), ('sentences', 1, 1), ('identity', 1, 1), ('withheld', 1, 0)) k(kind, fields, there), LATERAL (SELECT there * n AS present, (fields - there) * n AS missing)")
def review_counts(spark, sf):
    return SPEC.review(_documents(spark, sf))


# --------------------------------------------------------- mining and verdicts
@query("""SELECT id, strategy, CASE WHEN s <> '' AND verdict = 'ok' THEN trim(s) ELSE '' END AS sentence, complexity FROM (SELECT strategy || ':' || substr(sha1(strategy || '|' || CASE WHEN id % 2 = 0 THEN 'a,b' ELSE '' END || '|' || array_to_string(list_sort(['t' || n, 'f']), ',')), 1, 12) AS id, strategy, s, verdict, complexity FROM (
 SELECT *, CASE id % 5 WHEN 0 THEN 'net_new' WHEN 1 THEN 'bug_repair' WHEN 2 THEN 'repo_evolution' ELSE 'agentic' END AS strategy, CASE WHEN id % 4 = 0 THEN 'Large' ELSE 'Medium' END AS complexity FROM said JOIN verdicts USING (i)))""", _SENTENCES, _VERDICTS)
def mined_candidates(spark, sf):
    s = fx.spread(spark, sf, "orders", "o_orderkey", [(x,) for x in fx.SENTENCES], "s string")
    k = F.col("id")
    kind = F.when(k % 5 == 0, " Net_New ").when(k % 5 == 1, "bug_repair").when(k % 5 == 2, "repo_evolution").when(k % 5 == 3, "odd")
    items = s.select(k.alias("repo"), F.concat(F.lit("t"), "n").alias("title"), kind.alias("task_type"), F.when(k % 4 == 0, "Large").otherwise("huge").alias("complexity"), F.col("s").alias("summary"), F.array(F.lit("f")).alias("files"), F.when(k % 2 == 0, F.array(F.lit("b"), F.lit("a"))).alias("shas"))
    return census.candidates(items).select("id", "strategy", "sentence", "complexity")


@query("""SELECT c_custkey AS repo, CASE WHEN c_custkey % 7 = 0 THEN 0 WHEN c_custkey % 11 = 0 THEN NULL ELSE coalesce(t, 0) END AS total_candidates, CASE WHEN c_custkey % 7 = 0 THEN 0 WHEN c_custkey % 11 = 0 THEN NULL ELSE coalesce(nn, 0) END AS n_net_new, CASE WHEN c_custkey % 7 = 0 THEN 0 WHEN c_custkey % 11 = 0 THEN NULL ELSE coalesce(br, 0) END AS n_bug_repair,
 c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 AND coalesce(t, 0) > 0 AS scored, CASE WHEN c_custkey % 7 = 0 THEN 'skipped' WHEN c_custkey % 11 = 0 THEN 'unfinished' WHEN coalesce(t, 0) = 0 THEN 'measured_none' WHEN t >= 15 THEN 'floor' END AS note FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS t, count(*) FILTER (o_orderstatus = 'F') AS nn, count(*) FILTER (o_orderstatus = 'O') AS br FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def mining_blocks(spark, sf):
    k = F.col("c_custkey")
    lanes = rel.table(spark, sf, "customer").select(k.alias("repo"), (k % 7 != 0).alias("requested"), (k % 11 != 0).alias("finished"))
    s = F.col("o_orderstatus")
    found = rel.table(spark, sf, "orders").select(F.col("o_custkey").alias("repo"), F.when(s == "F", "net_new").when(s == "O", "bug_repair").otherwise("agentic").alias("strategy"), F.lit("").alias("sentence"))
    return census.mining_block(lanes, found, 15).select("repo", "total_candidates", "n_net_new", "n_bug_repair", "scored", "note")


@query("""SELECT kind, retryable, count(*) AS n FROM (SELECT CASE event_id % 7 WHEN 0 THEN 'rate_limited' WHEN 1 THEN 'auth' WHEN 2 THEN 'model_unavailable' WHEN 3 THEN 'crashed' WHEN 4 THEN 'crashed' ELSE CASE WHEN event_id % 4 = 0 THEN 'unknown' ELSE 'crashed' END END AS kind, event_id % 7 IN (0, 3) AS retryable FROM events) GROUP BY 1, 2""")
def run_failures(spark, sf):
    e, i = rel.table(spark, sf, "events"), F.col("event_id")
    pick = lambda xs, m: F.element_at(F.array(*map(F.lit, xs)), (m + 1).cast("int"))
    out = pick(("HTTP 429", "error 401", "model x does not exist", "socket hang up", "Segmentation fault", "odd", ""), i % 7)
    rc = pick((1, -9, 137, 139), i % 4)
    return e.groupBy(verdicts.run_failure(rc, out).alias("f")).agg(F.count("*").alias("n")).select("f.*", "n")


@query("SELECT event_id, CASE WHEN s < 120 THEN round_even(s, 0)::BIGINT || ' second' ELSE round_even(s / 60, 0)::BIGINT || ' minute' END AS took, round(greatest(least(3600.0, 5.0 + 3.0 * event_id / 1000.0), CASE WHEN event_id % 2 = 0 THEN least(1200.0, 900.0 + 45.0 * event_id / 1000.0) ELSE 0 END) + CASE event_id % 3 WHEN 0 THEN 30.0 * (event_id % 9) + 4.0 * event_id / 1000.0 WHEN 1 THEN 90.0 * (event_id % 9) + 20.0 * event_id / 1000.0 ELSE 0 END, 6) AS estimate, greatest(0.0, least(least(30.0, 5.0 * pow(2, event_id % 4)) * (0.5 + (event_id % 10) / 10.0), 45.0 - event_id % 50)) AS wait FROM (SELECT event_id, value * 3 AS s FROM events)")
def durations(spark, sf):
    e, k = rel.table(spark, sf, "events"), F.col("event_id")
    level = F.when(k % 3 == 0, "discover").when(k % 3 == 1, "full").otherwise("none")
    est = verdicts.run_estimate(k.cast("double"), (k % 9).cast("double"), level, F.lit(1200.0), k % 2 == 0)
    wait = verdicts.backoff(k % 4 + 1, (k % 50).cast("double"), (k % 10) / 10.0)
    return e.select("event_id", verdicts.duration(F.col("value") * 3).alias("took"), F.round(est, 6).alias("estimate"), wait.alias("wait"))


@query("""SELECT status, reason, count(*) AS n FROM (SELECT CASE WHEN reason IS NULL THEN 'measured' ELSE 'partial' END AS status, reason FROM (SELECT CASE WHEN c_custkey % 13 = 0 THEN 'lanes_timed_out' WHEN (c_custkey % 3 <> 0 AND c_custkey % 5 = 0) OR (c_custkey % 4 <> 0 AND c_custkey % 6 = 0) THEN 'lanes_unavailable' WHEN c_custkey % 3 = 0 THEN 'llm_disabled' WHEN c_custkey % 4 = 0 THEN 'mine_disabled' END AS reason FROM customer)) GROUP BY 1, 2""")
def flat_row_status(spark, sf):
    c, k = rel.table(spark, sf, "customer"), F.col("c_custkey")
    s = verdicts.row_state(F.when(k % 3 == 0, "llm_disabled"), k % 5 != 0, F.when(k % 4 == 0, "mine_disabled"), F.when(k % 6 != 0, 1), F.lit(None).cast("boolean"), k % 13 == 0)
    return c.groupBy(s.alias("s")).agg(F.count("*").alias("n")).select("s.*", "n")


# ------------------------------------------------------------------- history
@query("""SELECT o_custkey AS repo, count(*) AS commits, min(ord) AS first FROM (SELECT o_custkey, o_orderkey, ord, n, ord = 0 AND o_custkey % 3 < 2 AS a FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) - 1 AS ord, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)) WHERE NOT (a AND n > 1) GROUP BY 1""")
def anonymiser_tips(spark, sf):
    from pyspark.sql import Window

    o = rel.table(spark, sf, "orders").withColumn("ord", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))) - 1)
    m = F.col("o_custkey") % 3
    c = o.select(F.col("o_custkey").alias("repo"), "ord", F.when(m == 0, "The Anonymizer").otherwise("joe").alias("author_name"), F.when(m == 1, "x@anonymizer.local").otherwise("j@x.org").alias("author_email"), F.when(m == 2, "Anonymize everything").otherwise("work").alias("subject"))
    return history.without_anonymiser(c).groupBy("repo").agg(F.count("*").alias("commits"), F.min("ord").alias("first"))


@query("""SELECT o_custkey AS repo, CASE WHEN big AND deep THEN 'largest_tree_and_deepest_history' WHEN big THEN 'largest_tree' WHEN deep THEN 'deepest_history' ELSE 'model_choice_recorded' END AS reason FROM (SELECT *, files >= max(files) OVER (PARTITION BY o_custkey) AS big, commits >= max(commits) OVER (PARTITION BY o_custkey) AS deep FROM (
 SELECT o_custkey, o_orderpriority AS ref, count(*) AS commits, sum(o_orderkey % 97) AS files, first(pick) AS pick FROM (SELECT *, ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][o_custkey % 5 + 1] AS pick FROM orders) GROUP BY 1, 2)) WHERE ref = pick""")
def ref_reasons(spark, sf):
    o = rel.table(spark, sf, "orders")
    c = o.groupBy(F.col("o_custkey").alias("repo"), F.col("o_orderpriority").alias("ref")).agg(F.count("*").alias("commits"), F.sum(F.col("o_orderkey") % 97).alias("files"))
    names = F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")))
    return history.ref_reason(c.withColumn("pick", F.element_at(names, (F.col("repo") % 5 + 1).cast("int"))), "repo", "pick")


@query("""SELECT o_custkey AS repo, o_orderkey AS ord, '| `' || substr('c' || o_orderkey, 1, 12) || '` | ' || strftime(o_orderdate, '%Y-%m-%d') || ' | ' || (3 + o_orderkey % 12) || ' | ' || CAST(round(o_totalprice) AS BIGINT) || ' | ' || CASE WHEN o_orderkey % 2 = 0 THEN '`' || o_orderkey || '.diff`' ELSE '' END || ' | ' || replace('fix a|b ' || o_orderpriority, '|', '\\|') || ' | '
 || array_to_string(list_transform(range(0, least(12, 2 + o_orderkey % 12)), lambda x: 'f' || x), ', ') || CASE WHEN 2 + o_orderkey % 12 > 12 THEN ' +' || (2 + o_orderkey % 12 - 12) || ' more' ELSE '' END || ' |' AS line FROM orders""")
def history_brief(spark, sf):
    o, k = rel.table(spark, sf, "orders"), F.col("o_orderkey")
    files = F.concat(F.transform(F.sequence(F.lit(0), (k % 12 + 1).cast("int")), lambda x: F.concat(F.lit("f"), x)), F.array(F.lit(".env")))
    c = o.select(F.col("o_custkey").alias("repo"), F.concat(F.lit("c"), k).alias("sha"), k.alias("ord"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.concat(F.lit("fix a|b "), "o_orderpriority").alias("subject"), (k % 12 + 3).alias("files"), F.round("o_totalprice").cast("long").alias("churn"), files.alias("paths"))
    patches = o.where(k % 2 == 0).select(F.col("o_custkey").alias("repo"), F.concat(F.lit("c"), k).alias("sha"), F.concat(k, F.lit(".diff")).alias("name"))
    return history.brief(c, patches)
