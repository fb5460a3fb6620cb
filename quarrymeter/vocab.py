"""Patterns and word lists that decide results. Stated as they are needed, in natural order."""

from __future__ import annotations

#: Authors that are programs (case-insensitive, on "name email").
BOT_AUTHORS = (
    r"\[bot\]", r"\bdependabot\b", r"\brenovate\b", r"\bsnyk-bot\b", r"\bgithub-actions\b", r"\bactions-user\b", r"\bmergify\b", r"\bpre-commit-ci\b",
    r"\bwhitesource\b", r"\bgreenkeeper\b", r"\bimgbot\b", r"\ballcontributors\b", r"\brestyled\b", r"\bscala-steward\b", r"\bpyup-bot\b", r"\bdepfu\b",
    r"\btravis-ci\b", r"\bcircleci\b", r"\bbuildkite\b", r"\bsemantic-release\b", r"\banonymi[sz]er\b", r"\bjenkins[-_. ]?(ci|bot|build|builder|agent|server)\b", r"\bbot\b",
)
#: Commit subjects (case-insensitive).
CONVENTIONAL_SUBJECT = r"^(feat|fix|chore|docs|refactor|test|perf|build|ci|style|revert)(\([^)]+\))?!?:\s"
NOISE_SUBJECT = r"^(chore|revert|wip|bump|deps?|dependabot|lint|style|format|prettier|typo|merge|release|version|removed?|cleanup|cleanups?|delete|remove|rename|upgrade|update\s+(deps|dep|dependenc|package|lock))[\s:(\[]"
FEATURE_SUBJECT = r"^(feat|add|implement|introduce|support)\b|^test[:(]"
REPAIR_SUBJECT = r"^(fix(e[sd])?|hotfix|bugfix|bug|regression|revert(s|ed)?|patch(es|ed)?|resolve[sd]?|correct(s|ed)?)\b|^(fix|revert)[:(]"
#: Files of a commit (case-insensitive).
COMMIT_TEST_FILES = (r"\.(test|spec)\.(ts|tsx|js|jsx|mjs)$", r"(^|/)(test_|tests/)", r"_test\.(go|py|rb)$", r"(^|/)__tests__/", r"(^|/)spec/", r"\.spec\.rb$", r"Test\.(java|kt|cs)$", r"Tests\.(java|kt|cs)$")
TEST_INFRA_FILES = (
    r"(^|/)vitest[^/]*\.config\.(ts|js|mjs)$", r"(^|/)jest\.config\.(ts|js|mjs|cjs|json)$", r"(^|/)playwright\.config\.(ts|js|mjs)$", r"(^|/)cypress\.config\.(ts|js)$", r"(^|/)karma\.conf\.(ts|js)$",
    r"(^|/)tests?/setup/", r"(^|/)tests?/fixtures/", r"(^|/)tests?/helpers/", r"(^|/)tests?/__mocks__/", r"(^|/)tests?/conftest\.py$", r"(^|/)conftest\.py$", r"(^|/)pytest\.ini$", r"(^|/)tox\.ini$", r"(^|/)\.mocharc\.(js|cjs|json|yml|yaml)$",
)
SCHEMA_FILES = (r"(^|/)schemas?/", r"(^|/)types?/", r"\.schema\.(ts|js|py)$", r"(^|/)migrations?/", r"(^|/)drizzle/", r"(^|/)prisma/", r"\.proto$", r"openapi\.(ya?ml|json)$")
DOCS_FILES = (r"\.md$", r"^\.github/", r"^\.gitlab/", r"\.ya?ml$", r"^Dockerfile", r"package(-lock)?\.json$", r"pnpm-lock\.yaml$", r"yarn\.lock$", r"poetry\.lock$", r"Cargo\.lock$")
#: Files of a tree.
TREE_TEST_FILES = (r"(?i)\.(test|spec)\.(ts|tsx|js|jsx|mjs)$", r"(?i)(^|/)test_[^/]+\.(py)$", r"(?i)(^|/)[^/]+_test\.(go|py|rb)$", r"(?i)(^|/)__tests__/", r"(?i)(^|/)tests?/", r"(?i)(^|/)spec/", r"[A-Z][^/]*Test[s]?\.(java|kt|cs)$", r"(?i)\.(test|spec)\.rs$")
FIXTURE_FILES = (r"(^|/)tests?/fixtures?/", r"(^|/)__snapshots__/", r"(^|/)__mocks__/", r"\.snap$", r"\.fixture\.(json|ts|js|yaml)$")
#: Head of generated files (case-insensitive, plain text), and for structure scans (pattern).
GENERATED_HEADS = ("// code generated", "# do not edit", "# this file is auto-generated", "// auto-generated")
STRUCTURE_GENERATED = r"(?i)@generated|DO NOT EDIT|Code generated by|autogenerated"
#: Languages by file extension.
LANGUAGES = {
    ".ts": "TypeScript", ".tsx": "TypeScript", ".js": "JavaScript", ".jsx": "JavaScript", ".mjs": "JavaScript", ".cjs": "JavaScript", ".py": "Python", ".go": "Go", ".rs": "Rust", ".java": "Java", ".kt": "Kotlin", ".kts": "Kotlin",
    ".rb": "Ruby", ".php": "PHP", ".cs": "C#", ".cpp": "C++", ".cc": "C++", ".cxx": "C++", ".c": "C", ".h": "C/C++", ".swift": "Swift", ".dart": "Dart", ".ex": "Elixir", ".exs": "Elixir", ".erl": "Erlang", ".hrl": "Erlang",
    ".scala": "Scala", ".clj": "Clojure", ".hs": "Haskell", ".sh": "Shell", ".bash": "Shell", ".zsh": "Shell", ".sql": "SQL", ".css": "CSS", ".scss": "CSS", ".sass": "CSS", ".less": "CSS", ".html": "HTML", ".htm": "HTML",
    ".vue": "Vue", ".svelte": "Svelte", ".tf": "Terraform", ".yaml": "YAML", ".yml": "YAML", ".json": "JSON", ".toml": "TOML", ".md": "Markdown", ".mdx": "Markdown",
}
#: Of these, extensions that don't count as code.
NOT_CODE = (".css", ".scss", ".sass", ".less", ".html", ".htm", ".tf", ".yaml", ".yml", ".json", ".toml", ".md", ".mdx")
WEB_LANGUAGES = ("TypeScript", "JavaScript", "Vue", "Svelte")
JVM_NET_LANGUAGES = ("Java", "Kotlin", "Scala", "C#")
#: Folders that a scan of the tree never enters, and dot-folders that it does.
SKIP_DIRS = (
    "node_modules", ".git", "vendor", "dist", "build", "out", ".cache", "__pycache__", ".pytest_cache", ".mypy_cache", "venv", ".venv", "env", ".env", "target", ".next", ".nuxt", ".output", ".turbo",
    "coverage", ".nyc_output", "htmlcov", "migrations", "generated", "gen", "__generated__", ".tox", "eggs", "*.egg-info",
)
KEPT_DOT_DIRS = (".github", ".gitlab", ".circleci", ".devcontainer")
#: Folders and files that a scan for structure leaves out, and its test files (case-insensitive).
STRUCTURE_SKIP_DIR = r"(^|/)(node_modules|bower_components|vendor|third_party|thirdparty|dist|build|out|target|bin|obj|\.git|__pycache__|\.venv|venv|env|site-packages|coverage|migrations|generated|gen|\.next|\.nuxt|\.terraform|Pods)/"
STRUCTURE_SKIP_FILE = r"\.(min|bundle|generated|pb|_pb2|d)\.[a-z]+$"
STRUCTURE_TEST = r"(^|/)(tests?|spec|specs|__tests__|__mocks__|e2e|fixtures|testdata)/|(^|/)(test_|conftest\.)|[._-](test|spec)\.[a-z0-9]+$"
#: Folders that a search for projects never enters.
PROJECT_SKIP_DIRS = (
    ".git", ".hg", ".svn", "node_modules", "bower_components", "vendor", "dist", "build", "target", "out", "bin", "obj", ".venv", "venv", "env", "__pycache__", ".tox", ".nox", ".gradle", ".idea", ".vscode", ".terraform",
    "third_party", "Pods", "coverage", ".next", ".turbo", ".pnpm-store", ".cache", ".mypy_cache", ".pytest_cache", ".ruff_cache", "site-packages", "Carthage", "DerivedData", ".dart_tool", "elm-stuff",
)
#: Files whose changes are no implementation, and test files, in a count of mineable commits (case-insensitive).
HISTORY_NON_IMPL = (
    r"(^|/)(node_modules|vendor|third_party|dist|build|out|target|\.git|__pycache__|\.venv|venv|site-packages)/"
    r"|(^|/)(package-lock\.json|yarn\.lock|pnpm-lock\.yaml|poetry\.lock|Gemfile\.lock|composer\.lock|Cargo\.lock|go\.sum|requirements\.txt\.lock)$"
    r"|\.(min\.js|min\.css|map|snap|lock|svg|png|jpe?g|gif|ico|woff2?|ttf|eot|pdf|mp4)$"
)
HISTORY_TEST = r"(^|/)(tests?|spec|__tests__|e2e)/|(^|/)(test_|conftest)|[._-](test|spec)\.[a-z0-9]+$"
#: Files that look like credentials, as globs over the lower-cased name.
CREDENTIAL_GLOBS = (
    ".env", ".env.*", "*.env", ".envrc", ".netrc", "_netrc", ".npmrc", ".pypirc", ".htpasswd", ".dockercfg", "*.pem", "*.key", "*.pfx", "*.p12", "*.p8", "*.jks", "*.jceks", "*.keystore", "*.ppk", "*.asc", "*.gpg", "*.kdbx",
    "id_rsa*", "id_dsa*", "id_ecdsa*", "id_ed25519*", "credentials", "credentials.*", "*.credentials", "secrets.*", "*.secrets", "secrets.yaml", "secrets.yml", "secrets.json", "service-account*.json", "*serviceaccount*.json", "kubeconfig", "*.kubeconfig",
)
#: Frameworks by a file of the root, in order.
FRAMEWORK_FILES = (
    ("next.config.js", "Next.js"), ("next.config.ts", "Next.js"), ("next.config.mjs", "Next.js"), ("nuxt.config.ts", "Nuxt"), ("nuxt.config.js", "Nuxt"), ("svelte.config.js", "SvelteKit"), ("svelte.config.ts", "SvelteKit"),
    ("angular.json", "Angular"), ("vite.config.ts", "Vite"), ("vite.config.js", "Vite"), ("remix.config.js", "Remix"), ("remix.config.ts", "Remix"), ("astro.config.mjs", "Astro"), ("astro.config.ts", "Astro"),
    ("gatsby-config.js", "Gatsby"), ("gatsby-config.ts", "Gatsby"), ("vue.config.js", "Vue CLI"), ("manage.py", "Django"), ("settings.py", "Django"), ("wsgi.py", "WSGI (Flask/Django)"), ("asgi.py", "ASGI (FastAPI/Django Channels)"),
    ("Cargo.toml", "Rust (Cargo)"), ("go.mod", "Go Modules"), ("pom.xml", "Maven (Java)"), ("build.gradle", "Gradle"), ("build.gradle.kts", "Gradle (Kotlin DSL)"), ("Gemfile", "Ruby (Bundler)"), ("composer.json", "PHP (Composer)"),
    ("pubspec.yaml", "Flutter/Dart"), ("mix.exs", "Elixir (Mix)"), ("rebar.config", "Erlang (Rebar)"), ("project.clj", "Clojure (Leiningen)"), ("stack.yaml", "Haskell (Stack)"), ("cabal.project", "Haskell (Cabal)"),
    ("flake.nix", "Nix"), ("Makefile", "Make"), ("CMakeLists.txt", "CMake"), ("terraform.tfstate", "Terraform"), ("main.tf", "Terraform"), ("serverless.yml", "Serverless Framework"), ("serverless.yaml", "Serverless Framework"),
    ("amplify.yml", "AWS Amplify"), ("vercel.json", "Vercel"), ("netlify.toml", "Netlify"), ("fly.toml", "Fly.io"), ("helm/Chart.yaml", "Helm"), ("Chart.yaml", "Helm"), ("docker-compose.yml", "Docker Compose"),
    ("docker-compose.yaml", "Docker Compose"), ("Dockerfile", "Docker"), (".devcontainer/devcontainer.json", "Dev Container"), ("devcontainer.json", "Dev Container"),
)
#: Frameworks by a PyPI dependency, then by a dependency of the root's package.json, in order.
FRAMEWORK_PYPI = (("fastapi", "FastAPI"), ("flask", "Flask"), ("sqlalchemy", "SQLAlchemy"), ("pydantic", "Pydantic"))
FRAMEWORK_NPM = (
    ("express", "Express"), ("@nestjs/core", "NestJS"), ("hono", "Hono"), ("elysia", "Elysia"), ("koa", "Koa"), ("fastify", "Fastify"), ("@trpc/server", "tRPC"), ("prisma", "Prisma"), ("@prisma/client", "Prisma"),
    ("drizzle-orm", "Drizzle ORM"), ("typeorm", "TypeORM"), ("zod", "Zod"), ("tailwindcss", "Tailwind CSS"),
)
#: Frameworks that mark a class, and kinds of project.
FRONTEND_FRAMEWORKS = ("React", "Vue", "Vue CLI", "Angular", "SvelteKit", "Astro", "Gatsby", "Next.js", "Nuxt", "Remix", "Tailwind CSS")
BACKEND_FRAMEWORKS = ("Express", "NestJS", "FastAPI", "Flask", "Django", "Fastify", "Hono", "Koa", "Maven (Java)", "Ruby (Bundler)", "WSGI (Flask/Django)", "ASGI (FastAPI/Django Channels)", "tRPC")
APP_FRAMEWORKS = ("Next.js", "Remix", "Gatsby", "Nuxt", "SvelteKit", "Angular")
SERVICE_FRAMEWORKS = ("Express", "NestJS", "FastAPI", "Flask", "Django", "Hono", "Fastify", "Elysia", "Koa", "tRPC")
#: Lock files, in order.
LOCK_FILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "Pipfile.lock", "uv.lock", "go.sum", "Cargo.lock", "Gemfile.lock", "composer.lock", "packages.lock.json", "gradle.lockfile", "pubspec.lock")
#: CI systems by a file of the root, in order; GitHub Actions by its folder.
CI_FILES = (
    (".circleci/config.yml", "CircleCI"), (".gitlab-ci.yml", "GitLab CI"), ("Jenkinsfile", "Jenkins"), ("azure-pipelines.yml", "Azure Pipelines"), (".travis.yml", "Travis CI"), ("bitbucket-pipelines.yml", "Bitbucket Pipelines"),
    (".buildkite/pipeline.yml", "Buildkite"), ("cloudbuild.yaml", "GCP Cloud Build"), (".woodpecker.yml", "Woodpecker CI"), (".drone.yml", "Drone CI"),
)
#: Linters by a file of the root.
LINT_FILES = {
    ".eslintrc.js": "ESLint", ".eslintrc.cjs": "ESLint", ".eslintrc.ts": "ESLint", ".eslintrc.json": "ESLint", ".eslintrc.yaml": "ESLint", "eslint.config.js": "ESLint", "eslint.config.mjs": "ESLint", "eslint.config.ts": "ESLint",
    ".prettierrc": "Prettier", ".prettierrc.js": "Prettier", ".prettierrc.json": "Prettier", ".prettierrc.yaml": "Prettier", "ruff.toml": "Ruff", ".ruff.toml": "Ruff", ".pylintrc": "Pylint", "pylintrc": "Pylint", ".flake8": "Flake8",
    "golangci-lint.yml": "golangci-lint", ".golangci.yml": "golangci-lint", ".golangci.yaml": "golangci-lint", ".rubocop.yml": "RuboCop", "phpcs.xml": "PHP_CodeSniffer", ".editorconfig": "EditorConfig", "biome.json": "Biome", "biome.jsonc": "Biome", ".oxlintrc": "Oxlint",
}
LINT_SECTIONS = ("ruff", "black", "pylint", "flake8", "mypy", "pyright")
#: Test frameworks by a configuration file of the root, in order.
TEST_FILES = (
    ("vitest.config.ts", "vitest"), ("vitest.config.js", "vitest"), ("vitest.config.mjs", "vitest"), ("jest.config.ts", "jest"), ("jest.config.js", "jest"), ("jest.config.cjs", "jest"), ("jest.config.json", "jest"),
    ("playwright.config.ts", "Playwright"), ("playwright.config.js", "Playwright"), ("cypress.config.ts", "Cypress"), ("cypress.config.js", "Cypress"), ("karma.conf.js", "Karma"), (".mocharc.js", "Mocha"), (".mocharc.json", "Mocha"), (".mocharc.yaml", "Mocha"),
)
#: Documentation files of the root, by preference.
README_FILES = ("README.md", "README.rst", "README.txt", "README", "readme.md")
CHANGELOG_FILES = ("CHANGELOG.md", "CHANGELOG.rst", "CHANGELOG", "CHANGES.md", "HISTORY.md", "RELEASES.md")
CONTRIBUTING_FILES = ("CONTRIBUTING.md", "CONTRIBUTING.rst", "CONTRIBUTING")
ENV_EXAMPLES = (".env.example", ".env.template", ".env.sample", ".env.test.example")
README_SECTIONS = ("install", "setup", "getting started", "run", "test", "environment", "contributing", "architecture", "usage", "api")
#: Signals in sources: dependency audits in CI, validation libraries, logging, error tracking.
AUDIT_TEXT = r"(?i)\baudit\b|\bsnyk\b|\btrivy\b|\bgrype\b|\bsafety\b|\bpip.audit\b"
VALIDATION = (("zod", r"\bzod\b|z\.object|z\.string"), ("pydantic", r"\bpydantic\b|BaseModel"), ("joi", r"\bjoi\b|Joi\.object"), ("yup", r"\byup\b"), ("class-validator", r"\bclass-validator\b|@IsString|@IsNotEmpty"), ("valibot", r"\bvalibot\b"), ("jsonschema", r"\bjsonschema\b|jsonschema\.validate"))
ERROR_TRACKING = ("@sentry/", "sentry-sdk", "sentry_sdk", "rollbar", "honeybadger", "bugsnag", "airbrake")
HEALTH_TEXT = r"(?i)[\"'/](health|ping|readiness|liveness)[\"']"
METRICS_TEXT = r"(?i)prometheus|prom-client|metrics|statsd|datadog"
#: Demonstrations: known applications, and phrases of a template's README.
KNOWN_DEMO = r"(?i)\b(sock[-_ ]?shop|weaveworks|realworld|petclinic|todomvc|guestbook|2048|nodegoat|juice[-_ ]?shop)\b"
TEMPLATE_README = (
    r"(?i)(bootstrapped with create react app|create-react-app|weaveworks|sock shop|realworld example|this (is a|project is a|repo(sitory)? is a) (demo|sample|example|template|boilerplate|starter)"
    r"|(sample|example|demo) (app|application|project)|getting started template|starter (kit|template)|scaffold(ing)? for)"
)
#: Keywords of dependency names, by group and ecosystem ("any": all of them). A trailing * stands for any ending of a segment.
CLASS_KEYWORDS = {
    "ml_libs": {
        "pypi": "torch pytorch tensorflow tensorflow-gpu jax jaxlib flax scikit-learn sklearn keras xgboost lightgbm catboost transformers timm onnx onnxruntime diffusers sentence-transformers",
        "npm": "@tensorflow/tfjs onnxruntime-node onnxruntime-web",
    },
    "experiment_tracking": {"pypi": "wandb mlflow tensorboard sacred neptune neptune-client clearml hydra-core optuna accelerate deepspeed pytorch-lightning lightning"},
    "data_eng": {
        "pypi": "apache-airflow* dagster prefect dbt dbt-core pyspark apache-beam luigi kafka-python confluent-kafka great-expectations pandera dask apache-flink kedro feast delta-spark",
        "npm": "kafkajs",
        "go": "sarama kafka-go",
    },
    "security_libs": {"pypi": "bandit semgrep scapy pwntools pycryptodome python-nmap yara-python volatility volatility3 impacket mitmproxy angr capstone", "go": "trufflehog nuclei gosec"},
    "backend_frameworks": {
        "npm": "express fastify koa hono @nestjs", "pypi": "fastapi flask django", "go": "gin-gonic gofiber labstack/echo", "cargo": "actix-web axum rocket", "gem": "sinatra", "composer": "laravel", "maven": "org.springframework.boot spring-boot*",
    },
    "frontend_frameworks": {
        "npm": "react react-dom react-native vue @vue svelte @sveltejs @angular next nuxt @nuxt solid-js preact tailwindcss @mui styled-components @chakra-ui @remix-run gatsby astro @builder.io/qwik ember-source lit",
    },
    "orm_db": {"npm": "prisma @prisma drizzle-orm typeorm sequelize mongoose pg ioredis knex", "pypi": "sqlalchemy psycopg* alembic pymongo asyncpg peewee", "go": "gorm sqlx pgx", "any": "redis mysql* mongodb"},
    "infra_libs": {"any": "pulumi @pulumi aws-cdk* @aws-cdk kubernetes @kubernetes ansible ansible-core", "pypi": "boto3 google-cloud* azure-mgmt*", "npm": "@google-cloud"},
}
#: Public names of technologies that prose may hold.
TECHNOLOGIES = (
    "PostgreSQL", "MySQL", "MariaDB", "SQLite", "MongoDB", "DynamoDB", "ClickHouse", "BigQuery", "RedShift", "Snowflake", "ElasticSearch", "OpenSearch", "RabbitMQ", "GraphQL", "OpenAPI", "JavaScript", "TypeScript", "WebSocket", "WebAssembly",
    "PowerShell", "NoSQL", "OAuth", "GitHub", "GitLab", "BitBucket", "DevOps", "Kubernetes", "TensorFlow", "PyTorch", "NumPy", "SciPy", "DataDog", "NewRelic", "PagerDuty", "PayPal", "QuickBooks", "SalesForce", "Shopify", "Stripe", "Twilio",
    "SendGrid", "MacOS", "AppStore", "PlayStore", "AirFlow", "SpringBoot", "DjangoREST", "FastAPI", "NextJS", "NuxtJS", "SvelteKit", "DotNet", "AspNet", "Python", "Java", "Kotlin", "Swift", "Scala", "Rust", "Ruby", "React", "Angular",
    "Django", "Flask", "Fastapi", "Terraform", "Ansible", "Docker", "Maven", "Gradle",
)


def any_of(patterns, ignore_case: bool = False) -> str:
    """One alternation of several patterns."""
    return ("(?i)" if ignore_case else "") + "|".join(f"(?:{p})" for p in patterns)
