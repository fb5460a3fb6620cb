"""Failed builds: class of a log, whose failure it is, how sure that is, what mending takes; test-runner output; coverage.

Every rule is a column expression over one log, so a table of logs is read once and nothing is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Signatures of a log in order, (class, pattern); the first that fits names the class.
SIGNATURES = (
    ("out_of_disk", r"(?i)No space left on device|ENOSPC"),
    ("out_of_memory", r"Out of memory|OutOfMemoryError|JavaScript heap out of memory"),
    ("wrong_runtime", r"ERR_OSSL_EVP_UNSUPPORTED|error:0308010C"),
    ("wrong_runtime", r"Unsupported class file major version|invalid (source|target) release|class file has wrong version|Source option \d+ is no longer supported"),
    ("wrong_runtime", r"Requires-Python|requires a different Python|python_requires|This package requires Python|is not supported on Python"),
    ("wrong_runtime", r"engine \"?node\"? is incompatible|Unsupported engine|EBADENGINE"),
    ("wrong_runtime", r"go\.mod requires go >= |requires go1\.\d+ or later"),
    ("wrong_runtime", r"Your Ruby version is [\d.]+, but your Gemfile specified|Your PHP version \([\d.]+\) does not satisfy"),
    ("wrong_runtime", r"MSB3644|NETSDK1045|The reference assemblies for .* were not found"),
    ("wrong_runtime", r"externally.managed|break-system-packages|ensurepip is not available"),
    ("wrong_runtime", r"has invalid metadata: Expected matching|Please use pip<[\d.]+ if you need|since it has invalid metadata"),
    ("wrong_runtime", r"module '(?:ast|configparser|collections|imp|inspect|asyncio|cgi|locale|distutils)' has no attribute"),
    ("wrong_runtime", r"'build_ext' object has no attribute 'cython_sources'|use_2to3 is invalid|No module named 'distutils'"),
    ("wrong_runtime", r"Could not find 'bundler' \([\d.]+\) required by your|Gem::GemNotFoundException.{0,80}bundler|bundle update --bundler"),
    ("container_misconfig", r"world-writable|Don't run Bundler as root"),
    ("container_misconfig", r"Corepack is about to download|COREPACK_ENABLE_DOWNLOAD_PROMPT|YN0050"),
    ("missing_system_lib", r"fatal error: .*\.h: No such file|cannot find -l[a-zA-Z0-9_]+|Could NOT find [A-Za-z0-9_]+ \(missing|pg_config executable is not found|mysql_config: not found|libpq-fe\.h"),
    ("package_manager_bug", r"Exit handler never called|npm error code ENOTEMPTY|Maximum call stack size exceeded"),
    ("browser_missing", r"(Cannot find|No usable|Failed to launch|Could not find) (Chrome|Chromium|browser)|CHROME_BIN|no DISPLAY|cannot open display"),
    ("docker_missing", r"Is the docker daemon running|Cannot connect to the Docker daemon|docker: not found|docker-compose: not found"),
    ("external_service_missing", r"(?s)(Connection refused|ECONNREFUSED|could not connect to server).{0,80}(5432|3306|6379|27017|9200|localhost|127\.0\.0\.1)"),
    ("no_network", r"Temporary failure in name resolution|Could not resolve host|getaddrinfo|EAI_AGAIN|Network is unreachable|Could not transfer artifact"),
    ("native_build_failed", r"gyp ERR!|node-gyp|prebuild-install"),
    ("toolchain_missing", r"command not found|executable file not found|: not found\b|could not determine executable to run|npm ERR! could not determine|npx canceled due to missing packages"),
    ("test_dependency_missing", r"ImportError while importing test module|Interrupted: \d+ errors? during collection|code: 'MODULE_NOT_FOUND'|Cannot find module '"),
    ("build_backend_missing", r"BackendUnavailable|Cannot import '[A-Za-z0-9_.]+\.(?:api|build_meta)'"),
    ("private_registry", r"E401|E403|401 Unauthorized|403 Forbidden|ENEEDAUTH|authentication required|Incorrect or missing password|Permission denied \(publickey\)|could not read Username|Authentication failed for"),
    ("private_registry", r"go: unrecognized import path|is not in GOROOT"),
    ("broken_project_file", r"MSB4025|The project file could not be loaded|Could not find file .*\.(csproj|sln|fsproj)"),
    ("no_installable_manifest", r"probe: no installable manifest"),
    ("missing_wrapper_jar", r"GradleWrapperMain|gradle-wrapper\.jar.*(No such file|not found)"),
    ("missing_submodule", r"No url found for submodule path|failed to clone .*submodule|Submodule .* could not"),
    ("broken_lockfile", r"npm ci can only install packages when your package\.json and package-lock\.json|Missing: .* from lock file|Invalid: lock file|EUSAGE"),
    ("broken_lockfile", r"(?is)(lockfile|Gemfile\.lock|yarn\.lock|pnpm-lock\.yaml|poetry\.lock|Cargo\.lock).{0,80}(out of date|needs to be updated|is not up to date|does not match|frozen)"),
    ("broken_lockfile", r"Your lock file does not satisfy|The lockfile is not up to date|the lock file .* needs to be updated"),
    ("dependency_resolution", r"No matching distribution found|Could not find a version that satisfies|ResolutionImpossible|version solving failed|SolverProblemError"),
    ("dependency_resolution", r"ERESOLVE|Conflicting peer dependency|Couldn't find any versions for|error Couldn't find package"),
    ("dependency_resolution", r"(?s)404 Not Found.{0,120}(registry\.npmjs\.org|registry\.yarnpkg\.com)"),
    ("dependency_resolution", r"Could not resolve dependencies for project|Could not find artifact|Failed to collect dependencies|Non-resolvable (parent POM|import POM)|Could not resolve all (files|dependencies|artifacts) for configuration"),
    ("dependency_resolution", r"Bundler could not find compatible versions|Could not find gem |Your requirements could not be resolved|Root composer\.json requires|failed to select a version|no matching package named"),
    ("dependency_resolution", r"go: .*: (unknown revision|invalid version|no required module provides)|NU1101|NU1102|NU1103|Unable to find package"),
    ("broken_manifest", r"Could not open requirements file|is not a valid editable requirement"),
    ("compile_error", r"COMPILATION ERROR|cannot find symbol|package .* does not exist|incompatible types:"),
    ("compile_error", r"\bSyntaxError\b|\bIndentationError\b|\bTabError\b"),
    ("compile_error", r"\.go:\d+:\d+: (undefined|cannot use|syntax error|declared and not used)"),
    ("compile_error", r"error\[E\d+\]:|could not compile `"),
    ("compile_error", r"error TS\d+:|error CS\d+:|error BC\d+:|error FS\d+:"),
    ("compile_error", r"PHP Parse error|PHP Fatal error|unresolved reference"),
    ("build_backend_failed", r"error in .* setup command|Failed building wheel for|metadata-generation-failed|error: subprocess-exited-with-error"),
    ("script_failed", r"npm ERR! code ELIFECYCLE|Command failed with exit code|handling the (post-autoload-dump|post-install-cmd|pre-install-cmd) event"),
    ("build_failed", r"FAILURE: Build failed with an exception|BUILD FAILURE|BUILD FAILED"),
)
#: Refused credentials, signs of the host, signs of the repository (case-insensitive).
AUTH = r"(?i)E401|E403|401 Unauthorized|403 Forbidden|authentication required|Unable to authenticate|authentication token|npm login|not authori[sz]ed|Not authorized to|Access denied|401 \(Unauthorized\)|403 \(Forbidden\)"
HOST = (
    r"(?i)command not found|executable file not found|is not recognized as an internal or external|no such file or directory:\s*(npm|node|python3?|go|mvn|cargo|bundle|composer|pnpm|yarn|dotnet)|No module named"
    r"|unsupported engine|EBADENGINE|engine \"node\"|requires (node|python|ruby|\.NET|dotnet)|wrong ruby version|requires a different Python|requires Python\s*[<>=]|could not find (java|javac|jdk)|JAVA_HOME is not set"
    r"|invalid source release|class file version|Unsupported class file|externally.managed|break-system-packages|ensurepip is not available|python3?-venv|permission denied.*gem|EACCES|EPERM|EROFS|operation not permitted"
    r"|(should not|must not|cannot|refus\w+ to) be run as root|running pip as the .root. user|fatal error: .*\.h: No such file|cannot find -l|ld: library not found|library not found for|linker command failed|Microsoft Visual C\+\+ \d|cl\.exe"
    r"|command '(gcc|cc|clang|g\+\+|cmake)' failed|unable to execute '(gcc|cc|clang)'|Failed building wheel for|metadata-generation-failed|subprocess-exited-with-error|pkg-config.*not found|No package '[^']+' found"
    r"|Temporary failure in name resolution|Could not resolve host|getaddrinfo|ENOTFOUND|ECONNREFUSED|ECONNRESET|ETIMEDOUT|EAI_AGAIN|network is unreachable|connection refused|Read timed out|Connection timed out|proxy|CERTIFICATE_VERIFY_FAILED"
    r"|SSLError|TLS handshake|offline mode|no internet|EBADPLATFORM|unsupported platform|not supported on this platform|Unsupported architecture|incompatible architecture|wrong architecture|only supported on|requires (macOS|Windows|Linux)"
    r"|gradle-wrapper\.jar|gradle wrapper.*not found|corepack.*(prompt|enable)|Cannot find matching keyid"
)
INTRINSIC = (
    r"(?i)E404|404 Not Found|ERESOLVE|unable to resolve dependency tree|peer dep|version solving failed|no matching distribution|could not find a version|could not resolve dependencies|artifact.*(not found|resolution)"
    r"|lock(file)? (is )?(out of date|outdated|mismatch)|integrity check failed|(package-lock\.json|lock ?file).{0,40}(out of sync|in sync)|Missing: .+ from lock file|compilation (error|failed)|cannot find symbol|syntax error|parse error"
    r"|submodule.*(not initialized|failed|missing)"
)
#: Classes whose owner is settled by the class itself.
CREDENTIAL_CLASSES = ("private_registry",)
EXTERNAL_CLASSES = ("external_service_missing", "docker_missing", "browser_missing", "no_network")
HOST_STATE_CLASSES = ("wrong_runtime", "out_of_disk", "out_of_memory", "container_misconfig")
RUNNER_CLASSES = ("wrong_runtime", "toolchain_missing", "native_build_failed", "missing_system_lib", "container_misconfig", "out_of_disk", "out_of_memory", "package_manager_bug", "test_dependency_missing", "build_backend_missing", "missing_wrapper_jar")
#: Effort of mending by a sign in the log, in order.
EFFORTS = (
    ("infeasible", r"(?i)submodule.*(not initialized|failed|missing)|E401|E403|401 Unauthorized|403 Forbidden|authentication required|Unable to authenticate|authentication token|npm login|private (registry|repository)|\.npmrc.*token|credentials"),
    ("substantial", r"(?i)E404|404 Not Found|no matching distribution|could not find a version|artifact.*not found|end.?of.?life|no longer supported|deprecated runtime"),
    ("moderate", r"(?i)ERESOLVE|unable to resolve dependency tree|peer dep|version solving failed|lock(file)? (is )?(out of date|outdated|mismatch)|integrity check failed|(package-lock\.json|lock ?file).{0,40}(out of sync|in sync)|Missing: .+ from lock file|could not resolve dependencies"),
    ("moderate", r"(?i)compilation (error|failed)|cannot find symbol|parse error"),
    ("trivial", r"(?i)unsupported engine|EBADENGINE|engine \"node\"|requires (node|python|ruby)|wrong ruby version|JAVA_HOME|missing environment variable|\.env"),
)


def error_class(log: Column, timed_out: Column) -> Column:
    """Class of a failure, by the first signature that fits."""
    out = F.when(F.coalesce(timed_out, F.lit(False)), "timeout").when(~F.coalesce(log, F.lit("")).rlike(r"\S"), "unknown_no_output")
    for name, pattern in SIGNATURES:
        out = out.when(log.rlike(pattern), name)
    return out.otherwise("unclassified")


def failure_class(log: Column, timed_out: Column, private_registry: Column, error: Column) -> Column:
    """TIMEOUT, ENVIRONMENT, REPO_INTRINSIC or UNCLASSIFIED.

    Refused credentials are the repository's only where its tree asks for a
    private registry. A class that speaks of the host's state overrules the log;
    a class with a known owner decides what the log leaves open.
    """
    asked = F.when(F.coalesce(private_registry, F.lit(False)), "REPO_INTRINSIC").otherwise("ENVIRONMENT")
    by_log = F.when(log.rlike(AUTH), asked).when(log.rlike(HOST), "ENVIRONMENT").when(log.rlike(INTRINSIC), "REPO_INTRINSIC")
    by_class = F.when(error.isin(*CREDENTIAL_CLASSES), asked).when(error.isin(*RUNNER_CLASSES, *EXTERNAL_CLASSES), "ENVIRONMENT").otherwise("UNCLASSIFIED")
    return F.when(error.isin(*HOST_STATE_CLASSES), "ENVIRONMENT").when(F.coalesce(timed_out, F.lit(False)), "TIMEOUT").otherwise(F.coalesce(by_log, by_class))


def owner(failure: Column, error: Column) -> Column:
    """Who owns an outcome; a clean one is the repository's."""
    return (
        F.when(error.isin(*CREDENTIAL_CLASSES), "credentials").when(error.isin(*EXTERNAL_CLASSES), "external_service").when(failure.isin("REPO_INTRINSIC", "NONE"), "repository")
        .when(failure.isin("ENVIRONMENT", "TIMEOUT", "UNCLASSIFIED"), "runner").otherwise("unknown")
    )


def confidence(failure: Column, error: Column) -> Column:
    return F.when(failure == "UNCLASSIFIED", "low").when(error.isin("unclassified", "unknown_no_output"), "medium").otherwise("high")


def effort(failure: Column, log: Column) -> Column:
    """What mending takes, by the failure and then by signs in the log."""
    out = F.when(failure == "NONE", "none").when(failure == "ENVIRONMENT", "trivial").when(failure == "TIMEOUT", "unknown")
    for name, pattern in EFFORTS:
        out = out.when(log.rlike(pattern), name)
    return out.otherwise("unknown")


def attributed(logs: DataFrame, private_registry: Column) -> DataFrame:
    """Adds error_class, failure_class, attribution, confidence and effort to (log, timed_out)."""
    out = logs.withColumn("error_class", error_class(F.col("log"), F.col("timed_out")))
    out = out.withColumn("failure_class", failure_class(F.col("log"), F.col("timed_out"), private_registry, F.col("error_class")))
    f, e = F.col("failure_class"), F.col("error_class")
    return out.withColumn("attribution", owner(f, e)).withColumn("confidence", confidence(f, e)).withColumn("effort", effort(f, F.col("log")))


# ------------------------------------------------------------- runner output
def _one(text: Column, pattern: str) -> Column:
    """First capture as a whole number, null where the pattern doesn't fit."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("int")


def _sum(text: Column, pattern: str, group: int) -> Column:
    return F.aggregate(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(0), lambda a, x: a + x.cast("int"))


def _counts(collected=None, passed=None, failed=None, errored=None, skipped=None) -> Column:
    none = F.lit(None).cast("int")
    return F.struct(*[(none if c is None else c).cast("int").alias(n) for n, c in (("collected", collected), ("passed", passed), ("failed", failed), ("errored", errored), ("skipped", skipped))])


def _total(*parts: Column) -> Column:
    """Sum of what is there, null where nothing is."""
    return F.when(F.coalesce(*parts).isNotNull(), sum((F.coalesce(p, F.lit(0)) for p in parts), F.lit(0)))


def runner_counts(kind: Column, out: Column) -> Column:
    """struct(collected, passed, failed, errored, skipped) from the output of one of nine test runners.

    A figure that the output doesn't give is null; an unknown runner gives a null struct.
    """
    tail = F.right(out, F.lit(6000))
    said = F.coalesce(_one(out, r"(\d+) tests? collected"), _one(out, r"collected (\d+) items?"), F.when(out.rlike("no tests ran|collected 0 items"), 0))
    pytest = _counts(said, _one(tail, r"(\d+) passed"), _one(tail, r"(\d+) failed"), _one(tail, r"(\d+) errors?"), _one(tail, r"(\d+) skipped"))
    j = F.regexp_extract(out, r"(?m)^Tests:\s+(.+)$", 1)
    jest = _counts(_one(j, r"(\d+) total"), _one(j, r"(\d+) passed"), _one(j, r"(\d+) failed"), None, _one(j, r"(\d+) skipped"))
    v = F.regexp_extract(out, r"(?m)^\s*Tests\s+(.+?)\s*$", 1)
    v3 = [_one(v, rf"(\d+) {w}") for w in ("passed", "failed", "skipped")]
    m3 = [_one(out, rf"(\d+) {w}") for w in ("passing", "failing", "pending")]
    result = r"test result: \w+\. (\d+) passed; (\d+) failed; (\d+) ignored"
    c3 = [F.when(out.rlike(result), _sum(out, result, g)) for g in (1, 2, 3)]
    events = F.transform(F.filter(F.split(out, "\n"), lambda x: F.ltrim(x).startswith("{")), lambda x: F.from_json(x, "Action string, Test string"))
    seen = lambda a: F.size(F.filter(events, lambda e: (e["Action"] == a) & (F.coalesce(e["Test"], F.lit("")) != "")))
    g3 = [seen(a) for a in ("pass", "fail", "skip")]
    go = F.when(g3[0] + g3[1] + g3[2] > 0, _counts(g3[0] + g3[1] + g3[2], g3[0], g3[1], None, g3[2])).otherwise(_counts())
    dotnet = _counts(_one(out, r"Total:\s+(\d+)"), _one(out, r"Passed!?:\s+(\d+)"), _one(out, r"Failed!?:\s+(\d+)"), None, _one(out, r"Skipped!?:\s+(\d+)"))
    ok, all_ = _one(out, r"OK \((\d+) tests?"), _one(out, r"Tests: (\d+)")
    p3 = [_one(out, rf"{w}: (\d+)") for w in ("Failures", "Errors", "Skipped")]
    phpunit = F.when(ok.isNotNull(), _counts(ok, ok, F.lit(0))).otherwise(_counts(all_, F.greatest(F.lit(0), all_ - sum((F.coalesce(x, F.lit(0)) for x in p3), F.lit(0))) + 0 * all_, *p3))
    line = r"(\d+) examples?, (\d+) failures?(?:, (\d+) pending)?"
    r3 = [F.nullif(F.regexp_extract(out, line, g), F.lit("")).try_cast("int") for g in (1, 2, 3)]
    pending = F.when(r3[0].isNotNull(), F.coalesce(r3[2], F.lit(0)))
    rspec = _counts(r3[0], F.when(r3[0].isNotNull(), F.greatest(F.lit(0), r3[0] - r3[1] - pending)), r3[1], None, pending)
    return (
        F.when(kind == "pytest", pytest).when(kind == "jest", jest).when(kind == "vitest", _counts(_total(*v3), v3[0], v3[1], None, v3[2])).when(kind == "mocha", _counts(_total(*m3), m3[0], m3[1], None, m3[2]))
        .when(kind == "cargo", _counts(c3[0] + c3[1] + c3[2], c3[0], c3[1], None, c3[2])).when(kind == "go", go).when(kind == "dotnet", dotnet).when(kind == "phpunit", phpunit).when(kind == "rspec", rspec)
    )


def listing_count(kind: Column, out: Column) -> Column:
    """How many units a runner's own listing names; 0 for unknown kinds."""
    lines = F.split(out, "\n")
    of = lambda pattern, trim=True: F.size(F.filter(lines, lambda x: (F.trim(x) if trim else x).rlike(pattern)))
    return (
        F.when(kind == "jest_files", of(r"^(?:/|[A-Za-z]:\\).*\.[cm]?[jt]sx?$")).when(kind == "cargo_list", F.regexp_count(out, F.lit(r"(?m): test\s*$"))).when(kind == "go_list", of(r"^(Test|Example|Fuzz|Benchmark)\w*$"))
        .when(kind == "dotnet_list", of("^    ", False)).when(kind == "phpunit_list", F.regexp_count(out, F.lit(r"(?m)^\s*-\s+\S"))).when(kind == "rspec_dry", F.coalesce(_one(out, r"(\d+) examples?, \d+ failures?"), F.lit(0)))
        .when(kind == "gradle_dry", F.regexp_count(out, F.lit(r"(?m)^> Task .*:test\b"))).otherwise(0)
    )


def coverage(kind: Column, report: Column) -> Column:
    """struct(pct, covered, total, method) from a coverage report; null figures where it gives none."""
    get = lambda path: F.get_json_object(report, path)
    number = lambda c, kind: F.coalesce(c.try_cast(kind), F.lit(0).cast(kind))
    made = lambda pct, covered, total, method: F.struct(F.round(pct, 2).alias("pct"), covered.alias("covered"), total.alias("total"), F.lit(method).alias("method"))
    none = F.struct(F.lit(None).cast("double").alias("pct"), F.lit(None).cast("long").alias("covered"), F.lit(None).cast("long").alias("total"), F.lit(None).cast("string").alias("method"))
    py = F.when(number(get("$.totals.num_statements"), "long") > 0, made(number(get("$.totals.percent_covered"), "double"), number(get("$.totals.covered_lines"), "long"), number(get("$.totals.num_statements"), "long"), "coverage.py"))
    js = F.when(number(get("$.total.lines.total"), "long") > 0, made(number(get("$.total.lines.pct"), "double"), number(get("$.total.lines.covered"), "long"), number(get("$.total.lines.total"), "long"), "istanbul"))
    go = F.nullif(F.regexp_extract(report, r"(?m)^total:\s+\(statements\)\s+([\d.]+)%", 1), F.lit("")).try_cast("double")
    nothing = F.lit(None).cast("long")
    return F.coalesce(F.when(kind == "coveragepy", py).when(kind == "istanbul", js).when((kind == "go") & go.isNotNull(), made(go, nothing, nothing, "go cover")), none)


#: Totals in a transcript, in order, (name, pattern).
COVERAGE_LINES = (("go-cover", r"(?m)coverage:\s*([\d.]+)%\s*of statements"), ("coverage-total", r"(?m)^TOTAL\s+.*?\s([\d.]+)%\s*$"), ("istanbul", r"(?m)All files\s*\|\s*([\d.]+)"), ("dotnet-coverlet", r"(?m)Total\s*\|\s*([\d.]+)%"))


def coverage_in(log: Column) -> Column:
    """struct(pct, method) of the first total that a transcript shows, else nulls."""
    found = [F.when(log.rlike(p), F.struct(F.regexp_extract(log, p, 1).try_cast("double").alias("pct"), F.lit(n).alias("method"))) for n, p in COVERAGE_LINES]
    return F.coalesce(*found, F.struct(F.lit(None).cast("double").alias("pct"), F.lit(None).cast("string").alias("method")))


def junit_totals(suites: DataFrame, by: str) -> DataFrame:
    """Totals of (key, tests, failures, errors, skipped) rows, one a suite; passed is what is left, 0 at least."""
    n = lambda c: F.sum(F.coalesce(F.col(c).try_cast("long"), F.lit(0)))
    per = suites.groupBy(by).agg(n("tests").alias("collected"), n("failures").alias("failed"), n("errors").alias("errored"), n("skipped").alias("skipped"))
    return per.withColumn("passed", F.greatest(F.lit(0), F.col("collected") - F.col("failed") - F.col("errored") - F.col("skipped")))
