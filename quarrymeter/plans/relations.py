"""The driver's tables seen as the engine's relations (commits, files, phases, spans ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def commits(spark: SparkSession, sf: str) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    p = F.col("o_orderpriority")
    kind = F.when(p.isin("1-URGENT", "2-HIGH"), "feature").when(p == "3-MEDIUM", "repair").when(p == "5-LOW", "noise").otherwise("neutral")
    j = o.join(c, o.o_custkey == c.c_custkey)
    return j.select(F.col("o_orderkey").alias("sha"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("ts"), kind.alias("kind"), (F.col("c_mktsegment") == "MACHINERY").alias("bot"), F.col("o_totalprice").alias("price"))


def commit_files(spark: SparkSession, sf: str) -> DataFrame:
    li, p, s = table(spark, sf, "lineitem"), table(spark, sf, "part"), table(spark, sf, "supplier")
    t = F.col("p_type")
    kind = F.when(t == "PROMO", "test").when(t == "SMALL", "test_infra").when(t == "ECONOMY", "docs").when(t == "LARGE", "schema").otherwise("impl")
    j = li.join(p, li.l_partkey == p.p_partkey).join(s, li.l_suppkey == s.s_suppkey)
    return j.select(F.col("l_orderkey").alias("sha"), F.col("l_partkey").alias("path"), F.col("s_nationkey").alias("dir"), kind.alias("file_kind"), F.col("l_quantity").cast("int").alias("additions"), F.round(F.col("l_discount") * 100).cast("int").alias("deletions"))


def files(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(F.col("source").alias("repo"), F.col("doc_id").alias("path"), F.col("lang").alias("language"), "text", F.col("n_chars").alias("size"))


def phases(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    status = F.when(F.col("l_linestatus") == "O", "ok").when(F.col("l_returnflag") == "N", "skipped").otherwise("failed")
    owner = F.when(F.col("l_returnflag") == "R", "repo").when(F.col("l_tax") >= 0.04, "runner")
    return li.select(F.col("l_orderkey").alias("project"), F.col("l_linenumber").alias("phase"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), status.alias("status"), F.when(status == "failed", owner).alias("attribution"))


def written_sources(spark: SparkSession, sf: str) -> DataFrame:
    """(repo, path, ext, size, text): a source in Go, Java, JavaScript or Rust for each part, with as many branches as its size says."""
    key, n = F.col("p_partkey"), (F.col("p_size") % 7).cast("int")
    texts = [
        ("go", 'package a\n// if {\nfunc f() {\n s := "if {"\n', "if x {\n y()\n}\n", "}\n"),
        ("java", 'class A { /* while ( */ void f() throws B { String s = "for (";\n', "while (x) { }\n", "} }\n"),
        ("js", "const f = (x) => { const t = `if ${x ? 1 : 2} {`; // for\n", "if (x) { } else { }\n", "};\n"),
        ("rs", "fn f() { match x { // if\n", "A => '{',\n", "} }\n"),
    ]
    text, ext = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (e, head, each, tail) in enumerate(texts):
        text = F.when(key % 4 == i, F.concat(F.lit(head), F.repeat(F.lit(each), n), F.lit(tail))).otherwise(text)
        ext = F.when(key % 4 == i, F.lit(f".{e}")).otherwise(ext)
    p = table(spark, sf, "part").select(F.col("p_brand").alias("repo"), F.lpad(key.cast("string"), 12, "0").alias("path"), ext.alias("ext"), text.alias("text"))
    return p.withColumn("size", F.octet_length("text").cast("long"))


def written_manifests(spark: SparkSession, sf: str) -> DataFrame:
    """(repo, text): a YAML mapping for each customer, a line for each order: headers, comments and entries of any indent."""
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    pad = lambda n: F.repeat(F.lit(" "), (k % n).cast("int"))
    line = F.when(p == "1-URGENT", F.concat(pad(2), F.lit("dependencies:"))).when(p == "5-LOW", F.concat(pad(4), F.lit("# none: 1"))).otherwise(F.concat(pad(4), F.lit("- k"), k, F.lit(">=1  # why")))
    told = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("repo")).agg(F.sort_array(F.collect_list(F.struct(k.alias("k"), line.alias("line")))).alias("x"))
    return told.select("repo", F.array_join(F.transform("x", lambda e: e["line"]), "\n").alias("text"))


def detailed_customers(spark: SparkSession, sf: str) -> DataFrame:
    """(c_custkey, doc): a nested document with evidence at every depth: in structs, arrays and maps."""
    log = F.struct(F.col("o_comment" if "o_comment" in table(spark, sf, "orders").columns else "o_orderpriority").alias("text")).alias("log")
    one = F.struct(F.col("o_orderkey").alias("id"), log, F.array(F.struct(F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").alias("evidence"))).alias("lines"))
    o = table(spark, sf, "orders")
    n = F.count("*")
    per = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sort_array(F.collect_list(one)).alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("f"), n.alias("n"))
    count = lambda c: F.struct(c.alias("n"), F.array(c).alias("evidence"))
    both = F.create_map(F.lit("F"), count(F.col("f")), F.lit("O"), count(F.col("n") - F.col("f")))
    doc = F.struct(F.col("c_name").alias("name"), F.col("orders").alias("evidence"), "orders", both.alias("by_status"))
    return table(spark, sf, "customer").join(per, "c_custkey").select("c_custkey", doc.alias("doc"))


def probed_projects(spark: SparkSession, sf: str) -> DataFrame:
    """(repo, project, ecosystem, weight): a customer's orders as projects."""
    p = F.col("o_orderpriority")
    ecosystem = F.when(p == "1-URGENT", "python").when(p == "2-HIGH", "go").when(p == "3-MEDIUM", "ruby").when(p == "5-LOW", "php").otherwise("cobol")
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("project"), ecosystem.alias("ecosystem"), F.round("o_totalprice").cast("long").alias("weight"))


def probe_records(spark: SparkSession, sf: str) -> DataFrame:
    """(repo, project, phase, outcome, attribution, seconds): the first five lines of an order as its phases."""
    from ..operators.machine import PHASES

    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    flag = F.col("l_returnflag")
    outcome = F.when((F.col("l_linestatus") == "O") | (F.col("l_tax") < 0.05), "passed").when(flag == "R", "failed").when(flag == "A", "unavailable")
    first = li.where(F.col("l_linenumber").between(1, 5)).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    phase = F.element_at(F.array(*map(F.lit, PHASES)), F.col("l_linenumber").cast("int"))
    return first.select(F.col("o_custkey").alias("repo"), F.col("l_orderkey").alias("project"), phase.alias("phase"), outcome.alias("outcome"), F.when(flag == "R", "repository").when(flag == "A", "runner").alias("attribution"), (F.col("l_quantity").cast("int") * 20).cast("long").alias("seconds"))


#: The phase machine in DuckDB: a recursion over the phases of each repository in their order.
MACHINE_SQL = """
WITH RECURSIVE p AS (SELECT o_custkey AS repo, o_orderkey AS project, CASE o_orderpriority WHEN '1-URGENT' THEN 'python' WHEN '2-HIGH' THEN 'go' WHEN '3-MEDIUM' THEN 'ruby' WHEN '5-LOW' THEN 'php' ELSE 'cobol' END AS ecosystem, CAST(round(o_totalprice) AS BIGINT) AS weight FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY weight DESC, project) AS rank FROM p),
v AS (SELECT *, coalesce(sum(CASE WHEN rank <= 8 THEN weight END) OVER (PARTITION BY repo ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0)::BIGINT AS weight_left FROM k),
h AS (SELECT * FROM (VALUES (0, 'resolve'), (1, 'build'), (2, 'discover'), (3, 'test'), (4, 'coverage')) t(nth, phase)),
q AS (SELECT l_orderkey AS project, l_linenumber - 1 AS nth, CASE WHEN l_linestatus = 'O' OR l_tax < 0.05 THEN 'passed' WHEN l_returnflag = 'R' THEN 'failed' WHEN l_returnflag = 'A' THEN 'unavailable' END AS outcome,
 CASE l_returnflag WHEN 'R' THEN 'repository' WHEN 'A' THEN 'runner' END AS attribution, CAST(trunc(l_quantity) AS BIGINT) * 20 AS seconds FROM lineitem WHERE l_linenumber BETWEEN 1 AND 5),
r AS (SELECT project, nth, outcome, attribution, seconds FROM (SELECT *, row_number() OVER (PARTITION BY project, nth ORDER BY seconds DESC, outcome DESC NULLS LAST, attribution DESC NULLS LAST) AS i FROM q) WHERE i = 1),
e AS (SELECT v.*, h.*, (v.rank - 1) * 5 + h.nth AS pos, NOT (ecosystem = 'cobol' OR (phase = 'build' AND ecosystem IN ('python', 'ruby', 'php')) OR (phase = 'coverage' AND ecosystem = 'php')) AS planned, outcome, attribution, coalesce(seconds, 0) AS seconds FROM v, h LEFT JOIN r ON r.project = v.project AND r.nth = h.nth),
m AS (SELECT repo, -1::BIGINT AS pos, 1800::BIGINT AS lft, 0::BIGINT AS share, NULL::VARCHAR AS cause, NULL::VARCHAR AS owner, NULL::VARCHAR AS stop, NULL::BIGINT AS project, NULL::VARCHAR AS phase, NULL::BIGINT AS rank, NULL::INT AS nth, NULL::VARCHAR AS status, NULL::VARCHAR AS reason, NULL::VARCHAR AS blame, 0::BIGINT AS used FROM (SELECT DISTINCT repo FROM p)
UNION ALL SELECT repo, pos, lft - used, share - used, CASE WHEN blocks THEN phase || '_' || status ELSE cause END, CASE WHEN blocks THEN blame ELSE owner END, CASE WHEN status = 'skipped_budget' THEN 'spent' ELSE stop END, project, phase, rank, nth, status,
  CASE status WHEN 'blocked' THEN cause WHEN 'skipped_budget' THEN 'run_budget_exhausted' WHEN 'timed_out' THEN 'cut_off_by_budget' END, blame, used
 FROM (SELECT *, CASE WHEN runs AND allowed >= 15 AND outcome IS NOT NULL THEN least(seconds, allowed) ELSE 0 END AS used,
   runs AND (status IN ('unavailable', 'timed_out') AND phase <> 'coverage' OR status = 'failed' AND phase IN ('resolve', 'build')) AS blocks,
   CASE WHEN status = 'blocked' THEN owner WHEN status IN ('skipped_budget', 'timed_out') THEN 'runner' WHEN status IN ('failed', 'unavailable') THEN coalesce(attribution, 'unknown') END AS blame
  FROM (SELECT *, cause IS NULL AND stop IS NULL AND planned AS runs, CASE WHEN cause IS NOT NULL THEN 'blocked' WHEN stop IS NOT NULL THEN 'skipped_budget' WHEN NOT planned THEN 'not_planned' WHEN allowed < 15 THEN 'skipped_budget' WHEN outcome IS NULL THEN 'not_recorded' WHEN seconds > allowed THEN 'timed_out' ELSE outcome END AS status
   FROM (SELECT *, least(900, share, lft) AS allowed FROM (
    SELECT m.repo, e.pos, m.lft, e.project, e.phase, e.rank, e.nth, e.planned, e.outcome, e.attribution, e.seconds, CASE WHEN e.nth = 0 THEN greatest(m.lft * e.weight // greatest(1, e.weight_left), least(30, m.lft)) ELSE m.share END AS share,
     CASE WHEN e.nth > 0 THEN m.cause END AS cause, CASE WHEN e.nth > 0 THEN m.owner END AS owner, CASE WHEN e.nth > 0 THEN m.stop END AS stop FROM m JOIN e ON e.repo = m.repo AND e.pos = m.pos + 1 AND e.rank <= 8)))))
"""


def commit_graph(spark: SparkSession, sf: str) -> DataFrame:
    """(repo, sha, parents): 25 histories of merges over the orders."""
    k = F.col("o_orderkey")
    first = F.when(F.col("o_orderpriority") == "5-LOW", k - 75).otherwise(k - 25)
    merged = F.when(F.col("o_orderstatus") == "F", k - 25 * (2 + F.col("o_custkey") % 9))
    name = lambda c: c.cast("string")
    return table(spark, sf, "orders").select((k % 25).alias("repo"), name(k).alias("sha"), F.array_compact(F.array(name(first), name(merged))).alias("parents"))


def commit_refs(spark: SparkSession, sf: str) -> DataFrame:
    """(repo, ref, sha): the newest commit of each priority, and the dearest one."""
    o = table(spark, sf, "orders").select((F.col("o_orderkey") % 25).alias("repo"), F.col("o_orderpriority").alias("ref"), "o_orderkey", "o_totalprice")
    newest = o.groupBy("repo", "ref").agg(F.max("o_orderkey").cast("string").alias("sha"))
    return newest.unionByName(o.groupBy("repo").agg(F.lit("dearest").alias("ref"), F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).cast("string").alias("sha")))


def commit_tags(spark: SparkSession, sf: str) -> DataFrame:
    """(repo, tag, sha): the dearest commit of every customer in each repository."""
    o = table(spark, sf, "orders").select((F.col("o_orderkey") % 25).alias("repo"), "o_custkey", "o_orderkey", "o_totalprice")
    return o.groupBy("repo", F.col("o_custkey").cast("string").alias("tag")).agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).cast("string").alias("sha"))


#: The commit graph in DuckDB: edges, refs, tags, and by recursion the commits below each ref.
GRAPH_SQL = """
WITH RECURSIVE e AS (SELECT o_orderkey AS c, CASE o_orderpriority WHEN '5-LOW' THEN o_orderkey - 75 ELSE o_orderkey - 25 END AS p FROM orders UNION ALL SELECT o_orderkey, o_orderkey - 25 * (2 + o_custkey % 9) FROM orders WHERE o_orderstatus = 'F'),
refs AS (SELECT o_orderkey % 25 AS repo, o_orderpriority AS ref, max(o_orderkey) AS c FROM orders GROUP BY 1, 2
 UNION ALL SELECT o_orderkey % 25, 'dearest', arg_max(o_orderkey, o_totalprice * 1e9 + o_orderkey) FROM orders GROUP BY 1),
tags AS (SELECT o_orderkey % 25 AS repo, o_custkey::VARCHAR AS tag, arg_max(o_orderkey, o_totalprice * 1e9 + o_orderkey) AS c FROM orders GROUP BY 1, 2),
below AS (SELECT repo, ref, c FROM refs UNION SELECT b.repo, b.ref, e.p FROM below b JOIN e ON e.c = b.c WHERE e.p >= 0)
"""

#: The same relations as DuckDB views, as a WITH prefix.
SQL = """
WITH commits AS (
  SELECT o_orderkey AS sha, o_custkey AS author, o_orderdate AS ts,
    CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'feature' WHEN o_orderpriority='3-MEDIUM' THEN 'repair' WHEN o_orderpriority='5-LOW' THEN 'noise' ELSE 'neutral' END AS kind,
    c_mktsegment='MACHINERY' AS bot
  FROM orders JOIN customer ON o_custkey=c_custkey),
commit_files AS (
  SELECT l_orderkey AS sha, l_partkey AS path, s_nationkey AS dir,
    CASE p_type WHEN 'PROMO' THEN 'test' WHEN 'SMALL' THEN 'test_infra' WHEN 'ECONOMY' THEN 'docs' WHEN 'LARGE' THEN 'schema' ELSE 'impl' END AS file_kind,
    CAST(trunc(l_quantity) AS INTEGER) AS additions, CAST(round(l_discount*100) AS INTEGER) AS deletions
  FROM lineitem JOIN part ON l_partkey=p_partkey JOIN supplier ON l_suppkey=s_suppkey),
facts AS (
  SELECT c.*, coalesce(f.files,0) AS files, coalesce(f.tests,0) AS tests, coalesce(f.impl,0) AS impl, coalesce(f.diversity,0) AS diversity, coalesce(f.additions,0) AS additions, coalesce(f.deletions,0) AS deletions
  FROM commits c LEFT JOIN (
    SELECT sha, count(*) AS files, count(*) FILTER (file_kind='test') AS tests, count(*) FILTER (file_kind IN ('impl','schema')) AS impl, count(DISTINCT dir) AS diversity, sum(additions) AS additions, sum(deletions) AS deletions
    FROM commit_files GROUP BY sha) f USING (sha)),
classed AS (
  SELECT *, CASE
    WHEN files<=30 AND diversity<=3 AND tests>=1 AND impl>=1 AND NOT bot AND kind<>'noise' THEN 'A'
    WHEN tests>=3 AND impl<3 AND NOT bot AND kind<>'noise' THEN 'B'
    WHEN files<=30 AND diversity<=3 AND impl>=1 AND tests=0 AND kind='feature' AND NOT bot THEN 'C-pre' ELSE 'none' END AS commit_class,
    kind='repair' AND impl>=1 AND NOT bot AND deletions>=1 AND (tests>=1 OR additions<=10*deletions) AS repair
  FROM facts),
loc_files AS (
  SELECT source AS repo, doc_id AS path, lang AS language, text, n_chars AS size,
    len(list_filter(string_split_regex(text, '\\r\\n|\\r|\\n'), lambda x: length(trim(x, ' '))>0)) AS loc
  FROM documents),
phases AS (
  SELECT l_orderkey AS project, l_linenumber AS phase, l_partkey AS part, l_suppkey AS supp,
    CASE WHEN l_linestatus='O' THEN 'ok' WHEN l_returnflag='N' THEN 'skipped' ELSE 'failed' END AS status,
    CASE WHEN l_linestatus='O' OR l_returnflag='N' THEN NULL WHEN l_returnflag='R' THEN 'repo' WHEN l_tax>=0.04 THEN 'runner' END AS attribution
  FROM lineitem)
"""
