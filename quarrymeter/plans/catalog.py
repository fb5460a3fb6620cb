"""Registered queries over the driver's tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths, scores, text
from ..operators import census, emit, graph, history, lines, machine, projects, runtime, tree, verdicts
from ..sources import tree as trees
from . import relations as rel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None, prefix: bool = True):
    """Register a query with its SQL; ``prefix`` puts the relations' views before it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = (rel.SQL + sql) if prefix else sql
        return f

    return add


# ------------------------------------------------------------------ history
@query("SELECT commit_class, count(*) AS commits, sum(repair::INT)::BIGINT AS repairs, sum(CASE WHEN commit_class='B' THEN least(tests,15) ELSE 0 END)::BIGINT AS latent FROM classed GROUP BY commit_class")
def commit_class_tallies(spark, sf):
    facts = history.commit_facts(rel.commits(spark, sf), rel.commit_files(spark, sf))
    return history.class_tallies(facts, many_tests=3)


@query("""SELECT CASE WHEN x<0.33 THEN 'low' WHEN x<0.66 THEN 'medium' ELSE 'high' END AS band, count(*) AS commits, sum(deletions)::BIGINT AS deletions
 FROM (SELECT *, least(1.0::DOUBLE, 0.15::DOUBLE*impl + 0.1::DOUBLE*diversity + (additions+deletions)/2000.0::DOUBLE) AS x FROM classed WHERE repair) GROUP BY 1""")
def repair_bands(spark, sf):
    return history.repairs(history.commit_facts(rel.commits(spark, sf), rel.commit_files(spark, sf)))


@query("SELECT count(*) AS commits, count(*) FILTER (NOT bot AND impl>=2 AND additions+deletions BETWEEN 20 AND 10000) AS mineable, count(DISTINCT CASE WHEN NOT bot THEN author END) AS human_authors FROM facts")
def mineable_commits(spark, sf):
    return history.mineable(history.commit_facts(rel.commits(spark, sf), rel.commit_files(spark, sf)))


@query("""SELECT count(*) FILTER (NOT bot) AS humans, count(*) FILTER (bot) AS bots, sum(CASE WHEN bot THEN n ELSE 0 END)::BIGINT AS bot_commits, sum(n)::BIGINT AS commits,
 sum(CASE WHEN bot THEN n ELSE 0 END)::DOUBLE/sum(n) AS bot_ratio FROM (SELECT author, bool_or(bot) AS bot, count(*) AS n FROM commits GROUP BY author)""")
def author_profile(spark, sf):
    return history.author_profile(rel.commits(spark, sf))


@query("SELECT count(*) AS rows, avg((event_type='purchase')::INT::DOUBLE) AS rate FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 200)", prefix=False)
def recent_rate(spark, sf):
    return history.recent_rate(rel.table(spark, sf, "events"), F.col("event_type") == "purchase", "ts", "event_id")


@query("""SELECT strftime(m.month, '%Y-%m') AS month, coalesce(n, 0) AS commits FROM
 (SELECT unnest(generate_series(last - INTERVAL 11 MONTH, last, INTERVAL 1 MONTH)) AS month FROM (SELECT date_trunc('month', max(o_orderdate))::TIMESTAMP AS last FROM orders)) m
 LEFT JOIN (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS month, count(*) AS n FROM orders JOIN customer ON o_custkey=c_custkey GROUP BY 1) g ON m.month=g.month""", prefix=False)
def month_histogram(spark, sf):
    return history.month_histogram(rel.commits(spark, sf))


@query("""SELECT min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT ts::DATE) AS active_days, count(*) AS commits,
 CAST(floor((epoch(max(ts))-epoch(min(ts)))/86400) AS BIGINT) AS span_days, CAST(floor((epoch(TIMESTAMP '2002-01-01 00:00:00')-epoch(max(ts)))/86400) AS BIGINT) AS recency_days,
 count(*)>=2 AND floor((epoch(max(ts))-epoch(min(ts)))/86400)<=2 AS burst_copy FROM commits""")
def history_calendar(spark, sf):
    return history.calendar(rel.commits(spark, sf), "2002-01-01 00:00:00")


@query("SELECT sha, count(DISTINCT dir) AS dirs FROM commit_files GROUP BY sha")
def top_dirs(spark, sf):
    return rel.commit_files(spark, sf).groupBy("sha").agg(F.countDistinct("dir").alias("dirs"))


@query("""SELECT position, sha, ts FROM (SELECT row_number() OVER (ORDER BY ts, sha)-1 AS position, sha, ts, count(*) OVER () AS n FROM commits)
 WHERE position IN (SELECT CAST(floor(i * (n::DOUBLE/160)) AS BIGINT) FROM range(160) t(i), (SELECT count(*) AS n FROM commits))""")
def even_sample(spark, sf):
    return history.even_sample(rel.commits(spark, sf).select("sha", "ts"), ["ts", "sha"], 160).select("position", "sha", "ts")


@query("""SELECT l_suppkey, n, top, total, top/total AS top_share FROM (SELECT l_suppkey, count(*) AS n, sum(CASE WHEN rn<=k THEN q ELSE 0 END)::BIGINT AS top, sum(q)::BIGINT AS total FROM (
 SELECT *, greatest(1, CASE WHEN (c*0.01)%1=0.5 AND floor(c*0.01)%2=0 THEN floor(c*0.01) ELSE round(c*0.01) END) AS k FROM (
 SELECT l_suppkey, CAST(trunc(l_quantity) AS INTEGER) AS q, count(*) OVER (PARTITION BY l_suppkey) AS c, row_number() OVER (PARTITION BY l_suppkey ORDER BY CAST(trunc(l_quantity) AS INTEGER) DESC, l_orderkey*100+l_linenumber) AS rn FROM lineitem)) GROUP BY l_suppkey)""", prefix=False)
def decision_concentration(spark, sf):
    li = rel.table(spark, sf, "lineitem").select("l_suppkey", F.col("l_quantity").cast("int").alias("q"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("o"))
    return history.concentration(li, "l_suppkey", "q", "o")


@query("SELECT o_custkey AS sha, min(o_orderpriority) AS ref, count(*) AS aliases FROM orders GROUP BY o_custkey", prefix=False)
def ref_collapse(spark, sf):
    o = rel.table(spark, sf, "orders")
    return history.collapse_refs(o.select(F.col("o_custkey").alias("sha"), F.col("o_orderpriority").alias("ref")))


@query("SELECT * FROM (SELECT o_custkey AS ref, count(*) AS commits FROM orders GROUP BY o_custkey) ORDER BY commits DESC, ref LIMIT 12", prefix=False)
def deepest_refs(spark, sf):
    o = rel.table(spark, sf, "orders")
    return history.deepest_ref(o.groupBy(F.col("o_custkey").alias("ref")).agg(F.count("*").alias("commits")))


@query("SELECT count(*) AS tags, count(*) FILTER (regexp_matches(tag, '^v?[0-9]+\\.[0-9]+')) AS semver_tags FROM (SELECT CASE WHEN p_size%2=0 THEN 'v'||p_size||'.'||(p_partkey%10) ELSE p_name END AS tag FROM part)", prefix=False)
def tag_counts(spark, sf):
    p = rel.table(spark, sf, "part")
    tag = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("v"), F.col("p_size"), F.lit("."), F.col("p_partkey") % 10)).otherwise(F.col("p_name"))
    return p.select(tag.alias("tag")).agg(F.count("*").alias("tags"), F.sum(F.col("tag").rlike(r"^v?[0-9]+\.[0-9]+").cast("int")).alias("semver_tags"))


# --------------------------------------------------------------------- tree
@query("SELECT language, sum(loc)::BIGINT AS loc, count(*) AS files FROM loc_files GROUP BY language")
def language_loc(spark, sf):
    return tree.language_loc(tree.with_loc(rel.files(spark, sf)))


@query("SELECT repo, language, loc, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY loc DESC, language) AS rank FROM (SELECT repo, language, sum(loc)::BIGINT AS loc FROM loc_files GROUP BY 1,2) WHERE loc>0) WHERE rank<=4")
def language_rank(spark, sf):
    return tree.language_rank(tree.with_loc(rel.files(spark, sf)))


@query("""SELECT count(*) FILTER (NOT fx) AS specs, count(*) FILTER (fx) AS fixtures FROM (SELECT p_brand IN ('Brand#1','Brand#2') OR p_retailprice>1000 AS fx FROM part WHERE p_type IN ('PROMO','SMALL') OR p_brand IN ('Brand#1','Brand#2'))""", prefix=False)
def spec_fixture(spark, sf):
    p = rel.table(spark, sf, "part").withColumn("loc", F.col("p_retailprice"))
    return tree.spec_fixture(p, F.col("p_brand").isin("Brand#1", "Brand#2"), F.col("p_type").isin("PROMO", "SMALL"), big=1000)


@query("SELECT repo, sum(CASE WHEN language IN ('en','de') THEN loc ELSE 0 END)::BIGINT AS part_loc, sum(loc)::BIGINT AS loc, sum(CASE WHEN language IN ('en','de') THEN loc ELSE 0 END)::DOUBLE/nullif(sum(loc),0) AS loc_share FROM loc_files GROUP BY repo")
def language_share(spark, sf):
    return tree.loc_share(tree.with_loc(rel.files(spark, sf)), "repo", F.col("language").isin("en", "de"))


@query("SELECT language, sum(loc)::BIGINT AS loc FROM (SELECT language, sum(loc) AS loc FROM loc_files WHERE repo<'src5' GROUP BY 1 UNION ALL SELECT repo, sum(loc) FROM loc_files WHERE language='en' GROUP BY 1) GROUP BY language")
def merged_loc(spark, sf):
    f = tree.with_loc(rel.files(spark, sf))
    a = f.where("repo < 'src5'").groupBy("language").agg(F.sum("loc").alias("loc"))
    b = f.where("language = 'en'").groupBy(F.col("repo").alias("language")).agg(F.sum("loc").alias("loc"))
    return tree.merged_loc(a, b, "language")


@query("SELECT path, language, loc FROM loc_files ORDER BY loc DESC, path LIMIT 10")
def largest_files(spark, sf):
    return tree.largest(tree.with_loc(rel.files(spark, sf)).select("path", "language", "loc"))


@query("SELECT repo, sum(len(regexp_extract_all(text, '(tion|ment|ung) ')))::BIGINT AS hits, sum(loc)::BIGINT AS loc, sum(len(regexp_extract_all(text, '(tion|ment|ung) ')))/greatest(sum(loc)/1000.0::DOUBLE, 0.001::DOUBLE) AS per_kloc FROM loc_files GROUP BY repo")
def error_density(spark, sf):
    return tree.error_density(tree.with_loc(rel.files(spark, sf)), "repo", "(tion|ment|ung) ")


@query("SELECT CASE WHEN p_brand IN ('Brand#1','Brand#2','Brand#3') THEN p_brand ELSE 'other' END AS term, count(*) AS n FROM part GROUP BY 1", prefix=False)
def vocabulary_fold(spark, sf):
    return tree.fold_vocabulary(rel.table(spark, sf, "part"), "p_brand", ["Brand#1", "Brand#2", "Brand#3"])


@query("""SELECT repo, n, top, total, top::DOUBLE/nullif(total, 0) AS top_share FROM (SELECT repo, count(*) AS n, sum(d)::BIGINT AS total, sum(CASE WHEN r <= k THEN d ELSE 0 END)::BIGINT AS top FROM (
 SELECT *, row_number() OVER (PARTITION BY repo ORDER BY d DESC, path) AS r, greatest(1, round_even(count(*) OVER (PARTITION BY repo) * 0.1::DOUBLE, 0)) AS k FROM (
 SELECT p_brand AS repo, lpad(p_partkey::VARCHAR, 12, '0') AS path, CASE p_partkey % 4 WHEN 0 THEN 2 * (p_size % 7) WHEN 1 THEN 2 * (p_size % 7) WHEN 2 THEN 1 + 3 * (p_size % 7) ELSE 3 + 2 * (p_size % 7) END AS d FROM part)) GROUP BY repo)""", prefix=False)
def language_decisions(spark, sf):
    found = trees.function_decisions(rel.written_sources(spark, sf)).where("function is not null")
    return history.concentration(found, "repo", "decisions", "path", 0.1).select("repo", "n", "top", "total", "top_share")


@query("""SELECT repo, nr, entry FROM (SELECT *, min(CASE WHEN NOT head THEN indent END) OVER w > max(CASE WHEN head THEN indent END) OVER w AS inside FROM (
 SELECT *, last_value(CASE WHEN head THEN nr END IGNORE NULLS) OVER (PARTITION BY repo ORDER BY nr ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM (
 SELECT o_custkey AS repo, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS nr, o_orderpriority AS p, p = '1-URGENT' AS head, CASE p WHEN '1-URGENT' THEN o_orderkey % 2 ELSE o_orderkey % 4 END AS indent, 'k' || o_orderkey AS entry FROM orders)
 WHERE p <> '5-LOW') WHERE island IS NOT NULL WINDOW w AS (PARTITION BY repo, island ORDER BY nr ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE NOT head AND inside""", prefix=False)
def section_entries(spark, sf):
    return lines.yaml_section_entries(rel.written_manifests(spark, sf), ["repo"], F.array(F.lit("dependencies"), F.lit("pip"))).select("repo", "nr", "entry")


@query("""SELECT c_custkey, to_json({'name': c_name, 'orders': coalesce(o, []), 'by_status': {'F': {'n': f}, 'O': {'n': n - f}}})::VARCHAR AS doc FROM customer JOIN (
 SELECT o_custkey, list({'id': o_orderkey, 'lines': [{'priority': o_orderpriority}]} ORDER BY o_orderkey) AS o, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey""", prefix=False)
def without_detail(spark, sf):
    return emit.without(rel.detailed_customers(spark, sf), ["evidence", "log"]).select("c_custkey", F.to_json("doc").alias("doc"))


# ------------------------------------------------------------- commit graph
@query(rel.GRAPH_SQL + "SELECT repo, ref, count(*) AS commits FROM below GROUP BY repo, ref", prefix=False)
def reachable_commits(spark, sf):
    return graph.measure_refs(rel.commit_graph(spark, sf), rel.commit_refs(spark, sf)).select("repo", "ref", "commits")


@query(rel.GRAPH_SQL + "SELECT t.repo, t.tag FROM tags t JOIN below b ON b.repo = t.repo AND b.c = t.c WHERE b.ref = 'dearest'", prefix=False)
def merged_tags(spark, sf):
    refs = rel.commit_refs(spark, sf).where("ref = 'dearest'")
    tips = graph.tip_bits(refs)
    found = graph.reached(rel.commit_graph(spark, sf), tips)
    return graph.within(rel.commit_tags(spark, sf), found, tips, refs).select("repo", "tag")


# ------------------------------------------------------------ paths and text
@query("""SELECT page_id, CASE WHEN path<>'' AND len(string_split(path,'/')) BETWEEN 1 AND 4 THEN path END AS remote, split_part(bare, '/', -1) AS base, CASE WHEN contains(path,'/') THEN split_part(path,'/',1) END AS top
 FROM (SELECT page_id, bare, regexp_extract(bare, '^(?:[a-z+]+://[^/]+/|[^/@ ]+@[^/:]+:)(.+)$', 1) AS path FROM (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '(\\.git)?/*$', '') AS bare FROM pages))""", prefix=False)
def url_parts(spark, sf):
    p = rel.table(spark, sf, "pages")
    bare = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), r"(\.git)?/*$", "")
    name = paths.url_path(F.col("url"))
    return p.select("page_id", name.alias("remote"), paths.base_name(bare).alias("base"), paths.top_dir(name).alias("top"))


@query("""SELECT root, sum(v)::BIGINT AS total, count(*) AS n FROM (SELECT unnest(list_transform(range(0, len(a)), lambda i: array_to_string(a[1:i], '/'))) AS root, v FROM (SELECT string_split(regexp_extract(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://(.+)$', 1), '/') AS a, length(html) AS v FROM pages)) GROUP BY root""", prefix=False)
def subtree_sums(spark, sf):
    p = rel.table(spark, sf, "pages")
    path = F.regexp_extract(F.regexp_replace("url", r"[?#].*$", ""), r"^[a-z]+://(.+)$", 1)
    return projects.subtree_sums(p.select(path.alias("path"), F.length("html").alias("v")), "path", "v")


@query("SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS INT))::BIGINT AS k, count(*) AS n FROM events GROUP BY event_type", prefix=False)
def json_values(spark, sf):
    e = rel.table(spark, sf, "events").withColumn("v", text.json_in(F.col("props")))
    return e.groupBy("event_type").agg(F.sum(F.expr("variant_get(v, '$.k', 'int')")).alias("k"), F.count("*").alias("n"))


# ----------------------------------------------------------------- projects
@query("""SELECT project, total, ok, skipped, intrinsic, limited, reason, CASE reason WHEN 'all_built' THEN true WHEN 'intrinsic' THEN false END AS build_ok FROM (SELECT *, CASE WHEN ok=total THEN 'all_built' WHEN ok+skipped=total THEN 'skipped' WHEN intrinsic>0 THEN 'intrinsic' WHEN limited>0 THEN 'limited' ELSE 'unattributed' END AS reason FROM (
 SELECT project, count(*) AS total, count(*) FILTER (status='ok') AS ok, count(*) FILTER (status='skipped') AS skipped, count(*) FILTER (status='failed' AND attribution='repo') AS intrinsic, count(*) FILTER (status='failed' AND attribution='runner') AS limited FROM phases GROUP BY project))""")
def build_roll_up(spark, sf):
    return projects.roll_up(rel.phases(spark, sf), "project")


@query("SELECT status, count(*) AS n FROM phases GROUP BY status")
def status_histogram(spark, sf):
    return projects.status_histogram(rel.phases(spark, sf))


@query("""SELECT effective, owner, count(*) AS n FROM (SELECT CASE WHEN o IS NOT NULL THEN 'blocked' ELSE status END AS effective, coalesce(o, f) AS owner FROM (
 SELECT *, last_value(f IGNORE NULLS) OVER (PARTITION BY project ORDER BY phase, part, supp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS o FROM (SELECT *, CASE WHEN status='failed' THEN attribution END AS f FROM phases))) GROUP BY 1,2""")
def phase_propagation(spark, sf):
    p = projects.propagate(rel.phases(spark, sf), "project", ["phase", "part", "supp"])
    return p.groupBy("effective", "owner").agg(F.count("*").alias("n"))


@query("""SELECT o_custkey, o_orderkey, o_totalprice, rank, o_totalprice/nullif(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY rank DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),0) AS budget_share FROM (
 SELECT o_custkey, o_orderkey, CAST(round(o_totalprice) AS BIGINT) AS o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(round(o_totalprice) AS BIGINT) DESC, o_orderkey) AS rank FROM orders) WHERE rank<=8""", prefix=False)
def budget_shares(spark, sf):
    o = rel.table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.round("o_totalprice").cast("long").alias("o_totalprice"))
    return projects.budget_shares(o, "o_custkey", "o_totalprice", "o_orderkey")


@query("SELECT source, doc_id, before FROM (SELECT source, doc_id, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)::BIGINT AS before FROM documents) WHERE before<20000", prefix=False)
def running_cut(spark, sf):
    d = rel.table(spark, sf, "documents").select("source", "doc_id", "n_chars")
    return projects.running_cut(d, "source", "doc_id", "n_chars", 20000).select("source", "doc_id", "before")


@query("""SELECT a.user_id, least(a.event_id,b.event_id) AS a, greatest(a.event_id,b.event_id) AS b FROM (SELECT user_id, event_id, ts, ts + to_microseconds(CAST(round(value*60000000) AS BIGINT)) AS te FROM events) a JOIN (SELECT user_id, event_id, ts, ts + to_microseconds(CAST(round(value*60000000) AS BIGINT)) AS te FROM events) b ON a.user_id=b.user_id AND a.event_id<b.event_id AND a.ts<b.te AND b.ts<a.te""", prefix=False)
def span_overlaps(spark, sf):
    e = rel.table(spark, sf, "events")
    end = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.round(F.col("value") * 60000000).cast("long"))
    s = e.select("user_id", F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("s"), end.alias("e"))
    return projects.overlaps(s, "user_id", "s", "e", 3600)


@query("""SELECT event_type, round(sum(epoch_us(coalesce(fin, TIMESTAMP '2024-02-01')) - epoch_us(ts))/1e6, 3) AS seconds, max(coalesce(fin, TIMESTAMP '2024-02-01')) AS last_end FROM (SELECT *, CASE WHEN event_id%7<>0 THEN ts + to_microseconds(CAST(round(value*1000000) AS BIGINT)) END AS fin FROM events) GROUP BY event_type""", prefix=False)
def lane_clock(spark, sf):
    e = rel.table(spark, sf, "events").withColumn("started", F.col("ts").cast("timestamp"))
    fin = F.when(F.col("event_id") % 7 != 0, F.timestamp_micros(F.unix_micros("started") + F.round(F.col("value") * 1000000).cast("long")))
    out = emit.lane_clock(e.withColumn("finished", fin), "event_type", "2024-02-01 00:00:00")
    return out.withColumn("seconds", F.round("seconds", 3)).withColumn("last_end", F.col("last_end").cast("timestamp_ntz"))


@query(rel.MACHINE_SQL + """SELECT repo, project, phase, rank, nth, status, reason, blame AS owner, used AS seconds FROM m WHERE pos >= 0
 UNION ALL SELECT repo, project, phase, rank, nth, 'skipped_budget', 'project_cap_reached', 'runner', 0 FROM e WHERE rank > 8""", prefix=False)
def phase_machine(spark, sf):
    return machine.run_phases(rel.probed_projects(spark, sf), rel.probe_records(spark, sf), machine.plan_table(spark))


# ------------------------------------------------------------------ runtime
@query("SELECT o_custkey AS repo, o_orderstatus AS lane, arg_min(o_orderpriority, o_orderpriority||lpad(o_orderkey::VARCHAR,12,'0')) AS spec, min(o_orderpriority) AS priority FROM orders GROUP BY 1,2", prefix=False)
def lane_precedence(spark, sf):
    o = rel.table(spark, sf, "orders")
    d = o.select(F.col("o_custkey").alias("repo"), F.col("o_orderstatus").alias("lane"), F.col("o_orderpriority").alias("spec"), F.col("o_orderpriority").alias("priority"))
    return runtime.first_of_lane(d).select("repo", "lane", "spec", "priority")


# ------------------------------------------------------- classes and census
@query("""SELECT user_id, total, CASE WHEN total<0.5 THEN 0 WHEN total<3 THEN 1 WHEN total<7 THEN 2 WHEN total<14 THEN 3 WHEN total<28 THEN 4 WHEN total<55 THEN 5 ELSE 6 END AS depth FROM (SELECT user_id, round(sum(n*CASE kind WHEN 'purchase' THEN 1.5 WHEN 'signup' THEN 1.0 WHEN 'error' THEN 0.25 ELSE 0 END)::DOUBLE + 0.4::DOUBLE*least(sum(wt),sum(rp)),6) AS total FROM (SELECT user_id, event_type AS kind, count(*) AS n, count(*) FILTER (value>50) AS wt, count(*) FILTER (value<20) AS rp FROM events GROUP BY 1,2) GROUP BY user_id)""", prefix=False)
def census_totals(spark, sf):
    e = rel.table(spark, sf, "events")
    c = e.groupBy("user_id", F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.sum((F.col("value") > 50).cast("int")).alias("with_test"), F.sum((F.col("value") < 20).cast("int")).alias("repairs"))
    return census.weighted_total(c, "user_id", {"purchase": 1.5, "signup": 1.0, "error": 0.25}).withColumn("total", F.round("total", 6))


@query("SELECT user_id, count(*) FILTER (event_type='click') AS click, count(*) FILTER (event_type='purchase') AS purchase, count(*) FILTER (event_type='refund') AS refund FROM events GROUP BY user_id", prefix=False)
def type_counts(spark, sf):
    return census.type_counts(rel.table(spark, sf, "events"), "user_id", "event_type", ["click", "purchase", "refund"])


@query("SELECT c_custkey, CASE WHEN n IS NOT NULL THEN n END AS n, CASE WHEN n IS NULL THEN 'not_measured' END AS reason FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus='F' GROUP BY 1) ON c_custkey=o_custkey", prefix=False)
def null_not_zero(spark, sf):
    got = rel.table(spark, sf, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return census.block(rel.table(spark, sf, "customer").select("c_custkey"), got, "c_custkey", ["n"])


# --------------------------------------------------------------------- emit
@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN value>200 THEN 'timed_out' WHEN event_type<>'view' AND value<1 THEN 'unavailable' WHEN event_type='view' THEN 'skipped' ELSE 'measured' END AS status FROM events) GROUP BY status", prefix=False)
def row_status(spark, sf):
    e = rel.table(spark, sf, "events")
    s = scores.row_status(F.col("value") > 200, F.col("value") >= 1, F.col("event_type") != "view")
    return e.groupBy(s.alias("status")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_name, CASE WHEN c_acctbal>0 THEN 'true' ELSE 'false' END AS positive, CASE WHEN c_nationkey%2=0 THEN c_mktsegment ELSE '' END AS segment, '['||c_nationkey||','||(c_nationkey+1)||']' AS nations FROM customer", prefix=False)
def csv_cells(spark, sf):
    c = rel.table(spark, sf, "customer")
    return emit.csv_row(c.select("c_custkey", "c_name", (F.col("c_acctbal") > 0).alias("positive"), F.when(F.col("c_nationkey") % 2 == 0, F.col("c_mktsegment")).alias("segment"), F.array("c_nationkey", F.col("c_nationkey") + 1).alias("nations")))


# --------------------------------------------------------- joins and sets
@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus='F')", prefix=False)
def anti_join(spark, sf):
    o = rel.table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return rel.table(spark, sf, "customer").join(o, "c_custkey", "left_anti").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice>400000)", prefix=False)
def semi_join(spark, sf):
    o = rel.table(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return rel.table(spark, sf, "customer").join(o, "c_custkey", "left_semi").select("c_custkey")


@query("""SELECT o_custkey, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ',') AS seen, array_to_string(list_sort(list_distinct(list_filter(['1-URGENT','3-MEDIUM'], lambda x: list_contains(list(o_orderpriority), x)))), ',') AS marked, len(list_filter(['1-URGENT','2-HIGH'], lambda x: NOT list_contains(list(o_orderpriority), x)))=0 AS has_both FROM orders GROUP BY o_custkey""", prefix=False)
def set_algebra(spark, sf):
    g = rel.table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("s"))
    lit = lambda *x: F.array(*map(F.lit, x))
    return g.select("o_custkey", F.array_join("s", ",").alias("seen"), F.array_join(F.array_sort(F.array_intersect("s", lit("1-URGENT", "3-MEDIUM"))), ",").alias("marked"), (F.size(F.array_except(lit("1-URGENT", "2-HIGH"), "s")) == 0).alias("has_both"))


# ----------------------------------------------------------------- verdicts
@query("""SELECT o_custkey, coalesce(judged, fallback) AS ref, n AS candidates, CASE WHEN judged IS NULL THEN 'deterministic' ELSE 'agentic' END AS mode, coalesce(judged<>fallback, false) AS overrode FROM (
 SELECT o_custkey, max(ref) FILTER (r=1) AS fallback, max(ref) FILTER (idx=i) AS judged, max(n) AS n FROM (SELECT *, CASE WHEN choice IS NOT NULL THEN greatest(0, least(n-1, choice)) END AS i FROM (
 SELECT o_custkey, o_orderpriority AS ref, c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority)-1 AS idx, row_number() OVER (PARTITION BY o_custkey ORDER BY c DESC, o_orderpriority) AS r, count(*) OVER (PARTITION BY o_custkey) AS n, CASE WHEN o_custkey%3=0 THEN NULL ELSE o_custkey%7-1 END AS choice FROM (SELECT o_custkey, o_orderpriority, count(*) AS c FROM orders GROUP BY 1,2))) GROUP BY o_custkey)""", prefix=False)
def ref_choice(spark, sf):
    c = rel.table(spark, sf, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("ref")).agg(F.count("*").alias("commits"))
    c = c.withColumn("idx", F.row_number().over(Window.partitionBy("o_custkey").orderBy("ref")) - 1)
    a = rel.table(spark, sf, "orders").select("o_custkey").distinct().withColumn("choice", F.when(F.col("o_custkey") % 3 == 0, "none").otherwise((F.col("o_custkey") % 7 - 1).cast("string")))
    return verdicts.choose_ref(c, a, "o_custkey")


@query("SELECT s_suppkey, CASE WHEN s_acctbal<0 THEN NULL ELSE s_nationkey END AS s_nationkey, s_nationkey AS s_nationkey_deterministic FROM supplier", prefix=False)
def verdict_withdrawal(spark, sf):
    s = rel.table(spark, sf, "supplier")
    return verdicts.withdraw(s.select("s_suppkey", "s_nationkey", "s_acctbal"), F.col("s_acctbal") < 0, ["s_nationkey"]).drop("s_acctbal")


@query("""SELECT user_id, 'full' AS requested, CASE WHEN f IS NOT NULL THEN 'full' WHEN d IS NOT NULL THEN 'discover' END AS actual, coalesce(f, d) AS value FROM (
 SELECT user_id, max(k) FILTER (event_type='purchase' AND value>60) AS f, max(k) FILTER (event_type='click' AND value>20) AS d FROM (SELECT *, event_id AS k FROM events) GROUP BY user_id)""", prefix=False)
def level_fallback(spark, sf):
    e, t, v = rel.table(spark, sf, "events"), F.col("event_type"), F.col("value")
    best = lambda cond: F.max(F.when(cond, F.col("event_id")))
    both = e.groupBy("user_id").agg(best((t == "purchase") & (v > 60)).alias("full"), best((t == "click") & (v > 20)).alias("discover"))
    return verdicts.attempt(both.unpivot("user_id", ["full", "discover"], "level", "value"), "user_id", ["full", "discover"], "value")


@query("SELECT state, count(*) AS n, count(k) AS counted FROM (SELECT CASE WHEN event_type='view' THEN 'skipped' WHEN value>10 THEN 'scored' ELSE 'unavailable' END AS state, CASE WHEN event_type<>'view' AND value>10 THEN user_id END AS k FROM events) GROUP BY state", prefix=False)
def judged_blocks(spark, sf):
    e = rel.table(spark, sf, "events")
    b = verdicts.judged_block(e, "event_id", F.col("event_type") != "view", F.col("value") > 10, ["user_id"])
    return b.groupBy("state").agg(F.count("*").alias("n"), F.count("user_id").alias("counted"))


@query("SELECT o_custkey, array_to_string(list(o_orderkey ORDER BY o_orderkey)[1:5], ',') AS items, greatest(count(*)-5, 0) AS overflow FROM orders GROUP BY o_custkey", prefix=False)
def capped_lists(spark, sf):
    out = verdicts.capped_list(rel.table(spark, sf, "orders"), "o_custkey", ["o_orderkey"], "o_orderkey", 5)
    return out.select("o_custkey", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"), "overflow")


@query("SELECT c_custkey, coalesce(orders, 0) AS orders, price FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS orders, max(o_totalprice) AS price FROM orders GROUP BY 1) ON c_custkey=o_custkey", prefix=False)
def left_lane_join(spark, sf):
    o = rel.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.max("o_totalprice").alias("price"))
    return rel.table(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), "price")


@query("SELECT p_brand, sum(CASE WHEN p_type='PROMO' THEN p_size ELSE 0 END)::BIGINT AS PROMO, sum(CASE WHEN p_type='SMALL' THEN p_size ELSE 0 END)::BIGINT AS SMALL, sum(CASE WHEN p_type='LARGE' THEN p_size ELSE 0 END)::BIGINT AS LARGE FROM part GROUP BY p_brand", prefix=False)
def type_pivot(spark, sf):
    p = rel.table(spark, sf, "part")
    return p.groupBy("p_brand").pivot("p_type", ["PROMO", "SMALL", "LARGE"]).agg(F.sum("p_size")).fillna(0)


@query("SELECT ext, count(*) AS files, sum(size)::BIGINT AS bytes FROM (SELECT p_brand AS ext, p_size AS size FROM part WHERE p_brand NOT IN ('Brand#1','Brand#2')) GROUP BY ext ORDER BY files DESC, ext LIMIT 500", prefix=False)
def unmapped_extensions(spark, sf):
    p = rel.table(spark, sf, "part").select(F.col("p_brand").alias("ext"), F.col("p_size").alias("size"))
    return tree.unmapped_extensions(p, ["Brand#1", "Brand#2"])


@query("SELECT action, count(*) AS n FROM (SELECT CASE event_type WHEN 'purchase' THEN 'pass' WHEN 'error' THEN 'fail' WHEN 'view' THEN 'skip' END AS action FROM events) WHERE action IS NOT NULL GROUP BY action", prefix=False)
def test_events(spark, sf):
    t = F.col("event_type")
    action = F.when(t == "purchase", "pass").when(t == "error", "fail").when(t == "view", "skip").otherwise("run")
    lines = rel.table(spark, sf, "events").select(F.to_json(F.struct(action.alias("Action"), F.concat(F.lit("T"), F.col("event_id")).alias("Test"))).alias("line"))
    return projects.go_events(lines)


@query("SELECT project, count(*) FILTER (NOT after_repair AND status='ok') AS shipped_ok, count(*) FILTER (status='ok') AS repaired_ok FROM (SELECT *, phase%3=0 AS after_repair FROM phases) GROUP BY project")
def shipped_and_repaired(spark, sf):
    p = rel.phases(spark, sf).withColumn("after_repair", F.col("phase") % 3 == 0)
    n = lambda c: F.sum(F.coalesce((c == "ok").cast("int"), F.lit(0)))
    both = projects.as_shipped(p.withColumn("any", F.col("status")))
    return both.groupBy("project").agg(n(F.col("status")).alias("shipped_ok"), n(F.col("any")).alias("repaired_ok"))


from . import repo_catalog  # noqa: E402,F401  (registers the queries over trees, logs and sentences)
