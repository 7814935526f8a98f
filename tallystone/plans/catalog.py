"""The registered queries: every operator on an analogous relation of the driver's tables, with DuckDB SQL beside it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rates, text
from ..operators import facts, graph, judge, metrics, modules, sast, sast_rules
from ..sources import tree
from . import analysis, fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as source files: source is the project, id the path, lang the language."""
    return t(spark, sf_dir, "documents").select(F.col("source").alias("project_id"), F.col("doc_id").alias("path"), F.col("text").alias("content"), "lang")


LINES_SQL = "(SELECT source AS project_id, doc_id AS path, lang, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents)"

# --- lines, sizes, names ----------------------------------------------------------------------


@query(f"SELECT project_id, count(*) AS n_lines, count(*) FILTER (WHERE trim(text) <> '') AS n_nonblank, max(line_no)::BIGINT AS longest FROM {LINES_SQL} GROUP BY 1")
def lines_explode(spark, sf_dir):
    rows = text.lines(documents(spark, sf_dir), ["project_id", "path"])
    return rows.groupBy("project_id").agg(F.count("*").alias("n_lines"), F.count_if(F.trim("text") != "").alias("n_nonblank"), F.max("line_no").cast("long").alias("longest"))


@query(f"""SELECT project_id, round(count(*) FILTER (WHERE s <> '' AND NOT (starts_with(s,'#') OR starts_with(s,'//') OR starts_with(s,'/*') OR starts_with(s,'*'))) / 1000.0, 6) AS kloc1,
 round(count(*) FILTER (WHERE s <> '' AND NOT (starts_with(s,'#') OR starts_with(s,'//'))) / 1000.0, 6) AS kloc2, round(count(*) / 1000.0, 6) AS kloc3, round(count(*) FILTER (WHERE s <> '') / 1000.0, 6) AS kloc4
 FROM (SELECT project_id, trim(text) AS s FROM {LINES_SQL}) GROUP BY 1""")
def kloc_by_project(spark, sf_dir):
    rows = text.lines(documents(spark, sf_dir), ["project_id"])
    return rows.groupBy("project_id").agg(*[F.round(F.count_if(text.code_lines(F.col("text"), v)) / 1000.0, 6).alias(f"kloc{v}") for v in (1, 2, 3, 4)])


PATH_SQL = "regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '[?#].*$', '')"
HOST_SQL = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"


@query(f"""SELECT CASE regexp_extract(p, '(\\.[A-Za-z0-9]+)$', 1) WHEN '.html' THEN 'markup' WHEN '.php' THEN 'php' WHEN '' THEN 'none' ELSE 'other' END AS language, count(*) AS n
 FROM (SELECT {PATH_SQL} AS p FROM pages) GROUP BY 1""")
def lang_detect(spark, sf_dir):
    ext = text.path_extension(text.url_path(F.col("url")))
    lang = F.when(ext == ".html", "markup").when(ext == ".php", "php").when(ext == "", "none").otherwise("other")
    return t(spark, sf_dir, "pages").groupBy(lang.alias("language")).agg(F.count("*").alias("n"))


@query(f"SELECT page_id, p AS path FROM (SELECT page_id, {PATH_SQL} AS p FROM pages) WHERE NOT list_has_any(string_split(p, '/'), ['fr', 'es', 'build'])")
def skip_filter(spark, sf_dir):
    rows = t(spark, sf_dir, "pages").select("page_id", text.url_path(F.col("url")).alias("path"))
    return rows.where(~F.arrays_overlap(F.split("path", "/", -1), F.array(*map(F.lit, ("fr", "es", "build")))))


@query(f"""SELECT project_id, k AS key, count(*) AS n, min(v) AS first_value FROM (SELECT project_id, trim(split_part(m, '=', 1)) AS k, trim(trim(substr(m, strpos(m, '=') + 1)), '"') AS v
 FROM (SELECT project_id, regexp_extract(text, '([a-z_]+ = "[^"]*")', 1) AS m FROM {LINES_SQL}) WHERE m <> '') GROUP BY 1, 2""")
def env_parse(spark, sf_dir):
    rows = text.lines(documents(spark, sf_dir), ["project_id"]).select("project_id", F.regexp_extract("text", '([a-z_]+ = "[^"]*")', 1).alias("m")).where("m <> ''")
    key = F.trim(F.substring_index("m", "=", 1))
    value = F.trim(F.trim(F.expr("substring(m, instr(m, '=') + 1)")), F.lit('"'))
    return rows.groupBy("project_id", key.alias("key")).agg(F.count("*").alias("n"), F.min(value).alias("first_value"))


@query("SELECT event_type, 'props.k' AS key, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total FROM events GROUP BY 1")
def json_flatten(spark, sf_dir):
    rows = t(spark, sf_dir, "events").select("event_type", F.explode(F.from_json("props", "map<string,string>")).alias("k", "v"))
    return rows.groupBy("event_type", F.concat(F.lit("props."), F.col("k")).alias("key")).agg(F.count("*").alias("n"), F.sum(F.col("v").cast("long")).alias("total"))


@query("""SELECT kind, internal, count(*) AS n FROM (SELECT 'page' AS kind, url AS u FROM pages UNION ALL SELECT 'href', unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) FROM pages) x,
 LATERAL (SELECT CASE WHEN regexp_matches(u, '^https?://') THEN regexp_replace(regexp_extract(u, '^https?://([^/?#]*)', 1), ':[0-9]+$', '') IN ('localhost','127.0.0.1','0.0.0.0') OR regexp_matches(regexp_extract(u, '^https?://([^/?#]*)', 1), '[$\\{]')
 ELSE (starts_with(u, '/') AND NOT starts_with(u, '//')) OR regexp_matches(u, '^[$\\{]') OR contains(u, '/') END AS internal) GROUP BY 1, 2""")
def url_internal(spark, sf_dir):
    pages = t(spark, sf_dir, "pages")
    urls = pages.select(F.lit("page").alias("kind"), F.col("url").alias("u")).unionByName(pages.select(F.lit("href").alias("kind"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("u")))
    return urls.groupBy("kind", text.is_internal_url(F.col("u")).alias("internal")).agg(F.count("*").alias("n"))


@query(f"""SELECT template, count(*) AS n, bool_and(regexp_matches(p, '^' || replace(regexp_replace(template, '/$', ''), '{{id}}', '[^/]+') || '/?$')) AS matches_own
 FROM (SELECT p, regexp_replace(regexp_replace(p, '\\.html$', ''), '[0-9]+', '{{id}}', 'g') AS template FROM (SELECT regexp_replace({PATH_SQL}, '\\.html$', '') AS p FROM pages)) GROUP BY 1""")
def endpoint_regex(spark, sf_dir):
    p = F.regexp_replace(text.url_path(F.col("url")), r"\.html$", "")
    rows = t(spark, sf_dir, "pages").select(p.alias("p"), F.regexp_replace(p, "[0-9]+", "{id}").alias("template"))
    return rows.withColumn("r", text.template_regex(F.col("template"))).groupBy("template").agg(F.count("*").alias("n"), F.bool_and(F.expr("p rlike r")).alias("matches_own"))


# --- consistency metrics ----------------------------------------------------------------------


@query(f"""WITH c AS (SELECT {HOST_SQL} AS project_id, page_id, {PATH_SQL} AS p FROM pages),
 e AS (SELECT DISTINCT project_id, regexp_replace(p, '[0-9]+', '{{id}}', 'g') AS tpl FROM c WHERE page_id % 2 = 0)
 SELECT project_id, count(*) AS calls, count(*) FILTER (WHERE hit) AS matched, round(count(*) FILTER (WHERE hit) / (count(*) + 1.0), 6) AS icr
 FROM (SELECT c.project_id, EXISTS (SELECT 1 FROM e WHERE e.project_id = c.project_id AND regexp_matches(c.p, '^' || replace(replace(regexp_replace(tpl, '/$', ''), '.', '\\.'), '{{id}}', '[^/]+') || '/?$')) AS hit FROM c WHERE page_id % 2 = 1) GROUP BY 1""")
def icr(spark, sf_dir):
    pages = t(spark, sf_dir, "pages").select(text.url_host(F.col("url")).alias("project_id"), "page_id", text.url_path(F.col("url")).alias("path"))
    calls = pages.where("page_id % 2 = 1").select("project_id", F.monotonically_increasing_id().alias("call_id"), F.lit("GET").alias("method"), "path")
    ends = pages.where("page_id % 2 = 0").select("project_id", F.lit("GET").alias("method"), F.regexp_replace("path", "[0-9]+", "{id}").alias("route")).distinct()
    return metrics.interface_consistency(calls, ends)


REFS_SQL = "(SELECT p_brand AS project_id, CASE WHEN p_size % 3 = 0 THEN lower(replace(p_type, ' ', '-')) WHEN p_size % 3 = 1 THEN upper(replace(p_type, ' ', '_')) ELSE 'REACT_APP_' || upper(replace(p_type, ' ', '_')) END AS key FROM part)"
DEFS_SQL = "(SELECT DISTINCT upper(replace(p_type, ' ', '_')) AS key FROM part WHERE p_size % 2 = 0)"


def config_refs(spark, sf_dir):
    snake = F.upper(F.replace("p_type", F.lit(" "), F.lit("_")))
    key = F.when(F.col("p_size") % 3 == 0, F.lower(F.replace("p_type", F.lit(" "), F.lit("-")))).when(F.col("p_size") % 3 == 1, snake).otherwise(F.concat(F.lit("REACT_APP_"), snake))
    part = t(spark, sf_dir, "part")
    return part.select(F.col("p_brand").alias("project_id"), key.alias("key")), part.where("p_size % 2 = 0").select(snake.alias("key")).distinct()


@query(f"SELECT project_id, count(*) AS refs, count(*) FILTER (WHERE key IN (SELECT key FROM {DEFS_SQL})) AS defined, round(count(*) FILTER (WHERE key IN (SELECT key FROM {DEFS_SQL})) / (count(*) + 1.0), 6) AS ccs FROM {REFS_SQL} GROUP BY 1")
def ccs_exact(spark, sf_dir):
    return metrics.config_consistency(*config_refs(spark, sf_dir), fuzzy=False)


@query(f"""SELECT project_id, count(*) AS refs, count(*) FILTER (WHERE ok) AS defined, round(count(*) FILTER (WHERE ok) / (count(*) + 1.0), 6) AS ccs FROM (SELECT project_id,
 regexp_replace(upper(replace(key, '-', '_')), '^(REACT_APP_|NEXT_PUBLIC_|VITE_|VUE_APP_)', '') IN (SELECT key FROM {DEFS_SQL}) OR upper(replace(key, '-', '_')) IN (SELECT key FROM {DEFS_SQL}) AS ok FROM {REFS_SQL}) GROUP BY 1""")
def ccs_fuzzy(spark, sf_dir):
    return metrics.config_consistency(*config_refs(spark, sf_dir), fuzzy=True)


@query("""SELECT o_orderstatus AS project_id, count(*) AS refs, count(*) FILTER (WHERE c_custkey IS NULL) AS unresolved, round(count(*) FILTER (WHERE c_custkey IS NULL) / (count(*) + 1.0), 6) AS urr
 FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING') ON o_custkey = c_custkey GROUP BY 1""")
def urr(spark, sf_dir):
    refs = t(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("project_id"), F.col("o_custkey").alias("module"))
    return metrics.unresolved_references(refs, t(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("module")))


@query("""WITH u AS (SELECT DISTINCT l_returnflag AS project_id, l_partkey AS name FROM lineitem), s AS (SELECT l_returnflag AS project_id, count(*) AS lines FROM lineitem GROUP BY 1)
 SELECT project_id, max(lines)::BIGINT AS lines, count(*) AS packages, count(*) FILTER (WHERE p_partkey IS NULL) AS missing, round(count(*) FILTER (WHERE p_partkey IS NULL) * 1000.0 / max(lines), 6) AS hd
 FROM u JOIN s USING (project_id) LEFT JOIN (SELECT p_partkey FROM part WHERE p_size <= 45) ON name = p_partkey GROUP BY 1""")
def hd(spark, sf_dir):
    items = t(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("project_id"), F.col("l_partkey").alias("name"))
    return metrics.missing_packages(items, items.groupBy("project_id").agg(F.count("*").alias("lines")), t(spark, sf_dir, "part").where("p_size <= 45").select(F.col("p_partkey").alias("name")))


@query("SELECT DISTINCT l_suppkey AS name FROM lineitem WHERE l_quantity > 49 AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def deps_anti(spark, sf_dir):
    used = t(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("name"))
    return used.join(t(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("name")), "name", "left_anti").distinct()


WORDS_SQL = "(SELECT doc_id, source, lang, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS w FROM documents)"


@query(f"SELECT w AS variable, count(DISTINCT source) AS systems, count(*) AS mentions FROM {WORDS_SQL} WHERE w NOT IN (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{{4,}}')) FROM benchmark) GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 15")
def env_missing_top15(spark, sf_dir):
    words = lambda df, *keep: df.select(*keep, F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), 0)).alias("variable"))
    refs = words(t(spark, sf_dir, "documents"), "source").groupBy("variable", "source").agg(F.count("*").alias("n"))
    missing = refs.join(words(t(spark, sf_dir, "benchmark")).distinct(), "variable", "left_anti")
    return missing.groupBy("variable").agg(F.count("*").alias("systems"), F.sum("n").alias("mentions")).orderBy(F.desc("mentions"), "variable").limit(15)


# --- rule scans -------------------------------------------------------------------------------

#: Rules for the driver's documents; both engines read their patterns.
DOC_RULES = [
    sast.Rule("DOC-001", "CWE-798", "CRITICAL", "A07", "Secrets", "Token with 40 hex digits", 'token = "[0-9a-f]{40}"'),
    sast.Rule("DOC-002", "CWE-200", "HIGH", "A02", "Personal data", "E-mail address", r"[a-z0-9.]+@[a-z0-9.]+\.com"),
    sast.Rule("DOC-003", "CWE-200", "MEDIUM", "A05", "Personal data", "IPv4 address", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"),
    sast.Rule("DOC-004", "CWE-1104", "LOW", "A06", "License", "License line", "licen[cs]e|copyright"),
    sast.Rule("DOC-005", "CWE-74", "LOW", "A03", "Junk", "Runs of symbols", r"###|\*\*\*|%%%"),
]
FP_RULES = [sast.Rule(r.id, r.cwe, r.severity, r.owasp, r.category, r.description, r.pattern, false_positive=r"the\.|token") for r in DOC_RULES]


def found_sql(fp: str | None = None, cap: int | None = None) -> str:
    arms = " UNION ALL ".join(
        f"SELECT project_id, path, line_no, '{r.id}' AS rule_id, '{r.severity}' AS severity, '{r.owasp}' AS owasp, '{r.category}' AS category FROM l WHERE trim(text) <> '' AND regexp_matches(text, '(?i){r.pattern}')" + (f" AND NOT regexp_matches(ctx, '(?i){fp}')" if fp else "") for r in DOC_RULES
    )
    ctx = ", string_agg(text, chr(10)) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS ctx" if fp else ""
    body = f"(WITH l AS (SELECT *{ctx} FROM {LINES_SQL}) {arms})"
    return f"(SELECT * FROM {body} QUALIFY row_number() OVER (PARTITION BY project_id, rule_id ORDER BY path, line_no) <= {cap})" if cap else body


def findings(spark, sf_dir, rules=None):
    return sast.scan(documents(spark, sf_dir), rules or DOC_RULES)


@query(f"SELECT project_id, path, line_no::INTEGER AS line_no, rule_id, severity FROM {found_sql()}")
def sast_scan(spark, sf_dir):
    return findings(spark, sf_dir).select("project_id", "path", "line_no", "rule_id", "severity")


@query(f"SELECT project_id, path, line_no::INTEGER AS line_no, rule_id FROM {found_sql(fp='the' + chr(92) + '.|token')}")
def sast_context_fp(spark, sf_dir):
    return findings(spark, sf_dir, FP_RULES).select("project_id", "path", "line_no", "rule_id")


@query(f"SELECT project_id, rule_id, count(*) AS n, max(path) AS last_path FROM {found_sql(cap=2)} GROUP BY 1, 2")
def sast_cap(spark, sf_dir):
    return sast.capped(findings(spark, sf_dir), 2).groupBy("project_id", "rule_id").agg(F.count("*").alias("n"), F.max("path").alias("last_path"))


@query(f"""SELECT s.project_id, s.lines, coalesce(n, 0) AS findings, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low, round(coalesce(n, 0) * 1000.0 / s.lines, 6) AS density
 FROM (SELECT project_id, count(*) AS lines FROM {LINES_SQL} GROUP BY 1) s LEFT JOIN (SELECT project_id, count(*) AS n, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical, count(*) FILTER (WHERE severity = 'HIGH') AS high,
 count(*) FILTER (WHERE severity = 'MEDIUM') AS medium, count(*) FILTER (WHERE severity = 'LOW') AS low FROM {found_sql(cap=50)} GROUP BY 1) f USING (project_id)""")
def sast_summary(spark, sf_dir):
    docs = documents(spark, sf_dir)
    sizes = docs.groupBy("project_id").agg(F.sum(F.size(F.split("content", "\n", -1))).alias("lines"))
    return sast.summary(sast.capped(sast.scan(docs, DOC_RULES), 50), sizes)


@query(f"SELECT owasp, category, severity, count(*) AS n, count(DISTINCT project_id) AS systems FROM {found_sql()} GROUP BY 1, 2, 3")
def owasp_breakdown(spark, sf_dir):
    return findings(spark, sf_dir).groupBy("owasp", "category", "severity").agg(F.count("*").alias("n"), F.countDistinct("project_id").alias("systems"))


@query(f"SELECT rule_id, severity, count(*) AS n FROM {found_sql()} GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 3")
def top_patterns(spark, sf_dir):
    return findings(spark, sf_dir).groupBy("rule_id", "severity").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule_id").limit(3)


# --- boundary checks, composites --------------------------------------------------------------

CHECKS_SQL = """(SELECT project_id, unnest(['has_orders','many_orders','no_failed','priority_mix']) AS name, unnest([n > 0, n > 8, f < n / 2, p >= 4]) AS passed, unnest([TRUE, n > 0, n > 2, n > 4]) AS applicable FROM
 (SELECT c_custkey AS project_id, count(o_orderkey) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(DISTINCT o_orderpriority) AS p FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1))"""


def checks(spark, sf_dir):
    rows = t(spark, sf_dir, "customer").join(t(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy(F.col("c_custkey").alias("project_id"))
    flags = rows.agg(F.count("o_orderkey").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.countDistinct("o_orderpriority").alias("p"))
    return flags.selectExpr("project_id", "stack(4, 'has_orders', n > 0, true, 'many_orders', n > 8, n > 0, 'no_failed', f < n / 2, n > 2, 'priority_mix', p >= 4, n > 4) AS (name, passed, applicable)")


@query(f"SELECT project_id, name, passed, applicable FROM {CHECKS_SQL}")
def boundary_checks(spark, sf_dir):
    return checks(spark, sf_dir)


@query(f"SELECT project_id, count(*) FILTER (WHERE applicable) AS applicable, count(*) FILTER (WHERE applicable AND passed) AS passing, round(CASE WHEN count(*) FILTER (WHERE applicable) = 0 THEN 0 ELSE count(*) FILTER (WHERE applicable AND passed) / count(*) FILTER (WHERE applicable) END, 6)::DOUBLE AS drs FROM {CHECKS_SQL} GROUP BY 1")
def drs(spark, sf_dir):
    return metrics.readiness(checks(spark, sf_dir))


@query(f"SELECT name, count(*) FILTER (WHERE s = 'PASS') AS pass, count(*) FILTER (WHERE s = 'FAIL') AS fail, count(*) FILTER (WHERE s = 'N/A') AS na FROM (SELECT name, CASE WHEN passed THEN 'PASS' WHEN NOT applicable THEN 'N/A' ELSE 'FAIL' END AS s FROM {CHECKS_SQL}) GROUP BY 1")
def check_failure_rates(spark, sf_dir):
    return metrics.check_status(checks(spark, sf_dir))


@query(f"""WITH s AS (SELECT DISTINCT lang AS cohort, source AS pid, w FROM {WORDS_SQL} WHERE length(w) > 9), n AS (SELECT cohort, pid, count(*) AS n FROM s GROUP BY 1, 2),
 p AS (SELECT a.cohort, a.pid AS x, b.pid AS y, a.n + b.n AS both_n FROM n a JOIN n b ON a.cohort = b.cohort AND a.pid < b.pid), i AS (SELECT a.cohort, a.pid AS x, b.pid AS y, count(*) AS k FROM s a JOIN s b ON a.cohort = b.cohort AND a.w = b.w AND a.pid < b.pid GROUP BY 1, 2, 3)
 SELECT p.cohort, count(*) AS pairs, round(avg(coalesce(k, 0) / (both_n - coalesce(k, 0))), 6) AS thi FROM p LEFT JOIN i USING (cohort, x, y) GROUP BY 1""")
def thi(spark, sf_dir):
    words = t(spark, sf_dir, "documents").select(F.col("lang").alias("cohort"), F.col("source").alias("project_id"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), 0))).alias("item")).where(F.length("item") > 9)
    return metrics.homogeneity(words.distinct())


@query("""WITH d AS (SELECT DISTINCT doc_id, w FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS w FROM documents)), b AS (SELECT DISTINCT item_id, w FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS w FROM benchmark)),
 dn AS (SELECT doc_id, count(*) AS n FROM d GROUP BY 1), bn AS (SELECT item_id, count(*) AS n FROM b GROUP BY 1)
 SELECT item_id, doc_id, k AS common, round(k / (dn.n + bn.n - k), 6) AS jaccard FROM (SELECT item_id, doc_id, count(*) AS k FROM d JOIN b USING (w) GROUP BY 1, 2) JOIN dn USING (doc_id) JOIN bn USING (item_id) WHERE k >= 5""")
def abi_jaccard(spark, sf_dir):
    words = lambda name, key: t(spark, sf_dir, name).select(key, F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), 0)).alias("ws")).select(key, F.size("ws").alias(f"n_{key}"), F.explode("ws").alias("w"))
    joined = words("documents", "doc_id").join(words("benchmark", "item_id"), "w").groupBy("item_id", "doc_id", "n_doc_id", "n_item_id").agg(F.count("*").alias("common")).where("common >= 5")
    return joined.select("item_id", "doc_id", "common", F.round(F.col("common") / (F.col("n_doc_id") + F.col("n_item_id") - F.col("common")), 6).alias("jaccard"))


# --- graphs -----------------------------------------------------------------------------------

#: A customer is a project, suppliers are its nodes: a line of an order depends on the next line of that order.
RAW_EDGES_SQL = """(SELECT o_custkey AS project_id, src, dst, CASE WHEN o_orderpriority LIKE '1%' THEN 'STATE' WHEN o_orderpriority LIKE '2%' THEN 'ADDR' ELSE 'RUNTIME' END AS edge_type, o_totalprice > 300000 AS atomic, seq
 FROM (SELECT l_orderkey, l_suppkey AS src, lead(l_suppkey) OVER w AS dst, l_orderkey * 1000 + row_number() OVER w AS seq FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)) JOIN orders ON l_orderkey = o_orderkey WHERE dst IS NOT NULL)"""
EDGES_SQL = f"(SELECT project_id, src, dst, arg_max(edge_type, seq) AS edge_type, arg_max(atomic, seq) AS atomic FROM {RAW_EDGES_SQL} GROUP BY 1, 2, 3)"
SCC_CTE = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {EDGES_SQL}), r AS (SELECT project_id AS p, src AS a, dst AS b FROM e UNION SELECT r.p, r.a, e.dst FROM r JOIN e ON e.project_id = r.p AND r.b = e.src),
 v AS (SELECT project_id AS p, src AS n FROM e UNION SELECT project_id, dst FROM e), m AS (SELECT f.p, f.a, min(f.b) AS low FROM r f JOIN r g ON g.p = f.p AND g.a = f.b AND g.b = f.a GROUP BY 1, 2),
 s AS MATERIALIZED (SELECT v.p AS project_id, v.n AS node, least(v.n, coalesce(m.low, v.n)) AS scc FROM v LEFT JOIN m ON m.p = v.p AND m.a = v.n),
 i AS MATERIALIZED (SELECT e.*, x.scc AS cycle FROM e JOIN s x ON x.project_id = e.project_id AND x.node = e.src JOIN s y ON y.project_id = e.project_id AND y.node = e.dst AND y.scc = x.scc),
 k AS (SELECT project_id, src, dst, bool_or(atomic) AS atomic FROM i WHERE edge_type = 'STATE' GROUP BY 1, 2, 3),
 c AS (SELECT i.project_id, i.cycle, count(DISTINCT i.src) AS n_nodes, count(*) AS n_edges, bool_or(i.edge_type = 'STATE') AS has_state, bool_or(i.edge_type = 'STATE' AND k.src IS NOT NULL AND (k.atomic OR i.atomic)) AS irreparable,
 min(CASE i.edge_type WHEN 'ADDR' THEN 1 WHEN 'STATE' THEN 2 ELSE 0 END)::BIGINT AS min_cost FROM i LEFT JOIN k ON k.project_id = i.project_id AND k.src = i.dst AND k.dst = i.src GROUP BY 1, 2),
 q AS (SELECT DISTINCT project_id FROM e)"""


def edges(spark, sf_dir):
    own = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    line = t(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("src"), F.lead("l_suppkey").over(own).alias("dst"), (F.col("l_orderkey") * 1000 + F.row_number().over(own)).alias("seq")).where("dst is not null")
    rows = line.join(t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    kind = F.when(F.col("o_orderpriority").startswith("1"), "STATE").when(F.col("o_orderpriority").startswith("2"), "ADDR").otherwise("RUNTIME")
    raw = rows.select(F.col("o_custkey").alias("project_id"), "src", "dst", kind.alias("edge_type"), (F.col("o_totalprice") > 300000).alias("atomic"), "seq")
    return graph.edge_map(raw).select("project_id", "src", "dst", "edge_type", "atomic")


@query(f"SELECT project_id, src, dst, edge_type, atomic FROM {EDGES_SQL}")
def ddg_edges(spark, sf_dir):
    return edges(spark, sf_dir)


@query(f"SELECT project_id, count(*) AS n_edges, count(*) FILTER (WHERE edge_type = 'ADDR') AS n_addr, count(*) FILTER (WHERE edge_type = 'STATE') AS n_state, count(*) FILTER (WHERE edge_type = 'RUNTIME') AS n_runtime, count(*) FILTER (WHERE atomic) AS n_atomic, count(*) FILTER (WHERE src = dst) AS n_self FROM {EDGES_SQL} GROUP BY 1")
def ddg_stats(spark, sf_dir):
    return graph.edge_stats(edges(spark, sf_dir))


@query(f"{SCC_CTE} SELECT project_id, node, scc FROM s")
def scc(spark, sf_dir):
    return graph.scc(edges(spark, sf_dir)).select("project_id", "node", "scc")


@query(f"{SCC_CTE} SELECT project_id, cycle, n_nodes, n_edges, has_state, min_cost FROM c")
def cycles(spark, sf_dir):
    return graph.cycles(edges(spark, sf_dir)).select("project_id", "cycle", "n_nodes", "n_edges", "has_state", "min_cost")


@query(f"{SCC_CTE} SELECT project_id, cycle, irreparable FROM c")
def irreparable(spark, sf_dir):
    return graph.cycles(edges(spark, sf_dir)).select("project_id", "cycle", "irreparable")


@query(f"{SCC_CTE} SELECT q.project_id, CASE WHEN count(c.cycle) = 0 THEN 'DEPLOYABLE' WHEN bool_or(irreparable) THEN 'IRREPARABLE' ELSE 'REPAIRABLE' END AS rating, CASE WHEN count(c.cycle) = 0 OR bool_or(irreparable) THEN 'NONE' WHEN bool_or(has_state) THEN 'SDB' ELSE 'DARC' END AS pattern FROM q LEFT JOIN c USING (project_id) GROUP BY 1")
def dfr(spark, sf_dir):
    e = edges(spark, sf_dir)
    return graph.feasibility(e.select("project_id").distinct(), graph.cycles(e)).select("project_id", "rating", "pattern")


@query(f"{SCC_CTE} SELECT q.project_id, count(c.cycle) AS cycles, CASE WHEN count(c.cycle) = 0 THEN 0 WHEN bool_or(irreparable) THEN -1 ELSE sum(min_cost) END::BIGINT AS drd FROM q LEFT JOIN c USING (project_id) GROUP BY 1")
def drd(spark, sf_dir):
    e = edges(spark, sf_dir)
    return graph.feasibility(e.select("project_id").distinct(), graph.cycles(e)).select("project_id", "cycles", "drd")


# --- stages, smells, composites ---------------------------------------------------------------


@query("""SELECT o_orderpriority AS project_id, first_failed::INTEGER AS stage, count(*) AS n FROM (SELECT o_orderpriority, CASE WHEN NOT o_totalprice > 20000 THEN 0 WHEN NOT o_orderstatus <> 'P' THEN 1 WHEN NOT o_custkey % 2 = 0 THEN 2 WHEN NOT o_totalprice < 400000 THEN 3 ELSE 10 END AS first_failed FROM orders) GROUP BY 1, 2""")
def illusion_depth(spark, sf_dir):
    stages = [F.col("o_totalprice") > 20000, F.col("o_orderstatus") != "P", F.col("o_custkey") % 2 == 0, F.col("o_totalprice") < 400000]
    return t(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("project_id"), metrics.first_failed_stage(stages).alias("stage")).agg(F.count("*").alias("n"))


@query(f"""SELECT project_id, count(*) FILTER (WHERE length(text) > 120) AS low, count(*) FILTER (WHERE regexp_matches(text, '(?i)\\b(todo|fixme|xxx|hack)\\b')) AS info, round(count(*) FILTER (WHERE length(text) > 120 OR regexp_matches(text, '(?i)\\b(todo|fixme|xxx|hack)\\b')) * 1000.0 / count(*) FILTER (WHERE trim(text) <> ''), 6) AS csd FROM {LINES_SQL} GROUP BY 1""")
def csd_by_severity(spark, sf_dir):
    return metrics.smell_density(text.lines(documents(spark, sf_dir), ["project_id"]))


@query("SELECT source AS project_id, round(avg(c), 6) AS ccx, max(c)::BIGINT AS worst, count(*) AS functions, count(*) FILTER (WHERE c > 10) AS above FROM (SELECT source, len(regexp_extract_all(text, '[.!?]( |\\n)')) + 1 AS c FROM documents) GROUP BY 1")
def ccx(spark, sf_dir):
    per = documents(spark, sf_dir).select("project_id", (F.size(F.regexp_extract_all("content", F.lit("[.!?]( |\n)"), 0)) + 1).alias("complexity"))
    return metrics.complexity(per)


LEVELS_SQL = """(SELECT source AS project_id, avg(n_chars) / 10000.0 AS l1, CASE WHEN source LIKE '%1' THEN NULL ELSE count(*) FILTER (WHERE lang = 'en') / count(*) END AS l2, CASE WHEN source LIKE '%2%' THEN NULL ELSE count(*) FILTER (WHERE lang = 'fr') / count(*) END AS l3 FROM documents GROUP BY 1)"""


def levels(spark, sf_dir):
    share = lambda lang, unmeasured: F.when(~F.col("source").like(unmeasured), F.count_if(F.col("lang") == lang) / F.count("*"))
    return t(spark, sf_dir, "documents").groupBy("source").agg((F.avg("n_chars") / 10000).alias("l1"), share("en", "%1").alias("l2"), share("fr", "%2%").alias("l3")).withColumnRenamed("source", "project_id")


@query(f"SELECT project_id, round(1 - (1 - least(greatest(l1, 0), 1)) * (1 - coalesce(least(greatest(l2, 0), 1), 0)) * (1 - coalesce(least(greatest(l3, 0), 1), 0)), 6) AS acds FROM {LEVELS_SQL}")
def acds(spark, sf_dir):
    return metrics.composite(levels(spark, sf_dir), ["l1", "l2", "l3"]).select("project_id", "acds")


@query(f"SELECT project_id, (l1 IS NOT NULL)::INTEGER + (l2 IS NOT NULL)::INTEGER + (l3 IS NOT NULL)::INTEGER AS measured, concat_ws(',', CASE WHEN l1 IS NULL THEN 'l1' END, CASE WHEN l2 IS NULL THEN 'l2' END, CASE WHEN l3 IS NULL THEN 'l3' END) AS unmeasured FROM {LEVELS_SQL}")
def levels_unmeasured(spark, sf_dir):
    return metrics.composite(levels(spark, sf_dir), ["l1", "l2", "l3"]).select("project_id", "measured", "unmeasured")


@query("SELECT source AS project_id, issues, count(*) AS n, bool_and(issues = 0) AS viable FROM (SELECT source, (n_chars < 200)::INTEGER + (n_chars > 5000)::INTEGER + (lang <> 'en')::INTEGER + contains(text, '***')::INTEGER AS issues FROM documents) GROUP BY 1, 2")
def dapp_composite(spark, sf_dir):
    flags = [F.col("n_chars") < 200, F.col("n_chars") > 5000, F.col("lang") != "en", F.col("text").contains("***")]
    return t(spark, sf_dir, "documents").select(F.col("source").alias("project_id"), metrics.issue_count(flags).alias("issues")).groupBy("project_id", "issues").agg(F.count("*").alias("n"), F.bool_and(F.col("issues") == 0).alias("viable"))


@query("SELECT issues, count(*) AS n FROM (SELECT (n_chars < 200)::INTEGER + (n_chars > 5000)::INTEGER + (lang <> 'en')::INTEGER AS issues FROM documents) GROUP BY 1")
def issue_histogram(spark, sf_dir):
    flags = [F.col("n_chars") < 200, F.col("n_chars") > 5000, F.col("lang") != "en"]
    return t(spark, sf_dir, "documents").groupBy(metrics.issue_count(flags).alias("issues")).agg(F.count("*").alias("n"))


# --- judge ------------------------------------------------------------------------------------

#: Answers made of events: a metric by kind of event, a score that may lie outside the bands, in a block, in prose or missing.
METRIC_SQL = "CASE event_type WHEN 'error' THEN 'deployment_risk' WHEN 'signup' THEN 'ownership_void' WHEN 'purchase' THEN 'defect_density' WHEN 'click' THEN 'vulnerability_density' ELSE 'specification_alignment' END"
JUDGE_SQL = f"""(SELECT {METRIC_SQL} AS metric, CASE WHEN event_id % 5 = 4 THEN 3.0 ELSE least(greatest(round_even(k / 10.0 - 1, 0), 1), 5) END AS score, event_id % 5 <> 4 AS parsed,
 CASE WHEN event_id % 5 = 4 OR event_id % 5 = 1 THEN 'low' ELSE 'high' END AS confidence, k FROM (SELECT event_id, event_type, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events))"""


def answers(spark, sf_dir):
    """The events as a model's answers: blocks, prose before and after, two objects, a wrong confidence, nothing usable."""
    k, kind = F.get_json_object("props", "$.k"), F.col("event_id") % 5
    body = lambda sure: F.concat(F.lit('{"score": "'), (k.cast("double") / 10 - 1).cast("string"), F.lit(f'", "confidence": "{sure}", "evidence": ["a {{b}}"], "reasoning": "r"}}'))
    raw = F.when(kind == 0, F.concat(F.lit("Well:\n```json\n"), body("high"), F.lit("\n``` done"))).when(kind == 1, body("certain")).when(kind == 2, F.concat(F.lit("I say "), body("high"), F.lit(' and {"score": 1}'))).when(kind == 3, F.concat(F.lit("```\n"), body("high"), F.lit("\n```"))).otherwise(F.lit("no {score here"))
    metric = F.when(F.col("event_type") == "error", "deployment_risk").when(F.col("event_type") == "signup", "ownership_void").when(F.col("event_type") == "purchase", "defect_density").when(F.col("event_type") == "click", "vulnerability_density").otherwise("specification_alignment")
    return t(spark, sf_dir, "events").select("event_id", metric.alias("metric"), k.cast("double").alias("k"), raw.alias("raw"))


@query(f"SELECT metric, confidence, count(*) AS runs, count(*) FILTER (WHERE parsed) AS parsed, round(avg(score), 6) AS mean FROM {JUDGE_SQL} GROUP BY 1, 2")
def judge_parse(spark, sf_dir):
    rows = judge.parse_answers(answers(spark, sf_dir))
    return rows.groupBy("metric", "confidence").agg(F.count("*").alias("runs"), F.count_if("parsed").alias("parsed"), F.round(F.avg("score"), 6).alias("mean"))


BANDS_SQL = "CASE metric " + " ".join(f"WHEN '{m}' THEN [{', '.join(map(str, b))}]" for m, b in judge.BANDS.items()) + " END"


@query(f"SELECT metric, score, ({BANDS_SQL})[score::INTEGER] AS native FROM (SELECT metric, round_even(avg(score), 0) AS score FROM {JUDGE_SQL} GROUP BY 1)")
def judge_native(spark, sf_dir):
    rows = judge.parse_answers(answers(spark, sf_dir))
    means = rows.groupBy("metric").agg(F.bround(F.avg("score"), 0).alias("score"))
    return means.join(judge.native_scores(rows, judge.ORDINAL).withColumnRenamed("score", "native"), "metric")


@query(f"""SELECT metric, shape, CASE WHEN bool_or(b) AND bool_or(n) THEN NULL WHEN bool_or(b) THEN 'ordinal' WHEN bool_or(n) THEN 'native' END AS scale, coalesce(bool_or(b) AND bool_or(n), FALSE) AS conflict
 FROM (SELECT metric, shape, x > c AS b, x <= c AND x > 5 AS n FROM (SELECT metric, shape, CASE shape WHEN 0 THEN k / 100 WHEN 1 THEN score ELSE k / 50 END AS x, CASE metric WHEN 'deployment_risk' THEN 1 WHEN 'specification_alignment' THEN 1 WHEN 'ownership_void' THEN 100 ELSE 1e308 END AS c
 FROM {JUDGE_SQL}, (SELECT unnest([0, 1, 2]) AS shape))) GROUP BY 1, 2""")
def judge_scale(spark, sf_dir):
    rows = judge.parse_answers(answers(spark, sf_dir))
    shapes = F.explode(F.array(*[F.struct(F.lit(i).alias("shape"), x.alias("score")) for i, x in enumerate((F.col("k") / 100, F.col("score"), F.col("k") / 50))]))
    return judge.scale_of(rows.select("metric", shapes.alias("x")).select("metric", "x.*"), ["metric", "shape"])


@query("""SELECT source AS project_id, count(*) AS files, sum(least(b, 50000 - before))::BIGINT AS bytes FROM (SELECT source, octet_length(encode(text)) AS b, sum(octet_length(encode(text))) OVER (PARTITION BY source ORDER BY octet_length(encode(text)) DESC, doc_id) - octet_length(encode(text)) AS before FROM documents) WHERE before < 50000 GROUP BY 1""")
def source_sampler(spark, sf_dir):
    files = documents(spark, sf_dir).withColumn("bytes", F.octet_length("content").cast("long"))
    return metrics.byte_budget(files, 50_000).groupBy("project_id").agg(F.count("*").alias("files"), F.sum("taken").alias("bytes"))


# --- group statistics and samples -------------------------------------------------------------


@query("SELECT source, count(*) AS n, round(avg(n_chars), 6) AS mean, round(median(n_chars), 6) AS median, round(100.0 * avg((n_chars > 2000)::INTEGER), 6) AS pct_high FROM documents GROUP BY 1")
def group_summary(spark, sf_dir):
    out = rates.group_summary(t(spark, sf_dir, "documents"), ["source"], "n_chars", 2000)
    return out.select("source", "n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "pct_high")])


@query("SELECT lang, source, count(*) AS n, round(avg(n_chars), 6) AS mean FROM documents GROUP BY 1, 2")
def domain_breakdown(spark, sf_dir):
    return t(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"))


@query("SELECT source, n_chars AS upper_median FROM (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE r = n // 2 + 1")
def upper_median(spark, sf_dir):
    return rates.upper_median(t(spark, sf_dir, "documents"), ["source"], "n_chars")


@query("""WITH x AS (SELECT n_chars AS v, quality = 1 AS a FROM documents JOIN labels USING (doc_id)), r AS (SELECT a, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS rk FROM x), s AS (SELECT count(*) FILTER (WHERE a) AS n1, count(*) FILTER (WHERE NOT a) AS n2, sum(rk) FILTER (WHERE a) AS r1 FROM r)
 SELECT n1, n2, round(r1 - n1 * (n1 + 1) / 2, 6)::DOUBLE AS u, round(1 - 2 * (r1 - n1 * (n1 + 1) / 2) / (n1 * n2), 6)::DOUBLE AS rank_biserial FROM s""")
def mann_whitney(spark, sf_dir):
    rows = t(spark, sf_dir, "documents").join(t(spark, sf_dir, "labels"), "doc_id")
    return rates.mann_whitney(rows, "n_chars", F.col("quality") == 1).select("n1", "n2", F.round("u", 6).alias("u"), F.round("rank_biserial", 6).alias("rank_biserial"))


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE (r - 1) % 7 = 0 AND r <= 7 * 5")
def step_sample(spark, sf_dir):
    return metrics.step_sample(t(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", 7, 5)


@query("SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 5")
def first_n(spark, sf_dir):
    return metrics.first_n(t(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", 5)


@query("SELECT host, min(page_id) AS page_id, count(*) AS n FROM (SELECT page_id, " + HOST_SQL + " AS host FROM pages) GROUP BY 1")
def dedup_first(spark, sf_dir):
    return t(spark, sf_dir, "pages").groupBy(text.url_host(F.col("url")).alias("host")).agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))


@query("SELECT n_nationkey AS id, 'primary' AS origin FROM nation WHERE n_regionkey = 99 UNION ALL SELECT r_regionkey, 'fallback' FROM region WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_regionkey = 99)")
def union_fallback(spark, sf_dir):
    first = t(spark, sf_dir, "nation").where("n_regionkey = 99").select(F.col("n_nationkey").alias("id"), F.lit("primary").alias("origin"))
    return metrics.union_fallback(first, t(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.lit("fallback").alias("origin")))


# --- source trees (embedded projects; their results are held by tests) --------------------------


@query()
def srctree_scan(spark, sf_dir):
    listed = tree.read_tree(spark, path=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), content="false")
    return tree.analysed(listed).groupBy("project_id", "ext").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@query()
def py_ast_facts(spark, sf_dir):
    return facts.python_facts(fixtures.files(spark))


@query()
def compose_edges(spark, sf_dir):
    return facts.compose_edges(fixtures.files(spark))


@query()
def sast_full_rules(spark, sf_dir):
    return sast.scan(tree.scanned(fixtures.files(spark)), sast_rules.RULES)


@query()
def project_graph(spark, sf_dir):
    return graph.edge_map(modules.all_edges(fixtures.files(spark)))


@query()
def project_checks(spark, sf_dir):
    return analysis.checks(fixtures.files(spark))


@query()
def project_analysis(spark, sf_dir):
    return analysis.analyse(fixtures.files(spark))


@query()
def manifest_packages(spark, sf_dir):
    f = fixtures.files(spark)
    return facts.requirements(f).select("project_id", "name", "version").unionByName(facts.node_packages(f).select("project_id", "name", "version"))
