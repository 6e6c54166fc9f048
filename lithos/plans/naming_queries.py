"""Queries over names, display values and resolution, each beside its equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithos.config import RULES
from lithos.functions import naming
from lithos.functions.scalars import severity_rank
from lithos.operators import resolution, rules
from lithos.plans.bindings import table
from lithos.plans.queries import CATALOG, CHOSEN, FINDINGS, RANK, counts, findings, rule_catalog
from lithos.plans.registry import query

URL_PATH = r"regexp_replace(regexp_replace(url, '^https?://[^/]*/?', ''), '[?#].*$', '')"
HOST = "regexp_extract(url, '^https?://([^/?#]+)', 1)"
NAME = "CASE page_id % 7 WHEN 0 THEN 'API' WHEN 1 THEN 'app.services' WHEN 2 THEN 'x.repo.y' WHEN 3 THEN 'models.page' WHEN 4 THEN 'apis.repository2' WHEN 5 THEN 'a.dao.api' ELSE " + HOST + " END"


def url_path():
    return F.regexp_replace(F.regexp_replace("url", "^https?://[^/]*/?", ""), "[?#].*$", "")


@query("name_layer", f"WITH x AS (SELECT page_id, lower({NAME}) AS n FROM pages) SELECT page_id, CASE " + " ".join(rf"WHEN regexp_matches(n, '(^|[.])({'|'.join(w)})([.]|\z)') THEN {k}" for k, w in naming.LAYER_WORDS.items()) + " END AS layer FROM x")
def name_layer(spark, d):
    return table(spark, d, "pages").select("page_id", naming.layer(F.expr(NAME)).alias("layer"))


@query("node_module", rf"WITH x AS (SELECT page_id, list_filter(string_split(regexp_replace(CASE WHEN page_id % 2 = 0 THEN 'src/' ELSE '' END || {URL_PATH}, '^src/', ''), '/'), lambda p: p <> '') AS p FROM pages) SELECT page_id, CASE WHEN len(p) <= 1 THEN '_root' ELSE regexp_replace(p[1], '[^A-Za-z0-9_]', '_', 'g') END AS module FROM x")
def node_module(spark, d):
    path = F.concat(F.when(F.col("page_id") % 2 == 0, "src/").otherwise(""), url_path())
    return table(spark, d, "pages").select("page_id", naming.node_module(path).alias("module"))


@query("display_values", """WITH x AS (SELECT p_partkey, CAST(p_partkey * p_size * 97 AS BIGINT) AS n, CASE WHEN p_size % 9 > 0 THEN p_size / 64.0 END AS r FROM part)
SELECT p_partkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f', floor(n * 10 / 1024.0 + 0.5) / 10) || ' KB' ELSE printf('%.1f', floor(n * 10 / 1048576.0 + 0.5) / 10) || ' MB' END AS size,
CASE WHEN r IS NULL THEN '—' ELSE CAST(CAST(floor(r * 100 + 0.5) AS BIGINT) AS VARCHAR) || '%' END AS ratio FROM x""")
def display_values(spark, d):
    n = (F.col("p_partkey") * F.col("p_size") * 97).cast("long")
    return table(spark, d, "part").select("p_partkey", naming.bytes_text(n).alias("size"), naming.ratio_text(F.when(F.col("p_size") % 9 > 0, F.col("p_size") / 64.0)).alias("ratio"))


ALIASES = {"@app/*": ["src/*", "gen/*"], "lib/*.js": ["lib/*/index.ts"], "exact": ["exact.ts"], "@*": ["all/*"]}
SPECIFIER = "CASE page_id % 4 WHEN 0 THEN concat('@app/', page_id) WHEN 1 THEN concat('lib/x', page_id, '.js') WHEN 2 THEN 'exact' ELSE concat('other', page_id) END"


@query("alias_targets", f"""WITH x AS (SELECT page_id, {SPECIFIER} AS s FROM pages)
SELECT page_id, 'src/' || substr(s, 6) AS target FROM x WHERE starts_with(s, '@app/') UNION ALL SELECT page_id, 'gen/' || substr(s, 6) FROM x WHERE starts_with(s, '@app/')
UNION ALL SELECT page_id, 'lib/' || substr(s, 5, length(s) - 7) || '/index.ts' FROM x WHERE s LIKE 'lib/%.js' UNION ALL SELECT page_id, 'exact.ts' FROM x WHERE s = 'exact' UNION ALL SELECT page_id, 'all/' || substr(s, 2) FROM x WHERE starts_with(s, '@')""")
def alias_targets(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(naming.alias_targets(F.expr(SPECIFIER), ALIASES)).alias("target"))


@query("workspace_subpath", f"WITH x AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS s, {HOST} AS p FROM pages) SELECT page_id, CASE WHEN s = p THEN '' WHEN starts_with(s, p || '/') THEN substr(s, length(p) + 2) END AS rest FROM x")
def workspace_subpath(spark, d):
    return table(spark, d, "pages").select("page_id", naming.workspace_subpath(F.regexp_replace("url", "^https?://", ""), F.expr(HOST)).alias("rest"))


@query("fallback_grade", """WITH x AS (SELECT p_partkey, greatest(0, least(100, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice % 100 ELSE greatest(0, 100 - 5 * (p_size / 5.0) - 2 * (p_partkey % 11)) END)) AS s FROM part)
SELECT p_partkey, CASE WHEN s >= 90 THEN 'A' WHEN s >= 75 THEN 'B' WHEN s >= 60 THEN 'C' WHEN s >= 40 THEN 'D' ELSE 'E' END AS grade FROM x""")
def fallback_grade(spark, d):
    return table(spark, d, "part").select("p_partkey", naming.fallback_grade(F.when(F.col("p_partkey") % 3 == 0, F.col("p_retailprice") % 100), F.col("p_size") / 5.0, F.col("p_partkey") % 11).alias("grade"))


@query("snippet", r"""WITH x AS (SELECT doc_id, regexp_split_to_array(text, '\r?\n') AS l, doc_id % 30 + 1 AS a, doc_id % 30 + 3 AS b FROM documents), y AS (SELECT *, greatest(1, a - 20) AS t, least(len(l), b + 20) AS z FROM x)
SELECT doc_id, CASE WHEN t > z THEN '' ELSE array_to_string(list_transform(range(t, z + 1), lambda i: CASE WHEN i >= a AND i <= b THEN '> ' ELSE '  ' END || lpad(CAST(i AS VARCHAR), CAST(length(CAST(z AS VARCHAR)) AS INTEGER), ' ') || ' | ' || l[i]), chr(10)) END AS snippet FROM y""")
def snippet(spark, d):
    line = (F.col("doc_id") % 30).cast("int")
    return table(spark, d, "documents").select("doc_id", naming.snippet(F.col("text"), line + 1, line + 3).alias("snippet"))


@query("basename_collisions", f"SELECT base, count(*) AS n FROM (SELECT regexp_extract({URL_PATH}, '([^/]*)/?$', 1) AS base FROM pages) GROUP BY base HAVING count(*) > 1")
def basename_collisions(spark, d):
    base = F.regexp_extract(url_path(), "([^/]*)/?$", 1).alias("base")
    return table(spark, d, "pages").select(base).groupBy("base").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("wrapper_package", rf"""WITH RECURSIVE x AS (SELECT {HOST} AS host, string_split('top.' || replace({URL_PATH}, '/', '.'), '.') AS p FROM pages), g AS (SELECT DISTINCT host FROM x),
r AS (SELECT host, 0 AS k, CAST('' AS VARCHAR) AS w FROM g UNION ALL SELECT r.host, k + 1, CASE WHEN k = 0 THEN q.s ELSE w || '.' || q.s END FROM r JOIN (SELECT host, i, min(p[i]) AS s FROM x, range(1, 9) t(i) WHERE len(p) >= i GROUP BY host, i HAVING count(DISTINCT p[i]) = 1) q ON q.host = r.host AND q.i = r.k + 1),
deep AS (SELECT host, max(k) AS k, arg_max(w, k) AS w FROM r GROUP BY host)
SELECT host, CASE WHEN k > 0 AND (SELECT count(DISTINCT p[k + 1]) FROM x WHERE x.host = deep.host AND len(p) > k) >= 2 AND (SELECT max(len(p)) FROM x WHERE x.host = deep.host) > k + 1 THEN w END AS wrapper FROM deep""")
def wrapper_package(spark, d):
    names = table(spark, d, "pages").select(F.expr(HOST).alias("host"), F.concat(F.lit("top."), F.regexp_replace(url_path(), "/", ".")).alias("dotted"))
    return resolution.wrapper_packages(names, "host", "dotted")


@query("bean_resolution", """WITH b AS (SELECT 'p' || s_nationkey || '.T' || s_suppkey % 50 AS id, 'T' || s_suppkey % 50 AS simple, min(s_suppkey) AS place FROM supplier GROUP BY ALL), u AS (SELECT c_custkey AS u, 'p' || c_nationkey AS p, 'T' || c_custkey % 70 AS t, 'p' || c_custkey % 5 || '.T' || c_custkey % 70 AS named, 'p' || c_custkey % 7 AS wild FROM customer),
c AS (SELECT u, 1 AS rank, p || '.' || t AS id FROM u UNION ALL SELECT u, 2, named FROM u WHERE u % 2 = 0 UNION ALL SELECT u, 3, wild || '.' || t FROM u), f AS (SELECT simple, arg_min(id, place) AS id FROM b GROUP BY simple),
k AS (SELECT c.u, rank, id FROM c SEMI JOIN b USING (id) UNION ALL SELECT u, 4, f.id FROM u JOIN f ON t = simple) SELECT u AS use_id, arg_min(id, rank) AS bean_id FROM k GROUP BY u""")
def bean_resolution(spark, d):
    beans = table(spark, d, "supplier").selectExpr("concat('p', s_nationkey, '.T', s_suppkey % 50) AS bean_id", "concat('T', s_suppkey % 50) AS simple", "s_suppkey").groupBy("bean_id", "simple").agg(F.min("s_suppkey").alias("place"))
    c = table(spark, d, "customer")
    uses = c.selectExpr("c_custkey AS use_id", "concat('p', c_nationkey) AS package", "concat('T', c_custkey % 70) AS type")
    named = c.where("c_custkey % 2 = 0").selectExpr("c_custkey AS use_id", "concat('p', c_custkey % 5, '.T', c_custkey % 70) AS name", "false AS asterisk", "1 AS place")
    return resolution.resolve_types(uses, named.union(c.selectExpr("c_custkey", "concat('p', c_custkey % 7, '.*')", "true", "2")), beans)


@query("mitigations", f"WITH {FINDINGS}, {CATALOG} SELECT rule_id, severity, subject, category FROM findings JOIN catalog USING (rule_id) WHERE category IN ('design', 'coupling') ORDER BY {RANK}, rule_id, subject LIMIT 5")
def mitigations(spark, d):
    """JOI-15, SRT-03: findings of related rules by severity; a limit is the feature."""
    related = rule_catalog(spark, d).where("category IN ('design', 'coupling')").select("rule_id", "category")
    order = [severity_rank(F.col("severity")), F.col("rule_id")]
    own = rules.only(CHOSEN, rules.first_groups(counts(spark, d).join(F.broadcast(related), "rule_id"), order, 5))  # 31 fixed rows at most
    rows = (findings(spark, d, own) if own else findings(spark, d).where("false")).join(F.broadcast(related), "rule_id")
    return rows.select("rule_id", "severity", "subject", "category").orderBy(severity_rank(F.col("severity")), "rule_id", "subject").limit(5)


STEPS = [(k, f"reduce {c}", [r for r, own, *_ in RULES if own == c]) for k, c in enumerate(sorted({c for _, c, *_ in RULES}))] + [(9, "add a readme", ["missing-readme"])]


@query("playbook_steps", f"WITH {FINDINGS}, s(place, step, triggers) AS (VALUES " + ", ".join(f"({k}, '{s}', {t})" for k, s, t in STEPS) + ") SELECT place, step, EXISTS (SELECT 1 FROM findings f WHERE list_contains(triggers, f.rule_id)) AS relevant FROM s ORDER BY relevant DESC, place LIMIT 3")
def playbook_steps(spark, d):
    """JOI-18, SRT-09."""
    return resolution.relevant_steps(spark.createDataFrame(STEPS, "place int, step string, triggers array<string>"), counts(spark, d))
