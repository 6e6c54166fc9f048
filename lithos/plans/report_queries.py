"""Report queries: repository scores, lists, lookups and payloads, and operators over constant tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lithos.config import SEVERITIES, Thresholds
from lithos.functions import naming
from lithos.operators import metrics, rules
from lithos.plans import fixtures as fx
from lithos.plans.bindings import CLASSES, MODULES, PAIRS, UNITS, classes, edges, modules, pair_counts, pair_edges, table, units
from lithos.plans.queries import CHOSEN, COVER, FINDINGS, GRADE, HIST, REACH, counts, labels, module_facts, ranges
from lithos.plans.registry import query
from lithos.sources import files, java_source, python_source, script_source

# ---- the repository's scores --------------------------------------------------

REPO = f"""WITH RECURSIVE {FINDINGS}{REACH}, {COVER},
kinds AS (SELECT module_id, count(*) AS total, CAST(count(*) FILTER (WHERE attributes = 0) AS BIGINT) AS abstract FROM classes GROUP BY module_id),
pain AS (SELECT sum(greatest(abs(abstract / total + instability - 1) - 0.5, 0)) AS pain FROM kinds JOIN coup USING (module_id) WHERE total >= 3),
own AS (SELECT sum(loc) AS total_loc, count(*) AS functions, sum(greatest(complexity - 10, 0)) AS excess, count(*) FILTER (WHERE complexity > 10) AS hot FROM units),
links AS (SELECT count(*) AS modules, sum(fan_out) AS fan_out_total, max(fan_out) AS fan_out_max, max(fan_in * fan_out) AS dual_hub_max, sum(ratio * loc) FILTER (WHERE files > 1 AND ratio IS NOT NULL) AS weighted, sum(loc) FILTER (WHERE files > 1 AND ratio IS NOT NULL) AS within FROM module_facts),
cyc AS (SELECT count(DISTINCT coalesce(component, node)) AS cycles FROM scc WHERE cyclic),
sev AS (SELECT {HIST} FROM findings),
x AS (SELECT *, least(1.0, (SELECT sum(covered) FROM cover) / total_loc) AS dup FROM own, links, pain, cyc, sev),
p AS (SELECT *, greatest(0, least(100, 100 - 2 * coalesce(excess / nullif(total_loc / 1000.0, 0), 0))) AS complexity, greatest(0, least(100, 100 - 100 * dup)) AS duplication,
  greatest(0, least(100, 100 - (greatest(0, fan_out_total / modules - 1) * 10 + greatest(0, fan_out_max - greatest(5, ceil(0.3 * modules))) * 4 + greatest(0, dual_hub_max - greatest(25, 4 * modules)) * 1.5) - pain * 6 - cycles * 15)) AS coupling,
  coalesce(greatest(0, least(100, 100 * weighted / within)), 100) AS cohesion,
  greatest(0, least(100, 100 - (critical * 1000 / greatest(total_loc, 500) * 25.0 + major * 1000 / greatest(total_loc, 500) * 6.0 + minor * 1000 / greatest(total_loc, 500) * 1.5 + info * 1000 / greatest(total_loc, 500) * 0.3))) AS smells FROM x)"""


def repo_totals(spark, d):
    """One row of what the repository's scores are made of (AGG-09, AGG-29)."""
    u = units(spark, d).agg(F.sum("loc").alias("total_loc"), F.count(F.lit(1)).alias("functions"), F.sum(F.greatest(F.col("complexity") - 10, F.lit(0))).alias("excess"), F.count_if(F.col("complexity") > 10).alias("hot"))
    kinds = classes(spark, d).groupBy("module_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("attributes") == 0).alias("abstract"))
    f = module_facts(spark, d).join(kinds, "module_id", "left")
    signal = (F.col("files") > 1) & F.col("ratio").isNotNull()
    distance = F.when(F.col("total") >= 3, F.abs(F.col("abstract") / F.col("total") + F.col("instability") - 1))
    links = f.agg(
        F.count(F.lit(1)).alias("modules"), F.sum("fan_out").alias("fan_out_total"), F.max("fan_out").alias("fan_out_max"), F.max(F.col("fan_in") * F.col("fan_out")).alias("dual_hub_max"),
        F.sum(F.when(signal, F.col("ratio") * F.col("loc"))).alias("cohesion_weighted"), F.sum(F.when(signal, F.col("loc"))).alias("cohesion_loc"), F.coalesce(F.sum(F.greatest(distance - 0.5, F.lit(0.0))), F.lit(0.0)).alias("pain"),
    )
    cycles = labels(spark, d).where("cyclic").agg(F.count_distinct("component").alias("cycles"))
    found = metrics.counted_histogram(counts(spark, d))
    twice = metrics.merged_ranges(ranges(spark, d), "file_id").agg(F.sum("covered").alias("covered"))
    one = u
    for part in (links, cycles, found, twice):  # rows of totals, one each
        one = one.join(part, F.lit(True))
    return one.select(F.lit("repo").alias("repo"), "*", F.least(F.lit(1.0), F.col("covered") / F.col("total_loc")).alias("dup_ratio"))


@query("repo_scorecard", f"""{REPO}, z AS (SELECT *, floor((complexity * 0.25 + duplication * 0.15 + coupling * 0.25 + cohesion * 0.15 + smells * 0.20) / (0.25 + 0.15 + 0.25 + 0.15 + 0.20) * 100 + 0.5) / 100 AS s FROM p)
SELECT 'repo' AS repo, floor(complexity * 100 + 0.5) / 100 AS complexity, floor(duplication * 100 + 0.5) / 100 AS duplication, floor(coupling * 100 + 0.5) / 100 AS coupling, floor(cohesion * 100 + 0.5) / 100 AS cohesion, floor(smells * 100 + 0.5) / 100 AS smells, s AS overall, {GRADE} AS grade FROM z""")
def repo_scorecard(spark, d):
    """AGG-11; every dimension has a signal in these tables."""
    return metrics.repo_scores(repo_totals(spark, d))


@query("score_derivation", f"""{REPO} SELECT 'complexity' AS metric, '100 - hot-spot density x 2 = ' || CAST(floor(complexity + 0.5) AS BIGINT) || ' (' || hot || ' hot-spot functions over ' || format('{{:,}}', CAST(total_loc AS BIGINT)) || ' LOC)' AS derivation FROM p
UNION ALL SELECT 'coupling', '100 - penalties = ' || CAST(floor(coupling + 0.5) AS BIGINT) || ' (' || modules || ' modules, max ' || fan_out_max || ', ' || cycles || ' cycles)' FROM p""")
def score_derivation(spark, d):
    """SCL-39."""
    k, n, zero = F.col("total_loc") / 1000.0, F.col("modules"), F.lit(0.0)
    x = repo_totals(spark, d)
    scored = metrics.repo_scores(x).select("complexity", "coupling").join(x.select("hot", "total_loc", "modules", "fan_out_max", "cycles"), F.lit(True))
    whole = lambda c: F.floor(F.col(c) + 0.5).cast("string")
    text = F.array(
        F.struct(F.lit("complexity").alias("metric"), F.concat(F.lit("100 - hot-spot density x 2 = "), whole("complexity"), F.lit(" ("), F.col("hot").cast("string"), F.lit(" hot-spot functions over "), F.format_number("total_loc", 0), F.lit(" LOC)")).alias("derivation")),
        F.struct(F.lit("coupling").alias("metric"), F.concat(F.lit("100 - penalties = "), whole("coupling"), F.lit(" ("), n.cast("string"), F.lit(" modules, max "), F.col("fan_out_max").cast("string"), F.lit(", "), F.col("cycles").cast("string"), F.lit(" cycles)")).alias("derivation")),
    )
    return scored.select(F.explode(text).alias("t")).select("t.*")


@query("cohesion_groups", f"""WITH {PAIRS}, g AS (SELECT 'mod_' || CAST(n_nationkey AS VARCHAR) AS module_id, n_regionkey AS grp FROM nation), n AS (SELECT from_id, to_id, count(*) AS n FROM edges GROUP BY ALL)
SELECT from_id AS module_id, sum(n) FILTER (WHERE from_id = to_id) / sum(n) AS ratio, sum(n) FILTER (WHERE a.grp = b.grp) / sum(n) AS group_ratio FROM n JOIN g a ON a.module_id = from_id LEFT JOIN g b ON b.module_id = to_id GROUP BY from_id""")
def cohesion_groups(spark, d):
    """JOI-05, AGG-07: cohesion within the module and within its group; a target without a group is outside."""
    g = table(spark, d, "nation").select(F.concat(F.lit("mod_"), F.col("n_nationkey").cast("string")).alias("module_id"), F.col("n_regionkey").alias("grp"))
    a, b = g.select(F.col("module_id").alias("from_id"), F.col("grp").alias("a")), g.select(F.col("module_id").alias("to_id"), F.col("grp").alias("b"))
    inside = lambda cond: F.sum(F.when(cond, F.col("n"))) / F.sum("n")
    rows = pair_counts(spark, d).join(a, "from_id").join(b, "to_id", "left")
    return rows.groupBy(F.col("from_id").alias("module_id")).agg(inside(F.col("from_id") == F.col("to_id")).alias("ratio"), inside(F.col("a") == F.col("b")).alias("group_ratio"))


# ---- findings in lists ---------------------------------------------------------


@query("file_smells", f"WITH {UNITS} SELECT file_id, CAST(sum({' + '.join(f'CAST(({r.fires}) AS INTEGER)' for r in CHOSEN if r.grain == 'unit')}) AS BIGINT) AS smells, CAST(sum(complexity) AS BIGINT) AS complexity FROM units GROUP BY file_id")
def file_smells(spark, d):
    """AGG-15: findings of each file; a unit's rules fire once each, so the sum counts distinct ones."""
    fired = sum((F.expr(f"CAST(({r.fires}) AS INT)") for r in CHOSEN if r.grain == "unit"), F.lit(0))
    return units(spark, d).groupBy("file_id").agg(F.sum(fired).alias("smells"), F.sum("complexity").alias("complexity"))


@query("severity_groups", f"WITH {FINDINGS} SELECT module_id, severity, list_sort(list(DISTINCT rule_id)) AS rules, count(*) AS n FROM findings GROUP BY ALL")
def severity_groups(spark, d):
    """AGG-25, SRT-08."""
    return counts(spark, d).groupBy("module_id", "severity").agg(F.array_sort(F.collect_set("rule_id")).alias("rules"), F.sum("n").alias("n"))


@query("sequential_ids", f"WITH {CLASSES} SELECT module_id, class_id, 'smell_god_class_' || row_number() OVER (ORDER BY module_id, class_id) AS id FROM classes WHERE {next(r.fires for r in CHOSEN if r.name == 'god-class')}")
def sequential_ids(spark, d):
    """WIN-05: numbers in each module, after the counts of the modules before it, so no task holds all findings."""
    rule = next(r for r in CHOSEN if r.name == "god-class")
    fired = classes(spark, d).where(rule.fires).select("module_id", "class_id")
    per = fired.groupBy("module_id").agg(F.count(F.lit(1)).alias("n"))
    before = per.select("module_id", (F.sum("n").over(Window.orderBy("module_id")) - F.col("n")).alias("before"))  # a row a module
    own = F.row_number().over(Window.partitionBy("module_id").orderBy("class_id"))
    return fired.withColumn("own", own).join(before, "module_id").select("module_id", "class_id", F.concat(F.lit("smell_god_class_"), (F.col("before") + F.col("own")).cast("string")).alias("id"))


@query("smells_by_path", f"WITH {UNITS}, s AS (SELECT file_id, count(*) AS n FROM units WHERE max_depth >= {Thresholds().deep_nesting_depth} GROUP BY file_id), f AS (SELECT DISTINCT module_id, file_id FROM units) SELECT module_id, CAST(sum(n) AS BIGINT) AS smells FROM f JOIN s USING (file_id) GROUP BY module_id")
def smells_by_path(spark, d):
    """JOI-09: findings of a file count for every module that holds the file."""
    u = units(spark, d)
    s = u.where(F.col("max_depth") >= Thresholds().deep_nesting_depth).groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    return u.select("module_id", "file_id").distinct().join(s, "file_id").groupBy("module_id").agg(F.sum("n").alias("smells"))


# ---- lists, lookups and joins with stored rows ----------------------------------


@query("language_set", "SELECT source, list_sort(list_distinct(list(lang))) AS languages FROM documents GROUP BY source")
def language_set(spark, d):
    """SET-03."""
    return table(spark, d, "documents").groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("languages"))


@query("first_anchor", f"WITH {UNITS} SELECT module_id, min(file_id) AS anchor FROM units GROUP BY module_id")
def first_anchor(spark, d):
    """WIN-04."""
    return units(spark, d).groupBy("module_id").agg(F.min("file_id").alias("anchor"))


@query("size_partition", "WITH h AS (SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, count(*) AS n FROM pages GROUP BY ALL) SELECT CASE WHEN n > 1 THEN 'primary' ELSE 'small' END AS part, count(*) AS modules, CAST(sum(n) AS BIGINT) AS files FROM h GROUP BY ALL")
def size_partition(spark, d):
    """FLT-04."""
    h = table(spark, d, "pages").groupBy(F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host")).agg(F.count(F.lit(1)).alias("n"))
    return h.groupBy(F.when(F.col("n") > 1, "primary").otherwise("small").alias("part")).agg(F.count(F.lit(1)).alias("modules"), F.sum("n").alias("files"))


@query("owner_lookup", "SELECT d.source, count(*) AS n FROM documents d JOIN (SELECT DISTINCT upper(source) AS asked FROM documents) a ON lower(a.asked) = lower(d.source) GROUP BY d.source")
def owner_lookup(spark, d):
    """FLT-09: names are compared without regard to case."""
    docs = table(spark, d, "documents").select("source")
    asked = docs.select(F.lower(F.upper("source")).alias("key")).distinct()
    return docs.withColumn("key", F.lower("source")).join(asked, "key").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("module_order", f"WITH {MODULES} SELECT row_number() OVER (ORDER BY module_id) AS position, module_id FROM modules")
def module_order(spark, d):
    """SRT-05: a row a module."""
    return modules(spark, d).select(F.row_number().over(Window.orderBy("module_id")).cast("long").alias("position"), "module_id")


@query("scan_history", "SELECT user_id AS repo, event_id AS scan_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS position FROM events")
def scan_history(spark, d):
    """SRT-06, API-08."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, d, "events").select(F.col("user_id").alias("repo"), F.col("event_id").alias("scan_id"), F.row_number().over(w).cast("long").alias("position"))


@query("repo_overview", "WITH l AS (SELECT user_id, arg_max(event_id, (ts, event_id)) AS scan_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id) SELECT c_custkey AS repo, scan_id, CASE WHEN status = 'purchase' THEN (SELECT count(*) FROM events e WHERE e.user_id = c_custkey) END AS summary FROM customer LEFT JOIN l ON user_id = c_custkey")
def repo_overview(spark, d):
    """JOI-17: every repository, its newest scan if it has one, and a summary if that scan has ended."""
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("repo")).agg(F.max(F.struct("ts", "event_id", "event_type")).alias("l"), F.count(F.lit(1)).alias("n"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("repo")).join(e, "repo", "left").select("repo", F.col("l.event_id").alias("scan_id"), F.when(F.col("l.event_type") == "purchase", F.col("n")).alias("summary"))


RENAMED = "renamed AS (SELECT 'mod_' || CAST(n_nationkey AS VARCHAR) AS module_id, 'mod_' || CAST(n_nationkey AS VARCHAR) || '__' || lower(r_name) AS new_id FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE'))"


@query("rename_map", f"WITH {PAIRS}, {RENAMED} SELECT coalesce(a.new_id, from_id) AS from_id, coalesce(b.new_id, to_id) AS to_id, weight FROM pairs LEFT JOIN renamed a ON from_id = a.module_id LEFT JOIN renamed b ON to_id = b.module_id")
def rename_map(spark, d):
    """JOI-19: ends that were renamed get their new names, all others keep theirs."""
    r = table(spark, d, "region").where("r_name IN ('ASIA', 'EUROPE')").select(F.col("r_regionkey").alias("n_regionkey"), F.lower("r_name").alias("r"))
    m = table(spark, d, "nation").join(r, "n_regionkey").select(F.concat(F.lit("mod_"), F.col("n_nationkey").cast("string")).alias("module_id"), "r")
    new = m.select("module_id", F.concat_ws("__", "module_id", "r").alias("new_id"))
    a, b = new.select(F.col("module_id").alias("from_id"), F.col("new_id").alias("a")), new.select(F.col("module_id").alias("to_id"), F.col("new_id").alias("b"))
    return pair_edges(spark, d).join(a, "from_id", "left").join(b, "to_id", "left").select(F.coalesce("a", "from_id").alias("from_id"), F.coalesce("b", "to_id").alias("to_id"), "weight")


@query("cycle_names", f"WITH RECURSIVE {PAIRS}{REACH}, {MODULES} SELECT coalesce(component, node) AS component, list_sort(list(coalesce(name, node))) AS names FROM scc LEFT JOIN modules ON module_id = node WHERE cyclic GROUP BY ALL")
def cycle_names(spark, d):
    """JOI-14, JOI-10."""
    m = modules(spark, d).select(F.col("module_id").alias("node"), "name")
    return labels(spark, d).where("cyclic").join(m, "node", "left").groupBy("component").agg(F.array_sort(F.collect_list(F.coalesce("name", "node"))).alias("names"))


@query("module_rows", f"WITH {MODULES}, db AS (SELECT 'mod_' || CAST(s_nationkey AS VARCHAR) AS module_id, 'row' || min(s_suppkey) AS id FROM supplier WHERE s_acctbal < 0 GROUP BY s_nationkey) SELECT module_id, name, coalesce(db.id, '') AS id FROM modules LEFT JOIN db USING (module_id)")
def module_rows(spark, d):
    """JOI-12: a module without a stored row has an empty id."""
    db = table(spark, d, "supplier").where("s_acctbal < 0").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("k")).select(F.concat(F.lit("mod_"), F.col("s_nationkey").cast("string")).alias("module_id"), F.concat(F.lit("row"), F.col("k").cast("string")).alias("id"))
    return modules(spark, d).join(db, "module_id", "left").select("module_id", "name", F.coalesce("id", F.lit("")).alias("id"))


@query("file_rows", f"WITH {UNITS}, f AS (SELECT file_id, CAST(sum(loc) AS BIGINT) AS loc FROM units GROUP BY file_id) SELECT file_id, loc, coalesce(p_name, CAST(file_id AS VARCHAR)) AS id FROM f LEFT JOIN (SELECT p_partkey, p_name FROM part WHERE p_size > 25) ON p_partkey = file_id")
def file_rows(spark, d):
    """JOI-13: a file without a stored row goes by its own id."""
    db = table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("file_id"), "p_name")
    return units(spark, d).groupBy("file_id").agg(F.sum("loc").alias("loc")).join(db, "file_id", "left").select("file_id", "loc", F.coalesce("p_name", F.col("file_id").cast("string")).alias("id"))


@query("file_detail", f"WITH {UNITS}, f AS (SELECT file_id, arg_min(l_orderkey, (l_orderkey, l_linenumber)) AS first FROM (SELECT l_partkey AS file_id, l_orderkey, l_linenumber FROM lineitem) GROUP BY file_id) SELECT file_id, first, CAST(sum(loc) AS BIGINT) AS loc, CAST(sum(complexity) AS BIGINT) AS complexity, max(max_depth) AS max_depth, count(*) FILTER (WHERE max_depth >= 4) AS smells FROM units JOIN f USING (file_id) GROUP BY ALL")
def file_detail(spark, d):
    """API-04 for all files: sizes, complexity, findings and the first unit."""
    u = units(spark, d)
    return u.groupBy("file_id").agg(F.min(F.struct("class_id", "unit_no"))["class_id"].alias("first"), F.sum("loc").alias("loc"), F.sum("complexity").alias("complexity"), F.max("max_depth").alias("max_depth"), F.count_if(F.col("max_depth") >= 4).alias("smells"))


@query("file_source", r"SELECT doc_id AS file_id, sha256(text) AS hash, CAST(strlen(text) AS BIGINT) AS bytes, len(regexp_split_to_array(text, '\r?\n')) AS lines FROM documents WHERE regexp_replace(CAST(doc_id AS VARCHAR), '[^A-Za-z0-9._-]', '_', 'g') = CAST(doc_id AS VARCHAR)")
def file_source(spark, d):
    """API-05, SRC-17: stored texts by an id that stays as it is when made safe."""
    safe = F.regexp_replace(F.col("doc_id").cast("string"), "[^A-Za-z0-9._-]", "_")
    return table(spark, d, "documents").where(safe == F.col("doc_id").cast("string")).select(F.col("doc_id").alias("file_id"), F.sha2("text", 256).alias("hash"), F.octet_length("text").cast("long").alias("bytes"), F.size(F.split("text", "\\r?\\n")).cast("long").alias("lines"))


@query("sub_split", r"WITH x AS (SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(regexp_replace(url, '^https?://[^/?#]+/?', ''), '^([^/?#]+)/', 1) AS dir FROM pages) SELECT host, count(DISTINCT nullif(dir, '')) >= 2 AS split FROM x GROUP BY host")
def sub_split(spark, d):
    """AGG-28: a workspace is split if its files lie in two or more first directories."""
    x = table(spark, d, "pages").select(F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"), F.regexp_extract(F.regexp_replace("url", "^https?://[^/?#]+/?", ""), "^([^/?#]+)/", 1).alias("dir"))
    return x.groupBy("host").agg((F.count_distinct(F.nullif("dir", F.lit(""))) >= 2).alias("split"))


@query("number_text", "WITH x AS (SELECT o_orderkey AS k, CAST(floor(o_totalprice * 37) AS BIGINT) AS n FROM orders) SELECT k, CASE WHEN n >= 1000000 THEN (CAST(floor(n / 1000000 * 10 + 0.5) AS BIGINT) // 10) || '.' || (CAST(floor(n / 1000000 * 10 + 0.5) AS BIGINT) % 10) || 'M' WHEN n >= 1000 THEN (CAST(floor(n / 1000 * 10 + 0.5) AS BIGINT) // 10) || '.' || (CAST(floor(n / 1000 * 10 + 0.5) AS BIGINT) % 10) || 'k' ELSE CAST(n AS VARCHAR) END AS shown FROM x")
def number_text(spark, d):
    """SCL-32."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), naming.number_text(F.floor(F.col("o_totalprice") * 37).cast("long")).alias("shown"))


@query("age_text", "WITH x AS (SELECT event_id, ts, CAST(floor(epoch(TIMESTAMP '2024-02-20 00:00:00') - epoch(ts)) AS BIGINT) AS s FROM events), y AS (SELECT *, floor(s / 60 + 0.5) AS m FROM x), z AS (SELECT *, floor(m / 60 + 0.5) AS h FROM y), w AS (SELECT *, floor(h / 24 + 0.5) AS d FROM z) SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN m < 60 THEN CAST(m AS BIGINT) || 'm ago' WHEN h < 24 THEN CAST(h AS BIGINT) || 'h ago' WHEN d < 30 THEN CAST(d AS BIGINT) || 'd ago' ELSE strftime(ts, '%Y-%m-%d') END AS shown FROM w")
def age_text(spark, d):
    """SCL-33, with the date beyond a month."""
    e = table(spark, d, "events")
    s = F.floor(F.lit(1708387200) - F.expr("unix_micros(cast(ts as timestamp)) / 1000000.0")).cast("long")
    return e.select("event_id", naming.age_text(s, F.date_format("ts", "yyyy-MM-dd")).alias("shown"))


# ---- validation, events ----------------------------------------------------------


@query("request_validation", r"SELECT page_id, url IS NOT NULL AND regexp_matches(url, '^https?://[^\s/$.?#][^\s]*$') AND length(url) BETWEEN 1 AND 255 AS ok, CASE WHEN NOT regexp_matches(url, '^https?://[^\s/$.?#][^\s]*$') THEN 'invalid_url' WHEN length(url) > 255 THEN 'too_big' END AS code FROM pages")
def request_validation(spark, d):
    """VAL-03, VAL-05: a row's verdict and the first constraint it breaks."""
    good, short = F.col("url").rlike("^https?://[^\\s/$.?#][^\\s]*$"), F.length("url").between(1, 255)
    return table(spark, d, "pages").select("page_id", (F.col("url").isNotNull() & good & short).alias("ok"), F.when(~good, "invalid_url").when(F.length("url") > 255, "too_big").alias("code"))


@query("is_valid", f"WITH {UNITS} SELECT count(*) FILTER (WHERE loc < 1 OR complexity < 1 OR max_depth < 0) = 0 AS valid FROM units")
def is_valid(spark, d):
    """VAL-02."""
    return units(spark, d).agg((F.count_if(F.expr("loc < 1 OR complexity < 1 OR max_depth < 0")) == 0).alias("valid"))


@query("progress_events", f"WITH {fx.STEPS.sql}, s AS (SELECT DISTINCT user_id FROM events) SELECT user_id AS scan_id, place, step, percent, CASE WHEN percent = 100 THEN 'completed' ELSE 'running' END AS status FROM s, steps")
def progress_events(spark, d):
    """STR-02: eight steps for each scan."""
    steps = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("place", "step", "percent"), r)]) for r in fx.STEPS.rows])
    scans = table(spark, d, "events").select(F.col("user_id").alias("scan_id")).distinct()
    return scans.select("scan_id", F.explode(steps).alias("s")).select("scan_id", "s.*", F.when(F.col("s.percent") == 100, "completed").otherwise("running").alias("status"))


@query("room_events", "SELECT c_nationkey AS room, event_type, count(*) AS n FROM events JOIN customer ON c_custkey = user_id GROUP BY ALL")
def room_events(spark, d):
    """STR-03: events go to the room of the scan's owner; those of scans without an owner go nowhere."""
    owners = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("room"))
    return table(spark, d, "events").select("user_id", "event_type").join(owners, "user_id").groupBy("room", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("event_payload", """SELECT event_id, '{"id":"' || event_id || '","type":"' || event_type || '","at":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z"' || CASE WHEN event_type = 'error' THEN ',"error":"e' || user_id || '"' ELSE '' END || '}' AS payload FROM events""")
def event_payload(spark, d):
    """SCL-42, SNK-04: fields that are null are left out."""
    e = table(spark, d, "events")
    at = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
    error = F.when(F.col("event_type") == "error", F.concat(F.lit("e"), F.col("user_id").cast("string")))
    return e.select("event_id", F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("type"), at.alias("at"), error.alias("error"))).alias("payload"))


# ---- operators over constant tables ------------------------------------------------

LIST = fx.LISTING.sql
_has = lambda names: f"bool_or(path IN ({', '.join(map(fx.sql_value, names))}))"
HYGIENE = f"""WITH {LIST}, f AS (SELECT repo, {_has(files.READMES)} AS readme, bool_or(path IN ({', '.join(map(fx.sql_value, files.CI_PATHS[1:]))}) OR starts_with(path, '.github/workflows/')) AS ci,
 bool_or(path IN ({', '.join(map(fx.sql_value, files.LINTERS))}) OR (path IN ('setup.cfg', 'pyproject.toml') AND regexp_matches(coalesce(text, ''), '(?i)\\[tool\\.(ruff|black|flake8|isort)\\]|\\[flake8\\]'))) AS linter,
 {_has(['package.json'])} AS n0, {_has(files.LOCKS['package.json'])} AS h0, {_has(['pyproject.toml'])} AS n1, {_has(files.LOCKS['pyproject.toml'])} AS h1 FROM listing GROUP BY repo)
SELECT repo, 'missing-readme' AS rule_id, 'info' AS severity, 'README.md' AS file FROM f WHERE NOT readme UNION ALL SELECT repo, 'missing-ci', 'info', '.github/workflows/' FROM f WHERE NOT ci
UNION ALL SELECT repo, 'missing-linter-config', 'info', CASE WHEN n1 THEN 'pyproject.toml' ELSE 'package.json' END FROM f WHERE NOT linter
UNION ALL SELECT repo, 'missing-lockfile', 'minor', 'package.json' FROM f WHERE n0 AND NOT h0 UNION ALL SELECT repo, 'missing-lockfile', 'minor', 'pyproject.toml' FROM f WHERE n1 AND NOT h1"""


@query("repo_hygiene", HYGIENE)
def repo_hygiene(spark, d):
    """RUL-24..27, SET-06, UDF-08."""
    return files.hygiene(fx.LISTING.frame(spark))


@query("build_artifacts", f"WITH {LIST}, p AS (SELECT repo, string_split(path, '/') AS s FROM listing), x AS (SELECT repo, s, list_min(list_filter(list_transform({list(rules.BUILD_DIRS)}, lambda n: list_position(s[:-2], n)), lambda k: k > 0)) AS b, list_min(list_filter(list_transform({list(rules.SKIP_DIRS)}, lambda n: list_position(s[:-2], n)), lambda k: k > 0)) AS o FROM p) SELECT DISTINCT repo, array_to_string(s[1:b], '/') AS file, 'build-artifacts-committed' AS rule_id, 'minor' AS severity FROM x WHERE b IS NOT NULL AND (o IS NULL OR b < o)")
def build_artifacts(spark, d):
    """RUL-28, SRC-06."""
    return rules.build_artifacts(fx.LISTING.frame(spark))


@query("large_binaries", f"WITH {LIST} SELECT repo, path AS file, bytes, 'large-binary-file' AS rule_id, CASE WHEN bytes >= 10485760 THEN 'major' ELSE 'minor' END AS severity FROM listing WHERE lower(regexp_extract(path, '([.][^./]*)$', 1)) IN ({', '.join(map(fx.sql_value, files.BINARIES))}) AND bytes >= 2097152 AND NOT list_has_any(string_split(path, '/')[:-2], {[*rules.SKIP_DIRS, *rules.BUILD_DIRS]})")
def large_binaries(spark, d):
    """RUL-29 with its extensions."""
    return files.large_binaries(fx.LISTING.frame(spark), Thresholds().large_binary_bytes)


@query("todo_lines", rf"WITH {LIST}, x AS (SELECT path AS file_id, len(list_filter(regexp_split_to_array(text, '\r?\n'), lambda s: regexp_matches(s, '(^|[^A-Za-z0-9_])(TODO|FIXME|HACK|XXX)([^A-Za-z0-9_]|$)'))) AS hits FROM listing) SELECT file_id, CAST(hits AS INTEGER) AS hits, 'todo-accumulation' AS rule_id, CASE WHEN hits >= 15 THEN 'minor' ELSE 'info' END AS severity FROM x WHERE hits >= 5")
def todo_lines(spark, d):
    """RUL-14."""
    from lithos.plans.queries import MARKERS

    return rules.text_line_rule(fx.LISTING.frame(spark).select(F.col("path").alias("file_id"), "text").where("text IS NOT NULL"), MARKERS, 5, "todo-accumulation", "info", "minor")


@query("commented_code", f"WITH {LIST} SELECT path AS file_id, CAST(9 AS INTEGER) AS hits, 'commented-out-code' AS rule_id, 'minor' AS severity FROM listing WHERE path = 'lib/old.py'")
def commented_code(spark, d):
    """RUL-13; the expected row is counted by hand: three of four comments, three times."""
    return rules.commented_code(fx.LISTING.frame(spark).select(F.col("path").alias("file_id"), "text").where("text IS NOT NULL"))


@query("source_files", f"WITH {LIST} SELECT repo, path, CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.java' THEN 'java' ELSE 'script' END AS kind FROM listing WHERE path IN ('pkg/main.py', 'lib/old.py', 'src/a.ts', 'src/main/java/A.java')")
def source_files(spark, d):
    """SRC-03..05, FLT-01; the files that stay are named by hand."""
    x = fx.LISTING.frame(spark)
    kinds = {"python": files.python_files(x), "script": files.node_files(x), "java": files.java_files(x)}
    out = [f.select("repo", "path", F.lit(k).alias("kind")) for k, f in kinds.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("statement_rules", f"""WITH {fx.UNIT_FACTS.sql} SELECT file, name, 'empty-catch' AS rule_id, 'major' AS severity FROM unit_facts, range(empty_catches)
UNION ALL SELECT file, name, 'magic-numbers', CASE WHEN magic_numbers >= 6 THEN 'minor' ELSE 'info' END FROM unit_facts WHERE magic_numbers >= 2
UNION ALL SELECT file, name, 'long-boolean-expression', CASE WHEN boolean_operators >= 8 THEN 'major' ELSE 'minor' END FROM unit_facts WHERE boolean_operators >= 4
UNION ALL SELECT file, name, 'large-match', CASE WHEN ways >= 16 THEN 'major' ELSE 'minor' END FROM unit_facts WHERE ways >= 8""")
def statement_rules(spark, d):
    """RUL-09..12."""
    u = fx.UNIT_FACTS.frame(spark).withColumns({"branches": F.array("ways"), "error": F.lit(None).cast("string"), "class_name": F.lit(None).cast("string")})
    return rules.python_findings(u).drop("class_name")


@query("python_units", f"WITH {fx.PYTHON_UNITS.sql} SELECT * FROM want")
def python_units(spark, d):
    """SRC-08, SCL-04, SCL-38; the facts are counted by hand."""
    return python_source.units(spark.createDataFrame([("pkg/sub/a.py", fx.PYTHON)], "file string, text string")).select([c.split()[0] for c in fx.PYTHON_UNITS.schema.split(", ")])


@query("script_facts", f"WITH {fx.SCRIPT_FACTS.sql} SELECT * FROM want")
def script_facts(spark, d):
    """SRC-09, SCL-16, SCL-24, SCL-27, SCL-41; counted by hand."""
    f = script_source.facts(spark.createDataFrame([("src/a.ts", fx.SCRIPT), ("b.rb", "x")], "file string, text string"))
    own = F.when(F.col("what") == "class", script_source.layer(F.col("name"), F.col("marks")))
    return f.withColumn("layer", own).select([c.split()[0] for c in fx.SCRIPT_FACTS.schema.split(", ")])


def java_facts(spark):
    return java_source.facts(spark.createDataFrame(list(fx.JAVA.items()), "file string, text string"))


@query("java_methods", f"WITH {fx.JAVA_METHODS.sql} SELECT * FROM want")
def java_methods(spark, d):
    """SRC-10, SCL-05; counted by hand."""
    return java_facts(spark).where("what IN ('method', 'constructor')").select("file", "owner", "name", "what", "complexity", "cognitive", "max_depth", F.size("params").alias("params"))


@query("bean_edges", f"WITH {fx.BEAN_EDGES.sql} SELECT * FROM want")
def bean_edges(spark, d):
    """GRF-08, RUL-30, JOI-07, SCL-25."""
    f = java_facts(spark)
    e, known = java_source.injections(f), java_source.beans(f)
    skips = java_source.layer_skips(e, known).select("from_id", "to_id").distinct().withColumn("skips", F.lit(True))
    return e.join(skips, ["from_id", "to_id"], "left").select("from_id", "to_id", "kind", "type", F.coalesce("skips", F.lit(False)).alias("skips"))


@query("service_cycles", "SELECT 's.PetService' AS component, ['s.PetService', 's.VetService'] AS nodes, 'spring-service-cycle' AS rule_id, 'major' AS severity")
def service_cycles(spark, d):
    """RUL-31, GRF-09."""
    f = java_facts(spark)
    return java_source.service_cycles(java_source.injections(f), java_source.beans(f))


@query("java_module_edges", "SELECT * FROM (VALUES ('mod_c', 'mod_s', 'import', CAST(1 AS BIGINT)), ('mod_s', 'mod_r', 'import', 1), ('mod_r', 'mod_s', 'import', 1)) v(from_id, to_id, kind, weight)")
def java_module_edges(spark, d):
    """FLT-02, JOI-03."""
    return java_source.module_edges(java_facts(spark))


@query("metric_catalog", f"WITH {fx.METRICS.sql} SELECT metric, weight, rule_id, optimal FROM (SELECT metric, weight, optimal, unnest(related) AS rule_id FROM metric_catalog) UNION ALL SELECT metric, weight, NULL, optimal FROM metric_catalog WHERE len(related) = 0")
def metric_catalog(spark, d):
    """SRC-22, API-07: a row for each rule that lowers a dimension."""
    return fx.METRICS.frame(spark).select("metric", "weight", F.explode_outer("related").alias("rule_id"), "optimal")
