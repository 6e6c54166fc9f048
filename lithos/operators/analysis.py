"""From source files to scores: the pipelines of the three languages and their merge (UDF-01, UDF-06, UDF-07, SET-01, SET-02, SET-05)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithos.config import Thresholds, Weights
from lithos.functions.scalars import dotted, loc_hash, loc_slash
from lithos.operators import graph, metrics, rules
from lithos.operators.resolution import wrapper_packages
from lithos.sources import files as scans
from lithos.sources import java_source, node_resolution, python_source, script_source

#: Rules that all languages have; Python has every one.
SHARED = ("long-method", "deep-nesting", "god-class")


@dataclass
class Facts:
    """Tables of one language, or of several merged ones.

    files: module_id, path, language, loc. units and classes: the columns that
    the rules of their grain read. edges: from_id, to_id, kind, weight. extra:
    findings that come from statements or file texts.
    """

    files: DataFrame
    units: DataFrame
    classes: DataFrame
    edges: DataFrame
    extra: DataFrame


UNIT = ("module_id", "file_id", "class_id", "unit_no", "name", "complexity", "cognitive", "loc", "max_depth", "params", "annotated")
CLASS = ("module_id", "class_id", "loc", "methods", "wmc", "attributes")
EXTRA = "module_id string, rule_id string, severity string, subject string"


def _units(rows: DataFrame, class_name: str, annotated) -> DataFrame:
    own = F.concat_ws("#", "file_id", F.coalesce(class_name, F.lit("")))
    return rows.withColumns({"class_id": own, "unit_no": F.concat_ws(":", "name", F.col("start").cast("string")), "annotated": annotated}).select(*UNIT)


def _classes(rows: DataFrame, units: DataFrame) -> DataFrame:
    sums = units.groupBy("class_id").agg(F.count(F.lit(1)).alias("methods"), F.sum("complexity").alias("wmc"))
    own = rows.withColumn("class_id", F.concat_ws("#", "file_id", "name")).select("module_id", "class_id", "loc", "attributes").join(sums, "class_id", "left")
    return own.select("module_id", "class_id", "loc", F.coalesce("methods", F.lit(0)).alias("methods"), F.coalesce("wmc", F.lit(0)).alias("wmc"), "attributes")


def _edges(links: DataFrame, modules: DataFrame) -> DataFrame:
    """File links (file, target) as edges between their modules."""
    a, b = modules.select(F.col("path").alias("file"), F.col("module_id").alias("from_id")), modules.select(F.col("path").alias("target"), F.col("module_id").alias("to_id"))
    return links.join(a, "file").join(b, "target").groupBy("from_id", "to_id").agg(F.count(F.lit(1)).alias("weight")).select("from_id", "to_id", F.lit("import").alias("kind"), "weight")


def python_facts(files: DataFrame, t: Thresholds = Thresholds()) -> Facts:
    """Of (path, text)."""
    own = scans.python_files(files)
    wrapper = wrapper_packages(own.select(F.lit("r").alias("repo"), dotted(F.col("path")).alias("d")), "repo", "d").select("wrapper")
    named = own.join(wrapper, F.lit(True)).select("path", "text", F.concat(F.lit("mod_"), node_resolution.clean(node_resolution.module_of_dotted(dotted(F.col("path")), F.col("wrapper")))).alias("module_id"))
    modules, source = named.select("path", "module_id"), own.select(F.col("path").alias("file"), "text")
    found = python_source.units(source).where("error IS NULL")
    with_module = lambda df: df.withColumnRenamed("file", "file_id").join(modules.withColumnRenamed("path", "file_id"), "file_id")
    units = _units(with_module(found), "class_name", F.col("annotated"))
    classes = _classes(with_module(python_source.classes(source)), units.where("class_id NOT LIKE '%#'"))
    links = python_source.resolve(python_source.imports(source), source.select("file")).where("file <> target")
    texts = named.select(F.col("path").alias("file_id"), "module_id", "text")
    lines = rules.text_line_rule(texts, "(^|[^A-Za-z0-9_])(TODO|FIXME|HACK|XXX)([^A-Za-z0-9_]|$)", t.todo_limit, "todo-accumulation", "info", "minor").unionByName(rules.commented_code(texts, t))
    of_file = lines.join(modules.withColumnRenamed("path", "file_id"), "file_id").select("module_id", "rule_id", "severity", F.col("file_id").alias("subject"))
    of_unit = with_module(rules.python_findings(found.withColumn("error", F.lit(None)), t)).select("module_id", "rule_id", "severity", F.concat_ws("#", "file_id", "name").alias("subject"))
    listed = named.select("module_id", "path", F.lit("python").alias("language"), loc_hash(F.col("text")).alias("loc"))
    return Facts(listed, units, classes, _edges(links, modules), of_file.unionByName(of_unit))


def script_facts(files: DataFrame, spaces: DataFrame | None = None, config: dict | None = None) -> Facts:
    """Of (path, text); workspaces and the configuration's aliases as ``node_resolution`` reads them."""
    spark, own = files.sparkSession, scans.node_files(files)
    spaces = spaces if spaces is not None else spark.createDataFrame([], "workspace string, package string, module_id string, display string")
    modules = node_resolution.modules_of(own.select("path"), spaces).select("path", "module_id")
    found = script_source.facts(own.select(F.col("path").alias("file"), "text"))
    with_module = found.withColumnRenamed("file", "file_id").join(modules.withColumnRenamed("path", "file_id"), "file_id")
    units = _units(with_module.where("what IN ('function', 'method')"), "owner", F.lit(None).cast("int"))
    classes = _classes(with_module.where("what = 'class'"), units.where("class_id NOT LIKE '%#'"))
    imports = found.where("what = 'import'").select(F.xxhash64("file", "name", "start").alias("id"), "file", F.col("name").alias("source"))
    links = node_resolution.resolve_imports(imports, own.select("path"), spaces, config).join(imports, "id").select("file", "target")
    kinds = F.when(F.lower("path").rlike("\\.([mc]?js|jsx)$"), "javascript").otherwise("typescript")
    listed = own.join(modules, "path").select("module_id", "path", kinds.alias("language"), loc_slash(F.col("text")).alias("loc"))
    return Facts(listed, units, classes, _edges(links, modules), spark.createDataFrame([], EXTRA))


def java_facts(files: DataFrame) -> Facts:
    """Of (path, text)."""
    own = scans.java_files(files)
    found = java_source.facts(own.select(F.col("path").alias("file"), "text"))
    last = F.when(F.col("package") == "", "_root").otherwise(F.element_at(F.split("package", "\\."), -1))
    modules = found.where("what = 'file'").select(F.col("file").alias("path"), F.concat(F.lit("mod_"), node_resolution.clean(last)).alias("module_id"), "loc")
    with_module = found.withColumnRenamed("file", "file_id").withColumn("params", F.size("params")).join(modules.select(F.col("path").alias("file_id"), "module_id"), "file_id")
    units = _units(with_module.where("what IN ('method', 'constructor')"), "owner", F.col("params"))
    fields = found.where("what = 'field'").groupBy(F.concat_ws("#", "file", "owner").alias("key")).agg(F.count(F.lit(1)).alias("attributes"))
    types = with_module.where("what = 'type'").withColumn("key", F.concat_ws("#", "file_id", "name")).join(fields, "key", "left").withColumn("attributes", F.coalesce("attributes", F.lit(0)))
    known = java_source.beans(found)
    edges = java_source.injections(found)
    at = modules.select(F.col("path").alias("file"), "module_id")
    skips = java_source.layer_skips(edges, known).join(at, "file").select("module_id", "rule_id", "severity", F.concat_ws("->", "from_id", "to_id").alias("subject"))
    first = known.select(F.col("id").alias("component"), "file").join(at, "file").select("component", "module_id")
    cycles = java_source.service_cycles(edges, known).join(first, "component").select("module_id", "rule_id", "severity", F.array_join("nodes", "->").alias("subject"))
    listed = modules.select("module_id", "path", F.lit("java").alias("language"), "loc")
    return Facts(listed, units, _classes(types, units), java_source.module_edges(found), skips.unionByName(cycles))


def merge(parts: dict[str, Facts]) -> Facts:
    """Facts of several languages as one; a module id that more than one of them has gets its language's name (SET-04, JOI-19)."""
    owners = reduce(DataFrame.unionByName, [p.files.select("module_id").distinct().withColumn("lang", F.lit(k)) for k, p in parts.items()])
    shared = owners.groupBy("module_id").agg(F.count_distinct("lang").alias("n")).where("n > 1").select("module_id")

    def renamed(df: DataFrame, lang: str, *cols: str) -> DataFrame:
        for c in cols:
            hit = shared.select(F.col("module_id").alias(c), F.lit(True).alias("_hit"))
            df = df.join(hit, c, "left").withColumn(c, F.when(F.col("_hit"), F.concat_ws("__", c, F.lit(lang))).otherwise(F.col(c))).drop("_hit")
        return df

    union = lambda get, *cols: reduce(DataFrame.unionByName, [renamed(get(p), k, *cols) for k, p in parts.items()])
    return Facts(union(lambda p: p.files, "module_id"), union(lambda p: p.units, "module_id"), union(lambda p: p.classes, "module_id"), union(lambda p: p.edges, "from_id", "to_id"), union(lambda p: p.extra, "module_id"))


def analyze(files: DataFrame, languages: tuple[str, ...] = ("python", "script", "java"), t: Thresholds = Thresholds(), w: Weights = Weights(), duplication: DataFrame | None = None, **script) -> dict[str, DataFrame]:
    """files, units, classes, edges, findings, modules (scores) and repo (score) of (path, text).

    ``duplication`` has one row with dup_ratio, or is left out when clones were not searched.
    """
    parts = {"python": lambda: python_facts(files, t), "script": lambda: script_facts(files, **script), "java": lambda: java_facts(files)}
    f = merge({k: parts[k]() for k in languages})
    f = Facts(*(x.persist() for x in (f.files, f.units, f.classes, f.edges, f.extra)))  # sources are parsed once
    lang = f.files.groupBy("module_id").agg(F.max(F.col("language") == "python").alias("python"), F.count(F.lit(1)).alias("files"), F.sum("loc").alias("loc"))
    modules = lang.select("module_id", F.col("module_id").alias("name"))
    pairs = f.edges.groupBy("from_id", "to_id").agg(F.sum("weight").alias("weight"), F.min("kind").alias("kind"), F.sum("weight").alias("n"))
    links = metrics.module_links(modules, pairs).join(lang.select("module_id", "files", "loc"), "module_id")
    fired = rules.fire_all({"unit": f.units, "class": f.classes, "module": links}, rules.rules(t)).join(lang.select("module_id", "python"), "module_id").where(F.col("python") | F.col("rule_id").isin(*SHARED)).select("module_id", "rule_id", "severity", "subject")
    found = fired.unionByName(f.extra)
    cycles = graph.components(pairs.withColumn("graph", F.lit("g"))).where("cyclic")
    scored = metrics.module_scorecard(f.units, modules, pairs, metrics.severity_histogram(found, "module_id"), cycles.select(F.col("node").alias("module_id")))
    signal = (F.col("files") > 1) & F.col("ratio").isNotNull()
    one = f.files.agg(F.coalesce(F.sum("loc"), F.lit(0)).alias("total_loc"))
    for part in (
        f.units.agg(F.count(F.lit(1)).alias("functions"), F.coalesce(F.sum(F.greatest(F.col("complexity") - t.long_method_complexity, F.lit(0))), F.lit(0)).alias("excess")),
        links.agg(F.count(F.lit(1)).alias("modules"), F.sum("fan_out").alias("fan_out_total"), F.max("fan_out").alias("fan_out_max"), F.max(F.col("fan_in") * F.col("fan_out")).alias("dual_hub_max"), F.sum(F.when(signal, F.col("ratio") * F.col("loc"))).alias("cohesion_weighted"), F.sum(F.when(signal, F.col("loc"))).alias("cohesion_loc")),
        cycles.agg(F.count_distinct("component").alias("cycles")), metrics.severity_histogram(found.withColumn("all", F.lit(1)), "all").drop("all"),
    ):
        one = one.join(part, F.lit(True), "left")  # rows of totals, one each
    one = one.join(duplication, F.lit(True), "left") if duplication is not None else one.withColumn("dup_ratio", F.lit(None).cast("double"))
    repo = metrics.repo_scores(one.fillna(0, [c for c in one.columns if c not in ("dup_ratio", "cohesion_loc", "cohesion_weighted")]).withColumns({"repo": F.lit("repo"), "pain": F.lit(0.0)}))
    return {"files": f.files, "units": f.units, "classes": f.classes, "edges": f.edges, "findings": found, "modules": scored, "repo": repo}
