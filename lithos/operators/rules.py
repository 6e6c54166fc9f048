"""The rule engine: a rule is a predicate and a severity over one grain (RUL-01..22, 24..29, 32)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithos.config import SEVERITIES, Thresholds
from lithos.functions.scalars import clone_severity


@dataclass(frozen=True)
class Rule:
    name: str
    grain: str
    fires: str
    severity: str


def rules(t: Thresholds = Thresholds()) -> list[Rule]:
    """The rules as data; predicates and severities are SQL over the grain's columns."""
    step = lambda cond, hi, lo: f"CASE WHEN {cond} THEN '{hi}' ELSE '{lo}' END"
    return [
        Rule("long-method", "unit", f"loc >= {t.long_method_loc} OR complexity >= {t.long_method_complexity}", step(f"loc >= {2 * t.long_method_loc} OR complexity >= {2 * t.long_method_complexity}", "major", "minor")),
        Rule("deep-nesting", "unit", f"max_depth >= {t.deep_nesting_depth}", step(f"max_depth >= {t.deep_nesting_depth + 2}", "major", "minor")),
        Rule("long-parameter-list", "unit", f"params >= {t.long_parameter_list}", step(f"params >= {2 * t.long_parameter_list}", "major", "minor")),
        Rule("excessive-complexity", "unit", f"complexity >= {t.excessive_complexity}", step(f"complexity >= {2 * t.excessive_complexity}", "critical", "major")),
        Rule("primitive-obsession", "unit", f"params >= {t.primitive_obsession_params} AND annotated = 0", "'info'"),
        Rule("god-function", "unit", f"loc >= {t.god_function_loc} AND complexity >= {t.god_function_complexity}", step(f"loc >= {2 * t.god_function_loc} AND complexity >= {2 * t.god_function_complexity}", "critical", "major")),
        Rule("god-class", "class", f"methods >= {t.god_class_methods} OR loc >= {t.god_class_loc}", step(f"methods >= {2 * t.god_class_methods} OR loc >= {2 * t.god_class_loc}", "major", "minor")),
        Rule("high-wmc", "class", f"wmc >= {t.high_wmc}", step(f"wmc >= {2 * t.high_wmc}", "major", "minor")),
        Rule("data-class", "class", f"attributes > 0 AND methods <= {t.data_class_methods}", "'info'"),
        Rule("lazy-class", "class", f"loc <= {t.lazy_class_loc} AND methods <= 2 AND NOT (methods = 0 AND attributes > 0)", "'info'"),
        Rule("low-cohesion", "module", f"files >= 2 AND ratio < {t.low_cohesion_ratio}", step(f"ratio < {t.low_cohesion_ratio / 2}", "major", "minor")),
        Rule("hub-dependency", "module", f"fan_in >= {t.hub_fan_in}", step(f"fan_in >= {2 * t.hub_fan_in}", "major", "minor")),
        Rule("unstable-dependency", "module", f"instability >= {t.unstable_instability} AND fan_in >= {t.hub_fan_in}", "'minor'"),
        Rule("god-package", "module", f"files >= {t.god_package_files} OR loc >= {t.god_package_loc}", step(f"files >= {2 * t.god_package_files} OR loc >= {2 * t.god_package_loc}", "major", "minor")),
        Rule("scattered-functionality", "module", f"fan_out >= {t.scattered_fan_out}", step(f"fan_out >= {2 * t.scattered_fan_out}", "major", "minor")),
        Rule("large-binary-file", "binary", f"bytes >= {t.large_binary_bytes}", step(f"bytes >= {5 * t.large_binary_bytes}", "major", "minor")),
    ]


KEY = {"unit": ["module_id", "file_id", "class_id", "unit_no"], "class": ["module_id", "class_id"], "module": ["module_id"], "binary": ["file_id"]}


def fire(facts: DataFrame, rule: Rule) -> DataFrame:
    """Findings of one rule: the grain's key, rule and severity. A null fact is no signal and never fires."""
    return facts.where(rule.fires).select(*KEY[rule.grain], F.lit(rule.name).alias("rule_id"), F.expr(rule.severity).alias("severity"))


def fire_all(grains: dict[str, DataFrame], chosen: list[Rule]) -> DataFrame:
    """Findings of all rules over their grains in one pass a grain: (grain, subject, rule_id, severity)."""
    out = []
    for grain, facts in grains.items():
        own = [r for r in chosen if r.grain == grain]
        if own:
            hits = F.array(*[F.when(F.expr(r.fires), F.struct(F.lit(r.name).alias("rule_id"), F.expr(r.severity).alias("severity"))) for r in own])
            subject = F.concat_ws("/", *[F.col(c).cast("string") for c in KEY[grain]])
            out.append(facts.select("module_id", F.lit(grain).alias("grain"), subject.alias("subject"), F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h")).select("module_id", "grain", "subject", "h.rule_id", "h.severity"))
    return reduce(DataFrame.unionByName, out)


def fire_counts(grains: dict[str, DataFrame], chosen: list[Rule]) -> DataFrame:
    """(module_id, rule_id, severity, n): how often each rule fires, as conditional sums in one pass a grain; no finding is made."""
    out = []
    for grain, facts in grains.items():
        cells = [(r, s) for r in chosen if r.grain == grain for s in SEVERITIES if f"'{s}'" in r.severity]
        if cells:
            sums = facts.groupBy("module_id").agg(*[F.count_if(F.expr(f"({r.fires}) AND ({r.severity}) = '{s}'")).alias(f"c{k}") for k, (r, s) in enumerate(cells)])
            each = F.array(*[F.struct(F.lit(r.name).alias("rule_id"), F.lit(s).alias("severity"), F.col(f"c{k}").alias("n")) for k, (r, s) in enumerate(cells)])
            out.append(sums.select("module_id", F.explode(each).alias("c")).select("module_id", "c.*").where("n > 0"))
    return reduce(DataFrame.unionByName, out)


def first_groups(counts: DataFrame, order: list[Column], most: int) -> list[tuple[str, str]]:
    """The (rule_id, severity) groups that hold the first ``most`` findings in an order that begins with these columns."""
    taken, left = [], most
    for r in counts.groupBy("rule_id", "severity").agg(F.sum("n").alias("n")).orderBy(*order).collect():  # a row for each rule and severity
        if left <= 0:
            break
        taken.append((r["rule_id"], r["severity"]))
        left -= r["n"]
    return taken


def only(chosen: list[Rule], groups: list[tuple[str, str]]) -> list[Rule]:
    """The rules, cut down to some of their severities."""
    return [Rule(r.name, r.grain, f"({r.fires}) AND ({r.severity}) IN ({', '.join(repr(s) for n, s in groups if n == r.name)})", r.severity) for r in chosen if r.name in {n for n, _ in groups}]


def text_line_rule(files: DataFrame, pattern: str, least: int, rule_id: str, low: str, high: str) -> DataFrame:
    """RUL-14: files with enough lines that match a pattern."""
    hits = F.size(F.filter(F.split("text", "\\r?\\n"), lambda line: line.rlike(pattern)))
    return files.select("file_id", hits.alias("hits")).where(F.col("hits") >= least).select("file_id", "hits", F.lit(rule_id).alias("rule_id"), F.when(F.col("hits") >= 3 * least, high).otherwise(low).alias("severity"))


def missing_names(roots: DataFrame, required: DataFrame) -> DataFrame:
    """RUL-24..27, SET-06: required (repo, rule_id, name) groups of which no name is among the root's names."""
    present = required.join(roots, ["repo", "name"], "left_semi").select("repo", "rule_id").distinct()
    return required.select("repo", "rule_id").distinct().join(present, ["repo", "rule_id"], "left_anti")


def python_findings(units: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """RUL-09..12 over ``python_source.units``: one finding for each empty catch, each large branch, and each unit of the others."""
    one = lambda name, severity: F.struct(F.lit(name).alias("rule_id"), severity.alias("severity"))
    step = lambda n, at, hi, lo: F.when(n >= at, hi).otherwise(lo)
    magic, operators = F.col("magic_numbers"), F.col("boolean_operators")
    hits = F.concat(
        F.array_repeat(one("empty-catch", F.lit("major")), F.col("empty_catches")),
        F.array_repeat(one("magic-numbers", step(magic, 3 * t.magic_number_min, "minor", "info")), F.when(magic >= t.magic_number_min, 1).otherwise(0)),
        F.array_repeat(one("long-boolean-expression", step(operators, 2 * t.long_boolean_operators, "major", "minor")), F.when(operators >= t.long_boolean_operators, 1).otherwise(0)),
        F.transform(F.filter("branches", lambda n: n >= t.large_match_cases), lambda n: one("large-match", step(n, 2 * t.large_match_cases, "major", "minor"))),
    )
    return units.where("error IS NULL").select("file", "class_name", "name", F.explode(hits).alias("h")).select("file", "class_name", "name", "h.rule_id", "h.severity")


CODE_LIKE = "^\\s*(def|class|import|from|return|if|elif|else|for|while|with|try|except|finally|raise|yield|async|await)\\b|^\\s*\\w+\\s*=\\s*[^=]|^\\s*\\w+\\(.*\\)\\s*$|^\\s*(self|cls)\\.\\w+"


def commented_code(files: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """RUL-13: files (file_id, text) with enough comment lines that look like code."""
    bodies = F.transform(F.filter(F.split("text", "\\r?\\n"), lambda s: s.rlike("^\\s*#")), lambda s: F.regexp_replace(F.regexp_replace(s, "^\\s+|\\s+$", ""), "^#+\\s?", ""))
    hits = F.size(F.filter(bodies, lambda s: s.rlike(CODE_LIKE)))
    return files.select("file_id", hits.alias("hits")).where(F.col("hits") >= t.commented_code_lines).select("file_id", "hits", F.lit("commented-out-code").alias("rule_id"), F.when(F.col("hits") >= 3 * t.commented_code_lines, "minor").otherwise("info").alias("severity"))


def cyclic_dependencies(components: DataFrame, anchors: DataFrame) -> DataFrame:
    """RUL-19: a finding for each cycle of ``graph.components`` whose first node has a file in ``anchors`` (graph, node, file)."""
    first = components.where("cyclic AND node = component").join(anchors.where("file <> ''"), ["graph", "node"])
    return first.select("graph", F.col("node").alias("module_id"), "file", F.lit("cyclic-dependencies").alias("rule_id"), F.when(F.col("size") >= 4, "critical").otherwise("major").alias("severity"))


#: Names of directories that builds make, and of those that are not entered.
BUILD_DIRS = ("dist", "build", "out", ".next", ".nuxt", "__pycache__", ".pytest_cache", "target", "bin")
SKIP_DIRS = (".git", "node_modules", ".venv", "venv", ".tox")


def build_artifacts(paths: DataFrame) -> DataFrame:
    """RUL-28: the outermost build directories above the files of (repo, path), outside skipped ones."""
    dirs = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    at = lambda names: F.array_min(F.filter(F.transform(F.array(*map(F.lit, names)), lambda n: F.array_position("dirs", n)), lambda k: k > 0))
    found = paths.select("repo", dirs.alias("dirs")).select("repo", "dirs", at(BUILD_DIRS).alias("b"), at(SKIP_DIRS).alias("s")).where("b IS NOT NULL AND (s IS NULL OR b < s)")
    return found.select("repo", F.array_join(F.slice("dirs", F.lit(1), F.col("b").cast("int")), "/").alias("file"), F.lit("build-artifacts-committed").alias("rule_id"), F.lit("minor").alias("severity")).distinct()


def duplicate_code(found: DataFrame, files: DataFrame) -> DataFrame:
    """RUL-32: a finding for each side of a clone (``clones.clones``) whose file is in (file, text); its lines are the larger side's."""
    per_line = F.transform(F.split("text", "\n"), lambda s: F.size(F.filter(F.split(s, "[^\\w]+"), lambda x: x != "")))
    at = files.select("file", F.flatten(F.transform(per_line, lambda n, k: F.array_repeat(k + 1, n))).alias("at"))
    start = lambda s: F.get(F.col(f"at_{s}"), F.col(f"start_{s}").cast("int"))
    end = lambda s: F.get(F.col(f"at_{s}"), (F.col(f"start_{s}") + F.col("tokens") - 1).cast("int"))
    both = found
    for side in "ab":
        both = both.join(at.select(F.col("file").alias(f"file_{side}"), F.col("at").alias(f"at_{side}")), f"file_{side}", "left")
    sides = F.array(*[F.struct(F.col(f"file_{s}").alias("file"), start(s).alias("start"), end(s).alias("end")) for s in "ab"])
    rows = both.select(sides.alias("sides"), F.greatest(end("a") - start("a"), end("b") - start("b")).alias("more")).select(F.explode("sides").alias("x"), (F.col("more") + 1).alias("lines"))
    return rows.where("x.start IS NOT NULL").select("x.file", "x.start", "x.end", "lines", F.lit("duplicate_code").alias("rule_id"), clone_severity(F.col("lines")).alias("severity"))
