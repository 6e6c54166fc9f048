"""Aggregations over program facts (AGG-01..29) and their scores (2.14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithos.config import SEVERITY_COST, Weights


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))


def round2(x: Column) -> Column:
    """Half up on the binary product."""
    return F.floor(x * 100 + 0.5) / 100


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("E")


def aggregate_edges(edges: DataFrame) -> DataFrame:
    return edges.groupBy("from_id", "to_id", "kind").agg(F.sum("weight").alias("weight"))


def coupling(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """Fan-in, fan-out (rows, self edges left out) and instability of every module; null where nothing is known."""
    ends = edges.where("from_id <> to_id").select(F.explode(F.array(F.struct(F.col("from_id").alias("module_id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("to_id").alias("module_id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    counts = ends.groupBy("module_id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    out = modules.join(counts, "module_id", "left").withColumns({"fan_in": F.coalesce("fan_in", F.lit(0)), "fan_out": F.coalesce("fan_out", F.lit(0))})
    return out.withColumn("instability", F.try_divide("fan_out", F.col("fan_in") + F.col("fan_out")))


def cohesion(edges: DataFrame) -> DataFrame:
    """Per source module: internal and external edges and their ratio."""
    inner = F.count_if(F.col("from_id") == F.col("to_id"))
    return edges.groupBy(F.col("from_id").alias("module_id")).agg(inner.alias("internal"), (F.count(F.lit(1)) - inner).alias("external")).withColumn("ratio", F.try_divide("internal", F.col("internal") + F.col("external")))


def module_links(modules: DataFrame, pairs: DataFrame) -> DataFrame:
    """``coupling`` with the cohesion ratio, in one pass over pairs that stand for ``n`` edges each."""
    other = (F.col("from_id") != F.col("to_id")).cast("int")
    side = lambda m, i, o, inner, every: F.struct(m.alias("module_id"), i.alias("i"), o.alias("o"), inner.alias("inner"), every.alias("every"))
    zero = F.lit(0).cast("long")
    ends = pairs.select(F.explode(F.array(side(F.col("from_id"), F.lit(0), other, F.when(other == 0, F.col("n")).otherwise(zero), F.col("n")), side(F.col("to_id"), other, F.lit(0), zero, zero))).alias("e")).select("e.*")
    sums = ends.groupBy("module_id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"), F.sum("inner").alias("inner"), F.sum("every").alias("every"))
    out = modules.join(sums, "module_id", "left").withColumns({"fan_in": F.coalesce("fan_in", F.lit(0)), "fan_out": F.coalesce("fan_out", F.lit(0)), "ratio": F.try_divide("inner", "every")}).drop("inner", "every")
    return out.withColumn("instability", F.try_divide("fan_out", F.col("fan_in") + F.col("fan_out")))


def counted_histogram(counts: DataFrame, *by: str) -> DataFrame:
    """The histogram from counts (``n``) by rule and severity."""
    return counts.groupBy(*by).agg(*[F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("n"))), F.lit(0)).alias(s) for s in SEVERITY_COST])


def severity_histogram(findings: DataFrame, *by: str) -> DataFrame:
    return findings.groupBy(*by).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITY_COST])


def merged_ranges(ranges: DataFrame, *key: str) -> DataFrame:
    """AGG-20, WIN-07: lines covered by (start, end) ranges of each key; ranges that overlap or touch are one."""
    w = Window.partitionBy(*key).orderBy("start", "end")
    upto = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = ranges.withColumn("new", F.when(upto.isNull() | (F.col("start") > upto + 1), 1).otherwise(0)).withColumn("island", island)
    return marked.groupBy(*key, "island").agg((F.max("end") - F.min("start") + 1).alias("n")).groupBy(*key).agg(F.sum("n").alias("covered"))


def smell_score(total_loc: Column) -> Column:
    cost = sum((F.col(s) * 1000 / F.greatest(total_loc, F.lit(500)) * c for s, c in SEVERITY_COST.items()), F.lit(0.0))
    return clamp(100 - cost)


def overall(parts: dict[str, Column], noted: dict[str, Column], w: Weights = Weights()) -> Column:
    """Weighted mean of the dimensions that carry no note; 0 if none does."""
    share = {k: F.when(noted.get(k, F.lit(False)), 0.0).otherwise(getattr(w, k)) for k in parts}
    top, low = sum((F.coalesce(parts[k], F.lit(0.0)) * share[k] for k in parts), F.lit(0.0)), sum(share.values(), F.lit(0.0))
    return F.when(low > 0, top / low).otherwise(0.0)


def module_scorecard(units: DataFrame, modules: DataFrame, edges: DataFrame, histogram: DataFrame, in_cycle: DataFrame) -> DataFrame:
    """AGG-12: five scores, the overall score and grade of each module; edges are one for each pair of modules."""
    size = units.groupBy("module_id").agg(F.sum("loc").alias("loc"), F.avg("complexity").alias("avg_cx"), F.sum(F.greatest(F.col("complexity") - 10, F.lit(0))).alias("excess"), F.count(F.lit(1)).alias("functions"))
    facts = (
        module_links(modules, edges.withColumn("n", F.lit(1).cast("long"))).join(size, "module_id", "left")
        .join(histogram, "module_id", "left").join(in_cycle.withColumn("cyc", F.lit(1)), "module_id", "left")
        .fillna(0, ["loc", "excess", "functions", "cyc", *SEVERITY_COST])
    )
    zero = F.lit(0.0)
    i, o = F.col("fan_in"), F.col("fan_out")
    pen = F.greatest(zero, o - 2) * 4 + F.when(o == 0, F.greatest(zero, i - 4) * 3).otherwise(0.0) + F.greatest(zero, i * o - 6) * 2 + F.greatest(zero, F.coalesce("instability", zero) - 0.7) * 40 + F.col("cyc") * 15
    parts = {
        "complexity": clamp(100 - 2 * F.coalesce(F.try_divide(F.col("excess"), F.col("loc") / 1000.0), zero) - F.greatest(zero, F.coalesce("avg_cx", zero) - 4) * 4),
        "duplication": F.lit(100.0),
        "coupling": clamp(100 - pen),
        "cohesion": F.coalesce(F.col("ratio") * 100, F.lit(100.0)),
        "smells": smell_score(F.col("loc")),
    }
    noted = {"complexity": F.col("functions") == 0, "duplication": F.lit(True), "coupling": (i == 0) & (o == 0), "cohesion": F.col("ratio").isNull()}
    rows = facts.select("module_id", *[p.alias(k) for k, p in parts.items()], overall(parts, noted).alias("overall"))
    return rows.select("module_id", *[round2(F.col(k)).alias(k) for k in (*parts, "overall")], grade(round2(F.col("overall"))).alias("grade"))


def repo_scores(x: DataFrame) -> DataFrame:
    """AGG-11: one row per repository from its totals (see the columns used); scores, overall and grade."""
    k, n, zero = F.col("total_loc") / 1000.0, F.col("modules"), F.lit(0.0)
    fan = F.greatest(zero, F.col("fan_out_total") / n - 1) * 10 + F.greatest(zero, F.col("fan_out_max") - F.greatest(F.lit(5), F.ceil(0.3 * n))) * 4 + F.greatest(zero, F.col("dual_hub_max") - F.greatest(F.lit(25), 4 * n)) * 1.5
    parts = {
        "complexity": clamp(100 - 2 * F.coalesce(F.try_divide(F.col("excess"), k), zero)),
        "duplication": F.coalesce(clamp(100 - 100 * F.col("dup_ratio")), F.lit(100.0)),
        "coupling": clamp(100 - F.coalesce(fan, zero) - F.col("pain") * 6 - F.col("cycles") * 15),
        "cohesion": F.coalesce(clamp(100 * F.try_divide(F.col("cohesion_weighted"), F.col("cohesion_loc"))), F.lit(100.0)),
        "smells": smell_score(F.col("total_loc")),
    }
    noted = {"complexity": F.col("functions") == 0, "duplication": F.col("dup_ratio").isNull(), "coupling": (n <= 1) | (F.col("fan_out_total") == 0), "cohesion": F.coalesce(F.col("cohesion_loc"), F.lit(0)) == 0}
    rows = x.select("repo", *[p.alias(c) for c, p in parts.items()], overall(parts, noted).alias("overall"))
    return rows.select("repo", *[round2(F.col(c)).alias(c) for c in (*parts, "overall")], grade(round2(F.col("overall"))).alias("grade"))
