"""Names resolved to what they mean: wrapper packages, beans by type name, steps by present rules (AGG-27, JOI-06, JOI-18)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: segments a wrapper has at most.
DEEPEST = 8


def wrapper_packages(names: DataFrame, group: str, dotted: str) -> DataFrame:
    """Per group the leading segments that all its dotted names share, or null.

    A segment is shared when its smallest and largest value are equal, so one
    aggregation with partial sums does for all depths. It counts only if at least
    two different names follow and one of them goes deeper.
    """
    parts = F.split(F.col(dotted), "\\.")
    rows = names.where(F.length(dotted) > 0).select(group, parts.alias("_p"))
    levels = range(DEEPEST + 1)
    seg = lambda i: F.get("_p", F.lit(i))
    low, high = F.array(*[F.min(seg(i)) for i in levels]), F.array(*[F.max(seg(i)) for i in levels])
    found = names.select(group).distinct().join(rows.groupBy(group).agg(low.alias("_low"), high.alias("_high"), F.max(F.size("_p")).alias("_deep")), group, "left")
    depth = F.lit(DEEPEST)
    for i in reversed(range(DEEPEST)):
        depth = F.when(F.get("_low", F.lit(i)) == F.get("_high", F.lit(i)), depth).otherwise(i)
    found = found.withColumn("_k", depth)
    reveals = (F.get("_low", F.col("_k")) != F.get("_high", F.col("_k"))) & (F.col("_deep") > F.col("_k") + 1) & (F.col("_k") > 0)
    return found.select(group, F.when(reveals, F.array_join(F.slice("_low", F.lit(1), F.greatest(F.col("_k"), F.lit(1))), ".")).alias("wrapper"))


def resolve_types(uses: DataFrame, imports: DataFrame, beans: DataFrame) -> DataFrame:
    """(use_id, bean_id) of uses (use_id, package, type): same package, named import, wildcard import, then the first bean of that simple name.

    ``imports`` has (use_id, name, asterisk, place); ``beans`` has (bean_id, simple, place).
    Every way is an equality join; the best one found stays.
    """
    ids = beans.select("bean_id").distinct()
    inside = lambda p, t: F.when(p == "", t).otherwise(F.concat(p, F.lit("."), t))
    same = uses.select("use_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("place"), inside(F.col("package"), F.col("type")).alias("bean_id"))
    met = uses.join(imports, "use_id")
    named = met.where(~F.col("asterisk") & (F.element_at(F.split("name", "\\."), -1) == F.col("type"))).select("use_id", F.lit(2), F.col("place").cast("long"), F.col("name"))
    wild = met.where("asterisk").select("use_id", F.lit(3), F.col("place").cast("long"), F.concat(F.regexp_replace("name", "\\.\\*$", ""), F.lit("."), F.col("type")))
    known = same.union(named).union(wild).join(ids, "bean_id", "left_semi").select("use_id", "rank", "place", "bean_id")
    first = beans.groupBy("simple").agg(F.min_by("bean_id", "place").alias("bean_id"))
    anywhere = uses.join(first, uses["type"] == first["simple"]).select("use_id", F.lit(4), F.lit(0).cast("long"), "bean_id")
    return known.union(anywhere).groupBy("use_id").agg(F.min_by("bean_id", F.struct("rank", "place")).alias("bean_id"))


def relevant_steps(steps: DataFrame, present: DataFrame, most: int = 3) -> DataFrame:
    """Steps (place, step, triggers) with those first that a present rule triggers."""
    hit = steps.select("place", F.explode("triggers").alias("rule_id")).join(present.select("rule_id").distinct(), "rule_id", "left_semi").select("place").distinct().withColumn("relevant", F.lit(True))
    return steps.join(hit, "place", "left").select("place", "step", F.coalesce("relevant", F.lit(False)).alias("relevant")).orderBy(F.desc("relevant"), "place").limit(most)
