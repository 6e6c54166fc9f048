"""Operator 6 [native]: mixing sources to target weights by temperature.

Token shares of the sources are raised to an exponent and normalised. The
exponent is found by bisection (here in sixteenths, so that few passes over the
table of sources are needed): the largest one whose weights still have the
target entropy, or the smallest one whose weights repeat no source more than a
limit. Each source's weight times the budget is its quota of tokens. It is
realised over the source's documents in a fixed random order, made of blocks:
documents fall into about sqrt(n) blocks, blocks and the documents inside each
are permuted by digests of their ids, and running token counts say how often a
document is passed before the quota is used up. A whole pass over a source is an
epoch; a document starts once more in each epoch that reaches it.

Nothing gathers a source in one task: blocks hold about sqrt(n) documents, and
block totals are about sqrt(n) rows. The table of sources is joined without a
hint, so that Spark broadcasts it by its measured size or splits the hot source.

Defined results: a null source is a source of its own; a null or empty text has
one token (its end); repeated rows are documents of their own; an empty table
gives an empty table; with one source its weight is 1. A target beyond what
exponents in [0, 1] give is met as nearly as they can.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithos.llm.common import staged, table

SECTIONS, PASSES, DIGITS = 16, 8, 6
#: Production parameters: entropy as a share of the largest possible; budget as a share of the corpus.
ENTROPY_SHARE, BUDGET_SHARE = 0.93, 1.0
SOURCE, TOKENS, DIGEST, BLOCK = "_mix_source", "_mix_tokens", "_mix_digest", "_mix_block"


def with_tokens(docs: DataFrame) -> DataFrame:
    """Documents with their source's key, token count (bytes and an end mark) and digest."""
    return docs.withColumns({
        SOURCE: F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")),
        TOKENS: F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1,
        DIGEST: F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")),
    })


def source_totals(docs: DataFrame) -> DataFrame:
    return docs.groupBy(SOURCE).agg(F.count(F.lit(1)).alias("n"), F.sum(TOKENS).alias("t"))


def at_exponents(sources: DataFrame, exponents: list[float], total: int) -> dict[float, tuple[float, float]]:
    """Per exponent: entropy of its weights, and the most often that a source's tokens repeat in a budget that covers all sources."""
    x = F.col("x")
    rows = sources.select((F.col("t") / F.lit(float(total))).alias("p"), F.explode(F.array(*[F.lit(float(e)) for e in exponents])).alias("x"))
    u = F.pow("p", x)
    got = rows.groupBy("x").agg(F.sum(u).alias("z"), F.sum(u * F.log(u)).alias("l"), F.max(u / F.col("p")).alias("hi"), F.min(u / F.col("p")).alias("lo")).collect()

    return {r["x"]: (math.log(r["z"]) - r["l"] / r["z"], r["hi"] / r["lo"]) for r in got}


def find_exponent(sources: DataFrame, total: int, entropy: float | None, most_repeats: float | None) -> float:
    """The exponent in [0, 1], to six digits; both measures fall as it grows."""
    enough = (lambda m: m[0] >= entropy) if entropy is not None else (lambda m: m[1] > most_repeats)
    lo, hi = 0.0, 1.0
    ends = at_exponents(sources, [lo, hi], total)
    if not enough(ends[lo]):
        return 0.0
    if enough(ends[hi]):
        return 1.0
    for _ in range(PASSES):
        grid = [lo + (hi - lo) * k / SECTIONS for k in range(SECTIONS + 1)]
        found = at_exponents(sources, grid, total)
        k = max(k for k in range(SECTIONS) if k == 0 or enough(found[grid[k]]))
        lo, hi = grid[k], grid[k + 1]
    scale = 10**DIGITS
    return int(lo * scale) / scale if entropy is not None else (int(lo * scale) + 1) / scale


def quotas(sources: DataFrame, exponent: float, total: int, budget: int | None) -> DataFrame:
    """Sources with blocks and quota; without a budget the smallest that cuts no source."""
    u = F.pow(F.col("t") / F.lit(float(total)), F.lit(exponent))
    one = sources.select(u.alias("u"), "t").agg(F.sum("u").alias("z"), F.max(F.col("t") * F.lit(1.0) / F.col("u")).alias("c")).first()
    if one["z"] is None:
        return sources.select(SOURCE, F.lit(1).cast("long").alias("_mix_blocks"), F.col("t").alias("_mix_all"), F.lit(0).cast("long").alias("_mix_quota"))
    spent = budget if budget is not None else one["z"] * one["c"]
    return sources.select(SOURCE, F.ceil(F.sqrt("n")).cast("long").alias("_mix_blocks"), F.col("t").alias("_mix_all"), F.floor(u / F.lit(one["z"]) * F.lit(float(spent)) + 0.5).cast("long").alias("_mix_quota"))


def planned(docs: DataFrame, entropy_share: float | None = ENTROPY_SHARE, most_repeats: float | None = None, budget_share: float | None = BUDGET_SHARE) -> DataFrame:
    """``docs`` (doc_id, text, source and any others) with tokens, block, tokens before it in its source's order, and copies."""
    docs = with_tokens(docs)
    sources = staged(source_totals(docs.select(SOURCE, TOKENS)), "sources")
    n, total = sources.agg(F.count(F.lit(1)), F.coalesce(F.sum("t"), F.lit(1))).first()

    exponent = find_exponent(sources, total, entropy_share * math.log(n) if entropy_share is not None and n else None, most_repeats) if n > 1 else 1.0
    q = quotas(sources, exponent, total, None if budget_share is None else int(total * budget_share + 0.5))
    key = F.conv(F.substring(DIGEST, 1, 8), 16, 10).cast("long")
    rows = docs.join(q, SOURCE).withColumn(BLOCK, F.pmod(key, F.col("_mix_blocks")))
    over = Window.partitionBy(SOURCE).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    narrow = docs.select(SOURCE, TOKENS, DIGEST).join(q, SOURCE).withColumn(BLOCK, F.pmod(key, F.col("_mix_blocks")))
    blocks = narrow.groupBy(SOURCE, BLOCK).agg(F.sum(TOKENS).alias("b")).select(SOURCE, BLOCK, F.coalesce(F.sum("b").over(over), F.lit(0)).alias("_mix_base"))
    inside = Window.partitionBy(SOURCE, BLOCK).orderBy(DIGEST, "doc_id", TOKENS).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_mix_in", F.coalesce(F.sum(TOKENS).over(inside), F.lit(0))).join(blocks, [SOURCE, BLOCK])
    before = F.col("_mix_base") + F.col("_mix_in")
    left = F.col("_mix_quota") - before
    return rows.withColumn("_mix_before", before).withColumn("_mix_copies", F.when(left > 0, F.floor((left - 1) / F.col("_mix_all")).cast("long") + 1).otherwise(F.lit(0).cast("long")))


def mix(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with each document as often as the mixture passes it; its columns stay as they are."""
    rows = planned(docs, **how)
    return rows.where("_mix_copies > 0").withColumn("_mix_epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_copies")))).select(*docs.columns)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in its source's order and how often the mixture passes it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return planned(docs).select("doc_id", "source", F.col(TOKENS).alias("tokens"), F.col(BLOCK).alias("block"), F.col("_mix_before").alias("tokens_before"), F.col("_mix_copies").alias("copies"))


OP6_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS k, CAST(coalesce(strlen(text), 0) + 1 AS BIGINT) AS tokens,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents),
s AS (SELECT k, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS t FROM d GROUP BY k),
g AS (SELECT CAST(sum(t) AS BIGINT) AS total, 0.93 * ln(count(*)) AS target FROM s),
bisect(i, lo, hi) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END
  FROM (SELECT b.i, b.lo, b.hi, (b.lo + b.hi) / 2 AS mid,
               (SELECT ln(sum(pow(s.t / g.total, (b.lo + b.hi) / 2))) - sum(pow(s.t / g.total, (b.lo + b.hi) / 2) * ln(pow(s.t / g.total, (b.lo + b.hi) / 2))) / sum(pow(s.t / g.total, (b.lo + b.hi) / 2)) FROM s, g) >= (SELECT target FROM g) AS ok
        FROM bisect b WHERE b.i < 50) x),
e AS (SELECT floor(lo * 1e6) / 1e6 AS x FROM bisect WHERE i = 50),
w AS (SELECT k, n, t, pow(t / total, x) AS u, total FROM s, g, e),
q AS (SELECT k, t, CAST(ceil(sqrt(n)) AS BIGINT) AS blocks, CAST(floor(u / (SELECT sum(u) FROM w) * total + 0.5) AS BIGINT) AS quota FROM w),
r AS (SELECT d.*, q.t, q.quota, CAST(('0x' || substr(digest, 1, 8)) AS BIGINT) % q.blocks AS block FROM d JOIN q USING (k)),
p AS (SELECT *, CAST(coalesce(sum(tokens) OVER (PARTITION BY k ORDER BY block, digest, doc_id, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS tokens_before FROM r)
SELECT doc_id, source, tokens, block, tokens_before,
       CASE WHEN quota > tokens_before THEN (quota - tokens_before - 1) // t + 1 ELSE 0 END AS copies FROM p
"""
