"""Operator 7 [native]: sharding by sampled splitters.

Records are put in order over shards of near-equal bytes: by key, of equal keys by
a mix of checksum and size, of equal records by a number that tells them apart. So
no key and no text is too common to be cut. Places in this order are drawn with a
chance in proportion to their record's size; quantiles of the sample are the
splitters of fine ranges. The exact size of each range is then taken, and an
overfull range is sampled again and subdivided until it is small enough or one
record. Prefix sums over the ranges (a list of bounded length) and, inside each
range, over its records give every record's exact place in the whole order, and
so its shard and slot. The splitters shape the work only: the result depends on
the records alone. Texts are read once, for the records' sizes and checksums.

Defined results: a null text counts 0 bytes and has the checksum of no bytes; a
null key sorts first; repeated rows differ in their slot (and, where a shard ends
among them, their shard) alone; an empty table gives an empty table; columns
besides key and text are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithos.llm.common import staged, table

#: Sampled records of a range; ranges at first, at most; a range is overfull beyond so many times its share.
SAMPLES_A_RANGE = 24
MOST_RANGES = 1 << 14
OVERFULL = 2.0
#: Times that overfull ranges are subdivided; what is overfull then is only slower.
ROUNDS = 8


def chance(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the columns alone."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / float(1 << 53)


def literals(values: list) -> Column:
    """A constant array of whole numbers or of plain strings."""
    return F.expr("array(" + ", ".join(f"{v}L" if isinstance(v, int) else f"'{v}'" for v in values) + ")")


def range_of(place: Column, splitters: list[str]) -> Column:
    """How many splitters are <= place, by bisection over a constant array."""
    if not splitters:
        return F.lit(0)
    steps = F.sequence(F.lit(1), F.lit(len(splitters).bit_length()))

    def step(a: Column, _: Column) -> Column:
        mid = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        right = (a["lo"] < a["hi"]) & (F.get(literals(splitters), mid) <= place)
        return F.struct(F.when(right, mid + 1).otherwise(a["lo"]).alias("lo"), F.when(right | (a["lo"] >= a["hi"]), a["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(splitters)).alias("hi")), step)["lo"]


def records(df: DataFrame, key_col: str, text_col: str) -> DataFrame:
    """(key, size, crc, place): each record with a text that sorts as the records do."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    hexed = lambda x: F.lpad(F.hex(x), 16, "0")
    rows = df.select(F.col(key_col).cast("long").alias("key"), (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text.cast("binary")).alias("crc"))
    key = F.when(F.col("key").isNull(), F.lit("0" * 17)).otherwise(F.concat(F.lit("1"), hexed(F.col("key").bitwiseXOR(F.lit(-(1 << 63))))))
    return rows.withColumn("place", F.concat(key, hexed(F.xxhash64("crc", "size")), hexed(F.xxhash64(F.monotonically_increasing_id()))))


def sampled(rows: DataFrame, total: int, wanted: int, salt: int) -> list[str]:
    """Places drawn independently, each record with the chance wanted * size / total (about ``wanted`` in all)."""
    hit = chance("place", F.lit(salt)) < F.col("size") * (wanted / max(total, 1))
    return sorted(r[0] for r in rows.where(hit).select("place").collect())


def quantiles(sample: list[str], parts: int) -> list[str]:
    return sorted({sample[len(sample) * k // parts] for k in range(1, parts)}) if sample else []


def find_splitters(rows: DataFrame, parts: int, total: int) -> tuple[list[str], list[tuple[int, int]]]:
    """Splitters of records into ``parts`` ranges or more, and each range's bytes and rows."""
    splitters = quantiles(sampled(rows, total, parts * SAMPLES_A_RANGE, 0), parts)
    for k in range(1, ROUNDS + 1):
        found = {r["r"]: (r["bytes"], r["rows"]) for r in rows.groupBy(range_of(F.col("place"), splitters).alias("r")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()}
        sizes = [found.get(r, (0, 0)) for r in range(len(splitters) + 1)]
        full = [r for r, (size, n) in enumerate(sizes) if size > OVERFULL * total / parts and n > 1]
        if not full or k == ROUNDS:
            break
        drawn: dict[int, list[str]] = {r: [] for r in full}
        share = {r: 1 + int(sizes[r][0] * parts / total) for r in full}
        for x in sampled(rows.where(range_of(F.col("place"), splitters).isin(full)), sum(sizes[r][0] for r in full), sum(share.values()) * SAMPLES_A_RANGE, k):
            drawn[bisect_right(splitters, x)].append(x)
        splitters = sorted({*splitters, *(x for r in full for x in quantiles(drawn[r], share[r]))})
    return splitters, sizes


def shard(df: DataFrame, n_shards: int, key_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """One row per record: key, size, text_crc32, law, shard, slot, grown_shard (null: the law is not ``key``)."""
    rows = staged(records(df, key_col, text_col), "records")
    wide = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = max(1, rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    splitters, sizes = find_splitters(rows, min(MOST_RANGES, parts or max(4 * n_shards, 2 * wide)), total)
    bytes0, rows0 = ([0, *accumulate(x)] for x in zip(*sizes, strict=True))
    inside = Window.partitionBy("r").orderBy("place")
    before = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    byte_at, row_at = F.get(literals(bytes0), F.col("r")) + before, F.get(literals(rows0), F.col("r")) + F.row_number().over(inside) - 1

    def placed(some: DataFrame) -> DataFrame:
        own = some.withColumn("r", range_of(F.col("place"), splitters)).withColumns({"byte_at": byte_at, "at": row_at})
        return own.withColumn("shard", F.expr(f"CAST(least({n_shards - 1}L, (byte_at * {n_shards}L) div {total}L) AS INT)"))

    # a shard begins where a range does or inside one of at most n_shards ranges
    ends = [min(n_shards - 1, b * n_shards // total) for b in bytes0]
    first: dict[int, int] = {}
    for r in range(len(sizes)):
        if sizes[r][1]:
            first[ends[r]] = min(rows0[r], first.get(ends[r], rows0[r]))
    crossed = [r for r in range(len(sizes)) if ends[r] != ends[r + 1]]
    if crossed:
        for x in placed(rows.where(range_of(F.col("place"), splitters).isin(crossed))).groupBy("shard").agg(F.min("at").alias("at")).collect():
            first[x["shard"]] = min(x["at"], first.get(x["shard"], x["at"]))
    begin = literals([first.get(s, 0) for s in range(n_shards)])
    return placed(rows).select(F.col("key").alias(key_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("at") - F.get(begin, F.col("shard"))).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 40 shards of near-equal bytes, in the order of their ids."""
    return shard(table(spark, sf_dir, "documents"), 40)
