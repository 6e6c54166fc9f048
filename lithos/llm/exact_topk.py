"""Operator 5: exact top-k inner products by norm-bucketed retrieval.

Vectors are dealt by length into range partitions and cut into groups of bounded
size, these into buckets of nearly equal length, longest first. For a query and
its k-th best score so far, a bucket gives a local cosine threshold: score /
(query's length * bucket's largest length). Above 1 the bucket is left out; where
it is high, coordinate pruning keeps the vectors whose values on the query's
largest coordinates can still reach it; else length pruning keeps the bucket's
long enough head. What is kept is verified by whole products.

Queries stay in tables: each is sent to the groups that its first threshold, from
the longest vectors, can't leave out. A task holds one group at a time, its
queries stream past it, and at most k rows a query and group come back.

Defined results: vectors that are null or hold a null or non-finite component
take no part; a shorter or empty vector counts as filled up with zeros; rows with
one id are separate candidates, but one query (its smallest vector) and never a
candidate of their own id; ties go to the smaller id; with fewer candidates than
k all are returned; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithos.llm.common import sent_whole, staged, table

BUCKET, SCALE = 1024, 1024
#: Vectors that a task holds at most, and at least where there are enough.
GROUP, GROUP_LEAST = 1 << 16, 1 << 13
#: From this local cosine on coordinates prune better than length; so many of a query's coordinates are looked at.
COORDINATE_FROM, FOCUS = 0.75, 4
SLACK = 1e-9


def usable(vec: Column) -> Column:
    return vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def numbers(df: DataFrame, id_col: str, vec_col: str, scale: int | None) -> DataFrame:
    """(id, v, length) of the vectors that take part; whole numbers after a scale, else as they are."""
    number = (lambda x: x.cast("double")) if scale is None else lambda x: F.floor(x.cast("double") * scale).cast("long")
    rows = df.where(F.col(id_col).isNotNull() & usable(F.col(vec_col))).select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, number).alias("v"))
    return rows.withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)))


def matrix(lists: pa.Array, width: int, kind: type) -> np.ndarray:
    """Lists as rows, filled up with zeros."""
    flat, off = np.asarray(lists.flatten(), kind), np.asarray(lists.offsets) - lists.offsets[0].as_py()
    size = np.diff(off)
    if (size == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lists), width), kind)
    for k in range(len(size)):
        out[k, : size[k]] = flat[off[k] : off[k + 1]]
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows; exact for whole numbers."""
    if a.dtype == np.float64:
        return a @ b.T
    top = max(1, int(np.abs(a).max(initial=0))) * max(1, int(np.abs(b).max(initial=0))) * a.shape[1]
    if top < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return (a @ b.T) if top < 1 << 63 else (a.astype(object) @ b.astype(object).T).clip(-(1 << 63), (1 << 63) - 1).astype(np.int64)


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, k: int, ids: np.ndarray, floor: np.ndarray):
        self.k, self.ids, self.floor = k, ids, floor  # floor: a score that the k-th best is known to reach
        self.found: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, floor.dtype), np.empty(0, np.int64)) for _ in ids]

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = (scores >= self.floor[q]) & (ids != self.ids[q])
        if not keep.any():
            return
        s, i = np.concatenate([self.found[q][0], scores[keep]]), np.concatenate([self.found[q][1], ids[keep]])
        order = np.lexsort((i, -s))[: self.k]
        self.found[q] = s[order], i[order]
        if len(order) == self.k:
            self.floor[q] = max(self.floor[q], s[order[-1]])


def search_bucket(best: Best, queries: np.ndarray, lengths: np.ndarray, ids: np.ndarray, size: np.ndarray, vectors: np.ndarray) -> None:
    """Offer a bucket's vectors (longest first) to all queries."""
    bound = lengths * size[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(bound > 0, best.floor / bound, np.where(best.floor > 0, np.inf, -np.inf))
    live = np.flatnonzero(local <= 1 + SLACK)
    by_coordinate = live[local[live] >= COORDINATE_FROM]
    by_length = live[local[live] < COORDINATE_FROM]
    if len(by_length):
        need = np.where(best.floor[by_length] > 0, best.floor[by_length] / np.maximum(lengths[by_length], 1e-300) * (1 - SLACK), 0)
        head = np.searchsorted(-size, -need, "right")  # vectors at least so long
        scores = products(queries[by_length], vectors[: head.max(initial=0)])
        for row, q in enumerate(by_length):
            best.add(q, scores[row, : head[row]], ids[: head[row]])
    if len(by_coordinate):
        unit = vectors / np.maximum(size, 1e-300)[:, None]
        for q in by_coordinate:
            t = np.minimum(best.floor[q] / np.maximum(lengths[q] * size, 1e-300), 1.0) - SLACK  # each vector's own threshold
            direction = queries[q] / lengths[q]
            keep = np.ones(len(ids), bool)
            for f in np.argsort(-np.abs(direction))[:FOCUS]:
                c = direction[f]
                spread = np.sqrt(np.maximum(0, (1 - t * t) * (1 - c * c)))
                free = np.abs(c) > t  # the cone about the query holds the axis itself: no bound
                keep &= free | ((unit[:, f] >= c * t - spread - 1e-6) & (unit[:, f] <= c * t + spread + 1e-6))
            at = np.flatnonzero(keep)
            if len(at):
                best.add(q, products(queries[q][None], vectors[at])[0], ids[at])


def grouped(vectors: DataFrame, n: int) -> DataFrame:
    """(grp, id, v, length): vectors in groups of bounded size and falling length."""
    spread = min(-(-n // GROUP_LEAST), int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = vectors.repartitionByRange(max(1, spread, -(-n // GROUP)), F.desc("length"), F.xxhash64("id")).sortWithinPartitions(F.desc("length"), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for b in batches:
            part = (at + np.arange(b.num_rows)) // GROUP
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(b.column(0)) << 32 | part), *b.columns[1:]], ["grp", "id", "v", "length"])
            at += b.num_rows

    kind = vectors.schema["v"].dataType.simpleString()
    return dealt.select(F.spark_partition_id().cast("long").alias("part"), "id", "v", "length").mapInArrow(run, f"grp long, id long, v {kind}, length double")


def first_floors(asked: DataFrame, seed: tuple[np.ndarray, np.ndarray], tops: np.ndarray, k: int, width: int, kind: type) -> DataFrame:
    """Queries with a score that their k-th best is known to reach, and the count of groups that can hold better ones."""
    ids, longest = seed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, own = matrix(b.column(1), width, kind), np.asarray(b.column(0))
            least = np.finfo(np.float64).min if kind is np.float64 else -(1 << 62)
            floor = np.full(len(q), least, kind)
            if len(ids) > k:
                s = products(q, longest)
                s[ids[None] == own[:, None]] = least
                floor = np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k]
            reach = tops[None] * np.asarray(b.column(2))[:, None] * (1 + SLACK)
            many = np.where(floor > 0, (reach >= floor[:, None]).sum(1), len(tops))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(floor), pa.array(many.astype(np.int32))], ["id", "v", "length", "floor", "many"])

    number = "double" if kind is np.float64 else "long"
    return asked.select("id", "v", "length").mapInArrow(run, f"id long, v array<{number}>, length double, floor {number}, many int")


def search(rows: DataFrame, k: int, width: int, kind: type) -> DataFrame:
    """(query_id, vec_id, score) from (rank, asked, id, v, length, floor): each group's best for the queries sent to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, cut = None, [], None
        for b in batches:
            rank, asked = np.asarray(b.column(0)), np.asarray(b.column(1))
            ends = [*(np.flatnonzero((rank[1:] != rank[:-1]) | (asked[1:] != asked[:-1])) + 1).tolist(), b.num_rows]
            for a, e in zip([0, *ends], ends):
                part = b.slice(a, e - a)
                if not part.num_rows:
                    continue
                ids, length, v = np.asarray(part.column(2)), np.asarray(part.column(4)), matrix(part.column(3), width, kind)
                if rank[a] != now:
                    now, held, cut = rank[a], [], None
                if not asked[a]:
                    held.append((ids, length, v))
                    continue
                if cut is None:
                    whole = [np.concatenate(x) for x in zip(*held, strict=True)]
                    cut, held = [tuple(x[c : c + BUCKET] for x in whole) for c in range(0, len(whole[0]), BUCKET)] if whole else [], []
                best = Best(k, ids, np.array(part.column(5)))
                for i, size, vec in cut:
                    search_bucket(best, v, length, i, size, vec)
                counts = [len(i) for _, i in best.found]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, counts)), pa.array(np.concatenate([i for _, i in best.found])), pa.array(np.concatenate([s for s, _ in best.found]))], ["query_id", "vec_id", "score"])

    return rows.mapInArrow(run, f"query_id long, vec_id long, score {'double' if kind is np.float64 else 'long'}")


def top_k(df: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", scale: int | None = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score of the k largest products of each query: of whole numbers, or without a scale of doubles."""
    spark, kind = df.sparkSession, np.int64 if scale else np.float64
    vectors = numbers(df, id_col, vec_col, scale)
    asked = numbers(queries, id_col, vec_col, scale).groupBy("id").agg(F.min(F.struct("v", "length")).alias("m")).select("id", "m.v", "m.length")
    n, width = vectors.agg(F.count(F.lit(1)), F.greatest(F.coalesce(F.max(F.size("v")), F.lit(1)), F.lit(1))).first()
    groups = staged(grouped(vectors, n), "vectors")
    tops = sorted(((r["top"], r["grp"]) for r in groups.groupBy("grp").agg(F.max("length").alias("top")).collect()), reverse=True)  # n / GROUP rows, or one a partition
    drawn = groups.orderBy(F.desc("length"), "id").limit(BUCKET).select("id", "v").toArrow().combine_chunks()
    seed = (np.asarray(drawn.column("id")), matrix(drawn.column("v").chunk(0), width, kind)) if drawn.num_rows else (np.zeros(0, np.int64), np.zeros((0, width), kind))
    floors = first_floors(asked, seed, np.array([t for t, _ in tops]), k, width, kind)
    number = floors.schema["floor"].dataType.simpleString()
    ranks = sent_whole(spark.createDataFrame([(g, r) for r, (_, g) in enumerate(tops)], "grp long, rank int"), 1 << 20)
    held = groups.join(ranks, "grp").select("rank", F.lit(False).alias("asked"), "id", "v", "length", F.lit(None).cast(number).alias("floor"))
    sent = floors.where("many > 0").select(F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias("rank"), F.lit(True).alias("asked"), "id", "v", "length", "floor")
    rows = held.unionByName(sent).repartition("rank").sortWithinPartitions("rank", "asked", F.desc("length"), "id")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return search(rows, k, width, kind).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best products of every vector whose id is divisible by 100."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(rows, rows.where(F.col("vec_id") % 100 == 0), 10)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM (SELECT * FROM v WHERE vec_id % 100 = 0) q JOIN v c ON q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10
"""
