"""Operator 9: approximate nearest neighbours by NN-descent and greedy graph search.

Equal vectors are one node. The neighbour graph starts at random: nodes are dealt
by ``STARTS`` hashes into small groups, and a node's first neighbours, ``DEGREE`` or
so, are those of its groups. Rounds of Spark joins improve it: each node's list is met with the lists
it is on (the best ``REVERSE`` of them), the vectors of these neighbours of
neighbours are brought together, products of pairs with at least one member that
was not met before are offered to both, and the best stay. Rounds end when few
neighbours change. Here vectors are codes of one byte a coordinate and a scale.

A query starts at its own node and searches greedily: each step opens the best
nodes not opened yet, scores the nodes on their lists by joins and keeps the best.
What is left is scored by products of the original vectors in double precision; of
each node found the smallest row ids are taken. A query that found fewer rows than
it should get is answered exactly, by operator 5's search without a scale.

Nearness is the inner product; vectors are compared as they are. Defined
results: vectors that are null, zero or hold a null or non-finite component take
no part; a shorter vector counts as filled up with zeros; rows with one id are
candidates of their own but never neighbours of that id, and one query (its
smallest vector); ties go to the smaller id; with fewer candidates than k all are
returned; an empty table gives an empty table; other columns are not read. Recall
is measured against brute force in the tests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithos.llm import exact_topk
from lithos.llm.common import drop_staged, forget_shuffles, staged, table, whole_groups
from lithos.llm.exact_topk import matrix, usable

#: Neighbours of a node, reverse neighbours met in a round at most, neighbours offered to a member of a group at most.
DEGREE, REVERSE, OFFERED = 40, 32, 8
#: Random groups of each node at the start.
STARTS = 4
#: Rounds at most, and the share of changed neighbours that ends them.
MOST_ROUNDS, SETTLED = 12, 0.02
#: Search: nodes kept, nodes opened in a step, steps; reverse neighbours on a node's list at most.
BEAM, OPENED, STEPS, LISTED = 160, 40, 6, 64
#: Parts in which distinct vectors are numbered; groups whose products are taken together.
PARTS, TOGETHER = 1024, 64


def vectors_of(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.transform(vec_col, lambda x: x.cast("double"))
    return df.where(F.col(id_col).isNotNull() & usable(F.col(vec_col))).select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.exists("v", lambda x: x != 0))


def with_codes(nodes: DataFrame, width: int) -> DataFrame:
    """(node, v) with a code: a scale in eight bytes, then each coordinate in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1), width, np.float64)
            scale = np.maximum(np.abs(x).max(1), np.finfo(np.float64).tiny) / 127
            code = np.concatenate([scale[:, None].view(np.uint8), np.rint(x / scale[:, None]).astype(np.int8).view(np.uint8)], 1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes() for c in code], pa.binary())], ["node", "v", "code"])

    return nodes.mapInArrow(run, "node long, v array<double>, code binary")


def decoded(codes: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Scales and whole-number rows of codes."""
    off = np.frombuffer(codes.buffers()[1], np.int32)[codes.offset : codes.offset + len(codes) + 1]
    raw = np.frombuffer(codes.buffers()[2] or b"", np.uint8)[off[0] : off[-1]].reshape(len(codes), 8 + width)
    return raw[:, :8].copy().view(np.float64)[:, 0], raw[:, 8:].view(np.int8).astype(np.float32)


EDGE = "a long, b long, s double, new boolean"


def offers(rows: DataFrame, width: int) -> DataFrame:
    """Edges between the members of groups, from (grp, node, new, floor, code): for each member its best, above its floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, first in whole_groups(batches, 1):
            node, new = np.asarray(t.column(1)), np.asarray(t.column(2))
            floor = np.nan_to_num(np.asarray(t.column(3).to_numpy(zero_copy_only=False), np.float64), nan=-np.inf)
            scale, x = decoded(t.column(4), width)
            size = np.diff(np.append(first, len(node)))
            for g in range(0, len(first), TOGETHER):
                begin, n = first[g : g + TOGETHER], size[g : g + TOGETHER]
                inside = np.arange(n.max()) < n[:, None]
                at = np.where(inside, begin[:, None] + np.arange(n.max()), 0)
                s = (x[at] @ x[at].transpose(0, 2, 1)).astype(np.float64) * (scale[at][:, :, None] * scale[at][:, None, :])
                ok = inside[:, :, None] & inside[:, None, :] & (new[at][:, :, None] | new[at][:, None, :]) & (node[at][:, :, None] != node[at][:, None, :]) & (s > floor[at][:, :, None])
                s = np.where(ok, s, -np.inf)
                if s.shape[2] > OFFERED:
                    who = np.argpartition(-s, OFFERED - 1, axis=2)[:, :, :OFFERED]
                    s = np.take_along_axis(s, who, 2)
                else:
                    who = np.broadcast_to(np.arange(s.shape[2]), s.shape)
                i, j, k = np.nonzero(s > -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(node[at[i, j]]), pa.array(node[at[i, who[i, j, k]]]), pa.array(s[i, j, k]), pa.array(np.ones(len(i), bool))], ["a", "b", "s", "new"])

    return rows.repartition("grp").sortWithinPartitions("grp").mapInArrow(run, EDGE)


def top_edges(edges: DataFrame) -> DataFrame:
    """The best distinct edges of each node; one that was there before is not new."""
    w = Window.partitionBy("a").orderBy(F.desc("s"), "b")
    once = edges.repartition("a").groupBy("a", "b").agg(F.max("s").alias("s"), F.min("new").alias("new"))
    return once.withColumn("r", F.row_number().over(w)).where(F.col("r") <= DEGREE).drop("r")


def random_start(nodes: DataFrame, width: int, n: int) -> DataFrame:
    """Edges inside random groups; several groups of a node join them all into one graph."""
    groups = max(1, n // (DEGREE // STARTS + 1))
    dealt = F.transform(F.sequence(F.lit(1), F.lit(STARTS)), lambda k: F.pmod(F.xxhash64("node", k), F.lit(groups)) * STARTS + k)
    return offers(nodes.select(F.explode(dealt).alias("grp"), "node", F.lit(True).alias("new"), F.lit(None).cast("double").alias("floor"), "code"), width)


def both_ways(edges: DataFrame, most: int) -> DataFrame:
    """(a, b, new): each node's list, with the best ``most`` of the nodes that list it."""
    w = Window.partitionBy("b").orderBy(F.desc("s"), "a")
    back = edges.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).select(F.col("b").alias("a"), F.col("a").alias("b"), "new")
    return edges.select("a", "b", "new").unionByName(back).groupBy("a", "b").agg(F.max("new").alias("new"))


def descend(nodes: DataFrame, edges: DataFrame, width: int) -> DataFrame:
    """One round: neighbours of neighbours offered to each other."""
    worst = edges.groupBy("a").agg(F.min("s").alias("m"), F.count(F.lit(1)).alias("c")).select(F.col("a").alias("node"), F.when(F.col("c") >= DEGREE, F.col("m")).alias("floor"))
    known = nodes.select("node", "code").join(worst, "node", "left")
    met = both_ways(edges, REVERSE).select(F.col("a").alias("grp"), F.col("b").alias("node"), "new")
    return offers(met.join(known, "node").select("grp", "node", "new", "floor", "code"), width)


def graph(nodes: DataFrame, width: int, n: int) -> DataFrame:
    """(a, b, s, new): each node's best neighbours."""
    edges = staged(top_edges(random_start(nodes, width, n)), "edges")
    for _ in range(MOST_ROUNDS):
        better = staged(top_edges(edges.withColumn("new", F.lit(False)).unionByName(descend(nodes, edges, width))), "edges")
        drop_staged(edges)
        forget_shuffles(nodes.sparkSession)
        edges = better
        total, changed = edges.agg(F.count(F.lit(1)), F.count_if("new")).first()
        if changed <= SETTLED * total:
            break
    return edges


def search(nodes: DataFrame, edges: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """(q, node): the nodes that a greedy search from each asked node's own list finds best.

    ``asked`` has (q, code). The state holds a bounded list for each query.
    """
    lists = staged(both_ways(edges, LISTED).groupBy("a").agg(F.collect_list("b").alias("near")).select(F.col("a").alias("node"), "near"), "lists")

    def scored(want: DataFrame) -> DataFrame:
        """Products of (q, node) pairs by their codes."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    (p, x), (r, y) = decoded(b.column(2), width), decoded(b.column(3), width)
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array((x * y).sum(1) * (p * r))], ["q", "node", "s"])

        rows = want.join(nodes.select("node", "code"), "node").join(asked.select("q", F.col("code").alias("own")), "q")
        return rows.select("q", "node", "code", "own").mapInArrow(run, "q long, node long, s double")

    state = staged(scored(asked.select("q", F.col("q").alias("node"))).withColumn("open", F.lit(True)), "beam")
    best = Window.partitionBy("q").orderBy(F.desc("s"), "node")
    for _ in range(STEPS):
        turn = state.withColumn("o", F.row_number().over(Window.partitionBy("q", "open").orderBy(F.desc("s"), "node")))
        opened = turn.where(F.col("open") & (F.col("o") <= OPENED))
        fresh = opened.select("q", "node").join(lists, "node").select("q", F.explode("near").alias("node")).distinct().join(state.select("q", "node"), ["q", "node"], "left_anti")
        kept = turn.withColumn("open", F.col("open") & (F.col("o") > OPENED)).drop("o")
        both = kept.unionByName(scored(fresh).withColumn("open", F.lit(True)))
        after = staged(both.withColumn("r", F.row_number().over(best)).where(F.col("r") <= BEAM).drop("r"), "beam")
        drop_staged(state)
        state = after
    return state.select("q", "node")


def products(found: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(q, node, s) of (q, node): products of the original vectors in double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = (matrix(b.column(2), width, np.float64) * matrix(b.column(3), width, np.float64)).sum(1) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s)], ["q", "node", "s"])

    v = nodes.select("node", "v")
    return found.join(v, "node").join(v.select(F.col("node").alias("q"), F.col("v").alias("own")), "q").select("q", "node", "v", "own").mapInArrow(run, "q long, node long, s double")


def nearest(df: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query, itself left out.

    Queries must be rows of ``df``: the search starts at their own nodes.
    """
    rows = staged(vectors_of(df, id_col, vec_col), "vectors")
    all_rows, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    # distinct vectors are numbered in parts, as one id may hold several of them
    own = rows.groupBy("v").agg(F.min("id").alias("id")).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS)))
    number = F.row_number().over(Window.partitionBy("part").orderBy("id", "v"))
    nodes = staged(with_codes(own.select((number.cast("long") * PARTS + F.col("part")).alias("node"), "v"), width), "nodes")
    edges = graph(nodes, width, nodes.count())
    # the smallest k + 1 ids of each node, kept in two steps so that a node of very many rows is no burden
    member = rows.join(nodes.select("node", "v"), "v")
    part = member.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64)))
    few = lambda d, *by: d.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where(F.col("r") <= k + 1).drop("r")
    ids = staged(few(few(part.select("node", "part", "id"), "node", "part").drop("part"), "node").groupBy("node").agg(F.collect_list("id").alias("ids")), "ids")
    wanted = queries.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id")).distinct()
    ask = staged(member.join(wanted, "id").groupBy("id").agg(F.min_by("node", "v").alias("q"), F.count(F.lit(1)).alias("own")), "asked")
    asked = staged(ask.select(F.col("q").alias("node")).distinct().join(nodes, "node").select(F.col("node").alias("q"), "code"), "asked")
    found = products(search(nodes, edges, asked, width), nodes, width).join(ids, "node").select("q", "s", F.explode("ids").alias("id"))
    # one list for each node that is asked for, however many rows ask for it
    w = Window.partitionBy("q").orderBy(F.desc("s"), "id")
    lists = found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1).groupBy("q").agg(F.sort_array(F.collect_list(F.struct("r", "id", "s"))).alias("near"))
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    given = staged(ask.withColumnRenamed("id", "query_id").join(lists, "q", "left").select("query_id", F.least(F.lit(k), F.lit(all_rows) - F.col("own")).alias("due"), F.coalesce(others, F.array()).alias("near")), "found")
    out = given.where("size(near) >= due").select("query_id", F.posexplode("near").alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.s").alias("score"))
    short = given.where("size(near) < due").select(F.col("query_id").alias("id"))
    if short.isEmpty():
        return out
    lacking = ask.join(short, "id").join(nodes.select(F.col("node").alias("q"), "v"), "q").select("id", "v")
    return out.unionByName(exact_topk.top_k(rows, lacking, k, "id", "v", None))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest found of every vector whose id is divisible by 20."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.where(F.col("vec_id") % 20 == 0), 20)
