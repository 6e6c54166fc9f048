"""Graph operators over (from_id, to_id) edges (GRF-01..07, UDF-05).

Module graphs have at most some hundreds of nodes, so each graph is one group
and is solved in linear time inside it; graphs are keyed and solved in parallel.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def build(edges: DataFrame) -> DataFrame:
    """Parallel edges as one: weights summed, the first kind kept."""
    return edges.groupBy("graph", "from_id", "to_id").agg(F.sum("weight").alias("weight"), F.min("kind").alias("kind"))


def strong_components(pairs: Iterable[tuple[str, str]]) -> dict[str, str]:
    """Node -> smallest node of its strongly connected component (two passes of depth-first search, without recursion)."""
    out: dict[str, list[str]] = {}
    into: dict[str, list[str]] = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
        into.setdefault(b, []).append(a)
        out.setdefault(b, [])
        into.setdefault(a, [])
    order: list[str] = []
    seen: set[str] = set()
    for start in sorted(out):
        if start in seen:
            continue
        seen.add(start)
        walk = [(start, iter(out[start]))]
        while walk:
            node, rest = walk[-1]
            step = next((x for x in rest if x not in seen), None)
            if step is None:
                order.append(node)
                walk.pop()
            else:
                seen.add(step)
                walk.append((step, iter(out[step])))
    label: dict[str, str] = {}
    for start in reversed(order):
        if start in label:
            continue
        group, todo = {start}, [start]
        while todo:
            for x in into[todo.pop()]:
                if x not in label and x not in group:
                    group.add(x)
                    todo.append(x)
        label |= dict.fromkeys(group, min(group))
    return label


def components(edges: DataFrame) -> DataFrame:
    """(graph, node, component, size, cyclic): component is its smallest node; cyclic if larger than one or a self edge."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = list(zip(pdf.from_id, pdf.to_id, strict=True))
        label = strong_components(pairs)
        size = pd.Series(label).value_counts()
        loops = {a for a, b in pairs if a == b}
        rows = [(pdf.graph.iloc[0], n, c, int(size[c]), bool(size[c] > 1 or n in loops)) for n, c in sorted(label.items())]
        return pd.DataFrame(rows, columns=["graph", "node", "component", "size", "cyclic"])

    return edges.select("graph", "from_id", "to_id").distinct().groupBy("graph").applyInPandas(run, "graph string, node string, component string, size long, cyclic boolean")


def shortest_cycle(nodes: list[str], out: dict[str, list[str]]) -> list[str]:
    """The shortest closed path in a component; of equals the first in node order."""
    best: list[str] = []
    for start in sorted(nodes):
        back: dict[str, str | None] = {start: None}
        queue = deque([start])
        found = None
        while queue and found is None:
            node = queue.popleft()
            for x in sorted(out.get(node, [])):
                if x == start:
                    found = node
                    break
                if x not in back:
                    back[x] = node
                    queue.append(x)
        if found is None:
            continue
        path = [start]
        step: str | None = found
        while step is not None:
            path.append(step)
            step = back[step]
        path = path[::-1] if path[-1] == start else path
        path = [*path[:-1], start] if path[-1] != start else path
        if not best or len(path) < len(best):
            best = path
    return best


def cycle_paths(edges: DataFrame) -> DataFrame:
    """(graph, component, size, length): cyclic components and the length of their shortest cycle, with one such path."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = sorted(set(zip(pdf.from_id, pdf.to_id, strict=True)))
        label = strong_components(pairs)
        rows = []
        for c in sorted(set(label.values())):
            nodes = [n for n, l in label.items() if l == c]
            out: dict[str, list[str]] = {}
            for a, b in pairs:
                if label[a] == label[b] == c:
                    out.setdefault(a, []).append(b)
            if out:
                path = shortest_cycle(nodes, out)
                rows.append((pdf.graph.iloc[0], c, len(nodes), len(path) - 1, path))
        return pd.DataFrame(rows, columns=["graph", "component", "size", "length", "path"])

    return edges.select("graph", "from_id", "to_id").groupBy("graph").applyInPandas(run, "graph string, component string, size long, length long, path array<string>")


def inner_edges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """GRF-04: edges with both ends in one cyclic component."""
    a = labels.where("cyclic").select("graph", F.col("node").alias("from_id"), F.col("component"))
    b = labels.where("cyclic").select("graph", F.col("node").alias("to_id"), F.col("component").alias("component_b"))
    return edges.join(a, ["graph", "from_id"]).join(b, ["graph", "to_id"]).where("component = component_b").drop("component_b")


def mermaid(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GRF-06: lines of a diagram, nodes first."""
    clean = lambda c: F.regexp_replace(c, "[^A-Za-z0-9_]", "_")
    n = nodes.select(F.lit(0).alias("part"), F.concat(F.lit("  "), clean("module_id"), F.lit('["'), F.regexp_replace("module_id", '"', "'"), F.lit('"]')).alias("line"))
    e = edges.select(F.lit(1).alias("part"), F.concat(F.lit("  "), clean("from_id"), F.lit(" -->|"), F.col("kind"), F.lit("| "), clean("to_id")).alias("line"))
    return n.unionByName(e)


LAYERS = {
    "controller": "#ef4444,stroke:#b91c1c,color:#fff", "service": "#3b82f6,stroke:#1d4ed8,color:#fff", "module": "#10b981,stroke:#047857,color:#fff", "gateway": "#8b5cf6,stroke:#6d28d9,color:#fff", "guard": "#f59e0b,stroke:#b45309,color:#000",
    "pipe": "#06b6d4,stroke:#0e7490,color:#fff", "interceptor": "#ec4899,stroke:#be185d,color:#fff", "filter": "#64748b,stroke:#334155,color:#fff", "provider": "#94a3b8,stroke:#475569,color:#000", "untagged": "#e2e8f0,stroke:#94a3b8,color:#0f172a",
}


def layer_diagram(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """GRF-07: (part, module_pos, pos, line), in that order: a subgraph for each module with tagged classes, and edges between their first ones.

    ``classes`` has (module_pos, module_id, module_name, module_tags, pos, class_id, class_name, tags) and ``edges`` has (pos, from_id, to_id, kind).
    """
    clean, label = lambda c: F.regexp_replace(c, "[^a-zA-Z0-9_]", "_"), lambda c: F.replace(c, F.lit('"'), F.lit('\\"'))
    spark = classes.sparkSession
    head = spark.createDataFrame([(0, 0, k, x) for k, x in enumerate(["graph TD", *[f"  classDef {n} fill:{v}" for n, v in LAYERS.items()]])], "part int, module_pos long, pos long, line string")
    c = classes.where(F.size("tags") > 0).withColumn("node", clean(F.concat_ws("_", "module_id", "class_id")))
    mods = c.groupBy("module_pos", "module_id", "module_name", "module_tags").agg(F.min_by("node", "pos").alias("anchor"))
    tags = F.when(F.size("module_tags") > 0, F.concat(F.lit("\\n["), F.array_join("module_tags", ","), F.lit("]"))).otherwise("")
    own = F.array_compact(F.transform("tags", lambda t: F.when(t.startswith("layer:"), F.substring(t, 7, 999))))
    layer = F.coalesce(F.get(own, 0), F.lit("untagged"))
    row = lambda df, part, pos, line: df.select(F.lit(part).alias("part"), F.col("module_pos").cast("long").alias("module_pos"), pos.cast("long").alias("pos"), line.alias("line"))
    opened = row(mods, 1, F.lit(-1), F.concat(F.lit("  subgraph "), clean("module_id"), F.lit('["'), label(F.concat("module_name", tags)), F.lit('"]')))
    inside = row(c, 1, F.col("pos"), F.concat(F.lit("    "), "node", F.lit('["'), label(F.col("class_name")), F.lit('"]:::'), layer))
    closed = row(mods, 1, F.lit((1 << 63) - 1), F.lit("  end"))
    a, b = mods.select(F.col("module_id").alias("from_id"), F.col("anchor").alias("a")), mods.select(F.col("module_id").alias("to_id"), F.col("anchor").alias("b"))
    met = edges.join(a, "from_id").join(b, "to_id").where("a <> b").withColumn("module_pos", F.lit(0))
    between = row(met, 2, F.col("pos"), F.concat(F.lit("  "), "a", F.lit(" -->|"), "kind", F.lit("| "), "b"))
    return head.unionByName(opened).unionByName(inside).unionByName(closed).unionByName(between)
