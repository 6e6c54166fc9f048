"""Python sources to program facts, with the stdlib parser (SRC-08, SCL-04; the facts of RUL-09..12)."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithos.functions.scalars import loc_hash

PLAIN_NUMBERS = (0, 1, -1, 2, 10, 100, 1000)


def is_elif(node: ast.AST, parent: ast.If) -> bool:
    """An elif starts in its if's column, an if under else further right."""
    return isinstance(node, ast.If) and len(parent.orelse) == 1 and node.col_offset == parent.col_offset


def complexity(body: list[ast.stmt]) -> tuple[int, int, int]:
    """Cyclomatic and cognitive complexity and nesting depth of a body (SCL-04).

    Branches: if, elif, for, while, except, conditional expressions, assert, match
    and its cases; levels: if, elif, else, for, while, try, with, match. All elifs
    and the else of an if are one level below it.
    """
    cyc, cog, deepest = 1, 0, 0
    todo: list[tuple[ast.AST, int]] = [(n, 0) for n in body]

    def below(nodes: list, depth: int) -> None:
        nonlocal deepest
        deepest = max(deepest, depth)
        todo.extend((n, depth) for n in nodes)

    while todo:
        node, depth = todo.pop()
        if isinstance(node, ast.If):
            cyc, cog = cyc + 1, cog + 1 + depth
            below([node.test, *node.body], depth + 1)
            last = node
            while last.orelse and is_elif(last.orelse[0], last):
                last = last.orelse[0]
                cyc, cog = cyc + 1, cog + 2 + depth
                below([last.test, *last.body], depth + 2)
            if last.orelse:
                below(last.orelse, depth + 2)
            continue
        if isinstance(node, (ast.For, ast.AsyncFor, ast.While)):
            cyc, cog = cyc + 1, cog + 1 + depth
            below([n for n in ast.iter_child_nodes(node) if n not in node.orelse], depth + 1)
            if node.orelse:
                below(node.orelse, depth + 2)
        elif isinstance(node, (ast.Try, ast.TryStar)):
            below([*node.body, *node.handlers, *node.finalbody], depth + 1)
            if node.orelse:
                below(node.orelse, depth + 2)
        else:
            if isinstance(node, (ast.ExceptHandler, ast.IfExp, ast.Assert, ast.match_case, ast.Match)):
                cyc, cog = cyc + 1, cog + 1 + depth
            elif isinstance(node, ast.BoolOp):
                cyc, cog = cyc + len(node.values) - 1, cog + len(node.values) - 1
            elif isinstance(node, ast.comprehension):
                cyc, cog = cyc + len(node.ifs), cog + len(node.ifs) * (1 + depth)
            if isinstance(node, (ast.With, ast.AsyncWith, ast.Match)):
                below(list(ast.iter_child_nodes(node)), depth + 1)
            else:
                todo += [(c, depth) for c in ast.iter_child_nodes(node)]
    return cyc, cog, deepest


def branches(node: ast.AST) -> int:
    """Ways of a match, or of an if with its elifs."""
    if isinstance(node, ast.Match):
        return len(node.cases)
    ways = 1
    while node.orelse and is_elif(node.orelse[0], node):
        ways, node = ways + 1, node.orelse[0]
    return ways


def code_lines(lines: list[str], node: ast.AST) -> int:
    return sum(bool(x.strip()) and not x.strip().startswith("#") for x in lines[node.lineno - 1 : node.end_lineno])


def unit_facts(fn: ast.FunctionDef | ast.AsyncFunctionDef, owner: str | None, lines: list[str]) -> dict:
    cyc, cog, depth = complexity(fn.body)
    args = [*fn.args.posonlyargs, *fn.args.args, *fn.args.kwonlyargs]
    defaults = {id(x) for d in (*fn.args.defaults, *fn.args.kw_defaults) if d is not None for x in ast.walk(d)}
    walk = [n for s in fn.body for n in ast.walk(s)]
    elifs = {id(n.orelse[0]) for n in walk if isinstance(n, ast.If) and branches(n) > 1}
    conditions = [n.test for n in walk if isinstance(n, (ast.If, ast.While, ast.Assert))] + [n.value for n in walk if isinstance(n, ast.Return) and n.value]
    return {
        "kind": "method" if owner else "function", "class_name": owner, "name": fn.name, "start": fn.lineno, "end": fn.end_lineno, "loc": code_lines(lines, fn), "complexity": cyc, "cognitive": cog, "max_depth": depth,
        "params": len(args), "annotated": sum(a.annotation is not None for a in args), "empty_catches": sum(isinstance(n, ast.ExceptHandler) and all(isinstance(s, ast.Pass) or isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant) and s.value.value is ... for s in n.body) for n in walk),
        "magic_numbers": sum(isinstance(n, ast.Constant) and type(n.value) in (int, float) and n.value not in PLAIN_NUMBERS and id(n) not in defaults for n in walk),
        "boolean_operators": max((sum(len(b.values) - 1 for b in ast.walk(c) if isinstance(b, ast.BoolOp)) for c in conditions), default=0), "largest_match": max((branches(n) for n in walk if isinstance(n, (ast.Match, ast.If)) and id(n) not in elifs), default=0),
        "branches": [branches(n) for n in walk if isinstance(n, (ast.Match, ast.If)) and id(n) not in elifs],
    }


UNIT = "file string, kind string, class_name string, name string, start int, end int, loc int, complexity int, cognitive int, max_depth int, params int, annotated int, empty_catches int, magic_numbers int, boolean_operators int, largest_match int, branches array<int>, error string"
IMPORT = "file string, module string, level int"


def units(files: DataFrame) -> DataFrame:
    """One row per top-level function and method of (file, text); a file that does not parse gives one row with its error.

    Classes with a decorator and their methods are left out, as they are in ``classes``.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in UNIT.split(", ")]
        for pdf in parts:
            rows = []
            for file, text in zip(pdf.file, pdf.text, strict=True):
                try:
                    tree = ast.parse(text or "")
                except (SyntaxError, ValueError, RecursionError) as e:
                    rows.append({"file": file, "error": type(e).__name__})
                    continue
                lines = (text or "").splitlines()
                for node in tree.body:
                    if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                        rows.append({"file": file, **unit_facts(node, None, lines)})
                    elif isinstance(node, ast.ClassDef) and not node.decorator_list:
                        rows += [{"file": file, **unit_facts(m, node.name, lines)} for m in node.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))]
            yield pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in names})

    return files.select("file", "text").mapInPandas(run, UNIT)


CLASS = "file string, name string, start int, end int, loc int, methods int, attributes int"


def classes(files: DataFrame) -> DataFrame:
    """One row per top-level class without a decorator: its size, methods and the names that its body assigns."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in CLASS.split(", ")]
        for pdf in parts:
            rows = []
            for file, text in zip(pdf.file, pdf.text, strict=True):
                try:
                    tree = ast.parse(text or "")
                except (SyntaxError, ValueError, RecursionError):
                    continue
                lines = (text or "").splitlines()
                for c in tree.body:
                    if isinstance(c, ast.ClassDef) and not c.decorator_list:
                        assigned = [t for n in c.body for t in (n.targets if isinstance(n, ast.Assign) else [n.target] if isinstance(n, ast.AnnAssign) else []) if isinstance(t, ast.Name)]
                        rows.append((file, c.name, c.lineno, c.end_lineno, code_lines(lines, c), sum(isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) for n in c.body), len(assigned)))
            yield pd.DataFrame({n: pd.Series([r[k] for r in rows], dtype=object) for k, n in enumerate(names)})

    return files.select("file", "text").mapInPandas(run, CLASS)


def imports(files: DataFrame) -> DataFrame:
    """Top-level imports: module and level of relative ones."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for file, text in zip(pdf.file, pdf.text, strict=True):
                try:
                    tree = ast.parse(text or "")
                except (SyntaxError, ValueError, RecursionError):
                    continue
                for n in tree.body:
                    if isinstance(n, ast.Import):
                        rows += [(file, a.name, 0) for a in n.names]
                    elif isinstance(n, ast.ImportFrom):
                        rows.append((file, n.module or "", n.level))
            yield pd.DataFrame({n: pd.Series([r[k] for r in rows], dtype=object) for k, n in enumerate(("file", "module", "level"))})

    return files.select("file", "text").mapInPandas(run, IMPORT)


def resolve(found: DataFrame, files: DataFrame) -> DataFrame:
    """JOI-01: (file, target): each import's longest known dotted prefix; relative ones start at the source's package."""
    from lithos.functions.scalars import dotted

    index = files.select(F.col("file").alias("target"), dotted(F.col("file")).alias("p"))
    parts = F.split(dotted(F.col("file")), "\\.")
    up = F.col("level") - F.when(F.col("file").endswith("__init__.py"), 1).otherwise(0)
    base = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - up, F.lit(0))), ".")
    full = F.when(F.col("level") > 0, F.concat_ws(".", F.nullif(base, F.lit("")), F.nullif("module", F.lit("")))).otherwise(F.col("module"))
    want = found.withColumn("full", full).withColumn("seg", F.split("full", "\\."))
    prefixes = want.select("file", "full", F.explode(F.transform(F.sequence(F.lit(1), F.size("seg")), lambda k: F.array_join(F.slice("seg", 1, k), "."))).alias("p"))
    return prefixes.join(index, "p").groupBy("file", "full").agg(F.max_by("target", F.length("p")).alias("target")).select("file", "target")


def file_sizes(files: DataFrame) -> DataFrame:
    return files.select("file", loc_hash(F.col("text")).alias("loc"))
