"""Operators of the analytics engine: hand-computed values, quirks, and agreement with SQL."""

import math
import os
import random
import re
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from lithos import config
from lithos.functions import scalars as sc
from lithos.functions import naming
from lithos.operators import clones, graph, metrics, resolution, rules
from lithos.plans import naming_queries, queries, registry, report_queries  # noqa: F401
from lithos.sources import files, python_source

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    df = registry.QUERIES[name](spark, DATA)
    rel = con.sql(registry.ORACLE[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=repr)
    want = sorted((tuple(map(plain, r)) for r in rel.select(*[f'"{c}"' for c in cols]).fetchall()), key=repr)
    assert got == want


GOLDEN = [  # modules, loc, excess density, duplication, coupling, cohesion known, severities, smells, overall
    (3327, 15, 8, 0, 0, 69.34),
    (1410, 4, 5, 0, 0, 77.66),
]


@pytest.mark.parametrize("loc,major,minor,info,critical,want", GOLDEN)
def test_golden_smell_scores(spark, loc, major, minor, info, critical, want):
    x = spark.createDataFrame([(loc, major, minor, info, critical)], "loc int, major int, minor int, info int, critical int")
    assert x.select(metrics.round2(metrics.smell_score(F.col("loc")))).first()[0] == want


def test_overall_leaves_noted_dimensions_out(spark):
    parts = {"complexity": F.lit(100.0), "duplication": F.lit(100.0), "coupling": F.lit(70.18), "cohesion": F.lit(0.0), "smells": F.lit(77.66)}
    got = spark.range(1).select(metrics.overall(parts, {"cohesion": F.lit(True)})).first()[0]
    assert round(got, 2) == round((25 + 15 + 17.545 + 15.532) / 0.85, 2)


def test_repo_scores(spark):
    row = [("r", 2000, 3, 10, 0.1, 4, 2, 1, 0.0, 1, 500.0, 1000, 5, 0, 1, 2, 0)]
    cols = "repo string, total_loc int, modules int, excess int, dup_ratio double, fan_out_total int, fan_out_max int, dual_hub_max int, pain double, cycles int, cohesion_weighted double, cohesion_loc int, functions int, critical int, major int, minor int, info int"
    r = metrics.repo_scores(spark.createDataFrame(row, cols)).first()
    assert (r.complexity, r.duplication, r.coupling, r.cohesion, r.smells) == (90.0, 90.0, 81.67, 50.0, 95.5)
    assert r.grade == "B"


def test_loc_counts(spark):
    text = "a = 1\n\n# note\n/* block\n inner */ tail()\n// line\nb /* x */\n/* one */\n"
    r = spark.createDataFrame([(text,)], "t string").select(sc.loc_hash(F.col("t")), sc.loc_slash(F.col("t"))).first()
    assert tuple(r) == (6, 4)


def test_fnv_churn(spark):
    def slow(s):
        h = 2166136261
        for c in s:
            h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
        return abs(h - (1 << 32) if h >= 1 << 31 else h) % 100 + 1

    names = ["", "a", "src/app/main.ts", "http://x.example/1?q=2"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "p string").select(sc.fnv_churn(F.col("p"))).collect()]
    assert got == [slow(n) for n in names]


def test_scalar_paths(spark):
    r = spark.createDataFrame([("pkg/sub/__init__.py", "a.b.List<C>[]", "app/(shop)/cart/page.tsx")], "p string, t string, n string")
    assert tuple(r.select(sc.dotted(F.col("p")), sc.simple_type(F.lit("a.b.C[]")), sc.next_route(F.regexp_replace("n", "^app", ""))).first()) == ("pkg.sub", "C", "/cart")


def test_thresholds_override():
    t = config.merged(config.Thresholds(), god_class_loc=10)
    assert t.god_class_loc == 10 and t.god_class_methods == 10
    assert any("loc >= 10" in r.fires for r in rules.rules(t) if r.name == "god-class")


def closure(pairs):
    nodes = {x for p in pairs for x in p}
    reach = {n: {b for a, b in pairs if a == n} for n in nodes}
    for _ in nodes:
        for n in nodes:
            reach[n] |= {y for x in list(reach[n]) for y in reach[x]}
    return {n: min([n] + [m for m in nodes if m in reach[n] and n in reach[m]]) for n in nodes}


def test_components_on_random_graphs():
    r = random.Random(4)
    for _ in range(60):
        pairs = sorted({(f"n{r.randrange(9)}", f"n{r.randrange(9)}") for _ in range(r.randrange(1, 16))})
        assert graph.strong_components(pairs) == closure(pairs)


def test_shortest_cycle_uses_real_edges(spark):
    e = [("g", "a", "b"), ("g", "b", "c"), ("g", "c", "a"), ("g", "c", "b"), ("g", "x", "x"), ("g", "a", "x")]
    got = {r.component: (r.size, r.length, r.path) for r in graph.cycle_paths(spark.createDataFrame(e, "graph string, from_id string, to_id string")).collect()}
    assert got["a"] == (3, 2, ["b", "c", "b"]) and got["x"] == (1, 1, ["x", "x"])


def test_merged_ranges(spark):
    rows = [("f", 1, 3), ("f", 4, 6), ("f", 8, 9), ("f", 2, 2), ("g", 5, 5)]
    got = {r.file: r.covered for r in metrics.merged_ranges(spark.createDataFrame(rows, "file string, start int, end int"), "file").collect()}
    assert got == {"f": 8, "g": 1}


def test_planted_clone(spark):
    run = " ".join(f"tok{k}" for k in range(60))
    x = spark.createDataFrame([("a", f"one two {run} end"), ("b", f"{run} other"), ("c", "nothing here")], "file string, text string")
    assert [tuple(r) for r in clones.clones(x, 50).collect()] == [("a", "b", 2, 0, 60)]
    assert clones.clones(x, 500).count() == 0


def test_run_common_to_many_files_is_paired_exactly(spark):
    header, more = " ".join(f"lic{k}" for k in range(70)), " ".join(f"own{k}" for k in range(20))
    rows = [(f"f{k:02}", f"start{k} {header} {more if k in (7, 31) else f'end{k}'}") for k in range(60)] + [("g", f"{header} {header}")]
    x = spark.createDataFrame(rows, "file string, text string")
    got = sorted(tuple(r) for r in clones.clones(x, 50).collect())
    among = [(f"f{a:02}", f"f{b:02}", 1, 1, 90 if (a, b) == (7, 31) else 70) for a in range(60) for b in range(a + 1, 60)]
    assert got == sorted(among + [(f"f{a:02}", "g", 1, at, 70) for a in range(60) for at in (0, 70)])
    assert clones.blocks(x, 50).count() == 62 + 2  # the places of the header, and its end with the tail of two files


def test_clone_pairs_finds_a_passage_in_a_document(spark, tmp_path):
    words = [f"tok{k}" for k in range(60)]
    copy = "\n".join(" ".join(words[k : k + 10]) for k in range(0, 60, 10))
    spark.createDataFrame([(3, " ".join(words)), (4, "short")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(7, f"one two\n{copy}\nend"), (8, f"{copy} other"), (9, "nothing here")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "u", " ".join(words))], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    links = registry.QUERIES["clone_pairs"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in links.collect()) == [("b3", "d7", 0, 2, 60, False), ("b3", "d8", 0, 0, 60, False)]
    assert sorted(tuple(r) for r in clones.pairs(links).collect()) == [("b3", "d7", 0, 2, 60), ("b3", "d8", 0, 0, 60), ("d7", "d8", 2, 0, 60)]


def test_clone_pairs_grow_with_the_places_and_not_with_their_pairs(spark, tmp_path):
    line = " ".join(f"tok{k}" for k in range(60))
    spark.createDataFrame([(3, line)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(k, f"start{k} {line} mid{k} {line} end{k}") for k in range(40)] + [(100 + k, f"start0, {line} mid0 {line}\nend0") for k in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in registry.QUERIES["clone_pairs"](spark, str(tmp_path)).collect())
    copies = [("d0", f"d{100 + k}", 0, 0, 123, True) for k in range(40)]
    assert got == sorted(copies + [("b3", f"d{k}", 0, at, 60, False) for k in range(40) for at in (1, 62)])


def test_links_hold_all_clones_between_different_texts(spark):
    r = random.Random(2)
    t = {f"f{k}": [r.choice("ab") for _ in range(r.randrange(30))] for k in range(8)} | {"y": ["a", "b"] * 15, "z": ["a", "b"] * 9}
    t |= {f"{f}copy": t[f] for f in ("f1", "f3", "y")} | {"a-copy": t["f3"], "é": ["x"] * 3 + t["f5"]}
    x = spark.createDataFrame([(f, "\n–".join(v)) for f, v in t.items()], "file string, text string")
    links = clones.linked(x, 5)
    want = sorted(tuple(c) for c in clones.clones(x, 5).collect() if t[c.file_a] != t[c.file_b])
    assert want and sorted(tuple(c) for c in clones.pairs(links, 5).collect()) == want
    first = {f: min(g for g in t if t[g] == t[f]) for f in t}
    assert sorted(tuple(c) for c in links.where("copy").collect()) == sorted((first[f], f, 0, 0, len(t[f]), True) for f in t if first[f] != f and len(t[f]) >= 5)


def test_words_are_those_of_the_pattern():
    text = "Ab_1 ab_1,x\u00e9x  9\t–x " + "".join(map(chr, range(300)))
    words = [w for w in re.split(r"[^\w]+", text, flags=re.ASCII) if w]
    h = clones.hashed(text.encode()).tolist()
    assert len(h) == len(words) and len(set(h)) == len(set(words)) and all((a == b) == (p == q) for a, p in zip(h, words) for b, q in zip(h, words))
    assert len(clones.hashed(b"")) == 0


def test_clones_equal_brute_force(spark):
    r = random.Random(1)
    t = {f"f{k}": [r.choice("ab") for _ in range(r.randrange(40))] for k in range(12)} | {"y": ["a", "b"] * 15, "z": ["a", "b"] * 9}
    want = set()
    for a, b in ((a, b) for a in t for b in t if a < b):
        for i, j in ((i, j) for i in range(len(t[a])) for j in range(len(t[b])) if not (i and j and t[a][i - 1] == t[b][j - 1])):
            n = next((n for n in range(99) if i + n >= len(t[a]) or j + n >= len(t[b]) or t[a][i + n] != t[b][j + n]), 0)
            want |= {(a, b, i, j, n)} if n >= 5 else set()
    got = [tuple(x) for x in clones.clones(spark.createDataFrame([(f, " ".join(x)) for f, x in t.items()], "file string, text string"), 5).collect()]
    assert sorted(got) == sorted(want)


SOURCE = '''
import os
from . import near
from pkg.deep.thing import x

class A:
    def m(self, a: int, b, c=5):
        if a and b or c:
            for i in range(7):
                try:
                    pass
                except Exception:
                    pass
        return 42

def f(x):
    return [y for y in x if y]
'''


def test_python_facts(spark):
    x = spark.createDataFrame([("pkg/a.py", SOURCE), ("pkg/near.py", ""), ("pkg/deep/__init__.py", ""), ("bad.py", "def (")], "file string, text string")
    u = {r.name or r.file: r for r in python_source.units(x).collect()}
    assert (u["m"].complexity, u["m"].max_depth, u["m"].params, u["m"].annotated, u["m"].empty_catches, u["m"].magic_numbers, u["m"].boolean_operators) == (6, 3, 4, 1, 1, 2, 2)
    assert (u["f"].complexity, u["f"].kind, u["bad.py"].error) == (2, "function", "SyntaxError")
    got = {(r.file, r.target) for r in python_source.resolve(python_source.imports(x), x.select("file")).collect()}
    assert got == {("pkg/a.py", "pkg/deep/__init__.py")}


def test_configuration_readers():
    assert files.loose_json('{"a": [1, 2,], // note\n "u": "http://x", /* b */ }') == {"a": [1, 2], "u": "http://x"}
    assert files.pnpm_packages("packages:\n  - 'apps/*' # all\n  - tools\nother: 1\n") == ["apps/*", "tools"]
    assert files.pnpm_packages("packages: ['a', \"b\"]") == ["a", "b"]
    assert files.package_workspaces('{"workspaces": {"packages": ["p/*"]}}') == ["p/*"]


def test_file_listing(spark, tmp_path):
    for p in ("a.py", "node_modules/b.js", "src/c.ts", "src/d.d.ts", "test_e.py"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    paths = files.listing(spark, str(tmp_path)).select(F.regexp_replace("path", f"^.*{Path(tmp_path).name}/", "").alias("path"))
    assert [tuple(r) for r in files.languages(paths).collect()] == [("python", 2), ("typescript", 2)]
    assert [r.path for r in files.python_files(paths).collect()] == ["a.py"]
    assert [r.path for r in files.node_files(paths).collect()] == ["src/c.ts"]


def test_stream_fold_equals_batch(spark, tmp_path):
    from lithos.streaming import scan_events

    e = spark.createDataFrame([(k, k % 3, "error" if k % 5 == 0 else "view", float(k)) for k in range(40)], "event_id long, user_id long, event_type string, value double").withColumn("ts", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(event_id % 7 as int), 0)")).withColumn("props", F.lit("{}"))
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    scan_events.run_fold(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).drop("epoch").collect()))
    assert got == sorted(map(tuple, scan_events.fold(e).collect()))


WRAPPED = [
    ("several tops", ["main", "models.user", "routers.users"], None),
    ("one wrapper", ["app", "app.main", "app.api.endpoints", "app.core.config"], "app"),
    ("nested", ["src.myapp.api.endpoints", "src.myapp.core.config"], "src.myapp"),
    ("one package below", ["app.api.endpoints", "app.api.schemas"], None),
    ("nothing", [""], None),
]


def test_wrapper_packages(spark):
    rows = [(g, n) for g, names, _ in WRAPPED for n in names]
    got = resolution.wrapper_packages(spark.createDataFrame(rows, "g string, n string"), "g", "n").collect()
    assert {r.g: r.wrapper for r in got} == {g: w for g, _, w in WRAPPED}


def test_alias_edge_cases(spark):
    x = spark.createDataFrame([("ab",), ("aXb",), (None,), ("a",)], "s string")
    got = [r[0] for r in x.select(naming.alias_middle(F.col("s"), "a*b")).collect()]
    assert got == ["", "X", None, None]
    assert [r[0] for r in x.select(naming.alias_middle(F.col("s"), "ab")).collect()] == ["", None, None, None]


def test_python_rules(spark):
    chain = "\n".join([f"    {'if' if k == 0 else 'elif'} x == 0:\n        pass" for k in range(8)])
    cases = "\n".join(f"        case '{k}':\n            pass" for k in range(16))
    text = f"def f(x):\n{chain}\n    match x:\n{cases}\n    return x and x and x and x and x\n\ndef g(x):\n    for _ in x:\n        try:\n            x()\n        except A:\n            pass\n        except B:\n            ...\n    return [3, 4]\n\ndef h(x):\n    if x:\n        return 3\n    else:\n        if x:\n            return 1\n"
    u = python_source.units(spark.createDataFrame([("a.py", text), ("bad.py", "def (")], "file string, text string"))
    got = sorted((r.name, r.rule_id, r.severity) for r in rules.python_findings(u).collect())
    assert got == [("f", "large-match", "major"), ("f", "large-match", "minor"), ("f", "long-boolean-expression", "minor"), ("g", "empty-catch", "major"), ("g", "empty-catch", "major"), ("g", "magic-numbers", "info")]
    assert sorted(u.where("name = 'h'").first().branches) == [1, 1]


def test_commented_code(spark):
    x = [("a", "# x = 1\n  ## return x\nx = 2\n#f(1)\n# self.y\n# a word\n#"), ("b", "# x == 1\n# just text\n# y = 1\n# z(2)"), ("c", "# if a\n" * 9)]
    got = {r.file_id: (r.hits, r.severity) for r in rules.commented_code(spark.createDataFrame(x, "file_id string, text string")).collect()}
    assert got == {"a": (4, "info"), "c": (9, "minor")}


def test_cycles_artifacts_and_duplicates(spark):
    e = spark.createDataFrame([("g", a, b) for a, b in ("ab", "bc", "cd", "da", "xx", "yz", "zy", "pq")], "graph string, from_id string, to_id string")
    anchors = spark.createDataFrame([("g", n, f"{n}.py") for n in "abcdxpq"], "graph string, node string, file string")
    assert sorted((r.module_id, r.file, r.severity) for r in rules.cyclic_dependencies(graph.components(e), anchors).collect()) == [("a", "a.py", "critical"), ("x", "x.py", "major")]
    paths = ["a/dist/x.js", "a/dist/build/y.js", "node_modules/p/dist/z.js", "bin", "src/bin/t", "build/node_modules/q"]
    assert sorted(r.file for r in rules.build_artifacts(spark.createDataFrame([("r", p) for p in paths], "repo string, path string")).collect()) == ["a/dist", "build", "src/bin"]
    run = [f"t{k}" for k in range(60)]
    x = spark.createDataFrame([("a", "one\n" + "\n".join(run)), ("b", " ".join(run) + "\nend")], "file string, text string")
    assert sorted(map(tuple, rules.duplicate_code(clones.clones(x), x).collect())) == [("a", 2, 61, 60, "duplicate_code", "critical"), ("b", 1, 1, 60, "duplicate_code", "critical")]
    assert [r.file for r in rules.duplicate_code(clones.clones(x), x.where("file = 'a'")).collect()] == ["a"]


def test_layer_diagram(spark):
    c = [(0, "m-1", "One", ["t"], 0, "c.1", 'A"x', ["layer:service"]), (0, "m-1", "One", ["t"], 1, "c2", "B", ["other"]), (1, "m2", "Two", [], 0, "c3", "C", ["layer:guard"]), (2, "m3", "Three", [], 0, "c4", "D", [])]
    d = spark.createDataFrame(c, "module_pos long, module_id string, module_name string, module_tags array<string>, pos long, class_id string, class_name string, tags array<string>")
    e = spark.createDataFrame([(0, "m-1", "m2", "import"), (1, "m2", "m3", "import"), (2, "m2", "m2", "import")], "pos long, from_id string, to_id string, kind string")
    got = [r.line for r in graph.layer_diagram(d, e).orderBy("part", "module_pos", "pos").collect()]
    assert got[0] == "graph TD" and got[10] == "  classDef untagged fill:#e2e8f0,stroke:#94a3b8,color:#0f172a"
    assert got[11:] == ['  subgraph m_1["One\\n[t]"]', '    m_1_c_1["A\\"x"]:::service', '    m_1_c2["B"]:::untagged', "  end", '  subgraph m2["Two"]', '    m2_c3["C"]:::guard', "  end", "  m_1_c_1 -->|import| m2_c3"]
