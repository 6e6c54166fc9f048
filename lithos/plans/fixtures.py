"""Small constant tables, for operators whose facts the analytic tables don't hold; the same rows for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def sql_value(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(sql_value, v)) + "]"
    return str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


class Constant:
    """Rows with a schema, as a Spark table and as SQL."""

    def __init__(self, name: str, schema: str, rows: list[tuple]):
        self.name, self.schema, self.rows = name, schema, rows

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    @property
    def sql(self) -> str:
        kinds = {"int": "INTEGER", "long": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]"}
        cols = [c.rsplit(" ", 1) for c in self.schema.split(", ")]
        cast = ", ".join(f'CAST("{n}" AS {kinds[t]}) AS "{n}"' for n, t in cols)
        return f"{self.name} AS (SELECT {cast} FROM (VALUES {', '.join('(' + ', '.join(map(sql_value, r)) + ')' for r in self.rows)}) v({', '.join(f'"{n}"' for n, _ in cols)}))"


#: A listing of three repositories: names at the root, builds, binaries, sources and tests.
LISTING = Constant("listing", "repo string, path string, text string, bytes long", [
    ("r1", "README.md", None, 50), ("r1", ".github/workflows/ci.yml", None, 50), ("r1", "pyproject.toml", "[tool.ruff]", 50), ("r1", "uv.lock", None, 50), ("r1", "img/a.PNG", None, 3 << 20), ("r1", "dist/b.png", None, 3 << 20),
    ("r1", "img/c.txt", None, 30 << 20), ("r1", "x.zip", None, 11 << 20), ("r1", "pkg/build/out/z.o", None, 5), ("r1", "pkg/main.py", "# TODO a\n# FIXME b\nx = 1  # XXX c\n# HACK\n# TODO: d\n# notTODO\n", 90), ("r1", "pkg/test_main.py", None, 9),
    ("r2", "package.json", None, 50), ("r2", ".github/other.md", None, 50), ("r2", "setup.cfg", "[metadata]", 50), ("r2", "docs/README.md", None, 50), ("r2", "src/a.ts", "// TODO\n", 50), ("r2", "src/a.d.ts", None, 50), ("r2", "src/b.spec.ts", None, 50), ("r2", "node_modules/dist/c.js", None, 50), ("r2", "target/D.class", None, 50),
    ("r3", "pyproject.toml", "[project]", 50), ("r3", "Jenkinsfile", None, 50), ("r3", "README", None, 50), ("r3", "src/main/java/A.java", None, 50), ("r3", ".mvn/B.java", None, 50), ("r3", "lib/old.py", "\n".join(["# x = 1", "# return y", "# a note", "# call(z)"] * 3), 90),
])

PYTHON = '''import os
from ..core import run

def plain(a, b: int = 7):
    """Docs."""
    return a + 42 * 3600

async def branches(x, *rest, key=None):
    if x == 1 and key or rest:
        pass
    elif x == 2:
        return [y for y in rest if y]
    else:
        for y in rest:
            while y:
                break
    assert x, "no"
    try:
        run()
    except ValueError:
        ...
    return x if a and b and c and d and e else None

class Box:
    def put(self, v: int): self.v = v
'''
PYTHON_UNITS = Constant("want", "file string, class_name string, name string, start int, end int, complexity int, cognitive int, max_depth int, params int, annotated int, empty_catches int, magic_numbers int, boolean_operators int", [
    ("pkg/sub/a.py", None, "plain", 4, 6, 1, 0, 0, 2, 1, 0, 2, 0),
    ("pkg/sub/a.py", None, "branches", 8, 22, 15, 23, 4, 2, 0, 1, 0, 4),
    ("pkg/sub/a.py", "Box", "put", 25, 25, 1, 0, 0, 2, 1, 0, 0, 0),
])

SCRIPT = '''import { Module } from "@nestjs/common";
export const load = async (id: number, opts?: Map<string, number>) => {
  if (id > 1 && opts) { for (const x of [1, 2]) run(x) }
  else if (id === 0) return null
  return id ?? 0;
};
@Module({})
export class AppModule { constructor(private a: A) {} get(k) { return this.a.get(k) ? 1 : 2 } }
app.get("/users", load)
'''
SCRIPT_FACTS = Constant("want", "what string, name string, kind string, start int, end int, complexity int, cognitive int, max_depth int, params int, layer string", [
    ("import", "@nestjs/common", "value", 1, 1, None, None, None, None, None), ("function", "load", None, 2, 6, 6, 8, 3, 2, None), ("class", "AppModule", None, 8, 8, None, None, None, 0, "module"),
    ("method", "constructor", None, 8, 8, 1, 0, 0, 1, None), ("method", "get", None, 8, 8, 2, 1, 0, 1, None), ("route", "/users", "GET", 9, 9, None, None, None, None, None),
])

JAVA = {
    "c/PetController.java": "package c; import s.PetService; import r.*;\n@Controller public class PetController { @Autowired PetRepo repo; private PetService s; PetController(PetService s) {} }",
    "s/PetService.java": "package s; import r.PetRepo;\n@Service class PetService { private PetRepo p; public PetService(PetRepo p, VetService v) {} PetService() {} @Autowired void setVet(VetService v) { if (v == null || p == null) return; else if (v != null) p.go(); } }",
    "s/VetService.java": "package s;\n@Service class VetService { @Inject PetService<List> a; }",
    "r/PetRepo.java": "package r; import java.util.List; import org.springframework.data.Repo; import s.VetService;\n@Repository interface PetRepo {}",
}
JAVA_METHODS = Constant("want", "file string, owner string, name string, what string, complexity int, cognitive int, max_depth int, params int", [
    ("c/PetController.java", "PetController", "PetController", "constructor", 1, 0, 0, 1), ("s/PetService.java", "PetService", "PetService", "constructor", 1, 0, 0, 2), ("s/PetService.java", "PetService", "PetService", "constructor", 1, 0, 0, 0),
    ("s/PetService.java", "PetService", "setVet", "method", 4, 4, 2, 1),
])
BEAN_EDGES = Constant("want", "from_id string, to_id string, kind string, type string, skips boolean", [
    ("c.PetController", "r.PetRepo", "field", "PetRepo", True), ("c.PetController", "s.PetService", "constructor", "PetService", False), ("s.PetService", "s.VetService", "setter", "VetService", False), ("s.VetService", "s.PetService", "field", "PetService<List>", False),
])

#: Facts of Python units with what the rules of statements say about them.
UNIT_FACTS = Constant("unit_facts", "file string, name string, empty_catches int, magic_numbers int, boolean_operators int, ways int", [
    ("a.py", "f0", 0, 0, 0, 1), ("a.py", "f1", 2, 1, 3, 7), ("a.py", "f2", 1, 2, 4, 8), ("b.py", "f3", 0, 5, 7, 15), ("b.py", "f4", 0, 6, 8, 16), ("b.py", "f5", 0, 60, 80, 160),
])

STEPS = Constant("steps", "place int, step string, percent int", [
    (1, "01-clone", 10), (2, "02-detect-languages", 20), (3, "03-run-adapters", 50), (4, "04-compute-metrics", 60), (5, "05-build-graph", 70), (6, "06-score", 80), (7, "07-render-diagrams", 90), (8, "08-persist", 100),
])

#: Weight, related rules and bands of each dimension with a catalogue entry.
METRICS = Constant("metric_catalog", "metric string, weight double, related array<string>, optimal int", [
    ("cohesion", 0.15, ["low-cohesion", "god-package", "scattered-functionality"], 75),
    ("coupling", 0.25, ["cyclic-dependencies", "hub-dependency", "unstable-dependency", "scattered-functionality", "spring-service-cycle", "spring-layer-skip", "cross-layer-skip"], 80),
    ("duplication", 0.15, [], 90),
    ("complexity", 0.25, ["long-method", "excessive-complexity", "deep-nesting", "long-boolean-expression", "large-match", "high-wmc", "god-function"], 85),
])
