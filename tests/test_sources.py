"""Source parsers against hand-counted facts."""

import pytest

from pyspark.sql import functions as F

from lithos.sources import braces, files, java_source, node_resolution, python_source, script_source

SCRIPT = '''import express, { Router } from "express";
import type { User } from './types';
import "./side";
export { helper } from "./helper";
export * from './all'
const re = /[/"]+/g, half = 4 / 2;
// if (comment) && nothing
export const load = async (id: number, opts?: Map<string, number>) => {
  if (id > 1 && opts) {
    for (const x of [1, 2]) { try { run(x) } catch (e) { log(`${e ? "a" : `b${id}`}`) } }
  } else if (id === 0) return null
  else { while (true) break }
  return id ?? 0;
};
const wrapped = asyncHandler(async (req, res) => { switch (req.kind) { case "a": case 'b': return 1; default: return 2 } });
let plain = 5, short = x => x || 1
export default function* gen(a, { b, c }, ...rest): Generator<number> { do { yield a } while (b && c) }
function signature(a: string): void;
@Controller('users')
export class Users extends Base<User> implements A, B<C> {
  private readonly name: string = 'x';
  count?: number;
  constructor(private svc: Service) { super(); }
  @Get(':id') async find(id: string): Promise<{ a: number }> {
    return id ? this.svc.find(id) : null
  }
  abstract nope(): void;
  get size() { return this.count }
}
@Injectable()
export abstract class UserGuard {}
export interface Shape { area(): number }
app.get('/users', handler); router.POST("/x", (a) => a)
app.get(path, handler)
'''


def test_script_facts(spark):
    files = spark.createDataFrame([("src/a.ts", SCRIPT), ("b.py", "x = 1"), ("c.js", None)], "file string, text string")
    rows = script_source.facts(files).collect()
    assert {r.file for r in rows} == {"src/a.ts"} and "error" not in {r.what for r in rows}
    get = lambda what: [r for r in rows if r.what == what]
    assert [(r.name, r.kind) for r in get("import")] == [("express", "value"), ("./types", "type"), ("./side", "value"), ("./helper", "value"), ("./all", "value")]
    f = {r.name: r for r in get("function")}
    assert list(f) == ["load", "wrapped", "short", "gen"]
    # if, &&, for, catch, ternary, else if, while, ??; if > else > if > else > while
    assert (f["load"].complexity, f["load"].max_depth, f["load"].params, f["load"].loc, f["load"].start) == (9, 5, 2, 7, 8)
    assert (f["wrapped"].complexity, f["wrapped"].max_depth, f["wrapped"].params) == (3, 1, 2)
    assert (f["short"].complexity, f["short"].params) == (2, 0)
    assert (f["gen"].complexity, f["gen"].max_depth, f["gen"].params) == (3, 1, 3)
    c = {r.name: r for r in get("class")}
    users = c["Users"]
    assert (users.parent, users.uses, users.marks, users.attributes, users.abstract) == ("Base", ["A", "B"], ["Controller"], 2, False) and c["UserGuard"].abstract
    assert [(r.owner, r.name, r.params, r.complexity) for r in get("method")] == [("Users", "constructor", 1, 1), ("Users", "find", 1, 2), ("Users", "size", 0, 1)]
    assert [r.name for r in get("interface")] == ["Shape"]
    assert sorted((r.kind, r.name) for r in get("route")) == [("GET", "/users"), ("POST", "/x")]
    found = spark.createDataFrame([tuple(r) for r in rows], script_source.FACT)
    layers = {r.name: (r.l, r.t) for r in found.where("what = 'class'").select("name", script_source.layer(found.name, found.marks).alias("l"), script_source.layer_tags(found.name, found.marks).alias("t")).collect()}
    assert layers == {"Users": ("controller", ["layer:controller", "nest:controller"]), "UserGuard": ("guard", ["layer:guard", "nest:injectable"])}
    assert [tuple(r) for r in script_source.frameworks(found).collect()] == [("src/a.ts", "express")]


@pytest.mark.parametrize("body,want", [
    ("{}", (1, 0, 0)), ("{ if (a) b(); }", (2, 1, 1)), ("{ if (a) b(); else c() }", (2, 1, 2)), ("{ if (a) b(); else if (c) d(); else e(); }", (3, 4, 4)),
    ("{ return a && b || c }", (3, 2, 0)), ("{ try { a() } catch { b() } finally { c() } }", (2, 2, 2)), ("{ do x(); while (a && b) }", (3, 2, 1)),
    ("{ for (;;) for (const k in o) if (k) return }", (4, 6, 3)), ("{ x.catch(e => e ? 1 : 2); const o = { if: 1, case: 2 } }", (2, 1, 0)), ("{ switch (a) { case 1: if (b) c(); break; default: } }", (3, 4, 2)),
])
def test_script_complexity(body, want):
    t = braces.tokens(body)
    assert braces.complexity(t, 0, len(t.text)) == want


def test_markup_and_lines():
    src = "const A = (p: P) => (\n  <div className='a' onClick={() => p.x && go()}>\n    don't {p.y ? <b>it's</b> : null} <br/>\n  </div>\n);\nfunction after() { return 1 }\n"
    rows = script_source.Script("a.tsx", src, "tsx").run()
    assert [(r["name"], r["complexity"], r["start"], r["end"]) for r in rows] == [("A", 3, 1, 5), ("after", 1, 6, 6)]
    assert braces.lines_of_code("a\n\n// b\n/* c\n d */ e\n/* f */ // g\n/* h */\nx /* i\n*/\n/* j") == 5


JAVA = '''package com.shop.web;
import java.util.List;
import com.shop.data.*;
import com.shop.core.OrderService;
import static com.shop.Util.help;
/** Comment with class X { */
@RestController @RequestMapping("/a")
public class OrderController extends Base<Order> implements A, B<C> {
  @Autowired private OrderRepo repo;
  private final OrderService service, other[] = null;
  static { init(); }
  public OrderController(OrderService service, List<? extends Item> items) { this.service = service; }
  @Override
  public <T> Map<String, List<T>> find(final @NotNull String id, int... n) throws IOException {
    if (id == null || n.length == 0) return null;
    else if (n[0] > 1) { for (int k : n) { try { go(); } catch (A | B e) { throw e; } } }
    switch (n[0]) { case 1, 2: break; case 3 -> x(); default: }
    return id.isEmpty() ? null : List.of();
  }
  abstract void nothing();
  class Inner { void hidden() { if (a) b(); } }
  enum Kind { A, B }
}
interface Shape { double area(); default int two() { return 2; } }
enum Color { RED(1) { int x() { return 1; } }, BLUE; private int v; int value() { return v; } }
@interface Mark { String value() default ""; }
'''


def test_java_facts(spark):
    rows = java_source.facts(spark.createDataFrame([("web/OrderController.java", JAVA), ("a.ts", "x")], "file string, text string")).collect()
    get = lambda what: [r for r in rows if r.what == what]
    assert [(r.name, r.kind, r.static) for r in get("import")] == [("java.util.List", "one", False), ("com.shop.data", "all", False), ("com.shop.core.OrderService", "one", False), ("com.shop.Util.help", "one", True)]
    assert [(r.name, r.kind, r.abstract, r.marks) for r in get("type")] == [("OrderController", "class", False, ["RestController", "RequestMapping"]), ("Shape", "interface", True, []), ("Color", "enum", False, []), ("Mark", "annotation", True, [])]
    top = get("type")[0]
    assert (top.package, top.parent, top.uses, top.start, top.end, top.loc) == ("com.shop.web", "Base", ["A", "B"], 7, 23, 17)
    assert [(r.name, r.type, r.marks) for r in get("field")] == [("repo", "OrderRepo", ["Autowired"]), ("service", "OrderService", []), ("other", "OrderService", [])]
    assert [(r.name, r.params) for r in get("constructor")] == [("OrderController", ["OrderService", "List<?extendsItem>"])]
    m = {r.name: r for r in get("method")}
    assert list(m) == ["find", "nothing", "area", "two", "value"] and m["nothing"].abstract
    # if, ||, if, for, catch, two cases, choice; an else is no level of its own: if > if > for > try > catch
    assert (m["find"].complexity, m["find"].max_depth, m["find"].params, m["find"].loc, m["find"].marks) == (9, 5, ["String", "int..."], 7, ["Override"])
    assert get("file")[0].loc == 25


BEANS = {
    "c/PetController.java": "package c; import s.PetService; import r.*;\n@Controller public class PetController { @Autowired PetRepo repo; private PetService s; PetController(PetService s) {} }",
    "s/PetService.java": "package s; import r.PetRepo;\n@Service class PetService { private PetRepo p; private Vet v; public PetService(PetRepo p, VetService v) {} PetService() {} @Autowired void setVet(VetService v) {} }",
    "s/VetService.java": "package s;\n@Service class VetService { @Inject PetService<List> a; }",
    "r/PetRepo.java": "package r; import java.util.List; import org.springframework.data.Repo; import s.VetService;\n@Repository interface PetRepo {}",
    "x/Plain.java": "package x; class Plain { @Autowired r.PetRepo repo; }",
}


def test_beans_and_their_rules(spark):
    found = java_source.facts(spark.createDataFrame(list(BEANS.items()), "file string, text string")).cache()
    known = java_source.beans(found)
    assert {(r.id, r.layer) for r in known.collect()} == {("c.PetController", "controller"), ("s.PetService", "service"), ("s.VetService", "service"), ("r.PetRepo", "repository")}
    edges = java_source.injections(found)
    assert sorted((r.from_id, r.to_id, r.kind) for r in edges.collect()) == [("c.PetController", "r.PetRepo", "field"), ("c.PetController", "s.PetService", "constructor"), ("s.PetService", "s.VetService", "setter"), ("s.VetService", "s.PetService", "field")]
    assert [(r.from_id, r.to_id, r.severity) for r in java_source.layer_skips(edges, known).collect()] == [("c.PetController", "r.PetRepo", "major")]
    assert [r.nodes for r in java_source.service_cycles(edges, known).collect()] == [["s.PetService", "s.VetService"]]
    assert sorted((r.from_id, r.to_id, r.weight) for r in java_source.module_edges(found).collect()) == [("mod_c", "mod_s", 1), ("mod_r", "mod_s", 1), ("mod_s", "mod_r", 1)]
    tags = {r.name: r.t for r in found.where("what = 'type'").select("name", java_source.layer_tags(found.marks).alias("t")).collect()}
    assert tags["PetService"] == ["layer:service", "spring:Service"] and tags["Plain"] == []


FILES = ["packages/api/package.json", "packages/api/src/index.ts", "packages/api/src/users/a.ts", "packages/api/src/orders/deep/b.ts", "packages/api/src/orders/deep/more/c.tsx", "packages/ui/package.json", "packages/ui/button.js", "tools/ui/package.json", "tools/ui/src/x.mts", "packages/node_modules/package.json", ".hidden/package.json", "package.json", "src/app/main.ts", "src/app/lib/index.tsx", "top.ts"]


def test_workspaces_modules_and_imports(spark):
    paths = spark.createDataFrame([(p,) for p in FILES], "path string")
    names = spark.createDataFrame([("packages/api", "@my/api")], "workspace string, package string")
    spaces = node_resolution.workspaces(paths, ["packages/*", "tools/**", "!packages/ui"], names)
    assert [tuple(r) for r in spaces.collect()] == [("packages/api", "@my/api", "mod_api", "api"), ("packages/ui", "ui", "mod_packages_ui", "packages/ui"), ("tools/ui", "ui", "mod_tools_ui", "tools/ui")]
    assert {r.workspace for r in node_resolution.workspaces(paths, None).collect()} == {"packages/api", "packages/ui", "tools/ui"}
    assert node_resolution.workspaces(paths.where("path like 'tools%'"), None).count() == 0
    got = {r.path: (r.module_id, r.module) for r in node_resolution.modules_of(paths, spaces).collect()}
    assert len(got) == len(FILES)
    assert got["packages/api/src/index.ts"] == ("mod_api", "api") and got["packages/api/src/users/a.ts"] == ("mod_api_users", "api/users")
    assert got["packages/api/src/orders/deep/b.ts"] == got["packages/api/src/orders/deep/more/c.tsx"] == ("mod_api_orders_deep", "api/orders/deep")
    assert got["packages/ui/button.js"] == ("mod_packages_ui", "packages/ui") and got["src/app/main.ts"] == ("mod_app", "app") and got["top.ts"] == ("mod__root", "_root")
    config = node_resolution.read_config({"tsconfig.json": '{ // paths\n "compilerOptions": {"baseUrl": "./src", "paths": {"@app/*": ["app/lost/*", "app/*"], "lib": ["app/lib"],}} }'})
    assert config == {"base": "src", "paths": {"@app/*": ["app/lost/*", "app/*"], "lib": ["app/lib"]}}
    asked = [("packages/api/src/users/a.ts", "../index", "packages/api/src/index.ts"), ("packages/api/src/users/a.ts", "../orders/deep/b.js", "packages/api/src/orders/deep/b.ts"), ("top.ts", "@app/main", "src/app/main.ts"), ("top.ts", "lib", "src/app/lib/index.tsx"), ("top.ts", "@my/api", "packages/api/src/index.ts"), ("top.ts", "@my/api/users/a", "packages/api/src/users/a.ts"), ("top.ts", "ui/x.mjs", None), ("tools/ui/src/x.mts", "./x.mjs", "tools/ui/src/x.mts"), ("top.ts", "express", None), ("top.ts", "/abs", None), ("top.ts", "./src/app/lib", "src/app/lib/index.tsx")]
    imports = spark.createDataFrame([(k, f, s) for k, (f, s, _) in enumerate(asked)], "id int, file string, source string")
    found = {r.id: r.target for r in node_resolution.resolve_imports(imports, paths, spaces, config).collect()}
    assert [found.get(k) for k in range(len(asked))] == [t for *_, t in asked]


def test_module_of_dotted(spark):
    rows = [("routers.users", None, "routers"), ("app.api.endpoints", "app", "api"), ("app", "app", "app"), ("src.myapp", "src.myapp", "myapp"), ("apple.x", "app", "apple")]
    got = spark.createDataFrame(rows, "d string, w string, want string").select(node_resolution.module_of_dotted(F.col("d"), F.col("w")).alias("m"), "want").collect()
    assert all(r.m == r.want for r in got)


def test_scans_and_hygiene(spark):
    rows = [("r1", "README.md", None, 5), ("r1", ".github/workflows/ci.yml", None, 5), ("r1", "pyproject.toml", "[tool.ruff]", 5), ("r1", "uv.lock", None, 5), ("r1", "img/a.PNG", None, 3 << 20), ("r1", "dist/b.png", None, 3 << 20), ("r1", "img/c.txt", None, 3 << 20), ("r1", "x.zip", None, 11 << 20),
            ("r2", "package.json", None, 5), ("r2", ".github/other.md", None, 5), ("r2", "setup.cfg", "[metadata]", 5), ("r2", "docs/README.md", None, 5), ("r3", "pyproject.toml", "[project]", 5), ("r3", "Jenkinsfile", None, 1), ("r3", "README", None, 1)]
    df = spark.createDataFrame(rows, "repo string, path string, text string, bytes long")
    got = sorted((r.repo, r.rule_id, r.severity, r.file) for r in files.hygiene(df).collect())
    assert got == [("r2", "missing-ci", "info", ".github/workflows/"), ("r2", "missing-linter-config", "info", "package.json"), ("r2", "missing-lockfile", "minor", "package.json"), ("r2", "missing-readme", "info", "README.md"), ("r3", "missing-linter-config", "info", "pyproject.toml"), ("r3", "missing-lockfile", "minor", "pyproject.toml")]
    assert sorted((r.file, r.severity) for r in files.large_binaries(df, 2 << 20).collect()) == [("img/a.PNG", "minor"), ("x.zip", "major")]
    names = ["a.py", "tests/b.py", "test_c.py", "d_test.py", "conftest.py", "pkg/e.py", "f.ts", "g.d.ts", "h.spec.ts", "h.spec.tsx", "public/i.js", ".x/j.ts", "k.mjs", "coverage/l.js", "A.java", "target/B.java", ".mvn/C.java", "gen/D.java", "out/m.js", "n.JSX"]
    paths = spark.createDataFrame([(n,) for n in names], "path string")
    assert [r.path for r in files.python_files(paths).collect()] == ["a.py", "pkg/e.py"]
    assert [r.path for r in files.node_files(paths).collect()] == ["f.ts", "h.spec.tsx", "k.mjs", "n.JSX"]
    assert [r.path for r in files.java_files(paths).collect()] == ["A.java", "gen/D.java"]
    assert {r.language: r.files for r in files.languages(paths).collect()} == {"python": 5, "typescript": 5, "javascript": 4, "java": 4}
    assert {r.language: r.files for r in files.worker_languages(paths).collect()} == {"python": 6, "typescript": 5, "javascript": 4, "java": 4}
    with pytest.raises(ValueError):
        files.worker_languages(paths.where("path = 'x'"))


@pytest.mark.parametrize("body,want", [
    ("pass", (1, 0, 0)), ("if a:\n  b()\nelif c:\n  d()\nelif e:\n  f()\nelse:\n  g()", (4, 5, 2)), ("if a:\n  b()\nelse:\n  if c:\n    d()", (3, 4, 3)), ("assert a and b or c", (4, 3, 0)),
    ("for x in y:\n  pass\nelse:\n  while z:\n    pass", (3, 4, 3)), ("try:\n  a()\nexcept A:\n  b()\nfinally:\n  if c:\n    d()", (3, 4, 2)), ("with a:\n  x = [i for i in j if i if k]\n  y = 1 if z else 2", (4, 6, 1)), ("match a:\n  case 1:\n    pass\n  case _:\n    pass", (4, 5, 1)),
    ("if a:\n  x()\nelif b:\n  x()\nelif c:\n  x()\nelif d:\n  x()\nelif e:\n  x()\nassert f", (7, 10, 2)),
])
def test_python_complexity(body, want):
    import ast

    assert python_source.complexity(ast.parse(body).body) == want
