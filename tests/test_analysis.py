"""From sources to scores and stored reports; shortest cycles against powers of the adjacency matrix."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithos.operators import analysis, graph
from lithos.sources import reports

BIG = "def big(a, b, c, d, e, f):\n" + "".join(f"    if a == {k}:\n        b = {k + 200}\n" for k in range(16)) + "    return b\n"
SOURCES = {
    "app/main.py": "from app.core import util\nfrom app.web import views\n\ndef go():\n    return util.run(views.show())\n",
    "app/core/__init__.py": "", "app/core/util.py": "from app.web.views import show\n\nclass Box:\n    size: int = 1\n    def put(self):\n        pass\n\ndef run(x):\n    return x\n",
    "app/web/__init__.py": "", "app/web/views.py": "import app.core.util\nimport app.web.more\n" + BIG, "app/web/more.py": "x = 1\n", "app/tests/test_x.py": BIG,
    "src/a/x.ts": "import { y } from '../b/y';\nexport function f() { return y() }\n", "src/b/y.ts": "export const y = () => 1;\nexport class K { m() { return 1 } }\n", "src/b/y.spec.ts": "import '../a/x'",
    "java/p/core/A.java": "package p.core;\npublic class A { private int n; int get() { return n; } }\n", "java/p/web/B.java": "package p.web;\nimport p.core.A;\nclass B { A a; void run() { if (a != null) a.get(); } }\n",
}


@pytest.fixture(scope="module")
def report(spark):
    df = spark.createDataFrame(list(SOURCES.items()), "path string, text string").repartition(3)
    return {k: v.cache() for k, v in analysis.analyze(df).items()}


def test_facts_of_three_languages(report):
    assert {(r.path, r.module_id, r.loc) for r in report["files"].collect()} == {
        ("app/main.py", "mod_main", 4), ("app/core/__init__.py", "mod_core__python", 0), ("app/core/util.py", "mod_core__python", 7), ("app/web/__init__.py", "mod_web__python", 0), ("app/web/views.py", "mod_web__python", 36), ("app/web/more.py", "mod_web__python", 1),
        ("src/a/x.ts", "mod_a", 2), ("src/b/y.ts", "mod_b", 2), ("java/p/core/A.java", "mod_core__java", 2), ("java/p/web/B.java", "mod_web__java", 3),
    }
    assert sorted((r.from_id, r.to_id, r.weight) for r in report["edges"].where("from_id <> to_id").collect()) == [("mod_a", "mod_b", 1), ("mod_core__python", "mod_web__python", 1), ("mod_main", "mod_core__python", 1), ("mod_main", "mod_web__python", 1), ("mod_web__java", "mod_core__java", 1), ("mod_web__python", "mod_core__python", 1)]
    units = {(r.module_id, r.name): (r.complexity, r.loc, r.params) for r in report["units"].collect()}
    assert units[("mod_web__python", "big")] == (17, 34, 6) and units[("mod_b", "y")] == (1, 1, 0) and units[("mod_web__java", "run")] == (2, 1, 0) and len(units) == 9
    assert {(r.module_id, r.methods, r.attributes) for r in report["classes"].collect()} == {("mod_core__python", 1, 1), ("mod_b", 1, 0), ("mod_core__java", 1, 1), ("mod_web__java", 1, 1)}


def test_findings_and_scores(report):
    found = sorted((r.module_id, r.rule_id, r.severity) for r in report["findings"].collect())
    assert found == [("mod_core__python", "data-class", "info"), ("mod_core__python", "lazy-class", "info"), ("mod_core__python", "low-cohesion", "major"), ("mod_web__python", "excessive-complexity", "major"), ("mod_web__python", "long-method", "minor"), ("mod_web__python", "long-parameter-list", "minor"), ("mod_web__python", "magic-numbers", "minor"), ("mod_web__python", "primitive-obsession", "info")]
    m = {r.module_id: r for r in report["modules"].collect()}
    assert len(m) == 7 and m["mod_b"].grade == "A" and m["mod_web__python"].overall < m["mod_main"].overall
    r = report["repo"].first()
    # excess 7 over 57 lines; 6 links of 7 modules, at most 2 from one; one cycle
    assert r.complexity == 0 and r.duplication == 100 and r.coupling == 85 and r.grade in "ABCDE"


def test_reports_are_stored_and_read(spark, report, tmp_path):
    reports.write_report(report, f"{tmp_path}/r", "s1")
    back = reports.read_report(spark, f"{tmp_path}/r", "s1")
    assert {k: v.count() for k, v in back.items()} == {k: v.count() for k, v in report.items()}
    with pytest.raises(FileNotFoundError):
        reports.read_report(spark, f"{tmp_path}/r", "s2")
    reports.write_document(report, f"{tmp_path}/doc")
    docs = {x["module_id"]: x for x in (json.loads(r.value) for r in spark.read.text(f"{tmp_path}/doc").collect())}
    assert [f["path"] for f in docs["mod_b"]["files"]] == ["src/b/y.ts"] and "findings" not in docs["mod_b"]
    (tmp_path / "src").mkdir()
    (tmp_path / "src/pkg_a.py").write_text("x = 1\ny = 2\n")
    assert reports.stored_text(spark, f"{tmp_path}/src", "pkg/a.py") == "x = 1\ny = 2\n" and reports.stored_text(spark, f"{tmp_path}/src", "../x") is None and reports.stored_text(spark, f"{tmp_path}/src", "..") is None
    assert [tuple(r) for r in reports.read_sources(spark, f"{tmp_path}/src").collect()] == [("pkg_a.py", "x = 1\ny = 2\n")]
    reports.main([f"{tmp_path}/src", "--out", f"{tmp_path}/scores.json"])
    assert json.loads((tmp_path / "scores.json").read_text())["modules"][0]["grade"] in "ABCDE"


def test_progress_and_queue(spark, tmp_path):
    spark.createDataFrame([("a", 1, None), ("b", 2, "x")], "scan_id string, percent int, error string").write.json(f"{tmp_path}/in")
    events = spark.readStream.schema("scan_id string, percent int, error string").json(f"{tmp_path}/in")
    for _ in range(2):
        reports.write_progress(events, f"{tmp_path}/out", f"{tmp_path}/ck")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/out").collect()) == ['{"scan_id":"a","percent":1}', '{"scan_id":"b","percent":2,"error":"x"}']
    jobs = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1)], "scan_id string, n int")
    assert [r.scan_id for r in reports.enqueue(jobs, spark.createDataFrame([("b",)], "scan_id string")).collect()] == ["a"]


@pytest.mark.parametrize("seed", range(6))
def test_shortest_cycle_of_random_graphs(seed):
    r = np.random.default_rng(seed)
    n = 12
    adj = (r.random((n, n)) < 0.14).astype(np.int64)
    np.fill_diagonal(adj, 0)
    pairs = [(f"n{a:02}", f"n{b:02}") for a, b in zip(*np.nonzero(adj), strict=True)]
    label = graph.strong_components(pairs)
    for c in set(label.values()):
        nodes = sorted(k for k, v in label.items() if v == c)
        out: dict[str, list[str]] = {}
        for a, b in pairs:
            if label[a] == label[b] == c:
                out.setdefault(a, []).append(b)
        if not out:
            continue
        own = [int(k[1:]) for k in nodes]
        power, length = np.eye(n, dtype=np.int64), 0
        while True:
            power, length = np.minimum(power @ adj, 1), length + 1
            if power[own, own].any():
                break
        path = graph.shortest_cycle(nodes, out)
        assert len(path) - 1 == length and path[0] == path[-1] and all(b in out[a] for a, b in zip(path, path[1:]))
