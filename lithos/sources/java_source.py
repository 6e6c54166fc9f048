"""Java sources to program facts, beans and their rules (SRC-10, SCL-05, SCL-14, SCL-25, FLT-02, GRF-08, GRF-09, RUL-30, RUL-31)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithos.functions.scalars import package_of, simple_type
from lithos.operators.graph import components
from lithos.operators.resolution import resolve_types
from lithos.sources.braces import JAVA, OPEN, complexity, expression_end, lines_of_code, parted, tokens

WORDS = {"public", "private", "protected", "static", "final", "abstract", "synchronized", "native", "strictfp", "default", "transient", "volatile", "sealed"}
TYPES = {"class": "class", "interface": "interface", "enum": "enum"}
FACT = "file string, what string, kind string, package string, owner string, name string, type string, start int, end int, loc int, complexity int, cognitive int, max_depth int, params array<string>, abstract boolean, static boolean, marks array<string>, parent string, uses array<string>"
NAMES = [c.split()[0] for c in FACT.split(", ")]


class Java:
    """One file's facts: imports, types, and fields, constructors and methods of its outer types."""

    def __init__(self, file: str, source: str):
        self.file, self.source = file, source
        self.t = tokens(source, False)
        self.package, self.rows = "", []

    def add(self, what: str, begin: int, end: int, **more) -> None:
        t = self.t
        start, last = t.line[begin], t.last[end - 1]
        self.rows.append({"file": self.file, "what": what, "package": self.package, "start": start, "end": last, "loc": last - start + 1, "marks": [], "uses": [], "params": [], **more})

    def dotted(self, i: int) -> tuple[str, int]:
        t, name = self.t, self.t.at(i)
        while t.at(i + 1) == "." and (t.words(i + 2) or t.at(i + 2) == "*"):
            name, i = f"{name}.{t.text[i + 2]}", i + 2
        return name, i + 1

    def head(self, i: int) -> tuple[list[str], set[str], int]:
        """Annotations and modifiers from i on, and the place after them."""
        t, marks, words = self.t, [], set()
        while i < len(t.text):
            if t.text[i] == "@" and t.at(i + 1) != "interface":
                name, i = self.dotted(i + 1)
                marks.append(name)
                i = t.after(i) if t.at(i) == "(" else i
            elif t.text[i] in WORDS and t.at(i + 1) not in ("=", ";", ","):
                words.add(t.text[i])
                i += 1
            elif t.text[i] == "non" and t.at(i + 1) == "-":
                i += 3
            else:
                break
        return marks, words, i

    def run(self) -> list[dict]:
        t, i = self.t, 0
        while i < len(t.text):
            marks, words, j = self.head(i)
            if t.at(j) == "package":
                self.package, j = self.dotted(j + 1)
            elif t.at(j) == "import":
                k = j + 1 + (t.at(j + 1) == "static")
                name, e = self.dotted(k)
                self.add("import", j, e, name=name.removesuffix(".*"), kind="all" if name.endswith(".*") else "one", static=k > j + 1)
                j = e
            elif t.at(j) in TYPES or t.at(j) == "@":
                j = self.type_of(i, j, marks, words)
            elif t.at(j) in OPEN:
                j = t.after(j)
            i = max(j, i + 1)
        return [{**r, "package": self.package} for r in self.rows] + [{"file": self.file, "what": "file", "package": self.package, "loc": lines_of_code(self.source), "marks": [], "uses": [], "params": []}]

    def type_of(self, begin: int, at: int, marks: list[str], words: set[str]) -> int:
        t = self.t
        kind = "annotation" if t.text[at] == "@" else TYPES[t.text[at]]
        j = at + 1 + (kind == "annotation")
        name, body, angle = t.at(j), j, 0
        while body < len(t.text) and t.text[body] != "{":
            body += 1
        clause, parent, uses = "", None, []
        for k in range(j + 1, body):
            x = t.text[k]
            angle += (x == "<") - (len(x) if set(x) == {">"} else 0)
            if angle == 0 and x in ("extends", "implements", "permits"):
                clause = x
            elif angle == 0 and t.words(k) and t.at(k + 1) != ".":
                if clause == "extends" and parent is None:
                    parent = x
                elif clause == "implements":
                    uses.append(x)
        end = t.after(body)
        self.add("type", begin, end, name=name, kind=kind, abstract="abstract" in words or kind in ("interface", "annotation"), marks=marks, parent=parent if kind == "class" else None, uses=uses)
        if kind != "annotation":
            i = body + 1
            if kind == "enum":  # its constants come first
                i = expression_end(t, i, (";",))
                while i < end - 1 and t.text[i] != ";":
                    i = t.after(i) if t.text[i] in OPEN else i + 1
                i += 1
            while i < end - 1:
                i = max(self.member(i, end - 1, name, kind), i + 1)
        return end

    def member(self, i: int, end: int, owner: str, kind: str) -> int:
        t = self.t
        marks, words, j = self.head(i)
        if t.at(j) in TYPES and t.words(j + 1) or t.at(j) == "@" or t.at(j) == "record" and t.words(j + 1) and t.at(j + 2) in ("(", "<"):
            while j < end and t.text[j] != "{":
                j += 1
            return t.after(j)
        if t.at(j) in ("{", ";"):
            return t.after(j) if t.at(j) == "{" else j + 1
        k, angle = j, 0
        while k < end and (angle > 0 or t.text[k] not in ("(", "=", ";", "{", ",")):
            angle += (t.text[k] == "<") - (len(t.text[k]) if set(t.text[k]) == {">"} else 0)
            k += 1
        if t.at(k) == "(":
            maker = k == j + 1 and t.text[j] == owner
            after = t.after(k)
            body = after
            while body < end and t.text[body] not in ("{", ";"):
                body += 1
            e = t.after(body) if t.at(body) == "{" else body + 1
            cyc, cog, depth = complexity(t, body, e, JAVA) if t.at(body) == "{" else (1, 0, 0)
            if not maker or kind == "class":
                self.add("constructor" if maker else "method", i, min(e, len(t.text)), name=t.text[k - 1], owner=owner, complexity=cyc, cognitive=cog, max_depth=depth, params=self.types(k + 1, after - 1), marks=marks, abstract="abstract" in words, static="static" in words)
            return e
        stop = expression_end(t, k, (";",)) if t.at(k) == "=" else k
        while stop < end and t.text[stop] != ";":
            stop = t.after(stop) if t.text[stop] in OPEN else stop + 1
        if k > j + 1 and kind == "class":
            name_at = next((x for x in range(k - 1, j, -1) if t.words(x)), j + 1)
            of = "".join(t.text[j:name_at])
            for x, (a, _) in enumerate(parted(t, name_at, stop)):
                self.add("field", i, stop, name=t.text[a], owner=owner, type=re.sub(r"(\[\])+$", "", of), marks=marks, kind=str(x))
        return stop + 1

    def types(self, begin: int, end: int) -> list[str]:
        """The types of parameters."""
        out = []
        for a, e in parted(self.t, begin, end):
            _, _, a = self.head(a)
            name = next((k for k in range(e - 1, a, -1) if self.t.words(k)), e)
            out.append("".join(self.t.text[a:name]))
        return out


def facts(files: DataFrame) -> DataFrame:
    """Facts of (file, text); a file that can't be read gives a row with what = error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows: list[dict] = []
            for file, text in zip(pdf.file, pdf.text, strict=True):
                try:
                    rows += Java(file, text or "").run()
                except (IndexError, RecursionError, ValueError) as e:
                    rows.append({"file": file, "what": "error", "name": type(e).__name__, "marks": [], "uses": [], "params": []})
            yield pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in NAMES})

    return files.where(F.col("file").endswith(".java")).select("file", "text").mapInPandas(run, FACT)


#: Layers by annotation, the first that a class has counts.
BY_MARK = [("RestController", "controller"), ("Controller", "controller"), ("Service", "service"), ("Repository", "repository"), ("Configuration", "config"), ("Aspect", "aspect"), ("SpringBootApplication", "config"), ("EnableAutoConfiguration", "config"), ("Component", "component")]
INJECTED = ("Autowired", "Inject", "Resource")


def layer(marks: Column) -> Column:
    return F.coalesce(*[F.when(F.array_contains(marks, m), v) for m, v in BY_MARK])


def layer_tags(marks: Column) -> Column:
    own = F.filter(F.array(*[F.lit(m) for m, _ in BY_MARK]), lambda m: F.array_contains(marks, m))
    return F.array_compact(F.concat(F.array(F.concat(F.lit("layer:"), layer(marks))), F.transform(own, lambda m: F.concat(F.lit("spring:"), m))))


def full_name(package: Column, name: Column) -> Column:
    return F.concat_ws(".", F.nullif(package, F.lit("")), name)


def beans(found: DataFrame) -> DataFrame:
    """(id, name, package, file, layer, start): classes with a layer."""
    return found.where("what = 'type'").select(full_name(F.col("package"), F.col("name")).alias("id"), "name", "package", "file", layer(F.col("marks")).alias("layer"), "start").where("layer IS NOT NULL")


def injections(found: DataFrame) -> DataFrame:
    """(from_id, to_id, kind, type): beans that are injected into fields, constructors (marked, or the only one) and setters."""
    known = beans(found)
    marked = lambda names: F.arrays_overlap("marks", F.array(*[F.lit(n) for n in names]))
    one = lambda df, kind, place, of: df.select("file", "package", "owner", "start", F.lit(kind).alias("kind"), place.alias("place"), of.alias("type"))
    fields = one(found.where((F.col("what") == "field") & marked(INJECTED)), "field", F.col("name"), F.col("type"))
    single = found.where("what = 'constructor'").groupBy("file", "owner").agg(F.count(F.lit(1)).alias("n"))
    makers = found.where("what = 'constructor'").join(single, ["file", "owner"]).where((F.col("n") == 1) | marked(INJECTED[:2])).select("*", F.posexplode("params").alias("at", "of"))
    setters = found.where((F.col("what") == "method") & F.col("name").startswith("set") & (F.size("params") == 1) & marked(INJECTED[:2]))
    uses = fields.unionByName(one(makers, "constructor", F.col("at").cast("string"), F.col("of"))).unionByName(one(setters, "setter", F.lit(""), F.get("params", F.lit(0))))
    uses = uses.withColumn("from_id", full_name(F.col("package"), F.col("owner"))).join(known.select(F.col("id").alias("from_id"), "file"), ["from_id", "file"], "left_semi")
    uses = uses.withColumn("use_id", F.concat_ws("#", "file", "owner", "kind", F.col("start").cast("string"), "place")).withColumn("given", F.col("type")).withColumn("type", simple_type(F.trim("type")))
    imported = found.where("what = 'import' AND NOT static").select("file", F.col("name"), (F.col("kind") == "all").alias("asterisk"), F.col("start").alias("place"))
    of_use = uses.select("use_id", "file").join(imported, "file").select("use_id", "name", "asterisk", "place")
    by_type = resolve_types(uses.select("use_id", "package", "type"), of_use, known.select(F.col("id").alias("bean_id"), F.col("name").alias("simple"), F.struct("file", "start").alias("place")))
    return uses.join(by_type, "use_id").where("from_id <> bean_id").select("from_id", F.col("bean_id").alias("to_id"), "kind", F.col("given").alias("type"))


def layer_skips(edges: DataFrame, known: DataFrame) -> DataFrame:
    """RUL-30, JOI-07: controllers and components that are given a repository."""
    a = known.select(F.col("id").alias("from_id"), F.col("layer").alias("from_layer"), "file")
    b = known.select(F.col("id").alias("to_id"), F.col("layer").alias("to_layer"))
    return edges.join(a, "from_id").join(b, "to_id").where("from_layer IN ('controller', 'component') AND to_layer = 'repository'").select("from_id", "to_id", "type", "file", F.lit("spring-layer-skip").alias("rule_id"), F.lit("major").alias("severity"))


def service_cycles(edges: DataFrame, known: DataFrame) -> DataFrame:
    """RUL-31, GRF-09: cycles among services, one finding for each."""
    services = known.where("layer = 'service'").select("id")
    inner = edges.join(services.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(services.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    found = components(inner.select(F.lit("services").alias("graph"), "from_id", "to_id")).where("cyclic")
    return found.groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("nodes")).select("component", "nodes", F.lit("spring-service-cycle").alias("rule_id"), F.lit("major").alias("severity"))


def module_edges(found: DataFrame) -> DataFrame:
    """FLT-02, JOI-03: import edges between the modules of packages; outer libraries and own imports drop out."""
    module = lambda p: F.concat(F.lit("mod_"), F.regexp_replace(F.when(p == "", "_root").otherwise(F.element_at(F.split(p, "\\."), -1)), "[^A-Za-z0-9_]", "_"))
    target = package_of(F.col("name"))
    x = found.where("what = 'import'").withColumn("target", target).where("target <> '' AND NOT startswith(target, 'java.') AND NOT startswith(target, 'javax.') AND NOT startswith(target, 'org.springframework')")
    rows = x.select(module(F.col("package")).alias("from_id"), module(F.col("target")).alias("to_id")).where("from_id <> to_id")
    known = found.where("what = 'file'").select(module(F.col("package")).alias("to_id")).distinct()
    return rows.join(known, "to_id", "left_semi").groupBy("from_id", "to_id").agg(F.count(F.lit(1)).alias("weight")).select("from_id", "to_id", F.lit("import").alias("kind"), "weight")
