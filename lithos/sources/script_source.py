"""TypeScript and JavaScript sources to program facts (SRC-09, SCL-16, SCL-24, SCL-26, SCL-27, SCL-41)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithos.sources.braces import OPEN, SCRIPT, Tokens, complexity, expression_end, lines_of_code, parted, statement_end, tokens

#: The grammar of each extension.
GRAMMARS = {".ts": "typescript", ".mts": "typescript", ".cts": "typescript", ".tsx": "tsx", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascript"}
#: Methods whose calls with a literal path are routes.
VERBS = ("get", "post", "put", "delete", "patch", "options", "head", "all", "use")
MODIFIERS = {"public", "private", "protected", "static", "readonly", "abstract", "async", "get", "set", "override", "declare", "accessor", "*"}
UNWRAPS = 4

FACT = "file string, what string, kind string, owner string, name string, start int, end int, loc int, complexity int, cognitive int, max_depth int, params int, attributes int, abstract boolean, marks array<string>, parent string, uses array<string>"
NAMES = [c.split()[0] for c in FACT.split(", ")]


def grammar(path: str) -> str | None:
    m = re.search(r"\.[^./]*$", path)
    return GRAMMARS.get(m[0].lower()) if m else None


class Script:
    """One file's facts: imports, classes with their methods, interfaces, functions, routes."""

    def __init__(self, file: str, source: str, language: str):
        self.file, self.typed = file, language != "javascript"
        self.t = tokens(source, True, language != "typescript")
        self.rows: list[dict] = []

    def add(self, what: str, begin: int, end: int, **more) -> dict:
        t = self.t
        row = {"file": self.file, "what": what, "start": t.line[begin], "end": t.last[end - 1], "marks": [], "uses": [], **more}
        self.rows.append(row)
        return row

    def text(self, begin: int, end: int) -> str:
        return self.t.source[self.t.start[begin] : self.t.end[end - 1]]

    def run(self) -> list[dict]:
        t, i = self.t, 0
        while i < len(t.text):
            i = max(self.statement(i), i + 1)
        self.routes()
        return self.rows

    def marks(self, i: int) -> tuple[list[str], int]:
        """Names of the decorators from i on, each its last identifier, and the place after them."""
        t, out = self.t, []
        while t.at(i) == "@":
            i += 1
            while t.at(i + 1) in (".", "?."):
                i += 2
            if t.words(i):
                out.append(t.text[i])
            i = t.after(i + 1) if t.at(i + 1) == "(" else i + 1
        return out, i

    def statement(self, i: int, marks: tuple[str, ...] = ()) -> int:
        t = self.t
        found, j = self.marks(i)
        marks = (*marks, *found)
        x = t.at(j)
        if x == "import" and t.at(j + 1) not in ("(", "."):
            return self.imported(j)
        if x == "export":
            return self.exported(j, marks)
        k = j + (x in ("abstract", "async"))
        if t.at(k) == "class":
            return self.class_of(j, k, marks)
        if x == "interface" and t.words(j + 1):
            body = next((b for b in range(j, len(t.text)) if t.text[b] == "{"), len(t.text) - 1)
            self.add("interface", j, t.after(body), name=t.text[j + 1], abstract=True)
            return t.after(body)
        if t.at(k) == "function":
            return self.function(j, k, marks)
        if x in ("const", "let", "var") and t.at(j + 1) != "enum":
            return self.variables(j, marks)
        return statement_end(t, j)

    def imported(self, i: int) -> int:
        t, end = self.t, expression_end(self.t, i + 1)
        end = max(end, i + 2)
        source = next((k for k in range(i + 1, end) if t.kind[k] == "s" and t.at(k - 1) != "("), None)
        if source is not None:
            only = t.at(i + 1) == "type" and t.at(i + 2) not in ("from", ",")
            self.add("import", i, end, name=t.text[source][1:-1], kind="type" if only else "value")
        return end + (t.at(end) == ";")

    def exported(self, i: int, marks: tuple[str, ...]) -> int:
        t, j = self.t, i + 1
        if t.at(j) == "type" and t.at(j + 1) in ("{", "*"):
            j += 1
        if t.at(j) in ("{", "*"):
            end = expression_end(t, j)
            if t.at(end - 2) == "from" and t.kind[end - 1] == "s":
                self.add("import", i, end, name=t.text[end - 1][1:-1], kind="value")
            return end + (t.at(end) == ";")
        return self.statement(j + (t.at(j) == "default"), marks) if j < len(t.text) else j

    def measured(self, what: str, begin: int, end: int, params: tuple[int, int] | None, body: tuple[int, int], **more) -> None:
        cyc, cog, depth = complexity(self.t, *body, SCRIPT)
        self.add(what, begin, end, loc=lines_of_code(self.text(begin, end)), complexity=cyc, cognitive=cog, max_depth=depth, params=len(parted(self.t, *params)) if params else 0, **more)

    def signature(self, i: int) -> tuple[tuple[int, int], int]:
        """Parameters of what is declared from i on (type parameters skipped), and the place of its body or end."""
        t = self.t
        while i < len(t.text) and t.text[i] != "(":
            i += 1
        after = t.after(i)
        params = (i + 1, after - 1)
        if t.at(after) == ":":  # a result type, which may hold brackets
            after += 1
            while after < len(t.text) and not (t.text[after] in ("{", ";", "=>", "}") and t.text[after - 1] not in (":", "|", "&", "<", ",", "=>")):
                if t.line[after] > t.last[after - 1] and t.words(after) and t.text[after - 1] not in (":", "|", "&", "<", ",", "."):
                    break
                after = t.after(after) if t.text[after] in OPEN and t.kind[after] == "o" else after + 1
        return params, after

    def function(self, begin: int, at: int, marks: tuple[str, ...]) -> int:
        t, j = self.t, at + 1
        j += t.at(j) == "*"
        name = t.text[j] if t.words(j) else "<anonymous>"
        params, body = self.signature(j)
        if t.at(body) != "{":  # a signature without a body
            return expression_end(t, body) + 1
        self.measured("function", begin, t.after(body), params, (body, t.after(body)), name=name, marks=list(marks))
        return t.after(body)

    def variables(self, i: int, marks: tuple[str, ...]) -> int:
        t, j = self.t, i + 1
        while True:
            end = expression_end(t, j, (";", ","))
            k = j
            name = t.text[k] if t.words(k) else self.text(k, t.after(k)) if t.at(k) in OPEN else "<anonymous>"
            k, angle = t.after(k) if t.at(k) in OPEN else k + 1, 0
            while k < end and not (t.text[k] == "=" and angle == 0):
                angle += (t.text[k] == "<") - (t.text[k].count(">") if set(t.text[k]) == {">"} else 0)
                k = t.after(k) if t.text[k] in OPEN and t.kind[k] == "o" else k + 1
            if k < end and (fn := self.unwrapped(k + 1, end)):
                self.measured("function", j, end, *fn, name=name, marks=list(marks))
            if t.at(end) != ",":
                return end + (t.at(end) == ";")
            j = end + 1

    def unwrapped(self, i: int, end: int) -> tuple[tuple[int, int] | None, tuple[int, int]] | None:
        """Parameters and body of the function that the value from i to end is or wraps."""
        t = self.t
        for _ in range(UNWRAPS):
            j = i + (t.at(i) == "async" and t.at(i + 1) != "=>")
            if t.at(j) == "function":
                params, body = self.signature(j)
                return params, (body, t.after(body))
            if t.words(j) and t.at(j + 1) == "=>":
                return None, (j + 2, end)
            if t.at(j) in ("(", "<"):
                k = j
                if t.at(j) == "<":  # type parameters
                    while k < end and t.text[k] != "(":
                        k += 1
                params, body = self.signature(k)
                if t.at(body) == "=>" and body < end:
                    return params, (body + 1, end)
            if t.at(i) == "(" and (t.after(i) >= end or t.at(t.after(i)) == "as"):
                i, end = i + 1, t.after(i) - 1
                continue
            tail = next((k for k in range(i, end) if t.text[k] == "as" and t.words(k) and t.at(k - 1) == ")"), end)
            if tail > i and t.at(tail - 1) == ")":
                opened = next((a for a, b in t.match.items() if b == tail - 1), None)
                if opened is not None and opened > i:
                    for a, e in parted(t, opened + 1, tail - 1):
                        if fn := self.unwrapped(a, e):
                            return fn
            return None
        return None

    def class_of(self, begin: int, at: int, marks: tuple[str, ...]) -> int:
        t, j = self.t, at + 1
        name = t.text[j] if t.words(j) and t.text[j] not in ("extends", "implements") else "<anonymous>"
        body, angle = j, 0
        while body < len(t.text) and not (t.text[body] == "{" and angle <= 0):
            angle += (t.text[body] == "<") - (t.text[body].count(">") if set(t.text[body]) == {">"} else 0)
            body = t.after(body) if t.text[body] in ("(", "[", "{") and angle > 0 else body + 1
        head = [t.text[k] for k in range(j, body)]
        parent, uses = None, []
        if self.typed and "extends" in head:
            parent = next((x for x in head[head.index("extends") + 1 :] if re.match(r"[^\W\d]", x)), None)
        if self.typed and "implements" in head:
            at_names = j + head.index("implements") + 1
            uses = [t.text[a] for a, _ in parted(t, at_names, body)]
        end = t.after(body)
        row = self.add("class", begin, end, name=name, loc=lines_of_code(self.text(begin, end)), abstract=t.at(begin) == "abstract", marks=list(marks), parent=parent, uses=uses, params=0, attributes=0)
        i = body + 1
        while i < end - 1:
            i = max(self.member(i, end - 1, row), i + 1)
        return end

    def member(self, i: int, end: int, row: dict) -> int:
        t = self.t
        _, j = self.marks(i)
        if t.at(j) == ";":
            return j + 1
        begin = j
        while t.at(j) in MODIFIERS and t.at(j + 1) not in ("(", "=", ":", ";", "?", "<", "!") and j + 1 < end:
            if t.at(j) == "static" and t.at(j + 1) == "{":
                return t.after(j + 1)
            j += 1
        name = t.at(j) if t.at(j) != "[" else self.text(j, t.after(j))
        k = t.after(j) if t.at(j) == "[" else j + 1
        k += t.at(k) in ("?", "!")
        if t.at(k) in ("(", "<"):
            params, body = self.signature(k)
            if t.at(body) == "{":
                self.measured("method", begin, t.after(body), params, (body, t.after(body)), name=name, owner=row["name"])
                return t.after(body)
            return body + 1 if t.at(body) == ";" else body
        if self.typed and t.at(j) != "[":
            row["attributes"] += 1
        return expression_end(t, k) + 1 if t.at(expression_end(t, k)) == ";" else max(expression_end(t, k), k)

    def routes(self) -> None:
        t = self.t
        for i in range(1, len(t.text) - 2):
            if t.text[i].lower() in VERBS and t.at(i - 1) in (".", "?.") and t.text[i + 1] == "(" and t.kind[i + 2] == "s" and t.at(i + 3) in (",", ")"):
                begin = i
                while begin > 1 and t.at(begin - 1) in (".", "?.") and t.words(begin - 2):
                    begin -= 2
                self.add("route", begin, i + 2, kind=t.text[i].upper(), name=t.text[i + 2][1:-1])


def facts(files: DataFrame) -> DataFrame:
    """Facts of (file, text); a file of another language gives none, one that can't be read a row with what = error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows: list[dict] = []
            for file, text in zip(pdf.file, pdf.text, strict=True):
                if (language := grammar(file)) is None:
                    continue
                try:
                    rows += Script(file, text or "", language).run()
                except (IndexError, RecursionError, ValueError) as e:
                    rows.append({"file": file, "what": "error", "name": type(e).__name__, "marks": [], "uses": []})
            yield pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in NAMES})

    return files.select("file", "text").mapInPandas(run, FACT)


#: Layers by decorator, and by the end of an injectable class's name.
BY_MARK = {"Controller": "controller", "WebSocketGateway": "gateway", "Module": "module", "Catch": "filter", "Resolver": "resolver", "Mutation": "resolver", "Query": "resolver"}
BY_SUFFIX = {"Service": "service", "Repository": "service", "Guard": "guard", "Pipe": "pipe", "Interceptor": "interceptor", "Filter": "filter", "Middleware": "middleware", "Resolver": "resolver", "Strategy": "service"}


def layer(name: Column, marks: Column) -> Column:
    """SCL-24: the first decorator that names a layer; else, of an injectable class, what its name ends with."""
    by = F.create_map(*[F.lit(x) for kv in BY_MARK.items() for x in kv])
    named = F.lit("provider")
    for suffix, value in reversed(BY_SUFFIX.items()):
        named = F.when(name.endswith(suffix), value).otherwise(named)
    return F.coalesce(F.get(F.array_compact(F.transform(marks, lambda m: F.element_at(by, m))), 0), F.when(F.array_contains(marks, "Injectable"), named))


def layer_tags(name: Column, marks: Column) -> Column:
    """The layer's tag, then one for each decorator that names a layer, or for being injectable."""
    own = F.transform(F.filter(marks, lambda m: m.isin(*BY_MARK)), lambda m: F.concat(F.lit("nest:"), F.lower(m)))
    rest = F.when((F.size(own) == 0) & F.array_contains(marks, "Injectable"), F.array(F.lit("nest:injectable"))).otherwise(own)
    return F.array_compact(F.concat(F.array(F.concat(F.lit("layer:"), layer(name, marks))), rest))


def frameworks(found: DataFrame) -> DataFrame:
    """SCL-26: (file, framework) by imports, and by path for routes of pages."""
    by = F.when((F.col("name") == "express") | F.col("name").startswith("express/"), "express").when(F.col("name").startswith("@nestjs/"), "nest")
    imported = found.where("what = 'import'").select("file", by.alias("framework")).where("framework IS NOT NULL")
    paged = found.where(F.col("file").rlike("(^|/)(app|pages)/")).select("file", F.lit("next").alias("framework"))
    return imported.unionByName(paged).distinct()
