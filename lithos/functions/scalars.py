"""Scalar functions over columns (SCL-01..45)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = "^\\s+|\\s+$"


def trimmed(x: Column) -> Column:
    return F.regexp_replace(x, WHITE, "")


def loc_hash(text: Column) -> Column:
    """Lines that are neither blank nor start with #."""
    return F.size(F.filter(F.split(text, "\\r?\\n"), lambda s: (trimmed(s) != "") & ~trimmed(s).startswith("#")))


def loc_slash(text: Column) -> Column:
    """Lines of code where // and block comments that begin a line do not count; code after a block's end does."""
    def step(a: Column, raw: Column) -> Column:
        whole = trimmed(raw)
        end = F.instr(whole, "*/")
        line = F.when(~a["block"], whole).when(end > 0, trimmed(F.substring(whole, end + 2, F.length(whole)))).otherwise("")
        tail = F.substring(line, F.lit(3), F.length(line))
        closes = F.instr(tail, "*/")
        opens = line.startswith("/*")
        behind = trimmed(F.substring(tail, closes + 2, F.length(tail)))
        adds = F.when((line == "") | line.startswith("//"), 0).when(opens, F.when((closes > 0) & (behind != ""), 1).otherwise(0)).otherwise(1)
        return F.struct((a["n"] + adds).cast("int").alias("n"), ((a["block"] & (end == 0)) | (opens & (closes == 0))).alias("block"))

    return F.aggregate(F.split(text, "\\r?\\n"), F.struct(F.lit(0).alias("n"), F.lit(False).alias("block")), step)["n"]


def slug(x: Column) -> Column:
    return F.regexp_replace(x, "[^A-Za-z0-9]", "_")


def dotted(path: Column) -> Column:
    """a/b/__init__.py -> a.b"""
    no_ext = F.regexp_replace(path, "\\.py$", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(no_ext, "[/\\\\]+", "."), "(^|\\.)__init__$", ""), "^\\.+", "")


def top_package(path: Column) -> Column:
    return F.coalesce(F.nullif(F.split_part(path, F.lit("."), F.lit(1)), F.lit("")), F.lit("_root"))


def package_of(name: Column) -> Column:
    return F.regexp_extract(name, "^(.*)\\.", 1)


def last_segment(name: Column) -> Column:
    return F.coalesce(F.nullif(F.element_at(F.split(name, "\\."), -1), F.lit("")), F.lit("_root"))


def simple_type(name: Column) -> Column:
    """Without generics and one pair of brackets; the last segment."""
    return F.element_at(F.split(F.regexp_replace(F.regexp_replace(name, "<.*$", ""), "\\[\\]$", ""), "\\."), -1)


def web_grade(score: Column) -> Column:
    s = F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))
    return F.when(s >= 90, "A").when(s >= 75, "B").when(s >= 60, "C").when(s >= 40, "D").otherwise("E")


#: Fixed values.
GRADE_LABEL = {"A": "Excellent", "B": "Good", "C": "Fair", "D": "Poor", "E": "Critical"}


def grade_label(grade: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in GRADE_LABEL.items() for x in kv])[grade]


def clone_severity(lines: Column) -> Column:
    return F.when(lines >= 50, "critical").when(lines >= 30, "major").when(lines >= 15, "minor").otherwise("info")


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "critical", 0).when(severity == "major", 1).when(severity == "minor", 2).otherwise(3)


def fnv_churn(path: Column) -> Column:
    """32-bit FNV-1a of the UTF-16 units, folded to 1..100."""
    long = lambda x: F.lit(x).cast("long")
    code = lambda c: F.ascii(c).cast("long")
    pair = lambda c: F.array(long(0xD7C0) + F.shiftright(code(c), 10), long(0xDC00) + code(c).bitwiseAND(long(0x3FF)))
    units = F.flatten(F.transform(F.filter(F.split(path, ""), lambda c: c != ""), lambda c: F.when(code(c) > 0xFFFF, pair(c)).otherwise(F.array(code(c)))))
    h = F.aggregate(units, long(2166136261), lambda a, u: (a.bitwiseXOR(u) * long(16777619)).bitwiseAND(long(4294967295)))
    signed = F.when(h >= 2147483648, h - long(4294967296)).otherwise(h)
    return (F.abs(signed) % 100 + 1).cast("long")


#: Fixed value: names of modules that start programs.
ENTRYPOINT = "(?i)(^|\\W)(scripts?|bin|cli|main|cmd|app|entrypoint)(\\W|$)"


def module_shape(fan_in: Column, fan_out: Column, instability: Column, name: Column) -> Column:
    return (
        F.when((fan_in >= 3) & (fan_out >= 3), "dual-hub").when((fan_in >= 2) & (fan_out == 0), "stable-provider")
        .when((fan_in == 0) & (fan_out >= 2), F.when(name.rlike(ENTRYPOINT), "entrypoint").otherwise("pure-consumer"))
        .when((fan_in >= 1) & (fan_out == 0) & (F.coalesce(instability, F.lit(1.0)) <= 0.2), "leaf")
    )


def location(file: Column, start: Column, end: Column) -> Column:
    return F.when(start.isNull(), file).when(end.isNull() | (end == start), F.concat(file, F.lit(":"), start.cast("string"))).otherwise(F.concat(file, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string")))


def next_route(path: Column) -> Column:
    """Route of an app file: groups in parentheses, extension and a last page, layout, route or index drop out."""
    parts = F.filter(F.split(F.regexp_replace(path, "\\.[A-Za-z]+$", ""), "/"), lambda p: (p != "") & ~p.rlike("^\\(.*\\)$"))
    last = F.element_at(parts, -1)
    kept = F.when(F.size(parts) == 0, parts).when(last.isin("page", "layout", "route", "index"), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.concat(F.lit("/"), F.concat_ws("/", kept))


def relative_age(seconds: Column) -> Column:
    return F.when(seconds < 60, "just now").when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m"))).when(seconds < 86400, F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h"))).otherwise(F.concat(F.floor(seconds / 86400).cast("string"), F.lit("d")))
