"""Scalar functions over names, aliases, workspaces and display values (SCL-09, 23, 32, 34, 36, 37, 45)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lithos.functions.scalars import web_grade

#: The words that place a dotted name in a layer; the first layer that fits wins.
LAYER_WORDS = {
    1: ("controller", "controllers", "views", "routes", "handlers", "api", "endpoints"),
    2: ("service", "services", "usecases", "use_cases", "application"),
    3: ("repository", "repositories", "repo", "repos", "dao", "daos", "models", "schemas", "persistence"),
}
#: Lines of context around a finding, and lines of a snippet at most.
CONTEXT_LINES, SNIPPET_LINES = 20, 400


def layer_pattern(layer: int) -> str:
    return "(^|[.])(" + "|".join(LAYER_WORDS[layer]) + ")([.]|\\z)"


def layer(name: Column) -> Column:
    """1 to 3 where a whole segment of the dotted name is one of a layer's words, else null."""
    low = F.lower(name)
    return F.coalesce(*[F.when(low.rlike(layer_pattern(k)), k) for k in LAYER_WORDS])


def node_module(path: Column) -> Column:
    """First folder below an optional src/, made a plain name; _root for files that lie in none."""
    parts = F.filter(F.split(F.regexp_replace(F.regexp_replace(path, "\\\\", "/"), "^src/", ""), "/"), lambda p: p != "")
    return F.when(F.size(parts) <= 1, "_root").otherwise(F.regexp_replace(F.element_at(parts, 1), "[^A-Za-z0-9_]", "_"))


def bytes_text(n: Column) -> Column:
    """B, KB or MB; one decimal, half up (exact, as the divisors are powers of two)."""
    tenths = lambda unit: F.format_string("%.1f", F.floor(n * 10 / unit + 0.5) / 10)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.concat(tenths(1024), F.lit(" KB"))).otherwise(F.concat(tenths(1024 * 1024), F.lit(" MB")))


def tenths(x: Column) -> Column:
    """With one decimal, half up."""
    t = F.floor(x * 10 + 0.5).cast("long")
    return F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"))


def number_text(n: Column) -> Column:
    """1.2k, 3.4M, or the whole number."""
    return F.when(n >= 1_000_000, F.concat(tenths(n / 1_000_000), F.lit("M"))).when(n >= 1000, F.concat(tenths(n / 1000), F.lit("k"))).otherwise(n.cast("string"))


def age_text(seconds: Column, day: Column) -> Column:
    """just now, minutes, hours or days ago, each rounded from the one before; beyond a month the day itself."""
    half_up = lambda x: F.floor(x + 0.5)
    m = half_up(seconds / 60)
    h = half_up(m / 60)
    d = half_up(h / 24)
    text = lambda x, unit: F.concat(x.cast("string"), F.lit(unit))
    return F.when(seconds < 60, "just now").when(m < 60, text(m, "m ago")).when(h < 24, text(h, "h ago")).when(d < 30, text(d, "d ago")).otherwise(day)


def ratio_text(x: Column) -> Column:
    """Whole per cent; a dash for no value."""
    return F.when(x.isNull() | F.isnan(x), "—").otherwise(F.concat(F.floor(x * 100 + 0.5).cast("string"), F.lit("%")))


def alias_middle(specifier: Column, pattern: str) -> Column:
    """What the star of ``pattern`` stands for, '' for an equal pattern without one, null where they differ."""
    head, star, tail = pattern.partition("*")
    if not star:
        return F.when(specifier == pattern, "")
    inner = F.substring(specifier, F.lit(len(head) + 1), F.greatest(F.length(specifier) - len(head) - len(tail), F.lit(0)))
    return F.when(specifier.startswith(head) & specifier.endswith(tail), inner)


def alias_targets(specifier: Column, paths: dict[str, list[str]]) -> Column:
    """Targets of every pattern that fits, in order, with the star's text in the place of theirs."""
    found = []
    for pattern, targets in paths.items():
        middle = alias_middle(specifier, pattern)
        for t in targets:
            head, star, tail = t.partition("*")
            found.append(F.when(middle.isNotNull(), F.concat(F.lit(head), middle if star else F.lit(""), F.lit(tail))))
    return F.array_compact(F.array(*found))


def workspace_subpath(specifier: Column, package: Column) -> Column:
    """'' for the package itself, the rest for a path below it, else null."""
    return F.when(specifier == package, "").when(F.startswith(specifier, F.concat(package, F.lit("/"))), F.substring(specifier, F.length(package) + 2, F.length(specifier)))


def fallback_grade(overall: Column, average_complexity: Column, smells: Column) -> Column:
    return web_grade(F.coalesce(overall, F.greatest(F.lit(0.0), 100 - 5 * average_complexity - 2 * smells)))


def snippet(text: Column, start: Column, end: Column) -> Column:
    """Numbered lines around ``start``..``end``, these marked with >."""
    lines = F.split(text, "\\r?\\n")
    first = F.coalesce(start, F.lit(1))
    last = F.coalesce(end, first)
    top = F.greatest(F.lit(1), first - CONTEXT_LINES)
    low = F.least(F.size(lines), last + CONTEXT_LINES, top + SNIPPET_LINES - 1)
    row = lambda i: F.concat(F.when((i >= first) & (i <= last), "> ").otherwise("  "), F.lpad(i.cast("string"), F.length(low.cast("string")), " "), F.lit(" | "), F.get(lines, i - 1))
    return F.when(top > low, "").otherwise(F.array_join(F.transform(F.sequence(top, F.greatest(top, low)), row), "\n"))
