"""Workspaces, modules of files and targets of script imports, as joins (SRC-12, SRC-15, SCL-08, SCL-10, SCL-40, AGG-28, JOI-02, JOI-04)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithos.sources.files import loose_json

#: Directories that no workspace is in; extensions tried in this order; sources that a compiled name stands for.
SKIPPED = ["node_modules", ".git", "dist", "build", ".next", ".turbo", ".cache"]
EXTENSIONS = [".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".d.ts"]
COMPILED = {".js": [".ts", ".tsx"], ".jsx": [".tsx", ".ts"], ".mjs": [".mts"], ".cjs": [".cts"]}


def clean(x: Column) -> Column:
    return F.regexp_replace(x, "[^A-Za-z0-9_]", "_")


def pattern_regex(pattern: str) -> str:
    """A workspace pattern as a regular expression over directories; a star stands for names that don't begin with a dot and are not skipped."""
    name = f"(?!\\.)(?!(?:{'|'.join(map(re.escape, SKIPPED))})(?:/|$))"
    out = ""
    for seg in (s for s in pattern.replace("\\", "/").split("/") if s):
        if seg == "**":
            out += f"(?:{name}[^/]+/)*"
        elif "*" in seg:
            out += name + ".*".join(map(re.escape, seg.split("*"))).replace(".*", "[^/]*") + "/"
        else:
            out += re.escape(seg) + "/"
    return "^" + (out[:-1] if out.endswith("/") else re.sub(r"/\)\*$", ")*", out) + "[^/]*") + "$"


def workspaces(paths: DataFrame, patterns: list[str] | None, names: DataFrame | None = None) -> DataFrame:
    """SRC-15: (workspace, package, module_id, display) of the directories with a package file that the patterns name.

    Without patterns those one or two levels deep are taken, if there are two at
    least. Directories with one last name are told apart by their whole path.
    ``names`` has (workspace, package) as read from package files.
    """
    dirs = paths.where(F.col("path").endswith("/package.json")).select(F.regexp_replace("path", "/package\\.json$", "").alias("workspace")).distinct()
    if patterns:
        asked = [p for p in patterns if not p.startswith("!")]
        found = dirs.where(F.col("workspace").rlike("|".join(f"(?:{pattern_regex(p)})" for p in asked) or "^$"))
    else:
        segs = F.split("workspace", "/")
        near = dirs.where((F.size(segs) <= 2) & ~F.exists(segs, lambda s: s.startswith(".") | s.isin(*SKIPPED)))
        found = near.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))).where("n >= 2").drop("n")  # directories of one repository, two levels deep
    last = F.element_at(F.split("workspace", "/"), -1)
    count = found.groupBy(last.alias("base")).agg(F.count(F.lit(1)).alias("n"))
    out = found.withColumn("base", last).join(count, "base").withColumn("display", F.when(F.col("n") > 1, F.col("workspace")).otherwise(F.col("base")))
    if names is not None:
        out = out.join(names, "workspace", "left")
    else:
        out = out.withColumn("package", F.lit(None).cast("string"))
    return out.select("workspace", F.coalesce("package", "base").alias("package"), F.concat(F.lit("mod_"), clean(F.col("display"))).alias("module_id"), "display").orderBy(F.desc(F.length("workspace")), "workspace")


def prefixes(path: Column) -> Column:
    """A path's directories, shortest first, then the path itself."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def modules_of(files: DataFrame, spaces: DataFrame) -> DataFrame:
    """SCL-40: (path, module_id, module) of files (path): their workspace, split by its directories where it has two or more, else the first directory."""
    owned = files.select("path", F.explode(prefixes(F.col("path"))).alias("workspace")).join(spaces.select("workspace", "module_id", "display"), "workspace")
    best = owned.groupBy("path").agg(F.max_by(F.struct("workspace", "module_id", "display"), F.length("workspace")).alias("w")).select("path", "w.*")
    inner = best.withColumn("inside", F.expr("substring(path, length(workspace) + 2)"))
    src = inner.groupBy("workspace").agg(F.max(F.col("inside").startswith("src/")).alias("src"))
    inner = inner.join(src, "workspace")
    first = F.when(F.col("src"), F.when(F.col("inside").startswith("src/"), F.expr("substring(inside, 5)"))).otherwise(F.col("inside"))
    level = inner.withColumn("head", F.when(F.instr(first, "/") > 1, F.split(first, "/")[0]))
    split = level.groupBy("workspace").agg((F.count_distinct("head") >= 2).alias("split"))
    # directories with a file of their own; a file belongs to the highest of these above it
    own = F.when(F.col("inside").startswith("src/"), F.expr("substring(inside, 5)")).otherwise(F.col("inside"))
    base = F.when(F.col("inside").startswith("src/"), F.concat("workspace", F.lit("/src/"))).otherwise(F.concat("workspace", F.lit("/")))
    rows = inner.withColumns({"own": own, "base": base}).withColumn("dir", F.regexp_extract("own", "^(.*)/[^/]*$", 1))
    direct = rows.where("dir <> ''").select("base", F.col("dir").alias("sub")).distinct()
    above = rows.where("dir <> ''").select("path", "base", "dir", F.posexplode(prefixes(F.col("dir"))).alias("depth", "sub"))
    chosen = above.join(direct, ["base", "sub"]).groupBy("path").agg(F.min_by("sub", "depth").alias("sub"))
    out = inner.join(split, "workspace").join(chosen, "path", "left").withColumn("sub", F.when(F.col("split"), F.col("sub")))
    inside = out.select("path", F.when(F.col("sub").isNotNull(), F.concat("module_id", F.lit("_"), clean(F.col("sub")))).otherwise(F.col("module_id")).alias("module_id"), F.when(F.col("sub").isNotNull(), F.concat("display", F.lit("/"), "sub")).otherwise(F.col("display")).alias("module"))
    parts = F.split(F.regexp_replace("path", "^src/", ""), "/")
    name = F.when(F.size(parts) <= 1, "_root").otherwise(clean(parts[0]))
    return inside.unionByName(files.join(best.select("path"), "path", "left_anti").select("path", F.concat(F.lit("mod_"), name).alias("module_id"), name.alias("module")))


def module_of_dotted(dotted: Column, wrapper: Column) -> Column:
    """SCL-08: the first segment below the wrapper package; the wrapper itself is named by its last segment."""
    below = F.when(F.startswith(dotted, F.concat(wrapper, F.lit("."))), F.substring(dotted, F.length(wrapper) + 2, F.length(dotted))).otherwise(dotted)
    return F.when(dotted == wrapper, F.element_at(F.split(wrapper, "\\."), -1)).otherwise(F.coalesce(F.nullif(F.split(below, "\\.")[0], F.lit("")), F.lit("_root")))


def read_config(texts: dict[str, str]) -> dict | None:
    """SRC-12: base folder and paths of the first of the two configuration files that is there and can be read."""
    for name in ("tsconfig.json", "tsconfig.base.json"):
        if name not in texts:
            continue
        try:
            options = loose_json(texts[name]).get("compilerOptions") or {}
        except (ValueError, AttributeError):
            continue
        given = options.get("paths")
        paths = {k: v for k, v in given.items() if isinstance(v, list) and all(isinstance(x, str) for x in v)} if isinstance(given, dict) else {}
        base = options.get("baseUrl") if isinstance(options.get("baseUrl"), str) else None
        return {"base": (base or "").removeprefix("./").strip("/").replace(".", "", 1) if base == "." else (base or "").removeprefix("./").strip("/"), "paths": paths}
    return None


def normal(path: Column) -> Column:
    """A path without empty parts and dots, going up where it says so."""
    step = lambda a, s: F.when(s == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).when(s.isin("", "."), a).otherwise(F.concat(a, F.array(s)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def tries(target: Column) -> Column:
    """The files that a target may stand for, in order."""
    tail = F.regexp_extract(target, "\\.(js|jsx|mjs|cjs)$", 0)
    compiled = F.array().cast("array<string>")
    for end, sources in COMPILED.items():
        stem = F.substring(target, F.lit(1), F.length(target) - len(end))
        compiled = F.when(tail == end, F.array(*[F.concat(stem, F.lit(s)) for s in sources])).otherwise(compiled)
    return F.concat(F.array(target), F.array(*[F.concat(target, F.lit(e)) for e in EXTENSIONS]), compiled, F.array(*[F.concat(target, F.lit("/index" + e)) for e in EXTENSIONS]))


def resolve_imports(imports: DataFrame, files: DataFrame, spaces: DataFrame | None = None, config: dict | None = None) -> DataFrame:
    """JOI-02: (id, target) of imports (id, file, source) that mean one of the files (path).

    Relative sources, then aliases of the configuration in their order, then the
    workspace with the longest path whose package the source names. Every try is
    an equality join; the first that exists stays. A workspace that is named
    but lacks the file ends the search.
    """
    up = F.regexp_replace("file", "[^/]*$", "")
    relative = imports.where(F.col("source").startswith(".")).select("id", F.lit(0).alias("way"), normal(F.concat(up, "source")).alias("target"))
    bare = imports.where(~F.col("source").startswith(".") & ~F.col("source").startswith("/"))
    ways = relative
    for k, (pattern, targets) in enumerate((config or {}).get("paths", {}).items()):
        head, star, tail = pattern.partition("*")
        fits = (F.col("source") == pattern) if not star else F.col("source").startswith(head) & F.col("source").endswith(tail)
        middle = F.substring("source", len(head) + 1, F.length("source") - len(head) - len(tail)) if star else F.lit("")
        for j, to in enumerate(targets):
            before, any_, after = to.partition("*")
            path = F.concat(F.lit(f"{config['base']}/{before}"), middle, F.lit(after)) if any_ else F.lit(f"{config['base']}/{to}")
            ways = ways.unionByName(bare.where(fits).select("id", F.lit(1 + 100 * k + j).alias("way"), normal(path).alias("target")))
    if spaces is not None:
        met = bare.select("id", "source", F.explode(prefixes(F.col("source"))).alias("package")).join(spaces.select("package", "workspace"), "package")
        first = met.groupBy("id", "source").agg(F.max_by(F.struct("workspace", "package"), F.struct(F.length("workspace"), "workspace")).alias("w")).select("id", "source", "w.*")
        tail = F.coalesce(F.nullif(F.substring("source", F.length("package") + 2, F.length("source")), F.lit("")), F.lit("index"))
        for k, folder in enumerate(("/src/", "/")):
            ways = ways.unionByName(first.select("id", F.lit(100_000 + k).alias("way"), normal(F.concat("workspace", F.lit(folder), tail)).alias("target")))
    asked = ways.select("id", "way", F.posexplode(tries(F.col("target"))).alias("at", "path"))
    return asked.join(files.select("path").distinct(), "path").groupBy("id").agg(F.min_by("path", F.struct("way", "at")).alias("target"))
