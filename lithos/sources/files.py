"""File listings, configuration files and validation (SRC-01..06, 12..18, VAL-01..05)."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos.operators.rules import BUILD_DIRS, SKIP_DIRS

#: Extensions of each language.
LANGUAGES = {".py": "python", ".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".cts": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".java": "java"}
#: Names that the language scan, the worker's scan and the scans of each language don't enter.
PRUNED = ["node_modules", ".git", ".venv", "venv", "__pycache__", "dist", "build", ".next", ".turbo", ".cache", "test", "tests", "__tests__", "__mocks__", "fixtures", "__fixtures__", "e2e", "static", "public", "assets", "resources", "sample-projects"]
WORKER_PRUNED = [".git", "node_modules", ".venv", "venv", "__pycache__", "dist", "build", ".next", ".turbo"]
PYTHON_PRUNED = ["__pycache__", ".venv", "venv", ".git", "node_modules", "dist", "build", ".pytest_cache", ".tox", "test", "tests", "__tests__", "fixtures", "__fixtures__", "e2e", "static", "public", "assets", "resources", "sample-projects"]
NODE_PRUNED = ["node_modules", ".git", "dist", "build", ".next", ".turbo", "out", "coverage", ".cache", "test", "tests", "__tests__", "__mocks__", "fixtures", "__fixtures__", "e2e", "static", "public", "assets", "resources", "sample-projects"]
JAVA_PRUNED = [".git", "target", "build", ".gradle", ".idea", "node_modules", ".mvn", "test", "tests", "__tests__", "fixtures", "__fixtures__", "e2e", "static", "public", "assets", "resources", "sample-projects"]
#: Extensions of the worker's scan, which knows fewer.
WORKER_LANGUAGES = {".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".java": "java"}
#: Names at a repository's root, of which one is enough; of the last two a file must have a section.
READMES = ["README.md", "README.rst", "README.txt", "README"]
CI_PATHS = [".github/workflows", ".gitlab-ci.yml", ".circleci/config.yml", ".travis.yml", "azure-pipelines.yml", "Jenkinsfile"]
LINTERS = [".prettierrc", ".prettierrc.json", ".prettierrc.yml", ".prettierrc.yaml", ".prettierrc.js", ".eslintrc", ".eslintrc.json", ".eslintrc.js", ".eslintrc.cjs", ".eslintrc.yml", "eslint.config.js", "eslint.config.mjs", ".flake8", "ruff.toml", ".ruff.toml"]
LINTER_SECTIONS = ["setup.cfg", "pyproject.toml"]
LOCKS = {"package.json": ["pnpm-lock.yaml", "package-lock.json", "yarn.lock", "npm-shrinkwrap.json"], "pyproject.toml": ["poetry.lock", "uv.lock", "pdm.lock", "requirements.txt"]}
#: Extensions of binary files.
BINARIES = [".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tiff", ".ico", ".webp", ".mp3", ".mp4", ".mov", ".avi", ".wav", ".flac", ".ogg", ".zip", ".tar", ".gz", ".7z", ".rar", ".bin", ".exe", ".dll", ".so", ".dylib", ".jar", ".war", ".psd", ".ai", ".sketch", ".pdf"]


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, bytes, modified) of all files below a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def outside(paths: DataFrame, pruned: list[str] = PRUNED) -> DataFrame:
    """FLT-01: paths of which no part is a pruned name."""
    return paths.where(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(p) for p in pruned])))


def base(path: str = "path") -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: str = "path") -> Column:
    """The lower-case extension of a name, none for a name that only begins with a dot."""
    return F.lower(F.regexp_extract(base(path), "^.+?([.][^.]*)$", 1))


def languages(paths: DataFrame, pruned: list[str] = PRUNED, known: dict[str, str] = LANGUAGES) -> DataFrame:
    """SRC-01, SRC-02: files of each language, most frequent first."""
    by = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    x = outside(paths, pruned).select(F.element_at(by, extension()).alias("language"))
    return x.where("language is not null").groupBy("language").agg(F.count(F.lit(1)).alias("files")).orderBy(F.desc("files"), "language")


def worker_languages(paths: DataFrame) -> DataFrame:
    """SRC-02: the worker's scan; no supported file is an error."""
    found = languages(paths, WORKER_PRUNED, WORKER_LANGUAGES)
    if found.isEmpty():
        raise ValueError("no supported source files")
    return found


def python_files(paths: DataFrame) -> DataFrame:
    """SRC-03, by path."""
    name = base()
    return outside(paths, PYTHON_PRUNED).where(name.endswith(".py") & ~name.startswith("test_") & ~name.endswith("_test.py") & (name != "conftest.py")).orderBy("path")


def node_files(paths: DataFrame) -> DataFrame:
    """SRC-04: no declarations, no tests, nothing whose name begins with a dot."""
    found = outside(paths, NODE_PRUNED).where(extension().isin(".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs"))
    return found.where(~F.col("path").rlike("\\.(d|test|spec)\\.ts$") & ~F.col("path").rlike("(^|/)\\.[^/]+")).orderBy("path")


def java_files(paths: DataFrame) -> DataFrame:
    """SRC-05: nothing in directories that begin with a dot."""
    return outside(paths, JAVA_PRUNED).where(F.col("path").endswith(".java") & ~F.col("path").rlike("(^|/)\\.[^/]*/")).orderBy("path")


def hygiene(files: DataFrame) -> DataFrame:
    """RUL-24..27 over (repo, path, text): what a repository's root lacks. ``text`` may be null but for files with sections."""
    one = lambda names: F.max(F.col("path").isin(*names))
    section = F.col("path").isin(*LINTER_SECTIONS) & F.col("text").rlike(r"(?i)\[tool\.(ruff|black|flake8|isort)\]|\[flake8\]")
    ci = F.col("path").isin(*CI_PATHS[1:]) | F.col("path").startswith(CI_PATHS[0] + "/")
    facts = files.groupBy("repo").agg(one(READMES).alias("readme"), F.max(ci).alias("ci"), F.max(F.col("path").isin(*LINTERS) | F.coalesce(section, F.lit(False))).alias("linter"), *[x for k, (name, locks) in enumerate(LOCKS.items()) for x in (one([name]).alias(f"needs{k}"), one(locks).alias(f"has{k}"))])
    lack = lambda cond, rule, severity, file: F.when(cond, F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(file).alias("file")))
    found = F.array_compact(F.array(
        lack(~F.col("readme"), "missing-readme", "info", "README.md"), lack(~F.col("ci"), "missing-ci", "info", ".github/workflows/"),
        lack(~F.col("linter") & F.col("needs1"), "missing-linter-config", "info", "pyproject.toml"), lack(~F.col("linter") & ~F.col("needs1"), "missing-linter-config", "info", "package.json"),
        *[lack(F.col(f"needs{k}") & ~F.col(f"has{k}"), "missing-lockfile", "minor", name) for k, name in enumerate(LOCKS)],
    ))
    return facts.select("repo", F.explode(found).alias("f")).select("repo", "f.*")


def large_binaries(files: DataFrame, least: int) -> DataFrame:
    """RUL-29 over (repo, path, bytes): large files with a binary extension, outside skipped and build directories."""
    dirs = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    inside = files.where(extension().isin(*BINARIES) & (F.col("bytes") >= least) & ~F.arrays_overlap(dirs, F.array(*map(F.lit, (*SKIP_DIRS, *BUILD_DIRS)))))
    return inside.select("repo", F.col("path").alias("file"), "bytes", F.lit("large-binary-file").alias("rule_id"), F.when(F.col("bytes") >= 5 * least, "major").otherwise("minor").alias("severity"))


def loose_json(text: str) -> dict:
    """SRC-12: JSON with comments and trailing commas."""
    token = r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*[\s\S]*?\*/'
    bare = re.sub(token, lambda m: m[0] if m[0][0] == '"' else "", text)
    return json.loads(re.sub(r'("(?:\\.|[^"\\])*")|,(\s*[}\]])', lambda m: m[1] or m[2], bare))


def pnpm_packages(text: str) -> list[str]:
    """SRC-13: the packages list of a workspace file, block or inline."""
    out, inside = [], False
    for raw in text.splitlines():
        line = re.sub(r"\s+#.*$|^#.*$", "", raw).rstrip()
        if m := re.match(r"packages:\s*\[(.*)\]", line):
            return [x.strip().strip("'\"") for x in m[1].split(",") if x.strip()]
        if re.match(r"packages:\s*$", line):
            inside = True
        elif inside and (m := re.match(r"\s*-\s*(.+)$", line)):
            out.append(m[1].strip().strip("'\""))
        elif inside and line and not line[0].isspace():
            inside = False
    return out


def package_workspaces(text: str) -> list[str]:
    """SRC-14: workspaces of a package file, as a list or under ``packages``."""
    w = json.loads(text).get("workspaces", [])
    return list(w if isinstance(w, list) else w.get("packages", []))


def violations(rows: DataFrame, checks: dict[tuple[str, str], str]) -> DataFrame:
    """VAL-01: how often each constraint (path, code) is violated, in one pass."""
    hits = F.array(*[F.when(F.expr(cond), F.struct(F.lit(p).alias("path"), F.lit(c).alias("code"))) for (p, c), cond in checks.items()])
    return rows.select(F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("v")).groupBy("v.path", "v.code").agg(F.count(F.lit(1)).alias("n"))


def merge_rows(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """SNK-07/08: rows of ``new`` replace those of ``old`` by key."""
    return new.unionByName(old.join(new.select(*key), key, "left_anti"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
