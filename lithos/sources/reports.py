"""Reports as stored documents and tables, and progress events as lines (SNK-01, SNK-02, SNK-04, SNK-05, SNK-09, SRC-16, SRC-17, STR-02)."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from lithos.operators.analysis import analyze

TABLES = ("files", "units", "classes", "edges", "findings", "modules", "repo")


def read_sources(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of the readable files below a folder, paths relative to it."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = raw.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.try_to_binary(F.lit("")).alias("_"), "content")
    cut = len(root.removeprefix("file:").rstrip("/")) + 2
    return base.select(F.expr(f"substring(path, {cut})").alias("path"), F.expr("try_validate_utf8(cast(content as string))").alias("text"))


def write_report(report: dict[str, DataFrame], folder: str, scan_id: str) -> None:
    """Tables of a report under ``folder``, keyed by scan; a finding with one id is written once."""
    once = Window.partitionBy("module_id", "rule_id", "subject").orderBy("severity")
    for name in TABLES:
        rows = report[name]
        if name == "findings":
            rows = rows.withColumn("_r", F.row_number().over(once)).where("_r = 1").drop("_r")
        rows.withColumn("scan_id", F.lit(scan_id)).write.mode("overwrite").parquet(f"{folder}/{name}/scan={scan_id}")


def read_report(spark: SparkSession, folder: str, scan_id: str) -> dict[str, DataFrame]:
    """The tables of a scan; an unknown one is an error."""
    try:
        return {name: spark.read.parquet(f"{folder}/{name}/scan={scan_id}") for name in TABLES}
    except AnalysisException as e:
        raise FileNotFoundError(f"no report of scan {scan_id}") from e


def write_document(report: dict[str, DataFrame], path: str) -> None:
    """SNK-01: the report as one document a module, as lines of JSON: its scores, files, edges and findings."""
    many = lambda name, key, *cols: report[name].groupBy(F.col(key).alias("module_id")).agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(name))
    out = report["modules"].join(many("files", "module_id", "path", "language", "loc"), "module_id", "left").join(many("edges", "from_id", "to_id", "kind", "weight"), "module_id", "left").join(many("findings", "module_id", "rule_id", "severity", "subject"), "module_id", "left")
    out.write.mode("overwrite").json(path)


def stored_text(spark: SparkSession, folder: str, file_id: str) -> str | None:
    """SRC-17: a stored text by its id made safe, or nothing; ids can't leave the folder."""
    safe = "".join(c if c.isalnum() and c.isascii() or c in "._-" else "_" for c in file_id)
    if safe in ("", ".", ".."):
        return None
    try:
        row = spark.read.text(f"{folder}/{safe}", wholetext=True).first()
    except AnalysisException:
        return None
    return row[0] if row else None


def write_progress(events: DataFrame, folder: str, checkpoint: str) -> None:
    """SNK-04: a stream of events as lines of JSON; null fields are left out. Each event is written once."""
    q = events.select(F.to_json(F.struct(*events.columns)).alias("value")).writeStream.format("text").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def enqueue(jobs: DataFrame, queued: DataFrame) -> DataFrame:
    """SNK-05, STR-05: jobs (scan_id, ...) that are not queued yet, one of each."""
    return jobs.dropDuplicates(["scan_id"]).join(queued.select("scan_id"), "scan_id", "left_anti")


def main(argv: list[str]) -> int:
    """SNK-09: scores of a folder of sources, printed as JSON or written to a file."""
    p = argparse.ArgumentParser()
    p.add_argument("folder")
    p.add_argument("--out")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    report = analyze(read_sources(spark, a.folder))
    text = json.dumps({"repo": report["repo"].first().asDict(), "modules": [r.asDict() for r in report["modules"].orderBy("module_id").collect()]}, indent=2)
    if a.out:
        with open(a.out, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        print(text)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
