"""Scan progress events: a fold to the newest state, in batch and as a stream (STR-01..05, WIN-09)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def fold(events: DataFrame) -> DataFrame:
    """Newest state of each scan; of events at one time the largest id counts. A field without an event is null."""
    last = F.max(F.struct("ts", "event_id", "event_type", "value"))
    error = F.max(F.when(F.col("event_type") == "error", F.struct("ts", "event_id")))
    x = events.groupBy(F.col("user_id").alias("scan_id")).agg(F.count(F.lit(1)).alias("events"), last.alias("l"), error.alias("e"))
    return x.select("scan_id", "events", F.col("l.event_type").alias("status"), F.col("l.value").alias("percent"), F.col("e.event_id").alias("error_event"))


def stream(spark: SparkSession, folder: str, schema: str = EVENT) -> DataFrame:
    """Events of a growing folder of Parquet files; repeated event ids count once."""
    return spark.readStream.schema(schema).parquet(folder).dropDuplicates(["event_id"])


def run_fold(spark: SparkSession, folder: str, sink: str, checkpoint: str) -> None:
    """Fold all files present and write the newest state to ``sink`` (complete mode, exactly once by checkpoint)."""

    def write(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")

    q = fold(stream(spark, folder)).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def parse_json(lines: DataFrame, schema: str) -> DataFrame:
    """SRC-20: JSON events from a text column ``value``; malformed ones drop out."""
    return lines.select(F.from_json("value", schema).alias("e")).where("e is not null").select("e.*")
