"""Findings as a stream: an extension, the batch operators' online forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import planning
from ..schema import FINDING


def findings(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """New JSON files of a directory, with the time at which each row was read."""
    return spark.readStream.schema(FINDING).option("maxFilesPerTrigger", files_per_trigger).json(path).withColumn("seen_at", F.current_timestamp())


def first_of_id(stream: DataFrame, time: str, late: str) -> DataFrame:
    """Each id once within the time that late rows are waited for."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(["id"])


def bursts(stream: DataFrame, time: str, gap: str, late: str) -> DataFrame:
    """Sessions of findings of one file and weakness: start, end, n and the highest confidence."""
    window = F.session_window(F.col(time), gap)
    out = stream.withWatermark(time, late).groupBy(window, "file_path", "cwe_id").agg(F.count("*").alias("n"), F.max("confidence_score").alias("confidence"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "file_path", "cwe_id", "n", "confidence")


def severity_counts(stream: DataFrame, time: str, width: str, late: str) -> DataFrame:
    out = stream.withWatermark(time, late).groupBy(F.window(F.col(time), width), "severity").agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), "severity", "n")


def keep_baseline(stream: DataFrame, table: str, checkpoint: str):
    """Starts a query that appends every micro-batch's baseline to a table; ``planning.merged_baselines`` makes one of them. A batch that
    is replayed replaces its own rows."""

    def add(batch: DataFrame, batch_id: int) -> None:
        planning.baseline(batch).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
