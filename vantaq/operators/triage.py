"""Which files a triage lets through."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import responses

REPLY = "struct<findings: array<struct<file: string, suspicion: double, summary_one_line: string, reason: string>>>"


def triaged(files: DataFrame, replies: DataFrame, threshold: float = 0.3) -> DataFrame:
    """batch, path, decision: analyse, skip (named as too little suspicious), or done (not named and analysed before). Files that a
    reply doesn't name, and all of a batch whose reply cannot be read, are analysed. files: batch, path, analysed; replies:
    batch, content, one for each batch."""
    parsed = replies.select("batch", F.from_json(responses.unfenced_triage(F.col("content")), REPLY)["findings"].alias("named"))
    rows = parsed.select("batch", F.explode("named").alias("n")).select("batch", F.col("n.file").alias("path"), responses.suspicious(F.col("n.suspicion"), threshold).alias("high"))
    said = rows.groupBy("batch", "path").agg(F.bool_or("high").alias("high"))
    decision = F.when(F.col("high"), "analyse").when(F.col("high").isNotNull(), "skip").when(F.col("analysed"), "done").otherwise("analyse")
    return files.join(said, ["batch", "path"], "left").select("batch", "path", decision.alias("decision"), F.col("high").isNotNull().alias("classified"))


def trust(decisions: DataFrame, most: float = 0.5) -> DataFrame:
    """batch, submitted, classified, distrusted."""
    counts = decisions.groupBy("batch").agg(F.count("*").alias("submitted"), F.count_if("classified").alias("classified"))
    return counts.withColumn("distrusted", responses.distrusted(F.col("classified"), F.col("submitted"), most))


def not_analysed(files: DataFrame, done: DataFrame) -> DataFrame:
    """files (path) without those that a resumed scan has behind it (path)."""
    return files.join(done.select("path").distinct(), "path", "left_anti")
