"""Rows and runs; ``reports`` has whole documents, ``stores`` what a scan remembers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def sarif_level(severity: Column) -> Column:
    return F.when(severity.isin("critical", "high"), "error").when(severity == "medium", "warning").otherwise("note")


def json_lines(findings: DataFrame) -> DataFrame:
    """One JSON text per finding."""
    return findings.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in findings.columns if c != "ord"])).alias("value"))


def write_json(findings: DataFrame, path: str) -> None:
    json_lines(findings).write.mode("overwrite").text(path)


def write_run(findings: DataFrame, path: str, run_id: int) -> None:
    """A run that ``readers.prior_runs`` reads."""
    findings.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)
