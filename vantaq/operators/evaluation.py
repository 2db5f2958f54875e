"""Scoring against ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score(findings: DataFrame, expected: DataFrame, suppressed: DataFrame, near: int = 5) -> DataFrame:
    """Per target: expected, matched, missed, false_flags, clean, recall, precision, silence. A finding on a suppressed path is a false flag
    and matches nothing; an expected row is matched by any other finding of its path and weakness at most ``near`` lines off."""
    bad = suppressed.select("target", "file_path").distinct()
    flagged = findings.join(bad, ["target", "file_path"], "left_semi")
    usable = findings.join(bad, ["target", "file_path"], "left_anti").select("target", "file_path", "cwe_id", F.col("line_number").alias("at"))
    want = expected.withColumn("_row", F.monotonically_increasing_id()) if "ord" not in expected.columns else expected.withColumn("_row", F.col("ord"))
    e = want.alias("e")
    u = usable.alias("u")
    hit = e.join(u, (F.col("e.target") == F.col("u.target")) & (F.col("e.file_path") == F.col("u.file_path")) & (F.col("e.cwe_id") == F.col("u.cwe_id")) & (F.abs(F.col("e.line") - F.col("u.at")) <= near), "left_semi")
    clean = bad.join(flagged.select("target", "file_path"), ["target", "file_path"], "left_anti")
    count = lambda df, name: df.groupBy("target").agg(F.count("*").alias(name))
    targets = expected.select("target").union(suppressed.select("target")).union(findings.select("target")).distinct()
    out = targets
    for df, name in ((want, "expected"), (hit, "matched"), (flagged, "false_flags"), (bad, "suppressed"), (clean, "clean")):
        out = out.join(count(df, name), "target", "left")
    out = out.fillna(0)
    share = lambda a, b: F.when(b > 0, a / b).otherwise(1.0)
    return out.select(
        "target", "expected", "matched", (F.col("expected") - F.col("matched")).alias("missed"), "false_flags", "clean",
        share(F.col("matched"), F.col("expected")).alias("recall"), share(F.col("matched"), F.col("matched") + F.col("false_flags")).alias("precision"), share(F.col("clean"), F.col("suppressed")).alias("silence"),
    )


def suite(scores: DataFrame, floor: float = 0.7) -> DataFrame:
    """All targets together: the share of expected rows that are matched, and whether it exceeds the floor."""
    total = scores.agg(F.sum("expected").alias("expected"), F.sum("matched").alias("matched"), F.sum("false_flags").alias("false_flags"), F.count("*").alias("targets"))
    rate = F.when(F.col("expected") > 0, F.col("matched") / F.col("expected")).otherwise(1.0)
    return total.select("targets", "expected", "matched", "false_flags", rate.alias("aggregate"), (rate > floor).alias("passed"))


def confusion(rows: DataFrame) -> DataFrame:
    """rows: predicted, actual (booleans)."""
    n = rows.agg(*[F.count_if((F.col("predicted") == p) & (F.col("actual") == a)).alias(name) for name, p, a in (("tp", True, True), ("fp", True, False), ("fn", False, True), ("tn", False, False))])
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    precision, recall = share(F.col("tp"), F.col("tp") + F.col("fp")), share(F.col("tp"), F.col("tp") + F.col("fn"))
    return n.select("tp", "fp", "fn", "tn", precision.alias("precision"), recall.alias("recall"), share(2 * precision * recall, precision + recall).alias("f1"))
