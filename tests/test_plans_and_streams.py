"""The scan plan and the online forms."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vantaq.fixtures import view
from vantaq.operators import planning
from vantaq.plans import phases
from vantaq.streaming import online

SF = "/root/testdata/sf0.001"


def test_profiles():
    assert len(phases.effective("core")) == 14 and len(phases.effective("all")) == 23
    assert phases.resume_from("reporting") == "complete" and phases.resume_from("semgrep") == "cpg_slice" and phases.resume_from("odd") == "indexing"
    with pytest.raises(ValueError):
        phases.effective("none")


def test_scan(spark, tmp_path):
    f = view(spark, SF, "findings").filter("ord % 5 = 0").drop("cross_ref", "seed")
    inputs = phases.Inputs({"a": f.filter("ord % 2 = 0"), "b": f.filter("ord % 2 = 1").drop("evidence")}, cves=view(spark, SF, "cves"))
    plain = phases.scan(spark, inputs)
    saved = phases.scan(spark, inputs, snapshot=str(tmp_path))
    key = lambda out: sorted((r.ord, round(r.confidence_score, 6), r.root_id) for r in out.findings.select("ord", "confidence_score", "root_id").collect())
    assert key(plain) == key(saved) and plain.health["confidence_scoring"] == "planned" and plain.health["semgrep"] == "external"
    assert phases.scan(spark, inputs, skip=("confidence_scoring",)).health["confidence_scoring"] == "skipped"


def test_dry_run(spark):
    row = phases.dry_run(view(spark, SF, "files"), 16).first()
    assert row.calls == row.files + 2 and row.calls_with_triage < row.calls


def test_stream_baseline(spark, tmp_path):
    f = view(spark, SF, "findings")
    source = tmp_path / "in"
    f.select("id", "title", "severity", "confidence_score", "verification_status").repartition(3).write.json(str(source))
    online.keep_baseline(online.findings(spark, str(source), 1), str(tmp_path / "table"), str(tmp_path / "check")).awaitTermination(120)
    got, want = planning.merged_baselines(spark.read.parquet(str(tmp_path / "table"))).first(), planning.baseline(f).first()
    assert (got.n, got.mean, got.squares) == pytest.approx((want.n, want.mean, want.squares))


def test_stream_windows(spark, tmp_path):
    rows = [(f"i{k}", "a.py", "CWE-1", "high", 0.5, k * 10) for k in range(5)] + [("i0", "a.py", "CWE-1", "high", 0.5, 0), ("x", "a.py", "CWE-1", "low", 0.9, 500)]
    spark.createDataFrame(rows, "id string, file_path string, cwe_id string, severity string, confidence_score double, s int").coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, file_path string, cwe_id string, severity string, confidence_score double, s int").json(str(tmp_path / "in")).withColumn("t", F.timestamp_seconds(F.col("s") + 1_000_000))
    once = online.first_of_id(stream, "t", "1 hour")
    for name, out in (("once", once), ("bursts", online.bursts(stream, "t", "60 seconds", "10 seconds")), ("counts", online.severity_counts(stream, "t", "100 seconds", "10 seconds"))):
        out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(120)
    assert spark.table("once").count() == 6
    assert [(r.n, r.confidence) for r in spark.table("bursts").collect()] == [(6, 0.5)]
    assert [(r.severity, r.n) for r in spark.table("counts").collect()] == [("high", 6)]
