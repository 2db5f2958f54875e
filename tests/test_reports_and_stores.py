"""Whole documents, runs, stores, resuming scans, and functions of responses."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from vantaq.fixtures import view
from vantaq.functions import project, responses, text, verdict
from vantaq.operators import enrichment, planning
from vantaq.plans import phases
from vantaq.sinks import reports, stores, writers
from vantaq.sources import readers

SF = "/root/testdata/sf0.001"


def bound(spark, parts, tmp_path, name: str) -> str:
    reports.write_document(parts, f"{tmp_path}/{name}")
    reports.bind(spark, f"{tmp_path}/{name}", f"{tmp_path}/{name}.txt")
    return (tmp_path / f"{name}.txt").read_text()


def some(spark):
    return view(spark, SF, "findings").filter("ord < 60").withColumn("poc_code", F.when(F.col("ord") == 3, "run()\nit"))


def test_sarif_document(spark, tmp_path):
    f = some(spark)
    doc = json.loads(bound(spark, reports.sarif_document(f), tmp_path, "sarif"))
    run = doc["runs"][0]
    rows = f.orderBy("ord").collect()
    assert doc["version"] == "2.1.0" and [r["ruleId"] for r in run["results"]] == [r.id for r in rows] == [r["id"] for r in run["tool"]["driver"]["rules"]]
    assert all(r["locations"][0]["physicalLocation"]["artifactLocation"]["uriBaseId"] in run["originalUriBaseIds"] for r in run["results"])
    assert [r["locations"][0]["physicalLocation"]["region"].get("startLine") for r in run["results"]] == [r.line_number for r in rows]
    assert run["results"][3]["relatedLocations"][0]["annotations"][0]["endLine"] == 2 and "relatedLocations" not in run["results"][4]
    assert json.loads(bound(spark, reports.sarif_document(f.limit(0)), tmp_path, "none"))["runs"][0]["results"] == []
    assert len(json.loads(bound(spark, reports.sarif_document(f, gate=True), tmp_path, "gated"))["runs"][0]["results"]) < len(rows)


def test_json_documents(spark, tmp_path):
    f = some(spark).select("ord", "id", "title", "severity", "evidence", "confidence_score")
    plain = json.loads(bound(spark, reports.json_document(f), tmp_path, "plain"))
    assert [x["id"] for x in plain] == [r.id for r in f.orderBy("ord").collect()] and "verification_tier" not in plain[0]
    rejected = f.filter("ord % 7 = 0").withColumn("rejection_reason", F.lit("no"))
    whole = json.loads(bound(spark, reports.json_document(f, rejected, gate=True), tmp_path, "whole"))
    assert whole["summary"]["total_findings"] == 60 == sum(whole["summary"][s] for s in ("critical", "high", "medium", "low", "info"))
    assert len(whole["rejected"]) == 9 and whole["rejected"][0]["rejection_reason"] == "no" and whole["findings"][0]["verification_tier"]
    assert json.loads(bound(spark, reports.json_document(f.limit(0), rejected.limit(0)), tmp_path, "empty"))["findings"] == []


def test_markdown_and_html_documents(spark, tmp_path):
    f = some(spark)
    md = bound(spark, reports.markdown_document(f, "shop", "2024-01-01"), tmp_path, "md")
    assert md.startswith("# Security Vulnerability Report") and md.count("\n### [") == 60 + f.count() * 0 + sum(1 for r in f.collect() if len(r.evidence) == 1 and r.confidence_score <= 0.8)
    assert md.index("## Critical Findings (12)") < md.index("## Info Findings (12)") < md.index("## Appendix")
    assert "## No Findings" in bound(spark, reports.markdown_document(f.limit(0), "shop", "x"), tmp_path, "nothing")
    html = bound(spark, reports.html_document(f.withColumn("title", F.lit("<b>")), "shop"), tmp_path, "html")
    assert html.startswith("<!DOCTYPE html>") and "&lt;b&gt;" in html and "<h3><b>" not in html and html.count('<div class="card') == 5


def test_runs_round_trip(spark, tmp_path):
    path = f"{tmp_path}/runs"
    assert readers.prior_runs(spark, path, 3).count() == 0
    f = view(spark, SF, "findings").filter("ord < 10").select("ord", "id", "title", "file_path")
    for run in (100, 300, 200):
        writers.write_run(f.filter(F.col("ord") < run / 100), path, run)
    got = readers.prior_runs(spark, path, 2)
    assert {(r.run_id, r["count"]) for r in got.groupBy("run_id").count().collect()} == {(300, 3), (200, 2)}
    (tmp_path / "landed" / "run-5").mkdir(parents=True)
    (tmp_path / "landed" / "run-5" / "findings.json").write_text('[{"id": "a", "file_path": "x.py"}, {"id": "b"}]')
    assert [(r.id, r.run_id) for r in readers.landed_runs(spark, f"{tmp_path}/landed", 1).collect()] == [("a", 5)]


def test_stores(spark, tmp_path):
    root = f"{tmp_path}/stores"
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert stores.load(spark, root, "file_hashes").count() == 0
    for h in ("1", "2"):
        stores.save(spark.createDataFrame([("a", h)], "path string, hash string"), root, "file_hashes")
    assert rows(stores.load(spark, root, "file_hashes")) == [("a", "2")]
    stores.mark_false(spark.createDataFrame([("x",), ("y",), ("x",)], "id string"), root)
    stores.unmark_false(spark.createDataFrame([("y",)], "id string"), root)
    assert rows(stores.without_false(spark.createDataFrame([("x",), ("y",), ("z",)], "id string"), root)) == [("y",), ("z",)]
    for at, said in ((1, "old"), (2, "new")):
        stores.remember(spark.createDataFrame([("k", said, at)], stores.STORES["responses"]), root)
    assert rows(stores.cached(spark.createDataFrame([("k",), ("m",)], "key string"), root)) == [("k", "new"), ("m", None)]
    stores.save(spark.createDataFrame([("p", 3, ["a"])], stores.STORES["threat_models"]), root, "threat_models")
    assert enrichment.merged_threats(stores.load(spark, root, "threat_models"), stores.load(spark, root, "threat_models")).first().high_risk_areas == ["a"]


def test_scans_resume_and_end_early(spark, tmp_path):
    f = view(spark, SF, "findings").filter("ord % 5 = 0").drop("cross_ref", "seed")
    inputs = phases.Inputs({"a": f}, cves=view(spark, SF, "cves"))
    key = lambda out: sorted((r.ord, round(r.confidence_score, 6), r.root_id) for r in out.findings.select("ord", "confidence_score", "root_id").collect())
    whole = phases.scan(spark, inputs, snapshot=f"{tmp_path}/s")
    want = key(whole)
    last = sorted(p for p in (tmp_path / "s").iterdir() if "root_cause" in p.name or "cve_bootstrap" in p.name or "reporting" in p.name)
    for p in last:
        (p / "_SUCCESS").unlink()
    again = phases.scan(spark, phases.Inputs({"a": f.limit(0)}, cves=inputs.cves), snapshot=f"{tmp_path}/s", resume=True)
    assert again.health["confidence_scoring"] == "resumed" and again.health["root_cause_dedup"] == "planned" and key(again) == want
    early = phases.scan(spark, inputs, stop_at=3)
    assert early.health["confidence_scoring"] == "terminated" and early.health["reporting"] == "planned"
    assert phases.scan(spark, inputs, stop_at=0).health["confidence_scoring"] == "planned"


def test_related_findings_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(phases, "RELATED", 5)
    f = view(spark, SF, "findings").drop("cross_ref", "seed")
    out = phases._cross(f).select("ord", "n_related", F.size("related_finding_ids").alias("n")).collect()
    assert max(r.n for r in out) == phases.RELATED and any(r.n_related > phases.RELATED for r in out)


def test_response_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("v")).first().v
    long_text = "é" * 5000
    cut = get(responses.cut_code(F.lit(long_text)))
    assert len(cut.encode()) <= 8000 and cut.endswith(f"[truncated - {5000 - cut.count('é')} chars omitted]") and len(cut.encode()) > 7990
    assert get(responses.cut_code(F.lit("short"))) == "short"
    diff = "--- a/x.py\n+++ b/x.py\n@@ -1 +1 @@\n-a\n+b"
    assert get(responses.unified_diff(F.lit(f"Sure:\n```\n  {diff}\n```\nbye"), F.lit("x.py"))) == "  " + diff
    assert get(responses.unified_diff(F.lit(diff.replace("@@", "")), F.lit("x.py"))) is None and get(responses.unified_diff(F.lit(diff), F.lit("y.py"))) is None
    assert get(responses.resolved(F.lit("{{ a.out }} {{a.out}} {{ b.out }}"), {"a": F.lit("1$"), "b": F.lit(None).cast("string")})) == "1$ {{a.out}} "
    assert get(responses.placeholder_roles(F.lit("{{ a.out }} {{b}} {{ }} {{a.x}} {{c"))) == ["a", "b", "a"]
    assert get(text.ellipsis(F.lit("abcdef"), 6)) == "abcdef" and get(text.ellipsis(F.lit("abcdefg"), 6)) == "abc..."
    assert get(project.hunt_domains(F.array(F.lit("Rust")))) == ["crypto", "injection", "memory_safety"]
    assert get(verdict.compiled(F.lit(False), F.lit("x"))).note == "PoC compilation failed: x"
    assert get(readers.stripped_rule(F.lit("tmp-r"), ["other", "tmp"])) == "r" and get(readers.stripped_rule(F.lit("tmp-"), ["tmp"])) == "tmp-"
    with pytest.raises(ValueError):
        from vantaq.operators import anchors

        anchors.revspec("-x")


def test_global_ranks_are_a_numbering(spark):
    got = [r.n for r in planning.global_rank(spark.range(1000).withColumn("k", F.col("id") * 7919 % 1000), ["k"], "n").orderBy("k").collect()]
    assert got == list(range(1, 1001))


def test_traces_and_flows(spark, tmp_path):
    for name, code in (("vuln_CWE-89_1.txt", "q(x)\ny"), ("benign_2.txt", "ok"), ("other.txt", "no"), ("vuln_x.md", "no")):
        (tmp_path / name).write_text(code)
    assert sorted(map(tuple, readers.labelled_traces(spark, str(tmp_path)).collect())) == [("ok", False, ""), ("q(x)\ny", True, "CWE-89")]
    assert enrichment.execution_order(4, [(0, 2), (1, 2), (2, 3)]) == [1, 0, 2, 3] and enrichment.execution_order(2, [(0, 1), (1, 0)]) is None
