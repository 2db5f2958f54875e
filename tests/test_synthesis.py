"""Proposers and vulnerability evidence on small tables."""

from __future__ import annotations

import pytest

from vantaq.operators import history, synthesis


@pytest.mark.parametrize("at_once", [2000, 1])
def test_proposers_stop_at_the_first_good_round(spark, monkeypatch, at_once):
    monkeypatch.setattr(synthesis, "AT_ONCE", at_once)
    line = lambda sink, source="return": f"PATTERN {sink} CWE-89 {source} -> {sink}[0] HIGH"
    proposals = [
        ("a", 0, line("open")), ("a", 1, line("query", "param[1]")), ("a", 2, line("never")), ("a", 2, line("never")),
        ("b", 0, line("open")), ("b", 1, line("x")), ("c", 0, line("query")), ("c", 1, "no pattern"), ("d", 0, "no pattern"), ("d", 1, line("query")), ("e", 0, line("never")), ("f", 0, line("open")), ("f", 1, "no pattern"),
    ]
    traces = [("query(a, b)", True), ("query( a,b ) open", True), ("query(x)", False), ("open()", False), (None, False), ("nothing", None)]
    judged = synthesis.outcomes(spark.createDataFrame(proposals, "proposer string, round int, line string"), spark.createDataFrame(traces, "code string, is_vulnerable boolean"))
    got = {(r.proposer, r.round): (r.tp, r.fp, r.tn, r.fn, round(r.f1, 4)) for r in judged.collect() if r.pattern}
    assert got["a", 0] == (1, 1, 3, 1, 0.5) and got["a", 1] == (2, 0, 4, 0, 1.0) and got["b", 1] == (0, 1, 3, 2, 0.0) and got["c", 0] == (2, 1, 3, 0, 0.8) and got["e", 0] == (0, 0, 4, 2, 0.0)
    ends = {r.proposer: (r.best_round, r.best_id, r.rounds, r.stopped) for r in synthesis.converged(judged).collect()}
    assert ends == {"a": (1, "query", 2, True), "b": (0, "open", 2, False), "c": (0, "query", 1, True), "d": (None, None, 0, False), "e": (0, "never", 1, False), "f": (None, None, 1, False)}


def test_nothing_to_judge(spark):
    none = spark.createDataFrame([], "proposer string, round int, line string")
    traces = spark.createDataFrame([], "code string, is_vulnerable boolean")
    assert synthesis.converged(synthesis.outcomes(none, traces)).count() == 0
    one = spark.createDataFrame([("a", 0, "PATTERN p CWE-1 return -> f[0] LOW")], none.schema)
    assert [(r.tp, r.fp, r.tn, r.fn, r.f1) for r in synthesis.outcomes(one, traces).collect()] == [(0, 0, 0, 0, 0.0)]


def test_vulnerabilities_become_evidence(spark):
    kind = "array<struct<source: struct<kind: string, label: string>, weight: double, detail: string, ts: timestamp>>"
    findings = spark.createDataFrame([(1, "CWE-79", [(("semgrep", ""), 1.0, "seen", None)]), (2, "CWE-79", None), (3, "CWE-1", None), (4, None, [])], f"ord long, cwe_id string, evidence {kind}")
    cves = spark.createDataFrame([(2, "CVE-2", "CWE-79", "high"), (1, "CVE-1", "CWE-79", None), (3, "CVE-3", None, "low")], "ord long, cve_id string, cwe_id string, severity string")
    got = {r.ord: r.evidence for r in history.with_cve_items(findings, cves).collect()}
    details = ["Related CVE: CVE-1 (severity: unknown)", "Related CVE: CVE-2 (severity: High)"]
    assert [e.detail for e in got[1]] == ["seen", *details] and [(e.source.kind, e.source.label, e.weight, e.detail) for e in got[2]] == [("cwe_spec", "CWE-79", 0.5, d) for d in details]
    assert got[3] is None and got[4] == []
