"""Row-wise functions at the boundaries that matter."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vantaq.functions import ids, scoring, text, verdict
from vantaq.schema import severity_rank, worse
from vantaq.sources import readers


def one(spark, *columns):
    row = spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()
    return row[0] if len(columns) == 1 else tuple(row)


def test_severity(spark):
    assert one(spark, worse(F.lit("low"), F.lit("high")), severity_rank(F.lit("critical")), severity_rank(F.lit("odd"))) == ("high", 4, None)


def test_ids_tell_missing_from_empty(spark):
    make = lambda snippet: ids.finding_id(F.lit("a.py"), F.lit("x"), F.lit("CWE-1"), F.lit(None).cast("string"), snippet)
    a, b = one(spark, make(F.lit(None).cast("string")), make(F.lit("")))
    assert a != b and len(a) == 64


def test_stable_key_ignores_white_space_and_case(spark):
    a, b, c = one(spark, *[ids.stable_key(F.lit("CWE-89"), F.lit(s), F.lit("t"), F.lit("p")) for s in ("A  b\n", "a b", "ab")])
    assert a == b != c and len(a) == 12


def test_wrapping_hash(spark):
    def plain(s: str) -> int:
        h = 0
        for x in s.encode():
            h = (h * 31 + x) & 0xFFFFFFFF
        return h

    for s in ("", "abc", "handle_é" * 9):
        assert one(spark, ids.wrapping_hash(F.lit(s))) == plain(s)


@pytest.mark.parametrize("evidence,confidence,tier", [(["semgrep", "independent_verifier"], 0.1, "verified"), (["independent_verifier", "security_agent_verification"], 0.1, "supported"), (["semgrep"], 0.8, "unverified"), (["semgrep"], 0.81, "supported"), ([], 0.0, "unverified")])
def test_tiers(spark, evidence, confidence, tier):
    sources = F.array(*[F.lit(e) for e in evidence]) if evidence else F.array().cast("array<string>")
    assert one(spark, scoring.tier(sources, F.lit(confidence))) == tier


def base(**over):
    row = {"confidence_score": 0.5, "verification_status": None, "sources": ["semgrep"], "cross_file": False, "code_snippet": None, "cwe_id": None, "severity": "low", "file_path": "a.py", "verification_notes": None, "title": "t", "description": "d"} | over
    return {k: F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v) if v is not None else F.lit(None).cast("string") for k, v in row.items()}


@pytest.mark.parametrize(
    "over,score",
    [
        ({}, 0.5), ({"verification_status": "confirmed"}, 0.65), ({"verification_status": "false_positive"}, 0.2), ({"verification_status": "failed"}, 0.4), ({"sources": ["a", "b"]}, 0.6), ({"cross_file": True}, 0.58),
        ({"code_snippet": "x.innerHTML", "cwe_id": "CWE-79"}, 0.6), ({"code_snippet": "html_escape(x.innerHTML)", "cwe_id": "CWE-79"}, 0.15), ({"code_snippet": "eval(input)"}, 0.55), ({"severity": "high", "confidence_score": 0.7}, 0.7),
        ({"severity": "high", "confidence_score": 0.71}, 0.76), ({"file_path": "tests/vendor/a.py"}, 0.25), ({"sources": ["bandit"]}, 0.45), ({"verification_notes": "triage false_positive"}, 0.25),
        ({"verification_notes": "Triage: True positive; rationale flawed"}, 0.4), ({"title": "Missing X header"}, 0.05), ({"confidence_score": 0.95, "verification_status": "confirmed", "file_path": "test.py"}, 0.9),
    ],
)
def test_refinement(spark, over, score):
    assert one(spark, scoring.refinement(base(**over))[0]) == pytest.approx(score)


def test_normalisation(spark):
    c = F.lit(0.8)
    assert one(spark, scoring.by_false_positive_rate(c, F.lit(0.4)), scoring.by_false_positive_rate(c, F.lit(0.0)), scoring.by_false_positive_rate(c, F.lit(0.2))) == pytest.approx((0.64, 0.96, 0.8))
    assert one(spark, scoring.by_z_score(c, F.lit(0.5), F.lit(0.0), F.lit(50)), scoring.by_z_score(c, F.lit(0.5), F.lit(0.3), F.lit(9)), scoring.by_z_score(c, F.lit(0.5), F.lit(0.3), F.lit(10))) == pytest.approx((0.8, 0.8, 1.0))


@pytest.mark.parametrize("status,confidence,advice", [("false_positive", 0.9, "exclude"), ("confirmed", 0.2, "include"), (None, 0.69, "needs_review"), (None, 0.39, "manual_review"), (None, 0.8, "include")])
def test_consensus(spark, status, confidence, advice):
    s = F.lit(status) if status else F.lit(None).cast("string")
    assert one(spark, scoring.consensus(s, F.lit(confidence))["recommendation"]) == advice


@pytest.mark.parametrize(
    "no,status,want",
    [("reachability", "confirmed", "needs_review"), ("controllability", "confirmed", "needs_review"), ("context", "confirmed", "false_positive"), ("impact", "confirmed", "needs_review"), ("evidence", "confirmed", "needs_review"), ("confidence", "confirmed", "needs_review"), (None, "confirmed", "confirmed"), ("reachability", "failed", "failed")],
)
def test_gate(spark, no, status, want):
    answers = {q: F.lit("no" if q in (no, "preconditions") else "yes") for q in verdict.QUESTIONS}
    assert one(spark, verdict.gate(F.lit(status), answers, F.lit("network"), F.lit(False), F.lit(True), F.lit(True))) == want


def test_gate_needs_a_gate_and_a_proof(spark):
    yes = {q: F.lit("no" if q == "preconditions" else "yes") for q in verdict.QUESTIONS}
    run = lambda vector, theory, gate, proof: verdict.gate(F.lit("confirmed"), yes, F.lit(vector), F.lit(theory), F.lit(gate), F.lit(proof))
    assert one(spark, run("n", False, False, True), run(" ", False, True, True), run("n", True, True, True), run(" ", True, True, False)) == ("needs_review", "needs_review", "needs_review", "confirmed")


def test_texts(spark):
    assert one(spark, text.ticket_query(F.lit("CVE-2024-1 SQL injection in Python app"))) == "CVE-2024-1 injection python state:open"
    assert one(spark, text.ticket_query(F.lit("")), text.ticket_query(F.lit("the of"))) == ("vulnerability security state:open", "vulnerability the state:open")
    assert one(spark, text.directory(F.lit("a/b/c.py")), text.directory(F.lit("c.py")), text.basename(F.lit("a\\b\\c.py")), text.language_of(F.lit("x/Y.PHTML"))) == ("a/b", ".", "c.py", "php")
    assert one(spark, text.remove_between(F.lit("a<<x>>b<<y\nz>>c"), "<<", ">>"), text.strip_fences(F.lit("```json\n[1]\n```")), text.append_note(F.lit(None).cast("string"), F.lit("n"))) == ("abc", "[1]", "n")
    assert one(spark, text.words(F.lit("Été 42, x_y")), text.identifiers(F.lit("ab abc A_1"))) == (["été", "42", "x", "y"], ["abc", "a_1"])


@pytest.mark.parametrize("pattern,path,hit", [("src", "src/a.py", True), ("src", "SRC", True), ("src", "srcx/a.py", False), ("*.py", "a.py", True), ("*.py", "d/a.py", False), ("**/*.py", "d/a.py", True), ("**/*.py", "a.py", True), ("t?st/**", "test/x/y", True)])
def test_globs(spark, pattern, path, hit):
    assert one(spark, readers.excluded(F.lit(path), [pattern])) is hit
