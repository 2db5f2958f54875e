"""Operators on small tables, and the registered queries."""

from __future__ import annotations

import importlib
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vantaq import catalog, fixtures
from vantaq.operators import evaluation, findings, history, planning, retrieval
from vantaq.sources import readers

FIELDS = "ord long, id string, title string, file_path string, line_number int, cwe_id string, severity string, confidence_score double, sources array<string>, verification_status string, code_snippet string"


def rows(spark, *items):
    base = {"id": None, "title": "t", "file_path": "d/a.py", "line_number": 1, "cwe_id": "CWE-79", "severity": "low", "confidence_score": 0.5, "sources": ["semgrep"], "verification_status": None, "code_snippet": None}
    made = [base | {"ord": k, "id": f"i{k}"} | x for k, x in enumerate(items)]
    names = [f.split()[0] for f in FIELDS.split(", ")]
    return spark.createDataFrame([tuple(m[n] for n in names) for m in made], FIELDS)


def test_structural_dedup(spark):
    f = rows(spark, {"line_number": 10}, {"line_number": 12, "sources": ["llm", "semgrep"]}, {"line_number": 14}, {"line_number": 17, "confidence_score": 0.9}, {"line_number": None}, {"line_number": 1, "cwe_id": None}, {"line_number": 2, "cwe_id": None})
    got = sorted((r.ord, r.sources) for r in findings.structural_dedup(f).collect())
    assert got == [(1, ["semgrep", "llm"]), (3, ["semgrep"]), (4, ["semgrep"]), (5, ["semgrep"])]
    again = findings.structural_dedup(findings.structural_dedup(f).drop("island_size"))
    assert again.count() == len(got)


def test_cross_file(spark):
    f = rows(spark, {"file_path": "a"}, {"file_path": "b"}, {"file_path": "b", "cwe_id": None, "sources": ["x", "semgrep"]}, {"file_path": "c", "cwe_id": None, "severity": "high"}, {"file_path": "d", "cwe_id": "CWE-1", "sources": ["x"]})
    pairs = sorted((r.ord, r.other) for r in findings.cross_file_pairs(f).collect())
    assert pairs == [(0, 1), (0, 2), (1, 0), (2, 0), (2, 4), (4, 2)]
    counts = {r.ord: r.n for r in findings.cross_file_counts(f).collect() if r.n}
    assert counts == {0: 2, 1: 1, 2: 2, 4: 1}
    related = {r.ord: r.related_finding_ids for r in findings.with_cross_references(f, findings.cross_file_pairs(f)).collect()}
    assert related[0] == ["i1", "i2"] and related[3] is None


def test_whole_cross_file_queries_against_brute_force(spark, tmp_path):
    events = [(k, k * 7 % 60, ("click", "purchase", "error", "view")[k % 4]) for k in range(1, 241)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    f = fixtures.view(spark, str(tmp_path), "findings").select("ord", "file_path", "cwe_id", "severity", "sources").collect()
    alike = lambda a, b: a.file_path != b.file_path and ((a.cwe_id is not None and a.cwe_id == b.cwe_id) or (a.severity == b.severity and bool(set(a.sources) & set(b.sources))))
    pairs = sorted((a.ord, b.ord) for a in f for b in f if alike(a, b))
    whole = catalog.QUERIES["j3_cross_file_pairs_whole"](spark, str(tmp_path)).collect()
    assert sorted((r.ord, r.other) for r in whole) == [p for p in pairs if p[0] % 20 == 0]
    counts = {r.ord: r.n for r in catalog.QUERIES["j3_cross_file_counts_whole"](spark, str(tmp_path)).collect()}
    assert counts == dict(Counter(a for a, _ in pairs)) and len(counts) > 200


def test_whole_vector_searches_against_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(retrieval, "PART", 30)
    monkeypatch.setattr(retrieval, "BLOCK", 3)
    rng = np.random.default_rng(5)
    e = rng.normal(size=(140, 6)).astype(np.float32)
    e[7], e[50:60] = 0, e[40]
    spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(e)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    words = [[f"w{x}" for x in rng.integers(0, 40, 12)] for _ in range(140)]
    spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(words)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, "x")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    v = e.astype(float)
    norm = np.sqrt((v * v).sum(axis=1))
    df = Counter(t for w in words for t in set(w))

    def top(scores, k, least=None):
        return [d for d in sorted(range(140), key=lambda d: (-round(float(scores[d]), 9), d)) if least is None or scores[d] > least][:k]

    def cosine(q):
        both = norm * norm[q]
        return np.where(both > 0, v @ v[q] / np.where(both > 0, both, 1), 0.0)

    def bm25(q):
        asked = Counter(words[q])
        return [sum(n * (140 - df[t] + 0.5) / (df[t] + 0.5) * w.count(t) * 2.2 / (w.count(t) + 1.2) for t, n in asked.items()) for w in words]

    got: dict[int, list[int]] = {}
    for r in catalog.QUERIES["o2_cosine_top10_whole"](spark, str(tmp_path)).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append(r.doc)
    assert got == {q: top(cosine(q), 10) for q in range(0, 140, 20)}
    fused: dict[int, dict[int, float]] = {}
    for r in catalog.QUERIES["w7_rank_fusion_whole"](spark, str(tmp_path)).collect():
        fused.setdefault(r.query, {})[r.doc] = r.score
    for q in range(0, 140, 20):
        score = Counter()
        for listed in (top(cosine(q), 20), top(bm25(q), 20, 0)):
            for rank, d in enumerate(listed, 1):
                score[d] += 1 / (60 + rank)
        assert fused[q] == {d: round(s, 6) for d, s in sorted(score.items(), key=lambda x: (-round(x[1], 9), x[0]))[:10]}


def test_chains(spark):
    f = rows(spark, {"cwe_id": "CWE-78"}, {"cwe_id": "CWE-89"}, {"cwe_id": "CWE-89"}, {"cwe_id": "CWE-287"}, {"cwe_id": "CWE-269", "file_path": "e/b.py"}, {"cwe_id": "CWE-98"}, {"cwe_id": "CWE-22"})
    got = sorted((r.dir, r.chain_type, r.primary, r.partner) for r in findings.chains(f).collect())
    assert got == [("d", "file_access_to_rce", 0, 6), ("d", "injection_to_execution", 0, 1)]
    partners = {r.ord: r.chain_partners for r in findings.with_chain_partners(f, findings.chains(f)).collect()}
    assert partners[0] == ["i6", "i1"] and partners[2] is None


def test_near_duplicates(spark):
    f = rows(spark, {"line_number": 1}, {"line_number": 4}, {"line_number": 8}, {"line_number": None}, {"line_number": 4, "file_path": "x"}, {"line_number": 1})
    assert sorted((r.a, r.b) for r in findings.near_duplicate_pairs(f).collect()) == [(0, 1), (0, 5), (1, 5)]


def test_conflicts(spark):
    f = rows(spark, {"severity": "high"}, {}, {"line_number": 2}, {"line_number": 2, "cwe_id": "CWE-20"}, {"line_number": 3}, {"line_number": 3, "cwe_id": "odd"}, {"line_number": 4, "confidence_score": 0.1}, {"line_number": 4}, {"line_number": 5, "confidence_score": 0.2}, {"line_number": 5})
    got = sorted((r.location, r.kind, r.resolved) for r in findings.conflicts(f).collect())
    assert got == [("d/a.py:1", "severity", "high"), ("d/a.py:2", "cwe", "CWE-20"), ("d/a.py:4", "confidence", "0.300000")]


def test_citations(spark):
    files = spark.createDataFrame([("d/a.py", 10)], "path string, n_lines int")
    f = rows(spark, {"line_number": 10}, {"line_number": 11}, {"line_number": 0}, {"line_number": None}, {"file_path": "../x"}, {"file_path": "no.py"}, {"file_path": " "}, {"file_path": "multiple_files"}).withColumn("verification_notes", F.lit(None).cast("string"))
    cited = findings.citations(f, files)
    assert [r.state for r in cited.orderBy("ord").collect()] == ["passed", "past_end", "line_zero", "passed", "escaped", "unreadable", "unchecked", "unchecked"]
    assert [r.verification_status for r in findings.with_citation_verdict(cited).orderBy("ord").collect()] == [None, "failed", "failed", None, "failed", "failed", None, None]


def test_scores(spark):
    found = spark.createDataFrame([("t", "a", "CWE-1", 10), ("t", "s", "CWE-1", 10), ("t", "b", "cwe-1", 10), ("u", "z", "CWE-9", 1)], "target string, file_path string, cwe_id string, line_number long")
    expected = spark.createDataFrame([("t", "a", "CWE-1", 15), ("t", "a", "CWE-1", 16), ("t", "b", "CWE-1", 10), ("t", "s", "CWE-1", 10)], "target string, file_path string, cwe_id string, line long")
    suppressed = spark.createDataFrame([("t", "s"), ("t", "s"), ("t", "q")], "target string, file_path string")
    got = {r.target: r for r in evaluation.score(found, expected, suppressed).collect()}
    t = got["t"]
    assert (t.expected, t.matched, t.missed, t.false_flags, t.clean, t.recall, t.precision, t.silence) == (4, 1, 3, 1, 1, 0.25, 0.5, 0.5)
    assert (got["u"].recall, got["u"].precision, got["u"].silence) == (1.0, 1.0, 1.0)
    assert evaluation.suite(evaluation.score(found, expected, suppressed)).first().passed is False


def test_budget(spark):
    f = spark.createDataFrame([(i, i % 4 == 0) for i in range(100)], "ord long, high_risk boolean")
    got = sorted(r.ord for r in planning.budget(f, 10, 13).collect())
    assert got == [*range(10), 12, 16, 20]


def test_batch_verdicts(spark):
    items = spark.createDataFrame([(1, 0, 1, "confirmed"), (1, 1, None, "odd"), (1, 2, 9, "confirmed"), (2, 0, None, "confirmed"), (2, 1, None, "false_positive"), (1, 3, 0, "false_positive")], "batch long, position long, idx long, status string")
    got = {(r.batch, r.position): (r.verdict, r.missing) for r in planning.batch_verdicts(items, items).collect()}
    assert got == {(1, 0): ("false_positive", False), (1, 1): ("needs_review", False), (1, 2): ("needs_review", True), (1, 3): ("needs_review", True), (2, 0): ("confirmed", False), (2, 1): ("false_positive", False)}


def test_outermost_and_snippets(spark):
    r = spark.createDataFrame([("p", 1, 10), ("p", 2, 5), ("p", 10, 12), ("p", 10, 11), ("q", 3, 4)], "path string, start long, end long")
    assert sorted((x.path, x.start, x.end) for x in planning.outermost(r).collect()) == [("p", 1, 10), ("p", 10, 12), ("q", 3, 4)]
    lines = spark.createDataFrame([(1, k, f"l{k}") for k in range(1, 6)], "doc_id long, line_no long, text string")
    targets = spark.createDataFrame([(1, 3), (1, 99)], "doc_id long, line long")
    got = {x.line: x.snippet for x in planning.snippets(targets, lines, 1).collect()}
    assert got == {3: "   2: l2\n>> 3: l3\n   4: l4", 99: "   4: l4\n   5: l5"}


def test_chunks(spark):
    files = spark.createDataFrame([("a", "12345\n" * 5), ("b", None), ("c", "x" * 50 + "\ny\n")], "path string, text string")
    got = sorted((r.path, r.chunk, r.start_line, r.end_line, r.n_bytes) for r in planning.chunks(files, limit=13).collect())
    assert got == [("a", 0, 1, 2, 12), ("a", 1, 3, 4, 12), ("a", 2, 5, 5, 6), ("c", 0, 1, 1, 51), ("c", 1, 2, 2, 2)]


PYTHON = "import os\n\ndef one(x):\n    return x\n\nclass Two:\n    def a(self):\n        return 1\n\n    def b(self):\n        return '{'\n\ntail = 1\n"
PHP = "<?php\nfunction one($x) {\n  if ($x) { return 1; }\n}\nclass Two\n{\n  public function a() { return '}'; }\n  function b() {\n    return 2;\n  }\n}\n"


def test_function_spans():
    assert planning.function_spans(PYTHON, "python") == [(2, 4), (5, 11), (6, 8), (9, 11)]
    assert planning.function_spans(PHP, "php") == [(0, 4), (4, 11), (6, 7), (7, 10)]


def test_chunks_keep_functions_whole(spark):
    files = spark.createDataFrame([("a.py", PYTHON, "python"), ("b.php", PHP, "php"), ("c", PHP, None)], "path string, text string, language string")
    got = [(r.path, r.start_line, r.end_line, r.n_bytes) for r in planning.chunks(files, limit=80).orderBy("path", "chunk").collect()]
    assert [g[:3] for g in got if g[0] == "a.py"] == [("a.py", 1, 4), ("a.py", 5, 8), ("a.py", 9, 13)]
    assert [g[:3] for g in got if g[0] == "b.php"] == [("b.php", 1, 4), ("b.php", 5, 7), ("b.php", 8, 11)]
    assert sum(g[3] for g in got if g[0] == "b.php") == len(PHP) and sum(g[3] for g in got if g[0] == "c") == len(PHP)
    whole = [(r.start_line, r.end_line) for r in planning.chunks(files.limit(1)).collect()]
    assert whole == [(1, 13)]


def test_no_chunk_of_a_long_text_is_dropped(spark):
    files = spark.createDataFrame([("a", "12345\n" * 60)], "path string, text string")
    got = sorted((r.chunk, r.start_line, r.end_line, r.n_bytes, r.past_most) for r in planning.chunks(files, limit=13).collect())
    assert got == [(k, 2 * k + 1, 2 * k + 2, 12, k >= 24) for k in range(30)]


def test_baselines_merge(spark):
    f = rows(spark, *[{"confidence_score": x / 10} for x in range(10)])
    both = planning.merged_baselines(planning.baseline(f.filter("ord < 3")).unionByName(planning.baseline(f.filter("ord >= 3")))).first()
    whole = planning.baseline(f).first()
    assert (both.n, both.mean, both.squares) == pytest.approx((whole.n, whole.mean, whole.squares))


def test_cves(spark):
    c = spark.createDataFrame([(0, "C-1", "NVD", "Stored XSS"), (1, "C-1", "KEV", "a resource leak"), (2, "C-2", "NVD", "odd"), (3, "C-2", "NVD", "SQL Injection")], "ord long, cve_id string, src string, description string")
    assert sorted((r.cve_id, r.ord) for r in history.preferred_cves(c).collect()) == [("C-1", 1), ("C-2", 2)]
    assert {r.pattern: r.cve_count for r in history.cve_clusters(c).collect()} == {"Cross-Site Scripting": 1, "Remote Code Execution": 1, "Other": 1, "SQL Injection": 1}


def test_readers(spark, tmp_path):
    (tmp_path / "src").mkdir()
    for name, body in (("src/a.py", "x"), ("src/.h.py", "x"), ("src/b.php", "x" * 100), ("c.txt", "x")):
        (tmp_path / name).write_text(body)
    got = {r.path: r.language for r in readers.files(spark, str(tmp_path), max_size=50).collect()}
    assert got == {"src/a.py": "python"}
    now = readers.hashed(spark, str(tmp_path))
    assert readers.changed_since(now, now.filter("path NOT LIKE '%a.py'").withColumn("hash", F.lit("0"))).groupBy("change").count().count() == 2
    (tmp_path / "f.json").write_text('[{"title": "t", "file_path": "a", "severity": "high", "confidence_score": 0.5}]')
    assert len(readers.findings(spark, str(tmp_path / "f.json")).first().id) == 64
    (tmp_path / "o.json").write_text('{"target": "o", "description": "", "expected_findings": [{"file_path": "a", "line": 1, "cwe_id": "CWE-1", "class": "x"}], "expected_suppressed": []}')
    assert readers.oracles(spark, str(tmp_path / "o.json"))[0].first().target == "o"
    manifests = spark.createDataFrame([("package.json", '{"dependencies": {"a": "1"}}'), ("requirements.txt", "# c\nflask==2.0\nx"), ("go.mod", "module m\nrequire (\n\tgithub.com/a/b v1.2.3\n)"), ("Cargo.toml", '[package]\nname = "x"\n[dependencies]\nserde = "1.0"\n')], "path string, text string")
    assert sorted((r.name, r.version, r.ecosystem) for r in readers.dependencies(manifests).collect()) == [("a", "1", "npm"), ("flask", "2.0", "pip"), ("github.com/a/b", "v1.2.3", "go"), ("serde", "1.0", "cargo"), ("x", "", "pip")]


def test_entry_without_the_llm_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert "w1_structural_dedup" in entry.queries() and "pipeline" not in entry.queries()
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)


@pytest.mark.parametrize("name", ["a25_oracle_scores", "w1_structural_dedup", "m2_refined_confidence", "m7_bm25_top10", "j25_call_graph_paths", "w12_chunks", "k1_json_rows"])
def test_queries_run(spark, name):
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
