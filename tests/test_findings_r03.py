"""Findings of round 3: what went wrong with larger tables, on small ones."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from vantaq import catalog, queries_anchors
from vantaq.functions import responses, text
from vantaq.operators import anchors, findings, graphs, retrieval, specs, synthesis
from test_operators import rows


def test_a_finding_without_a_weakness_does_not_hide_the_others(spark):
    f = rows(spark, {"cwe_id": None}, {"cwe_id": "CWE-89"}, {"cwe_id": "CWE-79"}, {"cwe_id": "CWE-79"}, {"line_number": 2, "cwe_id": None}, {"line_number": 2, "cwe_id": "CWE-7"}, {"line_number": 2, "cwe_id": "CWE-x"})
    assert [(r.location, r.n, r.kind, r.resolved) for r in findings.conflicts(f).collect()] == [("d/a.py:1", 4, "cwe", "CWE-79")]


def test_classes_of_findings_meet_the_first_specifications_of_classes(spark, tmp_path):
    spark.range(3000).selectExpr("id AS event_id", "id % 50 AS user_id", "'error' AS event_type").write.parquet(str(tmp_path / "events.parquet"))
    spark.range(2000).selectExpr("7 * id + 4 AS p_partkey", "1 AS p_size").write.parquet(str(tmp_path / "part.parquet"))
    pairs = queries_anchors.scored_specs(spark, str(tmp_path), 3)
    assert pairs.groupBy("query", "k").count().filter("count > 3").count() == 0 and pairs.select("query").distinct().count() <= 202


def test_the_first_of_a_class_are_the_best_of_all(spark):
    made = [(f"{k % 13}/{k}", "CWE-1", k % 5) for k in range(60)]
    of = lambda some: some.crossJoin(spark.createDataFrame([(q,) for q in range(7)], "query int")).withColumn("score", (F.col("query") + 3 * F.col("k")) % 5 / 5)
    whole = spark.createDataFrame(made, "spec string, cwe_id string, k int")
    best = lambda some: sorted((r.query, r.rank, r.spec) for r in specs.best_specs(of(some), 4).collect())
    assert best(specs.first_of_class(whole, ["cwe_id", "k"], 4)) == best(whole) and len(best(whole)) == 28


def test_item_lists_are_written_once_a_weakness(spark, tmp_path):
    spark.range(600).selectExpr("id AS event_id", "id % 50 AS user_id", "'click' AS event_type").write.parquet(str(tmp_path / "events.parquet"))
    spark.range(900).selectExpr("id AS p_partkey", "1 AS p_size", "'PROMO x' AS p_type").write.parquet(str(tmp_path / "part.parquet"))
    out = catalog.QUERIES["j2_evidence_items"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "told" not in plan and "Generate" not in plan  # lists are settled before findings meet them
    assert {r.n_items for r in out.collect()} == {301, 302, 303}


def test_candidates_that_share_a_sink_are_judged_once(spark, monkeypatch):
    asked = []
    known = synthesis._counted
    monkeypatch.setattr(synthesis, "_counted", lambda traces, sinks: asked.append(sinks.count()) or known(traces, sinks))
    lines = [(f"p{k}", 0, f"PATTERN c{k} CWE-{k} {('return', 'param[0]', 'param[1]')[k % 3]} -> {('f', 'run', '', 'un')[k % 4]}[0] HIGH") for k in range(240)]
    traces = [("f(a, b)", True), ("run( )", True), ("un(x,y,)", False), ("run(x", False), ("", True), ("f (", False), ("() f(\t)", True)]
    made, of = spark.createDataFrame(lines, "proposer string, round int, line string"), spark.createDataFrame(traces, "code string, is_vulnerable boolean")
    got = {r.proposer: (r.tp, r.fp) for r in synthesis.outcomes(made, of).collect()}
    pairs = made.withColumn("p", responses.rule_pattern(F.col("line"))).crossJoin(of).filter(responses.rule_matches(F.col("p"), F.col("code")))
    want = {r.proposer: (r.tp, r.fp) for r in pairs.groupBy("proposer").agg(F.count_if("is_vulnerable").alias("tp"), F.count_if(~F.col("is_vulnerable")).alias("fp")).collect()}
    assert {k: v for k, v in got.items() if v != (0, 0)} == want and sum(asked) == 4


@pytest.mark.parametrize("made", [lambda c: responses.unified_diff(c, F.lit("x")), lambda c: responses.retrieval_query(F.lit("p"), F.array(), responses.imports(c), F.array(), c)])
def test_lines_of_a_text_are_split_few_times(spark, made):
    plan = spark.createDataFrame([("a",)], "text string").select(made(F.col("text")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 2


def test_restated_files_are_not_broadcast(spark):
    files = spark.createDataFrame([("d/a.py", "x = 1\n")], "path string, text string")
    plan = anchors.restated(rows(spark, {"code_snippet": "y"}), files)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_vectors_leave_a_worker_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "EMBEDDED", 2)
    texts = ["", None, "a", "b" * 769, "é"]
    got = {r.k: r.v for r in retrieval.byte_embeddings(spark.createDataFrame(list(enumerate(texts)), "k int, text string").coalesce(1)).collect()}
    assert [len(v) for v in got.values()] == [768] * 5 and not any(got[0]) and not any(got[1]) and got[2][0] == 1.0
    assert got[3][0] / got[3][1] == pytest.approx(2.0) and got[4][0] / got[4][1] == pytest.approx(0xC3 / 0xA9)


def test_packed_flows_are_those_that_are_peeled_together(spark, monkeypatch):
    rnd = random.Random(4)
    nodes = [(f, k) for f in range(40) for k in range(rnd.randrange(1, 8)) for _ in range(rnd.choice((1, 1, 2)))] + [(1, None), (None, 0), (None, 1)]
    edges = [(f, n, rnd.randrange(7), rnd.randrange(7), rnd.choice(("data", "data", "ok"))) for f in range(40) for n in range(rnd.randrange(9))] + [(2, 50, None, 1, "data"), (None, 0, 0, 1, "data")]
    frames = spark.createDataFrame(nodes, "flow long, idx long"), spark.createDataFrame(edges, "flow long, n long, a long, b long, kind string")
    together = sorted(map(str, graphs._large_waves(*frames).collect()))
    for most in (10_000, 8):
        monkeypatch.setattr(graphs, "PACKED", most)
        got = sorted(map(str, graphs.waves(*frames).collect()))
        assert got == together and len(got) > 100
    plan = graphs.execution_orders(*frames)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "CoGroups" not in plan


@pytest.mark.parametrize("presence", [False, True])
def test_best_documents_come_without_pairs(spark, monkeypatch, presence):
    monkeypatch.setattr(retrieval, "ASKED", 4)
    rnd = random.Random(6)
    texts = [" ".join(rnd.choice("abcdefghij") * 3 for _ in range(rnd.randrange(12))) for _ in range(600)]
    docs = spark.createDataFrame([*enumerate(texts), (600, None)], "doc long, text string").repartition(3)
    asked = spark.createDataFrame([(q, t) for q, t in enumerate(["aaa bbb bbb", "ccc", "zzz", "", "ddd eee fff aaa", "jjj zzz", "aaa"])], "query long, text string")
    words = text.words(F.col("text"))
    whole = retrieval.with_zeros(retrieval.bm25_presence(docs, asked, words, words), docs, asked, 10) if presence else retrieval.bm25(docs, asked, words, words)
    best = retrieval.bm25_best(docs, asked, words, words, 10, presence)
    told = lambda scored: sorted((r.query, r.rank, r.doc, round(r.score, 6)) for r in retrieval.ranked(scored, 10).collect())
    assert told(best) == told(whole) and best.count() < 3 * 10 * 7 + 1
