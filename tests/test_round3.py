"""Zeros of retrieval, failing detectors, empty inputs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from vantaq.fixtures import view
from vantaq.operators import retrieval
from vantaq.plans import phases
from vantaq.sources import readers

SF = "/root/testdata/sf0.001"


def test_zeros_are_the_first_documents_without_a_score(spark):
    rnd = random.Random(2)
    docs = spark.createDataFrame([(d,) for d in range(200)], "doc long")
    scores = [(q, d, rnd.choice([-1.0, 0.0, 2.0])) for q in range(4) for d in rnd.sample(range(200), [0, 5, 150, 199][q])] + [(4, d, 1.0) for d in range(10)] + [(5, d, -1.0) for d in range(195)]
    queries = spark.createDataFrame([(q,) for q in range(7)], "query long")
    got = retrieval.with_zeros(spark.createDataFrame(scores, "query long, doc long, score double"), docs, queries, 10).collect()
    for q in range(7):
        mine = {d for x, d, _ in scores if x == q}
        enough = sum(x == q and s > 0 for x, _, s in scores) >= 10
        want = [] if enough else [d for d in range(200) if d not in mine][:10]
        assert sorted(r.doc for r in got if r.query == q and r.doc not in mine) == want
    assert len([r for r in got if (r.query, r.doc) in {(q, d) for q, d, _ in scores}]) == len(scores)


def test_a_failing_detector_is_told_and_left_out(spark):
    f = view(spark, SF, "findings").filter("ord % 10 = 0").drop("cross_ref", "seed")
    bad = f.withColumn("title", F.raise_error(F.lit("no such tool")).cast("string"))
    got, alone = phases.scan(spark, phases.Inputs({"a": f, "b": bad})), phases.scan(spark, phases.Inputs({"a": f}))
    assert "no such tool" in got.health["detector:b"] and "detector:a" not in got.health
    assert got.findings.count() == alone.findings.count() > 0
    with pytest.raises(ValueError):
        phases.scan(spark, phases.Inputs({"b": bad}))


def test_no_findings_are_an_error(spark, tmp_path):
    (tmp_path / "f.json").write_text("[]")
    with pytest.raises(ValueError, match="no findings"):
        readers.findings(spark, f"{tmp_path}/f.json")


def test_many_queries_go_in_blocks(spark, monkeypatch):
    rnd = random.Random(3)
    v = spark.createDataFrame([(d, [rnd.random() for _ in range(4)]) for d in range(60)], "doc long, embedding array<double>")
    q = v.filter("doc < 7").withColumnRenamed("doc", "query")
    key = lambda df: sorted((r.query, r.doc, round(r.similarity, 9), r["rank"]) for r in df.collect())
    few = key(retrieval.nearest(v, q, 5))
    monkeypatch.setattr(retrieval, "ASKED", 3)
    assert key(retrieval.nearest(v, q, 5)) == few and len(few) == 35
