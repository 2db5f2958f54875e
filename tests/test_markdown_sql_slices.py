"""Markdown, the SQL surface and graph slices."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from vantaq import sql
from vantaq.fixtures import view
from vantaq.functions.markdown import to_html
from vantaq.operators import code, findings, graphs, planning, slicing
from vantaq.sinks import reports
from vantaq.sources import readers

SF = "/root/testdata/sf0.001"
CASES = [
    ("# A *b* c #\n\npara `x<y` **bold** _it_ ~~no~~\nnext  \nbr", "<h1>A <em>b</em> c</h1>\n<p>para <code>x&amp;lt;y</code> <strong>bold</strong> <em>it</em> <del>no</del>\nnext<br />\nbr</p>\n"),
    ("- a\n  - b\n    - c\n- d", "<ul>\n<li>a\n<ul>\n<li>b\n<ul>\n<li>c</li>\n</ul>\n</li>\n</ul>\n</li>\n<li>d</li>\n</ul>\n"),
    ("1. a\n2. b\n\n   c\n", "<ol>\n<li>\n<p>a</p>\n</li>\n<li>\n<p>b</p>\n<p>c</p>\n</li>\n</ol>\n"),
    ("3) x\n4) y", '<ol start="3">\n<li>x</li>\n<li>y</li>\n</ol>\n'),
    ("```rust a\nlet x = 1 < 2;\n\n```\nend", '<pre><code class="language-rust">let x = 1 &amp;lt; 2;\n\n</code></pre>\n<p>end</p>\n'),
    ("    code\n      more\n\nt", "<pre><code>code\n  more\n</code></pre>\n<p>t</p>\n"),
    ('[a *b*](http://x.y/?q=1&r=2 "ti") ![i](z.png)', '<p><a href="http://x.y/?q=1&amp;r=2" title="ti">a <em>b</em></a> <img src="z.png" alt="i" /></p>\n'),
    ("a\n===\nb\n---\n***\n", "<h1>a</h1>\n<h2>b</h2>\n<hr />\n"),
    ("***x*** **a *b* c** *a **b** c* a_b_c 2*3*4 \\*x\\* **open", "<p><em><strong>x</strong></em> <strong>a <em>b</em> c</strong> <em>a <strong>b</strong> c</em> a_b_c 2<em>3</em>4 *x* **open</p>\n"),
    ('line one\\nline "two" & <b>', "<p>line one\nline &quot;two&quot; &amp; &lt;b&gt;</p>\n"),
    ("- a\n  ```\n  x\n\n  y\n  ```\n- b\nlazy", "<ul>\n<li>a\n<pre><code>x\n\ny\n</code></pre>\n</li>\n<li>b\nlazy</li>\n</ul>\n"),
    ("* x\n+ y\n\n> q", "<ul>\n<li>x</li>\n</ul>\n<ul>\n<li>y</li>\n</ul>\n<p>&gt; q</p>\n"),
    ("text\n- i\n1. n\n2) m", '<p>text</p>\n<ul>\n<li>i</li>\n</ul>\n<ol>\n<li>n</li>\n</ol>\n<ol start="2">\n<li>m</li>\n</ol>\n'),
    ("``a ` b`` `c [x] [y](", "<p><code>a ` b</code> `c [x] [y](</p>\n"),
    ("", ""),
]


@pytest.mark.parametrize("text,want", CASES)
def test_markdown(text, want):
    assert to_html(text) == want


def test_any_text_becomes_html():
    rnd = random.Random(1)
    parts = ["*", "_", "**", "~~", "`", "```\n", "\n", "- ", "  ", "1. ", "[a](b)", "[", "]", "(", "|", "|-|\n", "# ", "a", "b c", "\\", "\n\n", "    ", "---\n", "==="]
    for _ in range(3000):
        got = to_html("".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))))
        assert all(got.count(f"<{t}>") == got.count(f"</{t}>") for t in ("ul", "li", "em", "strong", "del", "p", "pre"))
    assert len(to_html("a* " * 20000)) > 20000 and len(to_html("*a " * 20000)) > 20000


def test_texts_and_appendices(spark):
    f = spark.createDataFrame([(1, "<t>", "a.py", None, None, "**d**", None), (2, "u", "b.py", 3, "r & s", None, "- x")], "ord long, title string, file_path string, line_number int, reason string, description string, recommendation string")
    got = [r.x for r in f.orderBy("ord").select(reports.html_texts(f).alias("x")).collect()]
    assert got == ['<div class="description"><h4>Description</h4><p><strong>d</strong></p>\n</div>', '<div class="recommendation"><h4>Recommendation</h4><ul>\n<li>x</li>\n</ul>\n</div>']
    parts = [r.part for r in reports.appendices(f, f.limit(0)).orderBy("section", "rank", "ord").collect()]
    assert parts[0].endswith("1 unverified findings excluded from main report</p>".replace("1", "2")) and parts[-1] == "</section>" and len(parts) == 4
    assert "&lt;t&gt;" in parts[1] and "N/A" in parts[1] and "No evidence detail available" in parts[1] and "r &amp; s" in parts[2]


# The SQL surface: the same rows as the operators


def same(a, b):
    return sorted(map(str, a.select(sorted(a.columns)).collect())) == sorted(map(str, b.select(sorted(a.columns)).collect()))


def test_sql_functions_are_the_operators(spark):
    assert len(sql.register(spark)) == 10
    php = "<?php\nfunction a($x) {\n  exec($x);\n  b(1);\n}\nfunction b() { return strlen('x'); }\n"
    files = spark.createDataFrame([("a.php", php, "php"), ("b.php", None, "php"), ("c.php", php * 40, "php")], "path string, text string, language string")
    files.createOrReplaceTempView("t_files")
    assert same(spark.sql("SELECT * FROM vq_call_sites(TABLE(t_files))"), code.calls(files)) and code.calls(files).count() > 5
    assert same(spark.sql("SELECT * FROM vq_functions(TABLE(t_files))"), code.functions(files))
    whole = planning.chunks(files.filter("text IS NOT NULL"), 300).select("path", "chunk", "start_line", "end_line")
    assert same(spark.sql("SELECT * FROM vq_chunks(TABLE(t_files), 300)"), whole) and whole.count() > 5
    f = view(spark, SF, "findings")
    f.createOrReplaceTempView("t_findings")
    islands = spark.sql("SELECT file_path, n FROM vq_islands(TABLE(SELECT ord, file_path, cwe_id, coalesce(line_number, 0) AS line_number, confidence_score FROM t_findings) PARTITION BY (file_path, cwe_id) ORDER BY (line_number, ord), 2)")
    assert same(islands, findings.structural_dedup(f).select("file_path", F.col("island_size").alias("n")))
    ranges = spark.createDataFrame([("a", 1, 9), ("a", 2, 3), ("a", 9, 12), ("b", 5, 5), ("b", None, 4)], "path string, start long, end long")
    ranges.createOrReplaceTempView("t_ranges")
    assert same(spark.sql("SELECT * FROM vq_outermost(TABLE(t_ranges) PARTITION BY path ORDER BY (start, end DESC))"), planning.outermost(ranges.filter("start IS NOT NULL")))
    got = spark.sql("SELECT n, round(mean, 9) AS mean, round(squares, 6) AS squares FROM vq_baselines(TABLE(SELECT 'p' AS project, confidence_score, verification_status FROM t_findings) PARTITION BY project)")
    assert same(got, planning.baseline(f).select("n", F.round("mean", 9).alias("mean"), F.round("squares", 6).alias("squares")))
    nodes, edges = spark.createDataFrame([(1, k) for k in range(4)], "flow long, idx long"), spark.createDataFrame([(1, 0, 0, 2, "data"), (1, 1, 1, 2, "data"), (1, 2, 2, 3, "data")], "flow long, n long, a long, b long, kind string")
    nodes.selectExpr("flow", "-1L AS n", "idx AS a", "CAST(NULL AS BIGINT) AS b").union(edges.select("flow", "n", "a", "b")).createOrReplaceTempView("t_flow")
    assert same(spark.sql("SELECT * FROM vq_execution_order(TABLE(t_flow) PARTITION BY flow ORDER BY n)"), graphs.execution_orders(nodes, edges))
    assert [r.x for r in spark.sql("SELECT vq_worse(a, 'medium') AS x FROM VALUES ('low'), ('high'), ('odd') AS t(a)").collect()] == ["medium", "high", "medium"]
    assert spark.sql("SELECT * FROM vq_islands(TABLE(SELECT ord, file_path, cwe_id, 1 AS line_number, 1.0D AS confidence_score FROM t_findings WHERE false) PARTITION BY (file_path, cwe_id) ORDER BY (line_number, ord), 2)").count() == 0


def test_slices_of_landed_nodes(spark, tmp_path):
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "a.json").write_text(
        '{"slice": "s", "n": 0, "lineNumber": 130, "code": "c", "method": "f"}\n{"slice": "s", "n": 1, "filename": "a.py", "lineNumber": 60, "variable": "v", "method": "g"}\n'
        '{"slice": "s", "n": 2, "filename": "b.py", "lineNumber": 60, "code": "d", "method": "f"}\nbroken\n{"slice": "t", "n": 0, "filename": "a.py"}\n{"n": 0}\n{"slice": "u", "n": 0, "lineNumber": 5}\n'
    )
    lines = spark.createDataFrame([("a.py", k, f"l{k}") for k in range(1, 131)], "path string, line_no long, text string")
    got = {r.slice: r for r in slicing.code_slices(readers.graph_nodes(spark, str(tmp_path)), lines).collect()}
    assert set(got) == {"s", "t", "u"} and (got["s"].filename, got["s"].first_line, got["s"].last_line, got["s"].functions) == ("a.py", 60, 130, ["f", "g"])
    assert [tuple(x) for x in got["s"].data_flow] == [(60, "", "v"), (60, "d", ""), (130, "c", "")] and got["s"].source == "\n".join(f"l{k}" for k in range(60, 131))
    assert (got["t"].first_line, got["t"].last_line, got["t"].data_flow, got["t"].source) == (0, 0, [], "") and got["u"].filename is None and got["u"].source == ""
    assert sorted(r.slice for r in slicing.within_budget(slicing.code_slices(readers.graph_nodes(spark, str(tmp_path)), lines), 70).collect()) == ["t", "u"]
