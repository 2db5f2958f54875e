"""Queries of report texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import ctes, view
from .functions import markdown
from .registry import query
from .sinks import reports

#: A markdown text of each document's first words; what it becomes is typed by hand in SQL.
WORDS = "regexp_extract_all(text, '[A-Za-z]+')"
EXPECTED = f"""WITH w AS (SELECT doc_id, list_transform(range(1, 8), lambda k: coalesce(v[k], 'x')) AS w FROM (SELECT doc_id, {WORDS} AS v FROM documents))
SELECT doc_id, '<h2>' || w[1] || ' &amp; <em>' || w[2] || '</em></h2>' || chr(10)
 || '<p>See <a href="http://x.org/' || doc_id || '?a=1&amp;b=2" title="t">' || w[3] || ' <code>c</code></a> and <code>' || w[4] || ' &amp;lt; 1</code>,<br />' || chr(10) || 'a &quot;<strong>' || w[5] || '</strong>&quot; &lt;b&gt; <del>' || w[6] || '</del>.</p>' || chr(10)
 || '<ul>' || chr(10) || '<li>' || w[1] || chr(10) || '<ul>' || chr(10) || '<li><strong>' || w[2] || '</strong>' || chr(10) || '<ol>' || chr(10) || '<li>' || w[3] || '</li>' || chr(10) || '<li>' || w[4] || chr(10) || 'on</li>' || chr(10) || '</ol>' || chr(10) || '</li>' || chr(10) || '</ul>' || chr(10) || '</li>' || chr(10) || '<li>' || w[7] || '</li>' || chr(10) || '</ul>' || chr(10)
 || '<pre><code class="language-py">if ' || w[5] || ' &amp;lt; 1:' || chr(10) || chr(10) || '    *' || w[6] || '*' || chr(10) || '</code></pre>' || chr(10)
 || '<table><thead><tr><th>' || w[1] || '</th><th style="text-align: right">n</th></tr></thead><tbody>' || chr(10) || '<tr><td><em>' || w[2] || '</em></td><td style="text-align: right">' || doc_id || '</td></tr>' || chr(10) || '</tbody></table>' || chr(10) AS html FROM w"""


@query("f23_markdown", EXPECTED)
def f23_markdown(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0).alias("v"))
    w = lambda k: F.coalesce(F.get("v", F.lit(k - 1)), F.lit("x"))
    doc = F.col("doc_id").cast("string")
    lines = [
        ("## ", w(1), " & *", w(2), "* ##"), ("",), ("See [", w(3), " `c`](http://x.org/", doc, '?a=1&b=2 "t") and `', w(4), " < 1`,  "), ('a "**', w(5), '**" <b> ~~', w(6), "~~."), ("",), ("- ", w(1)), ("  - **", w(2), "**"), ("    1. ", w(3)), ("    2. ", w(4)), ("on",), ("- ", w(7)), ("",),
        ("```py",), ("if ", w(5), " < 1:"), ("",), ("    *", w(6), "*"), ("```",), ("| ", w(1), " | n |"), ("|---|--:|"), ("| *", w(2), "* | ", doc, " |"),
    ]
    lines = [x if isinstance(x, tuple) else (x,) for x in lines]
    text = F.concat_ws("\n", *[F.concat(*[F.lit(p) if isinstance(p, str) else p for p in line]) for line in lines])
    return d.select("doc_id", markdown.html(text).alias("html"))


ENTRY = """'<div class="finding ' || kind || '">' || chr(10) || '<div class="finding-header">' || chr(10) || '<h3>' || title || '</h3>' || chr(10) || '<span class="severity ' || kind || '">' || said || '</span>' || chr(10) || '</div>' || chr(10) || '<div class="meta">' || chr(10) || '<strong>File:</strong> ' || file_path || ' | <strong>Line:</strong> ' || coalesce(CAST(line_number AS VARCHAR), 'N/A') || chr(10) || '</div>' || chr(10) || '<div class="finding-details">' || chr(10) || '<p><strong>' || label || ':</strong> ' || coalesce(verification_notes, 'No evidence detail available') || '</p>' || chr(10) || '</div>' || chr(10) || '</div>'"""


@query(
    "k4_appendices",
    f"""{ctes('findings')}, e AS (SELECT *, 'unverified' AS kind, 'Unverified' AS said, 'Reason' AS label, 1 AS section FROM findings WHERE confidence_score < 0.3 UNION ALL SELECT *, 'rejected', 'Dismissed', 'Rejection Reason', 2 FROM findings WHERE verification_status = 'false_positive')
SELECT section, 1 AS rank, ord, {ENTRY} AS part FROM e
UNION ALL SELECT section, 0, 0, '<section class="' || kind || '-appendix"><h2>' || CASE section WHEN 1 THEN 'Appendix: Unverified Findings' ELSE 'Investigated & Dismissed' END || '</h2>' || chr(10) || '<p class="finding-count">' || count(*) || CASE section WHEN 1 THEN ' unverified findings excluded from main report' ELSE ' findings were investigated and dismissed' END || '</p>' FROM e GROUP BY section, kind
UNION ALL SELECT section, 2, 0, '</section>' FROM e GROUP BY section""",
)
def k4_appendices(spark: SparkSession, sf: str) -> DataFrame:
    f = view(spark, sf, "findings").withColumn("reason", F.col("verification_notes"))
    return reports.appendices(f.filter("confidence_score < 0.3"), f.filter("verification_status = 'false_positive'"))
