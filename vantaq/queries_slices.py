"""Queries over landed graph nodes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import ctes, view
from .operators import slicing
from .registry import query
from .sources import readers
from .tables import shared_dir

#: Nodes of the documents' lines: lines of an odd length, a slice for every third part of a document.
NODES = """SELECT 's' || CAST(doc_id AS {text}) || '.' || CAST(line_no % 3 AS {text}) AS slice, line_no AS n, CASE WHEN line_no % 5 = 1 THEN NULL ELSE 'd' || CAST(doc_id AS {text}) END AS filename,
  CAST(CASE WHEN length(text) % 7 = 0 THEN NULL ELSE line_no END AS INT) AS line, CASE WHEN length(text) % 11 = 0 THEN NULL ELSE text END AS code, split_part(text, ' ', 1) AS variable,
  'm' || CAST(CAST(floor(line_no / 4) AS INT) AS {text}) AS method FROM {lines} WHERE length(text) % 2 = 1"""
SQL = f"""{ctes('lines')}, nodes AS ({NODES.format(text='VARCHAR', lines='lines')}),
g AS (SELECT slice, first(filename ORDER BY n) FILTER (filename IS NOT NULL) AS filename, coalesce(min(line), 0) AS first_line, coalesce(max(line), 0) AS last_line,
  coalesce(string_agg(DISTINCT method, ',' ORDER BY method) FILTER (line IS NOT NULL), '') AS functions, coalesce(string_agg(line || ':' || coalesce(code, '') || ':' || variable, chr(10) ORDER BY line, n) FILTER (line IS NOT NULL), '') AS flow FROM nodes GROUP BY slice)
SELECT slice, filename, first_line, last_line, functions, sha256(flow) AS flow_sha256, sha256(coalesce((SELECT string_agg(l.text, chr(10) ORDER BY line_no) FROM lines l WHERE 'd' || l.doc_id = g.filename AND last_line > 0 AND line_no BETWEEN first_line AND last_line), '')) AS source_sha256 FROM g"""


@query("cpg_code_slices", SQL)
def cpg_code_slices(spark: SparkSession, sf: str) -> DataFrame:
    lines = view(spark, sf, "lines")
    lines.createOrReplaceTempView("slice_lines")
    landed = f"{shared_dir(spark)}/nodes-{uuid.uuid4().hex}"
    spark.sql(NODES.format(text="STRING", lines="slice_lines")).withColumnRenamed("line", "lineNumber").write.json(landed)
    out = slicing.code_slices(readers.graph_nodes(spark, landed), lines.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), "line_no", "text"))
    flow = F.array_join(F.transform("data_flow", lambda x: F.concat_ws(":", x["line"].cast("string"), x["code"], x["variable"])), "\n")
    return out.select("slice", "filename", "first_line", "last_line", F.array_join("functions", ",").alias("functions"), F.sha2(flow, 256).alias("flow_sha256"), F.sha2("source", 256).alias("source_sha256"))
