"""Queries that call the operators from SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import sql
from .fixtures import ctes, view
from .queries_graphs import CYCLES, FLOWS, ORDERS, flows
from .registry import query

FIND = ctes("findings")
LINE = "coalesce(line_number, 0)"
ISLANDS = f"""{FIND}, m AS (SELECT *, {LINE} AS line, CASE WHEN {LINE} - lag({LINE}) OVER w > 2 THEN 1 ELSE 0 END AS cut FROM findings WINDOW w AS (PARTITION BY file_path, cwe_id ORDER BY {LINE}, ord)),
i AS (SELECT *, 1 + sum(cut) OVER (PARTITION BY file_path, cwe_id ORDER BY line, ord) AS island FROM m)
SELECT file_path, cwe_id, CAST(island AS BIGINT) AS island, min(line) AS first_line, max(line) AS last_line, count(*) AS n, first(ord ORDER BY confidence_score DESC, line, ord) AS best FROM i GROUP BY file_path, cwe_id, island"""


@query("sql_islands", ISLANDS)
def sql_islands(spark: SparkSession, sf: str) -> DataFrame:
    sql.register(spark)
    view(spark, sf, "findings").createOrReplaceTempView("sql_findings")
    return spark.sql("SELECT * FROM vq_islands(TABLE(SELECT ord, file_path, cwe_id, coalesce(line_number, 0) AS line_number, confidence_score FROM sql_findings) PARTITION BY (file_path, cwe_id) ORDER BY (line_number, ord), 2)")


@query("sql_baselines", f"{FIND} SELECT split_part(file_path, '/', 1) AS project, count(*) AS n, round(avg(confidence_score), 6) AS mean, round(var_pop(confidence_score) * count(*), 6) AS squares, count(*) FILTER (verification_status = 'false_positive') AS false_positives FROM findings GROUP BY 1")
def sql_baselines(spark: SparkSession, sf: str) -> DataFrame:
    sql.register(spark)
    view(spark, sf, "findings").createOrReplaceTempView("sql_findings")
    return spark.sql("SELECT project, n, round(mean, 6) AS mean, round(squares, 6) AS squares, false_positives FROM vq_baselines(TABLE(SELECT split_part(file_path, '/', 1) AS project, confidence_score, verification_status FROM sql_findings) PARTITION BY project)")


RANGES = "SELECT 'p' || CAST(l_orderkey % 5000 AS {text}) AS path, CAST(l_linenumber * 10 + l_quantity AS BIGINT) AS start, CAST(l_linenumber * 10 + l_quantity + l_discount * 300 + 1 AS BIGINT) AS {end} FROM {table}"


@query(
    "sql_outermost",
    f"""WITH r AS ({RANGES.format(text='VARCHAR', end='stop', table='lineitem')}), m AS (SELECT *, max(stop) OVER (PARTITION BY path ORDER BY start, stop DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM r)
SELECT path, start, stop AS "end" FROM m WHERE seen IS NULL OR start >= seen""",
)
def sql_outermost(spark: SparkSession, sf: str) -> DataFrame:
    sql.register(spark)
    spark.read.parquet(f"{sf}/lineitem.parquet").createOrReplaceTempView("sql_lines")
    return spark.sql(f"SELECT * FROM vq_outermost(TABLE({RANGES.format(text='STRING', end='end', table='sql_lines')}) PARTITION BY path ORDER BY (start, end DESC))")


@query("sql_execution_orders", f"WITH RECURSIVE {FLOWS.format(text='VARCHAR')}, {CYCLES}" + ORDERS.split(CYCLES, 1)[1].replace("SELECT flow, array_to_string(done, ',') AS steps", "SELECT flow, list_transform(range(len(done)), lambda k: CAST(k AS VARCHAR) || ':' || done[k + 1])[1] AS first_step, len(done) AS n_steps"))
def sql_execution_orders(spark: SparkSession, sf: str) -> DataFrame:
    sql.register_packed(spark)
    _, nodes, edges = flows(spark, sf)
    nodes.createOrReplaceTempView("sql_steps")
    edges.createOrReplaceTempView("sql_edges")
    rows = "SELECT flow, -1L AS n, idx AS a, CAST(NULL AS BIGINT) AS b FROM sql_steps UNION ALL SELECT flow, n, a, b FROM sql_edges WHERE kind = 'data'"
    packed = f"SELECT flow, collect_list(a) FILTER (WHERE b IS NULL) AS steps, collect_list(n) FILTER (WHERE b IS NOT NULL) AS n, collect_list(a) FILTER (WHERE b IS NOT NULL) AS a, collect_list(b) AS b FROM ({rows}) GROUP BY flow"
    return spark.sql(f"SELECT flow, '0:' || CAST(steps[0] AS STRING) AS first_step, CAST(size(steps) AS BIGINT) AS n_steps FROM vq_ordered_flows(TABLE({packed}))")


@query("sql_severities", f"{FIND} SELECT ord, CASE WHEN severity IN ('critical', 'high') THEN severity ELSE 'medium' END AS raised FROM findings")
def sql_severities(spark: SparkSession, sf: str) -> DataFrame:
    sql.register(spark)
    view(spark, sf, "findings").createOrReplaceTempView("sql_findings")
    return spark.sql("SELECT ord, vq_worse(severity, 'medium') AS raised FROM sql_findings")
