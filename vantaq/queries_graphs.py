"""Queries over call graphs and agent flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import graphs
from .registry import query

#: Functions with a sink are those of the highest prices.
SINK_PRICE = 499000

CALLS = """calls AS MATERIALIZED (
 SELECT a, b FROM (SELECT min(o_orderkey) OVER (PARTITION BY o_custkey) AS a, o_orderkey AS b FROM orders) WHERE a <> b
 UNION SELECT a, b FROM (SELECT lag(o_orderkey) OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderkey) AS a, o_orderkey AS b FROM orders) WHERE a IS NOT NULL
 UNION SELECT a, b FROM (SELECT o_orderkey AS a, min(o_orderkey) OVER (PARTITION BY o_custkey) AS b, o_orderpriority FROM orders) WHERE o_orderpriority = '1-URGENT' AND a <> b)"""


def calls(orders: DataFrame) -> DataFrame:
    """A call graph of the orders: a customer's first order calls the others, urgent ones call it, and each order calls the next of its day."""
    first = orders.select("o_orderkey", "o_orderpriority", F.min("o_orderkey").over(Window.partitionBy("o_custkey")).alias("first")).filter("o_orderkey <> first")
    down, up = first.selectExpr("first AS a", "o_orderkey AS b"), first.filter("o_orderpriority = '1-URGENT'").selectExpr("o_orderkey AS a", "first AS b")
    day = Window.partitionBy(F.to_date("o_orderdate")).orderBy("o_orderkey")
    return down.union(up).union(orders.select(F.lag("o_orderkey").over(day).alias("a"), F.col("o_orderkey").alias("b")).filter("a IS NOT NULL"))


J25 = f"""WITH RECURSIVE {CALLS},
targets AS (SELECT o_orderkey AS t FROM orders WHERE o_totalprice > {SINK_PRICE}),
entries AS MATERIALIZED (SELECT o_orderkey AS v FROM orders WHERE o_orderkey NOT IN (SELECT b FROM calls)),
d(t, v, dist) USING KEY (t, v) AS (
  SELECT t, t, 0 FROM targets
  UNION SELECT d.t, c.a, d.dist + 1 FROM d JOIN calls c ON c.b = d.v LEFT JOIN recurring.d r ON r.t = d.t AND r.v = c.a WHERE r.v IS NULL AND d.dist < 50),
hop AS MATERIALIZED (SELECT d.t, d.v, min(c.b) AS b FROM d JOIN calls c ON c.a = d.v JOIN d e ON e.t = d.t AND e.v = c.b AND e.dist = d.dist - 1 GROUP BY ALL),
p(entry, t, dist, v, path) AS (
  SELECT v, t, dist, v, CAST(v AS VARCHAR) FROM d WHERE v IN (SELECT v FROM entries)
  UNION ALL SELECT p.entry, p.t, p.dist, hop.b, p.path || '>' || hop.b FROM p JOIN hop ON hop.t = p.t AND hop.v = p.v)
SELECT entry, t AS target, dist AS depth, path FROM p WHERE v = t"""


@query("j25_paths", J25)
def j25_paths(spark: SparkSession, sf: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    edges = graphs.settled(calls(orders), "calls")
    entries = graphs.entry_points(orders.select(F.col("o_orderkey").alias("vertex")), edges)
    targets = orders.filter(F.col("o_totalprice") > SINK_PRICE).select(F.col("o_orderkey").alias("vertex"))
    return graphs.call_paths(edges, entries, targets).withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), ">"))


#: Agent flows: an order is a flow, its lines are the steps; each line hands on to the next, and some discounts to the step of that number.
FLOWS = """steps AS (
 SELECT l_orderkey AS flow, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS idx,
        count(*) OVER (PARTITION BY l_orderkey) AS n_steps, l_suppkey, l_linenumber, l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem),
nodes AS (SELECT flow, CAST(idx AS BIGINT) AS idx, CASE WHEN l_tax > 0.07 THEN 'fanout' ELSE 'agent' END AS kind, 'agent ' || CAST(l_suppkey AS {text}) AS role, CAST(l_linenumber AS BIGINT) AS target FROM steps),
edges AS (
 SELECT flow, CAST(2 * idx AS BIGINT) AS n, CAST(idx AS BIGINT) AS a, CAST(idx + 1 AS BIGINT) AS b, 'data' AS kind, '{{{{ agent ' || CAST(l_suppkey AS {text}) || '.out }}}}' AS template FROM steps WHERE idx + 1 < n_steps
 UNION ALL SELECT flow, CAST(2 * idx + 1 AS BIGINT), CAST(idx AS BIGINT), CAST(round(100 * l_discount) AS BIGINT) - 5, CASE l_returnflag WHEN 'A' THEN 'data' WHEN 'N' THEN 'ok' ELSE 'fail' END,
        CASE WHEN l_linestatus = 'F' THEN 'see {{{{reviewer.out}}}} and {{{{ }}}}' ELSE 'again' END FROM steps WHERE l_discount > 0.045 AND l_tax < 0.02)"""
CYCLES = """data AS (SELECT DISTINCT e.flow, e.a, e.b FROM edges e JOIN nodes x ON x.flow = e.flow AND x.idx = e.a JOIN nodes y ON y.flow = e.flow AND y.idx = e.b WHERE e.kind = 'data'),
r(flow, a, b) AS (SELECT flow, a, b FROM data UNION SELECT r.flow, r.a, d.b FROM r JOIN data d ON d.flow = r.flow AND d.a = r.b),
looped AS (SELECT DISTINCT flow FROM r WHERE a = b)"""
O11 = f"""WITH RECURSIVE {FLOWS.format(text="VARCHAR")}, {CYCLES},
core AS (SELECT DISTINCT n.flow, n.idx FROM nodes n JOIN looped USING (flow) WHERE EXISTS (SELECT 1 FROM r u, r x WHERE u.flow = n.flow AND u.a = u.b AND x.flow = n.flow AND x.a = u.a AND x.b = n.idx)
  AND EXISTS (SELECT 1 FROM r u, r x WHERE u.flow = n.flow AND u.a = u.b AND x.flow = n.flow AND x.b = u.a AND x.a = n.idx)),
w(flow, idx, k) AS (SELECT flow, idx, 0 FROM nodes ANTI JOIN looped USING (flow) UNION SELECT w.flow, d.b, k + 1 FROM w JOIN data d ON d.flow = w.flow AND d.a = w.idx),
vars AS (SELECT flow, n, unnest(range(1, len(v) + 1)) AS part, unnest(v) AS role FROM (SELECT flow, n, list_filter(list_transform(regexp_extract_all(template, '(?s)\\{{\\{{(.*?)\\}}\\}}', 1), lambda x: trim(split_part(x, '.', 1))), lambda x: x <> '') AS v FROM edges)),
wrong AS (
  SELECT o_orderkey AS flow, 0 AS step, 0 AS place, 0 AS part, 'empty' AS problem, NULL AS detail FROM orders WHERE o_orderkey NOT IN (SELECT flow FROM nodes)
  UNION ALL SELECT e.flow, 1, n, 0, 'unknown_node', CAST(a AS VARCHAR) FROM edges e WHERE NOT EXISTS (SELECT 1 FROM nodes x WHERE x.flow = e.flow AND x.idx = e.a)
  UNION ALL SELECT e.flow, 1, n, 1, 'unknown_node', CAST(b AS VARCHAR) FROM edges e WHERE NOT EXISTS (SELECT 1 FROM nodes x WHERE x.flow = e.flow AND x.idx = e.b)
  UNION ALL SELECT m.flow, 2, m.idx, 0, 'fanout_target_missing', CAST(target AS VARCHAR) FROM nodes m WHERE kind = 'fanout' AND NOT EXISTS (SELECT 1 FROM nodes x WHERE x.flow = m.flow AND x.idx = m.target)
  UNION ALL SELECT flow, 3, 0, 0, 'cycle', string_agg(CAST(idx AS VARCHAR), ',' ORDER BY idx) FROM core GROUP BY flow
  UNION ALL SELECT m.flow, 4, m.idx, 0, 'duplicate_role', role FROM nodes m WHERE kind = 'agent' AND EXISTS (SELECT 1 FROM nodes x WHERE x.flow = m.flow AND x.kind = 'agent' AND x.role = m.role AND x.idx < m.idx)
  UNION ALL SELECT v.flow, 5, n, part, 'template_variable_missing', role FROM vars v WHERE NOT EXISTS (SELECT 1 FROM nodes x WHERE x.flow = v.flow AND x.kind = 'agent' AND x.role = v.role)),
first AS (SELECT flow, problem, detail, count(*) OVER (PARTITION BY flow) AS n_problems FROM wrong QUALIFY row_number() OVER (PARTITION BY flow ORDER BY step, place, part) = 1)
SELECT o_orderkey AS flow, problem, detail, coalesce(n_problems, 0) AS n_problems, CAST(coalesce(k, -1) AS INTEGER) AS waves FROM orders
LEFT JOIN first ON first.flow = o_orderkey LEFT JOIN (SELECT flow, max(k) + 1 AS k FROM w GROUP BY flow) w ON w.flow = o_orderkey"""
ORDERS = f"""WITH RECURSIVE {FLOWS.format(text="VARCHAR")}, {CYCLES},
before AS (SELECT flow, b, list(a) AS needs FROM data GROUP BY ALL),
after AS (SELECT flow, a, list(struct_pack(b := b, needs := needs) ORDER BY n) AS then_ FROM (SELECT e.flow, e.a, e.b, max(n) AS n, needs FROM edges e JOIN data USING (flow, a, b) JOIN before USING (flow, b) WHERE kind = 'data' GROUP BY ALL) GROUP BY ALL),
s(flow, ready, done) AS (
  SELECT flow, list(idx ORDER BY idx), CAST([] AS BIGINT[]) FROM nodes ANTI JOIN looped USING (flow) WHERE NOT EXISTS (SELECT 1 FROM data d WHERE d.flow = nodes.flow AND d.b = nodes.idx) GROUP BY flow
  UNION ALL SELECT s.flow, list_concat(ready[:-2], coalesce(list_transform(list_filter(then_, lambda x: list_has_all(list_append(done, ready[-1]), x.needs)), lambda x: x.b), CAST([] AS BIGINT[]))), list_append(done, ready[-1])
    FROM s LEFT JOIN after ON after.flow = s.flow AND after.a = ready[-1] WHERE len(ready) > 0)
SELECT flow, array_to_string(done, ',') AS steps FROM s WHERE len(ready) = 0"""


def flows(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    spark.read.parquet(f"{sf}/lineitem.parquet").createOrReplaceTempView("flow_lines")
    views = FLOWS.format(text="STRING").replace("FROM lineitem", "FROM flow_lines")
    nodes, edges = (graphs.settled(spark.sql(f"WITH {views} SELECT * FROM {x}"), x) for x in ("nodes", "edges"))
    return spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("flow")), nodes, edges


@query("o11_flow_checks", O11)
def o11_flow_checks(spark: SparkSession, sf: str) -> DataFrame:
    return graphs.typecheck(*flows(spark, sf)).withColumn("waves", F.coalesce("waves", F.lit(-1)))


@query("o11_execution_orders", ORDERS)
def o11_execution_orders(spark: SparkSession, sf: str) -> DataFrame:
    _, nodes, edges = flows(spark, sf)
    return graphs.ordered_flows(nodes, edges).select("flow", F.array_join(F.transform("steps", lambda x: x.cast("string")), ",").alias("steps"))
