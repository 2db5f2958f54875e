"""The operators as functions of SQL text: ``register(spark)`` makes them known to a session.

Table functions take TABLE arguments. Those that work row by row run wherever a row is; those of a group take PARTITION BY and ORDER BY from the query, so Spark deals and sorts the
groups, and they read a group as a stream, with a state of a few numbers (an execution order keeps one flow). Scalar functions are SQL expressions that the optimizer sees through.

Cases: null texts have no sites, functions or chunks; rows whose line, start or score is null count as line 0, begin no range and are passed over; a table without rows gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from .operators import code, graphs, planning
from .schema import SEVERITIES


@udtf(returnType="path string, callee string, args long")
class CallSites:
    """vq_call_sites(TABLE(path, text))"""

    def eval(self, row: Row) -> Iterator[tuple]:
        for callee, args in code.call_sites(row["text"] or ""):
            yield row["path"], callee, args


@udtf(returnType="path string, name string, line long, body string")
class Functions:
    """vq_functions(TABLE(path, text))"""

    def eval(self, row: Row) -> Iterator[tuple]:
        for name, line, body in code.function_bodies(row["text"] or ""):
            yield row["path"], name, line, body


@udtf(returnType="path string, chunk long, start_line long, end_line long")
class Chunks:
    """vq_chunks(TABLE(path, text, language), bytes)"""

    def eval(self, row: Row, limit: int) -> Iterator[tuple]:
        for k, (a, b) in enumerate(planning.span_chunks(row["text"], row["language"], limit) if row["text"] else []):
            yield row["path"], k, a + 1, b


@udtf(returnType="file_path string, cwe_id string, island long, first_line int, last_line int, n long, best long")
class Islands:
    """vq_islands(TABLE(ord, file_path, cwe_id, line_number, confidence_score) PARTITION BY file_path, cwe_id ORDER BY line_number, ord, gap): runs of lines at most ``gap`` apart, and the ord of the most confident finding
    of each, the first of several."""

    def __init__(self) -> None:
        self.now: list | None = None
        self.k = 0

    def eval(self, row: Row, gap: int) -> Iterator[tuple]:
        line, sure = row["line_number"] or 0, row["confidence_score"]
        if self.now and line - self.now[3] <= gap:
            self.now[3] = line
            self.now[4] += 1
            if sure is not None and (self.now[6] is None or sure > self.now[6]):
                self.now[5], self.now[6] = row["ord"], sure
            return
        if self.now:
            yield self._row()
        self.now = [row["file_path"], row["cwe_id"], line, line, 1, row["ord"], sure]
        self.k += 1

    def _row(self) -> tuple:
        path, cwe, first, last, n, best, _ = self.now
        return path, cwe, self.k, first, last, n, best

    def terminate(self) -> Iterator[tuple]:
        if self.now:
            yield self._row()


@udtf(returnType="path string, start long, end long")
class Outermost:
    """vq_outermost(TABLE(path, start, end) PARTITION BY path ORDER BY start, end DESC): ranges that lie in no earlier one."""

    def __init__(self) -> None:
        self.end = None

    def eval(self, row: Row) -> Iterator[tuple]:
        if row["start"] is None:
            return
        if self.end is None or row["start"] >= self.end:
            yield row["path"], row["start"], row["end"]
        if row["end"] is not None and (self.end is None or row["end"] > self.end):
            self.end = row["end"]


@udtf(returnType="project string, n long, mean double, squares double, false_positives long")
class Baselines:
    """vq_baselines(TABLE(project, confidence_score, verification_status) PARTITION BY project)"""

    def __init__(self) -> None:
        self.project, self.n, self.mean, self.squares, self.false = None, 0, 0.0, 0.0, 0

    def eval(self, row: Row) -> None:
        self.project = row["project"]
        x = row["confidence_score"]
        if x is not None:
            self.n += 1
            before, self.mean = self.mean, self.mean + (x - self.mean) / self.n
            self.squares += (x - before) * (x - self.mean)
            self.false += row["verification_status"] == "false_positive"

    def terminate(self) -> Iterator[tuple]:
        if self.n:
            yield self.project, self.n, self.mean, self.squares, self.false


@udtf(returnType="flow long, place int, idx long")
class ExecutionOrder:
    """vq_execution_order(TABLE(flow, n, a, b) PARTITION BY flow ORDER BY n): a step is a row with b null, a data edge one with both. No rows for a cycle."""

    def __init__(self) -> None:
        self.flow, self.steps, self.edges = None, set(), []

    def eval(self, row: Row) -> None:
        self.flow = row["flow"]
        if row["b"] is None:
            self.steps.add(row["a"])
        else:
            self.edges.append((row["n"], row["a"], row["b"]))

    def terminate(self) -> Iterator[tuple]:
        order = graphs._lifo(sorted(self.steps), self.edges)
        if len(order) == len(self.steps):
            for k, idx in enumerate(order):
                yield self.flow, k, idx


@udtf(returnType="flow long, steps array<long>")
class OrderedFlows:
    """vq_ordered_flows(TABLE(flow, steps, n, a, b)): ``vq_execution_order`` of flows that are a row each: steps, and the data edges as three arrays side by side; many flows cross to Python at once, and no group
    is dealt. No row for a cycle."""

    def eval(self, row: Row) -> Iterator[tuple]:
        steps = sorted(set(row["steps"]))
        order = graphs._lifo(steps, list(zip(row["n"], row["a"], row["b"])))
        if len(order) == len(steps):
            yield row["flow"], order


TABLES = {"vq_call_sites": CallSites, "vq_functions": Functions, "vq_chunks": Chunks, "vq_islands": Islands, "vq_outermost": Outermost, "vq_baselines": Baselines, "vq_execution_order": ExecutionOrder}
#: Forms of these that take a group as one row.
PACKED_TABLES = {"vq_ordered_flows": OrderedFlows}
#: name: (parameters, type, expression)
SCALARS = {
    "vq_severity_rank": ("severity STRING", "INT", "CASE severity " + " ".join(f"WHEN '{s}' THEN {4 - k}" for k, s in enumerate(SEVERITIES)) + " END"),
    "vq_severity_name": ("rank INT", "STRING", "CASE rank " + " ".join(f"WHEN {4 - k} THEN '{s}'" for k, s in enumerate(SEVERITIES)) + " END"),
    "vq_worse": ("a STRING, b STRING", "STRING", "vq_severity_name(greatest(vq_severity_rank(a), vq_severity_rank(b)))"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes all functions known to the session; their names."""
    for name, function in TABLES.items():
        spark.udtf.register(name, function)
    for name, (parameters, kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return [*TABLES, *SCALARS]


def register_packed(spark: SparkSession) -> list[str]:
    """Makes the forms that take a group as one row known to the session; their names."""
    for name, function in PACKED_TABLES.items():
        spark.udtf.register(name, function)
    return [*PACKED_TABLES]
