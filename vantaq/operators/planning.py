"""Files, budgets, batches, snippets, call logs, graphs."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..schema import SEVERITIES
from .code import BRACE

#: What marks a file as of high risk.
HIGH_RISK = ("auth", "login", "crypto", "password", "admin")
CHUNK_BYTES, MAX_CHUNKS = 24_000, 24
#: What opens a block of a function or class, and what does not.
_DECLARES = re.compile(r"\b(?:function|class|fn|func|interface|trait|impl)\b|\w\s*\([^()]*\)[^=]*$")
_CONTROL = re.compile(r"(?:if|for|foreach|while|switch|catch|else|do|try|match|with|return)\b")


def histogram(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("n"))


def severity_by_tier(findings: DataFrame) -> DataFrame:
    """severity, tier and n with totals; a total has 'all' in its place."""
    rolled = findings.groupingSets([["severity", "verification_tier"], ["severity"], ["verification_tier"], []], "severity", "verification_tier").agg(F.count("*").alias("n"))
    return rolled.select(F.coalesce("severity", F.lit("all")).alias("severity"), F.coalesce("verification_tier", F.lit("all")).alias("tier"), "n")


def file_totals(files: DataFrame) -> DataFrame:
    """Per language: files, bytes, tokens (bytes / 4), high-risk files."""
    risky = F.lower("path").rlike("|".join(HIGH_RISK))
    return files.groupBy("language").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.sum(F.floor(F.col("size") / 4)).alias("tokens"), F.count_if(risky).alias("high_risk"))


def planned_calls(files: Column, high_risk: Column, findings: Column, batch: int, triage: bool) -> Column:
    """Model calls for a scan: with triage files go in batches and only risky ones one by one."""
    each = F.ceil(files / batch) + high_risk if triage else files
    return (each + F.ceil(findings / 8)).cast("long")


def budget(files: DataFrame, normal: int, most: int) -> DataFrame:
    """The files that a budget admits, in order of ``ord``: any while fewer than ``normal`` are in, then only those of high risk, up to ``most``.
    files: ord, high_risk. Ranks come from two-level counts, so no single task sorts all files."""
    ranked = global_rank(files, ["ord"], "rn")
    early = ranked.filter(F.col("rn") <= normal)
    late = global_rank(ranked.filter((F.col("rn") > normal) & F.col("high_risk")), ["ord"], "k").filter(F.col("k") <= max(0, most - normal)).drop("k")
    return early.unionByName(late).drop("rn")


def global_rank(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Row numbers over the whole table: range-partitioned and sorted, then numbered within a partition; the partitions' bases are a running
    sum over one row per partition."""
    parts = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    local = Window.partitionBy("_p").orderBy(*order)
    numbered = parts.withColumn("_n", F.row_number().over(local))
    base = numbered.groupBy("_p").agg(F.max("_n").alias("_c")).withColumn("_base", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return numbered.join(F.broadcast(base.select("_p", "_base")), "_p").withColumn(name, F.col("_base") + F.col("_n")).drop("_p", "_n", "_base")


def batches(df: DataFrame, by: list[str], order: list[str], size: int) -> DataFrame:
    return df.withColumn("batch_no", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) / max(size, 1)).cast("long"))


def round_robin(df: DataFrame, by: list[str], order: list[str], models: list[str]) -> DataFrame:
    k = (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) % len(models) + 1
    return df.withColumn("chosen_model", F.element_at(F.array(*[F.lit(m) for m in models]), k.cast("int")))


def outermost(ranges: DataFrame) -> DataFrame:
    """ranges: path, start, end. Without those that lie in an earlier one."""
    order = Window.partitionBy("path").orderBy("start", F.desc("end"))
    seen = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return ranges.withColumn("_seen", seen).filter(F.col("_seen").isNull() | (F.col("start") >= F.col("_seen"))).drop("_seen")


def snippets(targets: DataFrame, lines: DataFrame, around: int) -> DataFrame:
    """targets: doc_id, line. doc_id, line and the lines around it, the line itself marked with >>; a target past the end shows
    the last lines. An equi join on each wanted line."""
    size = lines.groupBy("doc_id").agg(F.max("line_no").alias("n_lines"))
    placed = targets.join(size, "doc_id").withColumn("at", F.least("line", "n_lines"))
    wanted = placed.withColumn("line_no", F.explode(F.sequence(F.greatest(F.lit(1), F.col("at") - around), F.least(F.col("n_lines"), F.col("at") + around))))
    mark = F.when(F.col("line_no") == F.col("line"), ">> ").otherwise("   ")
    text_ = F.concat(mark, F.col("line_no").cast("string"), F.lit(": "), F.col("text"))
    return wanted.join(lines, ["doc_id", "line_no"]).groupBy("doc_id", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", text_.alias("t")))), lambda x: x["t"]), "\n").alias("snippet"))


def neighbours(lines: DataFrame) -> DataFrame:
    """Each line with the one before and after it."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    return lines.select("doc_id", "line_no", F.concat_ws("\n", F.lag("text").over(order), F.col("text"), F.lead("text").over(order)).alias("snippet"))


def function_spans(source: str, language: str) -> list[tuple[int, int]]:
    """Lines (from 0, the end not included) of functions and classes, nested ones too, read lexically: indented blocks of Python's def and
    class, brace blocks that a declaration opens elsewhere."""
    lines = source.split("\n")
    out: list[tuple[int, int]] = []
    if language == "python":
        indent = [len(x) - len(x.lstrip()) if x.strip() else None for x in lines]
        for k, x in enumerate(lines):
            if x.lstrip().startswith(("def ", "async def ", "class ")):
                end = k + 1
                for j in range(k + 1, len(lines)):
                    if indent[j] is not None:
                        if indent[j] <= indent[k]:
                            break
                        end = j + 1
                out.append((k, end))
        return out
    starts = [0]
    for x in lines:
        starts.append(starts[-1] + len(x) + 1)
    line_of = lambda place: bisect.bisect_right(starts, place) - 1
    opened: list[tuple[int, bool]] = []
    for m in BRACE.finditer(source):
        if m["quiet"] is not None:
            continue
        if m[0] == "{":
            begin = max(source.rfind(c, 0, m.start()) for c in "{};") + 1
            head = source[begin : m.start()]
            first = begin + len(head) - len(head.lstrip()) if head.strip() else m.start()
            opened.append((line_of(first), bool(_DECLARES.search(head)) and not _CONTROL.match(head.lstrip())))
        elif opened:
            start, declares = opened.pop()
            if declares:
                out.append((start, line_of(m.start()) + 1))
    return sorted(out)


def _outer(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans, key=lambda s: (s[0], -s[1])):
        if not out or a >= out[-1][1]:
            out.append((a, b))
    return out


def span_chunks(source: str, language: str | None, limit: int) -> list[tuple[int, int]]:
    """Chunks (first line, end) of at most ``limit`` bytes: neighbouring functions and classes together as far as they fit, a class that doesn't by
    its methods, what is still too long at lines. A file without any is cut at lines; a longer line is a chunk of its own."""
    lines = source.split("\n")
    if lines and not lines[-1]:
        lines.pop()
    at = [0]
    for x in lines:
        at.append(at[-1] + len(x.encode()) + 1)
    size = lambda a, b: at[b] - at[a]
    every = [(a, min(b, len(lines))) for a, b in function_spans(source, language)] if language else []
    units: list[tuple[int, int]] = []
    for a, b in _outer(every):
        inner = _outer([s for s in every if s[0] > a and s[1] <= b]) if size(a, b) > limit else []
        units += inner or [(a, b)]
    # What stands before a unit goes with it, what stands after the last with that; so no line is left out.
    ends = [b for _, b in _outer(units)][:-1] + [len(lines)]
    out: list[tuple[int, int]] = []
    group: tuple[int, int] | None = None
    for a, b in zip([0, *ends[:-1]], ends):
        if a == b:
            continue
        if group and size(group[0], b) <= limit:
            group = group[0], b
            continue
        if group:
            out.append(group)
        group = None
        if size(a, b) <= limit:
            group = a, b
            continue
        first = a
        for k in range(a + 1, b):
            if size(first, k + 1) > limit:
                out.append((first, k))
                first = k
        out.append((first, b))
    return [*out, group] if group else out


def chunks(files: DataFrame, limit: int = CHUNK_BYTES, most: int = MAX_CHUNKS) -> DataFrame:
    """path, text (and language) -> path, chunk, start_line, end_line, n_bytes, past_most: whole functions and classes packed to at most ``limit``
    bytes a chunk, as ``span_chunks`` does; files without a known language by their lines. All chunks are kept; past_most marks those beyond the
    ``most`` that are sent to a model."""

    def cut(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            out: list[tuple] = []
            for path, content, language in zip(*(batch.column(k).to_pylist() for k in range(3))):
                lines = (content or "").split("\n")
                at = [0]
                for k, x in enumerate(lines):
                    at.append(at[-1] + len(x.encode()) + (k + 1 < len(lines)))
                out += [(path, k, a + 1, b, at[b] - at[a]) for k, (a, b) in enumerate(span_chunks(content or "", language, limit))]
            made = [pa.array([r[i] for r in out], pa.string() if i == 0 else pa.int64()) for i in range(5)]
            yield pa.RecordBatch.from_arrays([*made, pa.array([r[1] >= most for r in out], pa.bool_())], names=["path", "chunk", "start_line", "end_line", "n_bytes", "past_most"])

    language = F.col("language") if "language" in files.columns else F.lit(None).cast("string")
    return files.select("path", "text", language.alias("language")).mapInArrow(cut, "path string, chunk long, start_line long, end_line long, n_bytes long, past_most boolean")


def call_metrics(calls: DataFrame) -> DataFrame:
    """Global, by model, and by operation and phase: calls, failures, cached, mean latency."""
    sets = calls.groupingSets([[], ["model"], ["operation", "phase"]], "model", "operation", "phase")
    out = sets.agg(F.count("*").alias("calls"), F.count_if(~F.col("success")).alias("failures"), F.count_if("cached").alias("cached"), F.avg("latency_ms").alias("mean_latency"))
    scope = F.when(F.col("model").isNotNull(), F.concat(F.lit("model:"), "model")).when(F.col("operation").isNotNull(), F.concat_ws(":", "operation", "phase")).otherwise("all")
    return out.select(scope.alias("scope"), "calls", "failures", "cached", "mean_latency")


def batch_verdicts(items: DataFrame, positions: DataFrame) -> DataFrame:
    """items: batch, position, idx, status; positions: batch, position (the findings). By index where the batch has one anywhere, else by position; the
    last item of an index wins; unknown statuses and missing items need review."""
    flagged = items.join(items.groupBy("batch").agg(F.bool_or(F.col("idx").isNotNull()).alias("indexed")), "batch")
    at = F.when(F.col("indexed"), F.coalesce("idx", "position")).otherwise(F.col("position"))
    known = F.when(F.col("status").isin("confirmed", "false_positive", "needs_review"), F.col("status")).otherwise("needs_review")
    last = flagged.withColumn("at", at).groupBy("batch", "at").agg(F.max_by(known, "position").alias("verdict"))
    both = positions.select("batch", "position").join(last.withColumnRenamed("at", "position"), ["batch", "position"], "left")
    return both.select("batch", "position", F.coalesce("verdict", F.lit("needs_review")).alias("verdict"), F.col("verdict").isNull().alias("missing"))


def reachable(edges: DataFrame, start: int, most: int = 50) -> DataFrame:
    """vertex and depth of the shortest path from ``start``, at most ``most`` edges long. edges: a, b. Each round joins the new frontier."""
    spark = edges.sparkSession
    seen = spark.createDataFrame([(start, 0)], "vertex long, depth int")
    frontier = seen
    for depth in range(1, most + 1):
        step = frontier.join(edges, frontier["vertex"] == edges["a"]).select(F.col("b").alias("vertex")).distinct().join(seen, "vertex", "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
        if step.isEmpty():
            break
        seen = seen.union(step).checkpoint()
        frontier = step
    return seen


def diff_scope(findings: DataFrame, changed: DataFrame) -> DataFrame:
    """Findings whose file has the base name of a changed file."""
    names = changed.select(text.basename(F.col("path")).alias("_name")).distinct()
    return findings.withColumn("_name", text.basename(F.col("file_path"))).join(names, "_name", "left_semi").drop("_name")


def medium_or_worse(findings: DataFrame, threshold: int = 1000) -> DataFrame:
    """n and whether a scan ends early; a threshold of 0 never ends one."""
    n = F.count_if(F.col("severity").isin(*SEVERITIES[:3]))
    return findings.agg(n.alias("n"), F.expr(str(bool(threshold))).alias("_on")).select("n", ((F.col("n") > threshold) & F.col("_on")).alias("terminate"))


def newest_runs(runs: DataFrame, n: int) -> DataFrame:
    """Rows of the n newest run_ids. The ids are few; the cut is found from their distinct values."""
    keep = runs.select("run_id").distinct().orderBy(F.desc("run_id")).limit(n)
    return runs.join(F.broadcast(keep), "run_id", "left_semi")


def baseline(findings: DataFrame) -> DataFrame:
    """One row: n, mean, squared deviations, deviation, true and false positives, false positive rate."""
    x = F.col("confidence_score")
    g = findings.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("squares"), F.count_if(F.col("verification_status") == "false_positive").alias("false_positives"), F.count_if(F.coalesce(F.col("verification_status") != "false_positive", F.lit(True))).alias("true_positives"))
    total = F.col("true_positives") + F.col("false_positives")
    return g.select("*", F.when(F.col("n") > 1, F.sqrt(F.col("squares") / F.col("n"))).otherwise(0.0).alias("deviation"), F.when(total > 0, F.col("false_positives") / total).otherwise(0.0).alias("false_positive_rate"))


def merged_baselines(parts: DataFrame) -> DataFrame:
    """Several baselines (n, mean, squares) as one, as if their findings had been counted together."""
    s = parts.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("s"), F.sum("squares").alias("q"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("m2"))
    return s.select("n", (F.col("s") / F.col("n")).alias("mean"), (F.col("q") + F.col("m2") - F.col("s") * F.col("s") / F.col("n")).alias("squares"))
