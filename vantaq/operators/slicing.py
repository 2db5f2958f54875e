"""Code slices from landed nodes of property graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines to a bin of the range join between slices and source lines.
BIN = 64


def code_slices(nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """slice, filename, first_line, last_line, functions (each once, in order), data_flow (line, code, variable in the order of lines, then of n) and source (the lines from first to last of the file) of
    each slice. nodes: slice, n (place in the query's result), filename, line, code, variable, method; lines: path, line_no, text. Lines meet slices by bins of ``BIN`` lines, so a file's lines
    are not paired with each of its slices.

    Cases: a slice's file is that of its first node with one, nodes without a line counted; nodes without a line are else passed over, and a slice of such nodes alone is an empty one (lines 0, nothing in it);
    null code and variables are empty; an unknown file or line gives no source; nodes without a slice are none; repeated nodes stay. A slice is one row."""
    known = nodes.filter("slice IS NOT NULL")
    some = F.col("line").isNotNull()
    flow = F.struct(F.col("line"), F.col("n"), F.coalesce("code", F.lit("")).alias("code"), F.coalesce("variable", F.lit("")).alias("variable"))
    g = known.groupBy("slice").agg(
        F.min_by("filename", F.when(F.col("filename").isNotNull(), F.col("n"))).alias("filename"),
        F.coalesce(F.min("line"), F.lit(0)).alias("first_line"),
        F.coalesce(F.max("line"), F.lit(0)).alias("last_line"),
        F.array_sort(F.collect_set(F.when(some, F.col("method")))).alias("functions"),
        F.array_sort(F.collect_list(F.when(some, flow))).alias("data_flow"),
    )
    g = g.withColumn("data_flow", F.transform("data_flow", lambda x: F.struct(x["line"].alias("line"), x["code"].alias("code"), x["variable"].alias("variable"))))
    wanted = g.filter("last_line > 0 AND filename IS NOT NULL").select("slice", F.col("filename").alias("path"), "first_line", "last_line")
    wanted = wanted.withColumn("bin", F.explode(F.sequence(F.floor(F.col("first_line") / BIN), F.floor(F.col("last_line") / BIN))))
    met = wanted.join(lines.select("path", "line_no", "text", F.floor(F.col("line_no") / BIN).alias("bin")), ["path", "bin"]).filter("line_no BETWEEN first_line AND last_line")
    source = met.groupBy("slice").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n", "").alias("source"))
    return g.join(source, "slice", "left").withColumn("source", F.coalesce("source", F.lit("")))


def within_budget(slices: DataFrame, lines: int) -> DataFrame:
    """The slices of at most ``lines`` lines; an empty one has none."""
    n = F.when(F.col("last_line") > 0, F.col("last_line") - F.col("first_line") + 1).otherwise(0)
    return slices.filter(n <= lines)
