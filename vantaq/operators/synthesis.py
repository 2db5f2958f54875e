"""Proposed rule patterns against labelled traces: all candidates of all proposers in one pass."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import responses
from ..tables import settled

#: Fixed value: the F1 at which a proposer stops.
CONVERGED = 0.8
#: Sinks that go to the traces at once.
AT_ONCE = 50000
COUNTS = pa.schema([("sink", pa.string()), ("param", pa.int32()), ("tp", pa.int64()), ("fp", pa.int64())])
#: What ends of arguments are freed of.
SPACE = " \t\n\x0b\f\r"


def arguments(code: str, sink: str) -> int:
    """How many arguments the first call of the sink has; -1 without a call that ends."""
    start = code.find(sink + "(")
    end = code.find(")", start + len(sink) + 1) if start >= 0 else -1
    if end < 0:
        return -1
    args = code[start + len(sink) + 1 : end]
    return args.count(",") + 1 if args.strip(SPACE) else 0


def _counted(labelled: DataFrame, sinks: DataFrame) -> DataFrame:
    """sink, param, tp, fp of each task: how many of its traces (code, bad) hold what ``responses.rule_matches`` asks for. sinks: sink, params; collected, so they are bounded by the caller."""
    known = labelled.sparkSession.sparkContext.broadcast([(r.sink, tuple(r.params)) for r in sinks.select("sink", "params").collect()])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine, params = ahocorasick.Automaton(), dict(known.value)
        for sink in params:
            if sink:
                machine.add_word(sink, sink)
        if len(machine):
            machine.make_automaton()
        always = {""} & set(params)
        seen: dict[tuple[str, int], list[int]] = {}
        for batch in batches:
            for code, bad in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for sink in {s for _, s in machine.iter(code)} | always if len(machine) else always:
                    n = None
                    for param in params[sink]:
                        if param >= 0 and n is None:
                            n = arguments(code, sink)
                        if param < 0 or n > param:
                            seen.setdefault((sink, param), [0, 0])[0 if bad else 1] += 1
        yield pa.RecordBatch.from_pydict({"sink": [k[0] for k in seen], "param": [k[1] for k in seen], "tp": [v[0] for v in seen.values()], "fp": [v[1] for v in seen.values()]}, COUNTS)

    return labelled.mapInArrow(count, "sink string, param int, tp long, fp long")


def outcomes(proposals: DataFrame, traces: DataFrame) -> DataFrame:
    """proposer, round, line, pattern (null if the line is none), tp, fp, tn, fn, precision, recall and f1 of every proposal against all traces. proposals: proposer, round, line; traces:
    code, is_vulnerable. Whether a pattern matches depends on its sink and parameter alone, so candidates that share both are judged once: an automaton of at most ``AT_ONCE`` sinks reads each
    trace, only the parameters of sinks that it met are tried, and a task sends on two counts for each sink and parameter. Sinks beyond that follow in further passes.

    Cases: a null code matches nothing, a null label is a benign trace; without traces all figures are 0; equal rounds of a proposer are judged each by their line; an empty table of
    proposals gives no rows."""
    ranked = proposals.select("proposer", "round", "line").distinct().withColumn("pattern", responses.rule_pattern(F.col("line")))
    ranked = settled(ranked.withColumn("sink", F.col("pattern.sink")).withColumn("param", F.col("pattern.param")), "proposals")
    known = ranked.filter("pattern IS NOT NULL").groupBy("sink").agg(F.collect_set("param").alias("params"))
    known = settled(known.withColumn("k", F.xxhash64("sink")), "sinks")
    parts = max(1, -(-known.count() // AT_ONCE))
    labelled = traces.select(F.coalesce("code", F.lit("")).alias("code"), F.coalesce("is_vulnerable", F.lit(False)).alias("bad"))
    totals = labelled.agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good")).first()
    hit = reduce(DataFrame.union, [_counted(labelled, known.filter(F.pmod("k", F.lit(parts)) == k)) for k in range(parts)])
    hit = hit.groupBy("sink", "param").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"))
    out = ranked.join(hit, ["sink", "param"], "left").drop("sink", "param").withColumn("tp", F.coalesce("tp", F.lit(0))).withColumn("fp", F.coalesce("fp", F.lit(0)))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = out.withColumn("tn", totals["good"] - F.col("fp")).withColumn("fn", totals["bad"] - F.col("tp"))
    out = out.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), both))


def converged(judged: DataFrame, enough: float = CONVERGED) -> DataFrame:
    """proposer, best_round, best_id, best_f1, rounds and stopped of each proposer from its ``outcomes``: rounds are taken in order up to the first that reaches ``enough`` (stopped); the best is the first with the highest
    F1. A line that is no pattern ends a proposer with no result, whatever was best before; one after the stop was never asked for.

    Cases: of equal rounds the least line counts as the first; a proposer whose first line is no pattern has 0 rounds and nulls."""
    order = Window.partitionBy("proposer").orderBy("round", "line")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    done = F.coalesce(F.bool_or((F.col("f1") >= enough) & F.col("pattern").isNotNull()).over(before), F.lit(False))
    taken = judged.withColumn("_n", F.row_number().over(order)).withColumn("_done", done).filter("NOT _done")
    g = taken.groupBy("proposer").agg(
        F.bool_or(F.col("pattern").isNull()).alias("_broken"),
        F.min(F.when(F.col("pattern").isNull(), F.col("_n"))).alias("_at"),
        F.count("*").alias("_all"),
        F.bool_or((F.col("f1") >= enough) & F.col("pattern").isNotNull()).alias("_reached"),
        F.max_by(F.struct("round", "pattern.id", "f1"), F.struct("f1", -F.col("_n"))).alias("_best"),
    )
    sound = lambda c: F.when(~F.col("_broken"), c)
    return g.select("proposer", sound(F.col("_best.round")).alias("best_round"), sound(F.col("_best.id")).alias("best_id"), sound(F.col("_best.f1")).alias("best_f1"), F.when(F.col("_broken"), F.col("_at") - 1).otherwise(F.col("_all")).alias("rounds"), (F.col("_reached") & ~F.col("_broken")).alias("stopped"))
