"""Baselines of projects kept as state of a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = "n long, mean double, squares double, false_positives long, late long, last_ms long"
BASELINE = "n long, mean double, squares double, deviation double, true_positives long, false_positives long, false_positive_rate double, late long, closed boolean"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare(spark: SparkSession) -> None:
    """State of this kind needs a state store with column families."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def merged(a: tuple[int, float, float], b: tuple[int, float, float]) -> tuple[int, float, float]:
    """Count, mean and squared deviations of two sets of numbers together."""
    n = a[0] + b[0]
    if not n:
        return 0, 0.0, 0.0
    apart = b[1] - a[1]
    return n, a[1] + apart * b[0] / n, a[2] + b[2] + apart * apart * a[0] * b[0] / n


class _Baseline(StatefulProcessor):
    """Of each key: the moments of what was seen, and a timer that closes the key when event time has left it behind."""

    def __init__(self, key: str, idle_ms: int) -> None:
        self.key, self.idle_ms = key, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("moments", STATE)

    def _row(self, key: tuple, n: int, mean: float, squares: float, false: int, late: int, closed: bool) -> pd.DataFrame:
        deviation = float(np.sqrt(squares / n)) if n > 1 else 0.0
        values = [n, mean, squares, deviation, n - false, false, false / n if n else 0.0, late, closed]
        return pd.DataFrame([[key[0], *values]], columns=[self.key, *[c.split()[0] for c in BASELINE.split(", ")]])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, mean, squares, false, late, last = self.state.get() if self.state.exists() else (0, 0.0, 0.0, 0, 0, 0)
        passed = timerValues.getCurrentWatermarkInMs()
        for part in rows:
            at = part["at_ms"].to_numpy(np.int64)
            on_time = at >= passed
            late += int((~on_time).sum())
            x = part["confidence_score"].to_numpy(np.float64)[on_time]
            if len(x):
                n, mean, squares = merged((n, mean, squares), (len(x), float(x.mean()), float(((x - x.mean()) ** 2).sum())))
                false += int((part["verification_status"][on_time] == "false_positive").sum())
                last = max(last, int(at[on_time].max()))
        self.state.update((n, mean, squares, false, late, last))
        if n:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(last + self.idle_ms)
        yield self._row(key, n, mean, squares, false, late, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, mean, squares, false, late, _ = self.state.get()
        self.state.clear()
        yield self._row(key, n, mean, squares, false, late, True)

    def close(self) -> None:
        pass


def baselines(stream: DataFrame, key: str, time: str, wait: str, idle: str) -> DataFrame:
    """A row of a key's baseline after each micro-batch that touches it (closed false), and a last one when event time is ``idle`` past its last finding (closed true); then its
    state goes, and what comes later begins anew, to be put together by ``planning.merged_baselines``. Rows that are behind the watermark by the time they come are late:
    they are counted as such at most, not in the moments. ``wait``: how long late rows are waited for. stream: ``key``, ``time`` (a timestamp), confidence_score and
    verification_status; rows without key, time or score are passed over.

    State is kept by the state store and its checkpoint, so a restarted query goes on where it was. A key's state is six numbers."""
    prepare(stream.sparkSession)
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    read = stream.select(F.col(key), F.col(time).alias("at"), F.unix_millis(F.col(time).cast("timestamp")).alias("at_ms"), F.col("confidence_score").cast("double"), F.col("verification_status").cast("string"))
    read = read.filter(F.col(key).isNotNull() & F.col("at").isNotNull() & F.col("confidence_score").isNotNull()).withWatermark("at", wait)
    schema = f"{key} {read.schema[key].dataType.simpleString()}, {BASELINE}"
    return read.groupBy(key).transformWithStateInPandas(statefulProcessor=_Baseline(key, idle_ms), outputStructType=schema, outputMode="Update", timeMode="EventTime")


def newest(rows: DataFrame, key: str) -> DataFrame:
    """Of an append log of ``baselines`` rows the one of each key that counts most findings, since its last close."""
    return rows.filter("NOT closed").groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), "n").alias("x")).select(key, "x.*")
