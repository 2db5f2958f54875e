"""What the operators share: reading tables, the shared folder, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


#: Bounds of what crosses to Python at once, where the session leaves them at their defaults: texts may be long.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def prepare(spark: SparkSession) -> None:
    known = spark.sparkContext.getConf()
    for key, value in ARROW.items():
        if not known.contains(key):
            spark.conf.set(key, value)


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A table. ``spread``: a table of fewer splits than there are cores (a file of one row group) is dealt to all of them."""
    prepare(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if spread and df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share: ``spark.checkpoint.dir``. A temporary folder only where that
    is unset, in local mode; on a cluster it must be set."""
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not known:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        known = tempfile.mkdtemp(prefix="vantaq-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(known)
    return known.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: it is computed once, and a lost executor loses no part of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    # What was shuffled for this table is of no more use, and goes at once.
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean, None)
    spark.conf.set(clean, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(clean) if before is None else spark.conf.set(clean, before)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def per_batch(f: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = f(batch)
            if out is not None and out.num_rows:
                yield out

    return each
