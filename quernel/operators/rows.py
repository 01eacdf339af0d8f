"""Rows of written tables: identity, numbering and cutting of lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RID = "__rid"
_runs: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a temporary one, in local mode only: on a cluster each
    executor would write to its own disk."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="quernel-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    context.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


def run_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one; deleted when the driver exits."""
    parent = shared_dir(spark)
    path = f"{parent}/quernel-{spark.sparkContext.applicationId}"
    if path not in _runs:
        _runs.add(path)
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        # the JVM outlives Python's own exit handlers, so it is the one to delete
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: evaluated once, whatever reads it later and whichever executors are
    lost."""
    path = f"{run_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_rids(df: DataFrame) -> DataFrame:
    """Adds the hidden identity of each row, unique over all batches."""
    return df.withColumn(RID, F.concat(F.lit(uuid.uuid4().hex[:12] + ":"), F.monotonically_increasing_id().cast("string")))


def numbered(df: DataFrame, name: str, start: int, step: int) -> tuple[DataFrame, int]:
    """Adds start, start + step, ... without a global sort: partitions count their rows, the driver adds up one number for
    each partition. ``df`` must be a written table. Returns the rows and their number."""
    sizes = {r.p: r.n for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()}
    base, at = [], 0
    for p in sorted(sizes):
        base += [F.lit(p), F.lit(at)]
        at += sizes[p]
    if not base:
        return df.withColumn(name, F.lit(None).cast("long")), 0
    offset = F.element_at(F.create_map(*base), F.spark_partition_id()).cast("long") + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return df.withColumn(name, F.lit(start) + F.lit(step) * offset), at
