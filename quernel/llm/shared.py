"""Reading the input tables and cutting lineage in storage that every executor sees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quernel.operators.rows import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; Spark alone opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str, taken: list[str]) -> str:
    """``name``, lengthened until no column of ``taken`` begins with it."""
    while any(c.startswith(name) for c in taken):
        name += "_"
    return name


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: lost executors cost no recomputation of it. The
    folder goes when the application ends."""
    return written(df)
