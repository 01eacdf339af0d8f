"""Streams as tables of an engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quernel.session import Engine


def attach_stream(engine: Engine, name: str, path: str, schema: str | object, fmt: str = "parquet", watermark: tuple[str, str] | None = None, **options: str) -> None:
    """A read-only table over files that keep arriving. ``watermark``: event-time column and how late rows may be."""
    df = engine.spark.readStream.format(fmt).schema(schema).options(**options).load(path)
    if watermark:
        df = df.withWatermark(*watermark)
    engine.attach(name, df)


def start(df: DataFrame, sink: str, checkpoint: str, mode: str = "append", fmt: str = "parquet") -> StreamingQuery:
    """Starts the streaming query of ``df`` into a sink path, or into a named in-memory table (``fmt="memory"``)."""
    writer = df.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint)
    return writer.queryName(sink).start() if fmt == "memory" else writer.start(sink)
