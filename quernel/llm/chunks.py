"""Chunks of whole rows, and an exchange that asks hash-partitioned shards about a chunk's entries.

A chunk is a few MB of rows, compressed, in a table in the shared folder that is bucketed by chunk: what comes back to a
chunk is shuffled, the chunk itself never. An operator that must know something about every window or n-gram of the corpus
sends, for each chunk, its *distinct* entries to shards by hash (so that a frequent entry costs each chunk one entry, and
no key is hot), lets every shard combine what all chunks sent (``gather``), and gets for each chunk one answer for each
entry, in the order sent (``finish``). What one exchange told can decide what the next one asks. Chunk and shard sizes are
fixed; only their number grows, and a task takes several chunks. A text longer than a chunk is a chunk of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quernel.llm import textblocks as tb
from quernel.operators.rows import run_dir

CHUNK = 4 << 20
TASK = 8 << 20  # bytes of text in the chunks of one task, about
TASKS = 1 << 16  # of one exchange at most; beyond that a task takes more chunks, one after another


@dataclass
class Chunks:
    """Rows (chunk, rows) in the shared folder: number, and the rows, all columns, as Arrow; and the bytes of all texts."""

    rows: DataFrame
    size: int


def squeeze(a: np.ndarray) -> bytes:
    """Bytes of an integer array by significance, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())


def expand(b: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


def squeeze_sorted(a: np.ndarray) -> bytes:
    return squeeze(np.diff(a, prepend=a.dtype.type(0)))


def expand_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(expand(b, np.uint64), dtype=np.uint64)


def pack(docs: DataFrame, text: str, most: int = CHUNK) -> Chunks:
    """The rows of ``docs`` in chunks of at most ``most`` bytes of text, or one longer text."""
    spark, names = docs.sparkSession, docs.columns
    size = docs.agg(F.sum(F.octet_length(text))).collect()[0][0] or 0
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text_at = f"c{names.index(text)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(pa.Table.from_batches(held).combine_chunks())
            return pa.record_batch([pa.array([part << 32 | seq]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "rows"])

        for batch, data, _ in tb.blocks(batches, text=text_at, most=most):
            if held and size + len(data) > most:
                yield out()
                held, size, seq = [], 0, seq + 1
            held.append(batch)
            size += len(data)
        if held:
            yield out()

    name = f"quernel_{uuid.uuid4().hex}"
    writer = inner.mapInArrow(run, "chunk long, rows binary").write.bucketBy(min(TASKS, max(1, -(-size // TASK))), "chunk")
    writer.option("path", f"{run_dir(spark)}/{name}").option("parquet.enable.dictionary", "false").saveAsTable(name)
    rows = spark.table(name)
    rows.schema  # resolved; the catalog's entry is no longer needed, and the files stay
    spark.sql(f"DROP TABLE {name}")
    return Chunks(rows, size)


def unpack(rows: bytes) -> pa.RecordBatch:
    t = pa.ipc.open_stream(rows).read_all().combine_chunks()
    return t.to_batches()[0] if t.num_rows else pa.RecordBatch.from_pylist([], t.schema)


def sub_blocks(batch: pa.RecordBatch, text: str, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and offsets of slices of a chunk's rows."""
    at = 0
    for part, data, off in tb.blocks(iter([batch]), text=text, most=most):
        yield at, data, off
        at += part.num_rows


def shard_cuts(sorted_hashes: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's range of hashes begins, and the end."""
    edges = np.array([(i << 64) // shards for i in range(1, shards)], np.uint64)
    return np.r_[0, np.searchsorted(sorted_hashes, edges), len(sorted_hashes)]


Rows = Iterator[tuple[int, bytes]]


def bundle(parts: list[tuple[int, bytes]]) -> bytes:
    """Numbered byte strings as one."""
    head = np.array([len(parts), *(x for s, b in parts for x in (s, len(b)))], np.uint32)
    return head.tobytes() + b"".join(b for _, b in parts)


def unbundle(b: bytes) -> Rows:
    n = int(np.frombuffer(b, np.uint32, 1)[0])
    head, at = np.frombuffer(b, np.uint32, 2 * n, 4).reshape(-1, 2).tolist(), 4 + 8 * n
    for s, size in head:
        yield s, b[at : at + size]
        at += size


def gather(chunks: Chunks, shards: int, per_row: int, ask: Callable[[pa.RecordBatch, dict[int, bytes]], Rows], combine: Callable[[list[bytes]], list[bytes]], known: DataFrame | None = None) -> DataFrame:
    """Rows (chunk, entries), what shards answer to each chunk. ``ask`` gives a chunk's (shard, entries), by shard, from its
    rows and what it knows from an earlier exchange; ``combine`` answers all entries of one shard, in order. ``per_row``
    neighbouring shards travel in one row and are combined one after another, so that a shard stays small in memory while
    rows, chunks times shards over ``per_row``, stay few."""
    names = ["team", "chunk", "entries"]

    def send(chunk: int, rows: bytes, told: dict[int, bytes]) -> pa.RecordBatch:
        groups: dict[int, list[tuple[int, bytes]]] = {}
        for s, b in ask(unpack(rows), told):
            groups.setdefault(s // per_row, []).append((s, b))
        return pa.record_batch([pa.array(list(groups), pa.int32()), pa.array([chunk] * len(groups), pa.int64()), pa.array([bundle(g) for g in groups.values()], pa.binary())], names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield send(chunk, rows.as_py(), {})

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.Table.from_batches([send(left.column("chunk")[0].as_py(), left.column("rows")[0].as_py(), _unbundled(right.column("entries")))])

    def meet(group: pa.Table) -> pa.Table:
        by_shard: dict[int, list[tuple[int, bytes]]] = {}
        for i, e in enumerate(group.column("entries")):
            for s, b in unbundle(e.as_py()):
                by_shard.setdefault(s, []).append((i, b))
        out: list[list[tuple[int, bytes]]] = [[] for _ in range(group.num_rows)]
        for s in sorted(by_shard):
            asked = by_shard.pop(s)
            for (i, _), b in zip(asked, combine([b for _, b in asked]), strict=True):
                out[i].append((s, b))
        tb.release()
        return pa.table([group.column("chunk"), pa.array([bundle(x) for x in out], pa.binary())], names[1:])

    kinds = "team int, chunk long, entries binary"
    if known is None:
        asked = chunks.rows.mapInArrow(each, kinds)
    else:
        asked = chunks.rows.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(both, kinds)
    return asked.repartition(min(TASKS, max(1, -(-shards // per_row))), "team").groupBy("team").applyInArrow(meet, "chunk long, entries binary")


def _unbundled(entries: pa.ChunkedArray) -> dict[int, bytes]:
    return {s: b for e in entries.to_pylist() for s, b in unbundle(e)}


def finish(chunks: Chunks, answers: DataFrame, answer: Callable[[pa.RecordBatch, dict[int, bytes], dict[int, bytes]], pa.Table], schema: StructType, known: DataFrame | None = None) -> DataFrame:
    """Rows of ``schema`` from each chunk's rows (columns named c0, c1, ...), its answers by shard, and what it knew before."""
    told = answers.select("chunk", "entries", F.lit(False).alias("known"))
    if known is not None:
        told = told.unionAll(known.select("chunk", "entries", F.lit(True)))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        before = right.column("known")
        return answer(unpack(left.column("rows")[0].as_py()), _unbundled(right.filter(pc.invert(before)).column("entries")), _unbundled(right.filter(before).column("entries")))

    return chunks.rows.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(run, schema)
