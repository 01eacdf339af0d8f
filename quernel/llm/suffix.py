"""Removal of repeated byte strings by bucket-pointer refinement of suffixes.

Every window of ``window`` bytes has an anchor, its leftmost ``gram``-byte string of least hash, which depends on the
window's content alone. A count-min sketch of the anchors leaves the windows whose anchor occurs twice by estimate; no
repeated window is lost. Windows that share an anchor sit side by side, so a chunk sends their common context, each
distinct one once, to the shard of the anchor's hash: suffixes that can be equal for ``window`` bytes meet in one shard.

A shard names the q-grams at all positions of its distinct contexts (the initial buckets) and refines buckets of more
than one suffix by sorting on the pair of a suffix's bucket and the bucket of the suffix that starts as much later as
the buckets are deep. Every refinement uses the buckets that the one before has made, so depth doubles; a suffix alone in
its bucket is left out from then on, and keeps a number that no later round gives again. Suffixes that share a bucket at depth ``window`` are repeated strings.

Anchors of ``hot`` or more occurrences by estimate (a passage in a large share of all documents) would fill one shard:
their windows are spread by their own hashes instead and grouped exactly by 96 bits.

Each byte covered by a string that starts elsewhere too goes; strings are judged on the input. Null texts are empty;
texts shorter than a window lose nothing; a text longer than a chunk is scanned whole in one task; the two rows of a repeated document are two places. Extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from quernel.llm import textblocks as tb
from quernel.llm import windows
from quernel.llm.chunks import CHUNK, Rows, expand, finish, gather, pack, squeeze, sub_blocks
from quernel.llm.shared import table
from quernel.llm.sketch import Sketch

BLOCK = 1 << 20
SHARD = 2 << 20  # bytes of contexts a shard gets on average, about
TEAM = 32  # shards that travel together
GRAM, FIRST = 64, 50
HOT = 4096
SPACING = 128  # bytes of text for each anchor, at least, as a rule


@dataclass
class Block:
    """One block of a chunk: its runs of windows, the distinct contexts in shard order, and the hot runs."""

    off: np.ndarray
    begin: np.ndarray  # of each context run: first window
    count: np.ndarray
    of: np.ndarray  # its distinct context
    shard: np.ndarray  # of each distinct context, sorted
    owned: np.ndarray
    twice: np.ndarray
    text: np.ndarray  # the distinct contexts' bytes
    ends: np.ndarray  # where each ends in text
    hot: np.ndarray  # first byte of each hot window


def spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... for each run."""
    return np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())


def _runs(data: np.ndarray, off: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, tb.Rolling]:
    rolling = tb.Rolling(tb.byte_values(data, 3), 3)
    grams = rolling.windows(gram)
    pos, begin, count, _ = tb.anchors(grams, off, window, gram)
    return grams[pos], begin, count, rolling


def _anchors(batch: pa.RecordBatch, text: str, window: int, gram: int) -> np.ndarray:
    # anchors are least hashes, all small: mixed again before they are counted or spread
    return tb.mix(np.concatenate([np.zeros(0, np.uint64), *(_runs(data, off, window, gram)[0] for _, data, off in sub_blocks(batch, text, BLOCK))]))


def _blocks(batch: pa.RecordBatch, text: str, window: int, gram: int, shards: int, estimates, told: dict[int, bytes]) -> Iterator[tuple[Block, np.ndarray, np.ndarray]]:
    """Blocks with the two hashes of their hot windows."""
    blocks = [(data, off, *_runs(data, off, window, gram)) for _, data, off in sub_blocks(batch, text, BLOCK)]
    seen = estimates(tb.mix(np.concatenate([np.zeros(0, np.uint64), *(b[2] for b in blocks)])), told)
    for data, off, anchor, begin, count, rolling in blocks:
        anchor = tb.mix(anchor)
        keep = seen.twice(anchor)
        hot = keep & seen.hot(anchor)
        h = spread(begin[hot], count[hot])
        one = rolling.windows(window)[h] if len(h) else np.zeros(0, np.uint64)
        two = (tb.Rolling(tb.byte_values(data, 4), 4).windows(window)[h] >> np.uint64(32)).astype(np.uint32) if len(h) else np.zeros(0, np.uint32)
        keep &= ~hot
        anchor, begin, count = anchor[keep], begin[keep], count[keep]
        where = ((anchor >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
        key = rolling.spans(begin, begin + count + window - 1)
        _, at, of, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        order = np.argsort(where[at], kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        at, size = at[order], count[at[order]] + window - 1
        yield Block(off, begin, count, rank[of], where[at], count[at], n[order] > 1, data[spread(begin[at], size)], np.cumsum(size), h), one, two


def refine(text: np.ndarray, size: np.ndarray, owned: np.ndarray, window: int) -> np.ndarray:
    """Of contexts laid end to end, ``size`` bytes each: for each of their first ``owned`` positions, in order, whether
    the ``window`` bytes from there also start at another of these positions."""
    ends = np.cumsum(size).astype(np.int32)
    rest = np.repeat(ends, size) - np.arange(len(text), dtype=np.int32)
    start = spread(ends - size, owned)
    depth = first = min(FIRST, window)
    live = np.flatnonzero(rest >= first).astype(np.int32)
    names = tb.Rolling(tb.byte_values(text, 6), 6).windows(first)[live]
    bucket = np.zeros(len(text), np.uint32)
    bucket[live], live, used = _name(names, live, 0)
    del names
    while depth < window and len(live):
        step = min(depth, window - depth)
        live = live[rest[live] >= depth + step]
        pair = bucket[live].astype(np.uint64) << np.uint64(32) | bucket[live + step]
        bucket[live], live, used = _name(pair, live, used)
        depth += step
    several = np.zeros(len(text), bool)
    several[live] = True
    # of the suffixes that share a bucket, at least two must start at owned positions; all full-depth ones are owned
    return several[start]


def _name(keys: np.ndarray, at: np.ndarray, used: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bucket numbers, from ``used`` on, of the suffixes ``at`` by their keys, the suffixes whose bucket has several, and
    the first number that is free."""
    order = np.argsort(keys)
    s = keys[order]
    new = np.r_[True, s[1:] != s[:-1]] if len(s) else np.zeros(0, bool)
    rank = (np.cumsum(new) - 1 + used).astype(np.uint32)
    out = np.empty(len(keys), np.uint32)
    out[order] = rank
    alone = new & np.r_[new[1:], True] if len(s) else new
    many = np.ones(len(keys), bool)
    many[order] = ~alone
    return out, at[many], used + int(new.sum())


def _combine(entries: list[bytes], window: int) -> list[bytes]:
    if entries[0][:1] == b"h":
        return windows.combine([e[1:] for e in entries])
    distinct: dict[bytes, int] = {}
    ids, twice, owned_of, cuts = [], [], [], []
    for e in entries:
        n, m = int.from_bytes(e[1:5], "little"), int.from_bytes(e[5:9], "little")
        owned = expand(e[9 : 9 + n], np.uint16).astype(np.int64)
        twice.append(np.unpackbits(np.frombuffer(e[9 + n : 9 + n + m], np.uint8), count=len(owned)))
        text = zstandard.ZstdDecompressor().decompress(e[9 + n + m :])
        ends = np.cumsum(owned + window - 1).tolist()
        ids.append([distinct.setdefault(text[a:b], len(distinct)) for a, b in zip([0, *ends[:-1]], ends, strict=True)])
        owned_of.append(owned)
        cuts.append(int(owned.sum()))
    of, owned_all = np.concatenate([np.array(x, np.int64) for x in ids]), np.concatenate(owned_of)
    owned = np.zeros(len(distinct), np.int64)
    owned[of] = owned_all
    copies = np.bincount(of, 1.0 + np.concatenate(twice), len(distinct)) > 1
    flags = refine(np.frombuffer(b"".join(distinct), np.uint8), owned + window - 1, owned, window) | np.repeat(copies, owned)
    back = flags[spread((np.cumsum(owned) - owned)[of], owned_all)]
    return [np.packbits(x).tobytes() for x in np.split(back, np.cumsum(cuts)[:-1])]


def remove_strings(docs: DataFrame, text: str = "text", window: int = 400, prefix: str = "", chunk_bytes: int = CHUNK) -> DataFrame:
    """All columns with n_bytes, spans (pairs of first and end byte of each removed run) and kept (the bytes left),
    named with ``prefix``; input columns of these names are replaced."""
    added = [f"{prefix}{x}" for x in ("n_bytes", "spans", "kept")]
    docs = docs.drop(*added)
    names, column, gram = docs.columns, f"c{docs.columns.index(text)}", min(GRAM, max(1, window // 4))
    chunks = pack(docs, text, chunk_bytes)
    shards = max(1, -(-chunks.size // SHARD))
    sketch = Sketch(chunks, lambda batch: _anchors(batch, column, window, gram), HOT, SPACING)
    estimates = sketch.reader()

    def read(batch: pa.RecordBatch, told: dict[int, bytes]) -> tuple[list[Block], windows.Local]:
        got = list(_blocks(batch, column, window, gram, shards, estimates, told))
        none = (np.zeros(0, np.uint64), np.zeros(0, np.uint32))
        return [b for b, _, _ in got], windows.Local(np.concatenate([none[0], *(x for _, x, _ in got)]), np.concatenate([none[1], *(x for _, _, x in got)]))

    def ask(batch: pa.RecordBatch, told: dict[int, bytes]) -> Rows:
        parts, hot = read(batch, told)
        for s, e in hot.ask(shards):
            yield shards + s, b"h" + e
        for s in np.unique(np.concatenate([np.zeros(0, np.int64), *(b.shard for b in parts)])).tolist():
            own = [(b, *np.searchsorted(b.shard, (s, s + 1)).tolist()) for b in parts]
            own = [x for x in own if x[1] < x[2]]
            owned = squeeze(np.concatenate([b.owned[i:j] for b, i, j in own]).astype(np.uint16))
            twice = np.packbits(np.concatenate([b.twice[i:j] for b, i, j in own])).tobytes()
            body = zstandard.ZstdCompressor(level=1).compress(b"".join(b.text[b.ends[i - 1] if i else 0 : b.ends[j - 1]].tobytes() for b, i, j in own))
            yield s, b"c" + len(owned).to_bytes(4, "little") + len(twice).to_bytes(4, "little") + owned + twice + body

    fields = [*docs.schema, StructField(added[0], LongType()), StructField(added[1], ArrayType(ArrayType(LongType()))), StructField(added[2], BinaryType())]
    out_names = [*(f"c{i}" for i in range(len(names))), "x0", "x1", "x2"]

    def answer(batch: pa.RecordBatch, answers: dict[int, bytes], told: dict[int, bytes]) -> pa.Table:
        parts, hot = read(batch, told)
        hot_again = hot.answered(shards, {s - shards: b for s, b in answers.items() if s >= shards})
        got = {s: np.unpackbits(np.frombuffer(b, np.uint8)).astype(bool) for s, b in answers.items() if s < shards}
        taken, used, n_bytes, spans, kept = dict.fromkeys(got, 0), 0, [], [], []
        for b, (_, data, off) in zip(parts, sub_blocks(batch, column, BLOCK), strict=True):
            flags = [np.zeros(0, bool)]
            for s, n in zip(*(x.tolist() for x in _sums(b.shard, b.owned)), strict=True):
                flags.append(got[s][taken[s] : taken[s] + n])
                taken[s] += n
            flags = np.concatenate(flags)
            base = np.cumsum(b.owned) - b.owned
            again = spread(b.begin, b.count)[flags[spread(base[b.of], b.count)]]
            again = np.r_[again, b.hot[hot_again[used : used + len(b.hot)]]].astype(np.int64)
            used += len(b.hot)
            gone = tb.covered(len(data), again, window)
            for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                edge = np.flatnonzero(np.diff(np.r_[False, gone[i:j], False].astype(np.int8)))
                n_bytes.append(j - i)
                spans.append(edge.reshape(-1, 2).tolist())
                kept.append(data[i:j][~gone[i:j]].tobytes())
        return pa.table([*batch.columns, pa.array(n_bytes, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary())], out_names)

    kinds = StructType([StructField(n, f.dataType) for n, f in zip(out_names, fields, strict=True)])
    answers = gather(chunks, 2 * shards, TEAM, ask, lambda e: _combine(e, window), sketch.told)
    return finish(chunks, answers, answer, kinds, sketch.told).toDF(*names, *added)


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and the sum of values of each."""
    cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[cut], np.add.reduceat(values, cut) if len(cut) else cut


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_strings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
