"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact similarity.

Words are lower-cased (A-Z) maximal runs of other bytes than white space; shingles are ``size`` consecutive words, or all
words of a shorter text. For each benchmark item, windows of as many words (the whole document, if that is shorter) are
fingerprinted: the bitwise majority of the shingles' 64-bit hashes. Fingerprints are cut into four blocks of 16 bits;
two within RADIUS = 19 differing bits have a block with at most four differing ones, so probing every block at all values
up to four bits away finds every item within the radius. Candidates are verified exactly: sum of minima over sum of
maxima of shingle counts (each shingle weighs as often as it occurs), at least ``similarity``. At 0.8 two fingerprints
differ in about ten bits; 19 is over three standard deviations more. A document shorter than an item has fewer shingles
than it, so that its majorities lean differently (4 of 5 shingles: 12 bits on average, and over 19 in one case of 90): such
pairs are allowed 27 bits, probed up to six away.

Of all item-sized windows only those that hold a shingle of an item of their size are fingerprinted and looked up. That
loses nothing, since a window that shares no shingle with an item has similarity zero with it, and leaves few of them (17,695
of 253,529,970 in 40 MB of the test documents). Which items such a window may match, the fingerprints alone propose.

A text of any length is scanned whole, in one task and one block if it is longer than a block. Items are read to the driver in parts of at most ``PART`` bytes of text, by hash of item_id, and documents are scanned
once for each part, so what is broadcast is bounded whatever the benchmark's size. Documents are never shuffled. Null and
wordless texts and items match nothing. Null ids stay null. Repeated rows are judged alike. Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm import textblocks as tb
from quernel.llm.shared import table
from quernel.llm.simhash import ONES, popcount

RADIUS = 19
SHORT_RADIUS = 27  # of a whole document and a longer item
PART = 8 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the shingles of one sequence of word hashes."""
    if not len(h):
        return np.zeros(0, np.uint64)
    return tb.Rolling(h, 7).windows(min(size, len(h)))


def majority(sums: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.packbits(sums * 2 > n[:, None], axis=1).view(">u8")[:, 0].astype(np.uint64)


def bits(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


class Items:
    """Benchmark items by fingerprint and by shingle."""

    def __init__(self, ids: list, texts: list[str | None], size: int) -> None:
        self.size, self.ids, self.words, own = size, [], [], []
        for i, t in zip(ids, texts, strict=True):
            data = LOWER[np.frombuffer((t or "").encode(), np.uint8)]
            starts, ends, _ = tb.words(data, np.array([0, len(data)]))
            if len(starts):
                self.ids.append(i)
                self.words.append(len(starts))
                own.append(shingles(tb.word_hashes(data, starts, ends, 1), size))
        self.words = np.array(self.words, np.int64)
        self.counts = [np.unique(x, return_counts=True) for x in own]
        self.fp = np.array([majority(bits(x).sum(0, dtype=np.int64)[None], np.array([len(x)]))[0] for x in own], np.uint64)
        of = np.repeat(np.arange(len(own)), [len(x) for x in own])
        every = np.concatenate([np.zeros(0, np.uint64), *own])
        order = np.lexsort((of, every))
        self.shingle, self.shingle_item = every[order], of[order]
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(every & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        self.short = np.unique(self.words[self.words < size])

    @cached_property
    def blocks(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per block of 16 bits: where each value's items begin (and the end), and the items in order."""
        out = []
        for b in range(4):
            v = (self.fp >> np.uint64(16 * b) & np.uint64(0xFFFF)).astype(np.int64)
            order = np.argsort(v, kind="stable")
            out.append((np.searchsorted(v[order], np.arange((1 << 16) + 1)), order))
        return out

    def near(self, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, item) within ``radius`` bits, each once: some block of 16 bits has at most a fourth of them, and all
        its values that far away are probed."""
        pairs, probes = [np.zeros(0, np.int64)], np.flatnonzero(ONES <= radius // 4)
        for at in range(0, len(fps), 512):
            part = fps[at : at + 512]
            for b, (begin, order) in enumerate(self.blocks):
                v = (part >> np.uint64(16 * b) & np.uint64(0xFFFF)).astype(np.int64)[:, None] ^ probes
                n = begin[v + 1] - begin[v]
                q, p = np.nonzero(n)
                n, start = n[q, p], begin[v[q, p]]
                item = order[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                query = np.repeat(q, n) + at
                ok = popcount(fps[query] ^ self.fp[item]) <= radius
                pairs.append(query[ok] * len(self.fp) + item[ok])
        both = np.unique(np.concatenate(pairs))
        return both // max(1, len(self.fp)), both % max(1, len(self.fp))

    def similarity(self, item: int, other: np.ndarray) -> float:
        """Sum of minima over sum of maxima of shingle counts."""
        (mine, n), (theirs, m) = self.counts[item], np.unique(other, return_counts=True)
        _, i, j = np.intersect1d(mine, theirs, assume_unique=True, return_indices=True)
        least = int(np.minimum(n[i], m[j]).sum())
        return least / (int(n.sum() + m.sum()) - least)

    def hits(self, h: np.ndarray) -> np.ndarray:
        """Positions of hashes that are shingles of some item."""
        some = np.flatnonzero(self.filter[(h & np.uint64((1 << 22) - 1)).astype(np.int64)])
        at = np.searchsorted(self.shingle, h[some])
        return some[(at < len(self.shingle)) & (self.shingle[np.minimum(at, max(0, len(self.shingle) - 1))] == h[some])] if len(self.shingle) else some[:0]


def matches(items: Items, data: np.ndarray, off: np.ndarray, similarity: float) -> list[tuple[int, int, int, int, float]]:
    """(text, item, first word, words, similarity) of each text's best window for every item that it holds."""
    if not len(items.ids):
        return []
    size, data = items.size, LOWER[data]
    starts, ends, first = tb.words(data, off)
    h = tb.word_hashes(data, starts, ends, 1)
    lengths = np.diff(first)
    found: dict[tuple[int, int], tuple[int, int, float]] = {}
    # windows of at least a shingle's words use its hashes; shorter ones are one shingle of their own size
    for width in [size, *(int(x) for x in items.short), *(int(x) for x in np.unique(lengths[(lengths > 0) & (lengths < size)]))] if len(h) else []:
        w = tb.Rolling(h, 7).windows(width)
        hit = items.hits(w)
        doc = np.searchsorted(first, hit, "right") - 1
        inside = hit + width <= first[doc + 1]
        hit, doc = hit[inside], doc[inside]
        if not len(hit):
            continue
        lo, hi = np.searchsorted(items.shingle, w[hit], "left"), np.searchsorted(items.shingle, w[hit], "right")
        each = hi - lo
        item = items.shingle_item[np.repeat(lo - (np.cumsum(each) - each), each) + np.arange(each.sum())]
        hit, doc = np.repeat(hit, each), np.repeat(doc, each)
        n = np.minimum(items.words[item], lengths[doc])
        fits = (n >= size) if width == size else (n == width)
        rows = np.unique(np.c_[doc, hit, n][fits], axis=0)
        if not len(rows):
            continue
        doc, hit, n = rows.T
        low, high = np.maximum(hit + width - n, first[doc]), np.minimum(hit, first[doc + 1] - n)
        several = np.maximum(high - low + 1, 0)
        begin = np.repeat(low - (np.cumsum(several) - several), several) + np.arange(several.sum())
        windows = np.unique(np.c_[np.repeat(doc, several), begin, np.repeat(n, several)], axis=0)
        for at in range(0, len(windows), 4096):
            _verify(items, windows[at : at + 4096], w, width, first, similarity, found)
    return [(d, i, s - int(first[d]), n, v) for (d, i), (s, n, v) in found.items()]


def _verify(items: Items, windows: np.ndarray, w: np.ndarray, width: int, first: np.ndarray, similarity: float, found: dict) -> None:
    doc, begin, n = windows.T
    count = n - width + 1
    # shingles of all windows, each distinct position once
    need = np.unique(np.concatenate([np.arange(b, b + c) for b, c in zip(begin.tolist(), count.tolist(), strict=True)]))
    sums = np.zeros((len(need) + 1, 64), np.int32)
    np.cumsum(bits(w[need]), axis=0, dtype=np.int32, out=sums[1:])
    at = np.searchsorted(need, begin)
    fps = majority(sums[at + count] - sums[at], count)
    whole = n == np.diff(first)[doc]
    query, item = items.near(fps)
    fits = (items.words[item] == n[query]) | whole[query]
    query, item = query[fits], item[fits]
    if whole.any():  # whole documents meet longer items too, at a wider radius
        at = np.flatnonzero(whole)
        more, longer = items.near(fps[at], SHORT_RADIUS)
        fits = items.words[longer] >= n[at[more]]
        query, item = np.r_[query, at[more[fits]]], np.r_[item, longer[fits]]
    for q, i in np.unique(np.c_[query, item], axis=0).tolist():
        v = items.similarity(i, w[begin[q] : begin[q] + count[q]])
        key = (int(doc[q]), i)
        if v >= similarity and (key not in found or v > found[key][2]):
            found[key] = (int(begin[q]), int(n[q]), v)


def item_parts(benchmark: DataFrame, text: str, id_col: str) -> Iterator[tuple[list, list]]:
    """Ids and texts of the items, in parts of bounded size."""
    total = benchmark.agg(F.sum(F.octet_length(text))).collect()[0][0] or 0
    parts = max(1, -(-total // PART))
    for p in range(parts):
        got = benchmark.where(F.pmod(F.xxhash64(F.col(id_col), F.col(text)), F.lit(parts)) == p).select(F.col(id_col).alias("i"), F.col(text).alias("t")).orderBy("i", "t").collect()
        yield [r.i for r in got], [r.t for r in got]


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", id_col: str = "doc_id", item_text: str = "text", item_id: str = "item_id", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, item_id, first_word, n_words, similarity: for each document the items it holds, with the best window."""
    spark, out = docs.sparkSession, None
    kinds = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    for ids, texts in item_parts(benchmark, item_text, item_id):
        shared = spark.sparkContext.broadcast(Items(ids, texts, size))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch, data, off in tb.blocks(batches):
                got = sorted(matches(items, data, off, similarity), key=lambda m: m[:2])
                doc = tb.column(batch, "doc_id").take(pa.array([m[0] for m in got], pa.int64()))
                yield pa.record_batch([doc, pa.array([items.ids[m[1]] for m in got]).cast(item_type) if got else pa.array([], item_type), *(pa.array([m[k] for m in got], t) for k, t in ((2, pa.int64()), (3, pa.int64()), (4, pa.float64())))], ["doc_id", "item_id", "first_word", "n_words", "similarity"])

        from pyspark.sql.pandas.types import to_arrow_type

        item_type = to_arrow_type(benchmark.schema[item_id].dataType)
        part = source.mapInArrow(run, f"doc_id {kinds[0]}, item_id {kinds[1]}, first_word long, n_words long, similarity double")
        out = part if out is None else out.unionAll(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents that hold no item."""
    spark = docs.sparkSession
    for ids, texts in item_parts(benchmark, item_text, item_id):
        shared = spark.sparkContext.broadcast(Items(ids, texts, size))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch, data, off in tb.blocks(batches, text=text):
                keep = np.ones(batch.num_rows, bool)
                keep[[m[0] for m in matches(shared.value, data, off, similarity)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return clean(docs, table(spark, sf_dir, "benchmark"))
