"""Vectorised views of Arrow text columns: bytes, words, rolling hashes, minimisers.

Everything works on *blocks*: the UTF-8 bytes of several whole texts laid end to end, with offsets. Words are
maximal runs of bytes other than 0x20 and 0x09-0x0D; no word, window or gram crosses a text's end.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
U64 = np.uint64


@lru_cache(maxsize=1)
def _trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Gives freed memory back to the system: Python workers outlive their tasks, and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    if _trim() is not None:
        _trim()(0)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than texts) of a string column; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(off) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches holding at most ``most`` bytes of text, or one longer text, with bytes and offsets."""
    for batch in batches:
        data, off = text_bytes(column(batch, text))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            yield batch.slice(at, end - at), data[off[at] : off[end]], off[at : end + 1] - off[at]
            at = end
        del batch, data, off
        release()


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each text the index of its first word (one more entry than texts)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    space = SPACE[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = True, space[:-1]
    after[-1], after[:-1] = True, space[1:]
    before[off[:-1][off[:-1] < n]] = True
    after[off[1:][off[1:] > 0] - 1] = True
    np.logical_not(space, out=space)
    starts, ends = np.flatnonzero(space & before), np.flatnonzero(space & after) + 1
    return starts, ends, np.searchsorted(starts, off)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(maxsize=8)
def _base(seed: int) -> tuple[int, int, np.ndarray]:
    r = np.random.default_rng(seed)
    p = int(r.integers(0, 1 << 63, dtype=np.int64)) << 1 | 1
    p = (p & ~6 | 4) % (1 << 64) | 1
    return p, pow(p, -1, 1 << 64), r.integers(0, 1 << 64, 256, dtype=np.uint64)


STEP = 1 << 12  # powers kept for each multiplier


@lru_cache(maxsize=16)
def _first_powers(seed: int, inverse: bool) -> np.ndarray:
    have = np.ones(STEP + 1, U64)
    have[1:] = U64(_base(seed)[1 if inverse else 0])
    return np.multiply.accumulate(have)


def powers(seed: int, n: int, inverse: bool = False) -> np.ndarray:
    """The first ``n`` powers of the odd multiplier of ``seed``, or of its inverse modulo 2**64. Made anew from a short
    table, so that a worker keeps nothing as long as the longest text it saw."""
    have = _first_powers(seed, inverse)
    if n <= STEP:
        return have[:n]
    steps = np.ones(-(-n // STEP), U64)
    steps[1:] = have[STEP]
    return (np.multiply.accumulate(steps)[:, None] * have[:STEP]).ravel()[:n]


class Rolling:
    """Hashes of any spans of a sequence of 64-bit values, by prefix sums of a polynomial modulo 2**64."""

    def __init__(self, values: np.ndarray, seed: int) -> None:
        self.seed, n = seed, len(values)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(values * powers(seed, n), out=self.sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * powers(self.seed, len(self.sums), True)[starts] + (ends - starts).astype(U64))

    def windows(self, size: int) -> np.ndarray:
        """Hash of every ``size`` consecutive values."""
        n = len(self.sums) - size
        if n <= 0:
            return np.zeros(0, U64)
        return mix((self.sums[size:] - self.sums[:-size]) * powers(self.seed, n, True))


def byte_values(data: np.ndarray, seed: int) -> np.ndarray:
    return _base(seed)[2][data]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    return Rolling(byte_values(data, seed), seed).spans(starts, ends)


def window_starts(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of texts whose symbols start at ``first`` (one more entry than texts): the start of every window of ``size``
    symbols within one text, and the text's number for each."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    begin = np.cumsum(counts) - counts
    return first[:-1][doc] + (np.arange(len(doc)) - begin[doc]), doc


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` consecutive values."""
    if len(x) < size:
        return x[:0]
    have, width = x, 1
    while width * 2 <= size:
        have, width = np.minimum(have[:-width], have[width:]), width * 2
    return have if width == size else np.minimum(have[: len(x) - size + 1], have[size - width :][: len(x) - size + 1])


def anchors(grams: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimisers: for every window its leftmost gram of least hash, which depends on the window's content alone.

    ``grams``: hash of the gram that starts at each symbol. Returns, for each run of windows of one text that share an
    anchor: the anchor's position, the first window start, the number of windows, the text's number.
    """
    starts, doc = window_starts(first, window)
    if not len(starts):
        e = np.zeros(0, np.int64)
        return e, e, e, e
    # 32 bits of hash, then the position: leftmost of equals, whatever the block's length
    packed = (grams >> U64(32) << U64(32)) | np.arange(len(grams), dtype=U64)
    pos = (sliding_min(packed, window - gram + 1)[starts] & U64(0xFFFFFFFF)).astype(np.int64)
    cut = np.flatnonzero(np.r_[True, (pos[1:] != pos[:-1]) | (doc[1:] != doc[:-1])])
    return pos[cut], starts[cut], np.diff(np.r_[cut, len(starts)]), doc[cut]


def covered(length: int, starts: np.ndarray, size: int) -> np.ndarray:
    """Which of ``length`` positions lie in a window of ``size`` from one of ``starts``."""
    d = np.zeros(length + 1, np.int32)
    np.add.at(d, starts, 1)
    np.subtract.at(d, np.minimum(starts + size, length), 1)
    return np.cumsum(d[:-1]) > 0
