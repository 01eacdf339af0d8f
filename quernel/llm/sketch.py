"""Count-min sketches, counted by each chunk, merged by shards of cells and asked by chunk.

Each chunk counts its hashes in ``depth`` rows of cells and sends the cells that it hit to the shards that own them; a shard
adds up what all chunks counted, and answers for each cell sent whether it reached two, and ``hot``. The least of a hash's
cells is its estimate: never too low. The number of cells follows the size of the input (CELLS for each hash expected), so
the share of hashes overestimated stays as it is when the input grows, and no part of the sketch is ever in one place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quernel.llm.chunks import Chunks, Rows, expand, expand_sorted, gather, shard_cuts, squeeze, squeeze_sorted
from quernel.llm.shared import materialize

DEPTH, CELLS = 2, 8
SPREAD = (1, 0xC2B2AE3D27D4EB4F)  # a row's multiplier; sorted hashes have sorted cells in the first row, which is fast to search
SHARD = 1 << 25  # bytes of text whose cells a shard gets, at most, about
HASHES = 1 << 21  # of a shard, at most, about: what bounds its memory
TEAM = 4  # shards that travel together


class Cells:
    """The cells that one chunk's hashes, spread evenly over 64 bits, hit, by row, in order."""

    def __init__(self, hashes: np.ndarray, bits: int, shards: int, depth: int = DEPTH) -> None:
        self.bits, self.shards = bits, shards
        self.hit = [np.unique(self.cells(hashes, r), return_counts=True) for r in range(depth)]
        self.cut = [shard_cuts(c << np.uint64(64 - bits), shards) for c, _ in self.hit]

    def cells(self, hashes: np.ndarray, row: int) -> np.ndarray:
        return (hashes * np.uint64(SPREAD[row])) >> np.uint64(64 - self.bits)

    def ask(self) -> Rows:
        for r, ((c, n), cut) in enumerate(zip(self.hit, self.cut, strict=True)):
            for s in np.flatnonzero(np.diff(cut)).tolist():
                own = slice(cut[s], cut[s + 1])
                one = squeeze_sorted(c[own])
                yield r * self.shards + s, len(one).to_bytes(4, "little") + one + squeeze(np.minimum(n[own], 65535).astype(np.uint16))

    def told(self, answers: dict[int, bytes]) -> Estimates:
        out = np.zeros((2, len(self.hit)), object)
        for r, cut in enumerate(self.cut):
            parts = [np.zeros((2, 0), np.uint8)]
            for s in np.flatnonzero(np.diff(cut)).tolist():
                n = int(cut[s + 1] - cut[s])
                parts.append(np.unpackbits(np.frombuffer(answers[r * self.shards + s], np.uint8).reshape(2, -1), axis=1, count=n))
            out[0, r], out[1, r] = np.concatenate(parts, axis=1).astype(bool)
        return Estimates(self, out)


class Estimates:
    """Which of a chunk's hashes occur at least twice, or at least ``hot`` times, by estimate."""

    def __init__(self, cells: Cells, flags: np.ndarray) -> None:
        self.of, self.flags = cells, flags

    def _all(self, hashes: np.ndarray, which: int) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for r in range(len(self.of.hit)):
            out &= self.flags[which, r][np.searchsorted(self.of.hit[r][0], self.of.cells(hashes, r))]
        return out

    def twice(self, hashes: np.ndarray) -> np.ndarray:
        return self._all(hashes, 0)

    def hot(self, hashes: np.ndarray) -> np.ndarray:
        return self._all(hashes, 1)


def merge(entries: list[bytes], hot: int) -> list[bytes]:
    """One shard: for each chunk's cells whether all chunks together reach two, and ``hot``."""
    cells, counts = [], []
    for e in entries:
        n = int.from_bytes(e[:4], "little")
        cells.append(expand_sorted(e[4 : 4 + n]))
        counts.append(expand(e[4 + n :], np.uint16))
    every = np.concatenate(cells)
    order = np.argsort(every, kind="stable")
    s = every[order]
    cut = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    totals = np.empty(len(every), np.int64)
    totals[order] = np.repeat(np.add.reduceat(np.concatenate(counts)[order].astype(np.int64), cut), np.diff(np.r_[cut, len(s)]))
    flags = np.stack([totals >= 2, totals >= hot])
    return [np.packbits(x, axis=1).tobytes() for x in np.split(flags, np.cumsum([len(x) for x in cells])[:-1], axis=1)]


class Sketch:
    """A merged sketch of all chunks. ``hashes`` lists those of one chunk, one for each ``spacing`` bytes or fewer;
    ``told`` is what each chunk learns, for ``gather`` and ``finish``, and ``estimates`` reads it."""

    def __init__(self, chunks: Chunks, hashes: Callable[[pa.RecordBatch], np.ndarray], hot: int, spacing: int, depth: int = DEPTH) -> None:
        self.depth = depth
        self.bits = bits = max(16, (CELLS * chunks.size // spacing).bit_length())
        self.shards = shards = max(1, -(-chunks.size // min(SHARD, spacing * HASHES)))

        def ask(batch: pa.RecordBatch, _: dict[int, bytes]) -> Iterator[tuple[int, bytes]]:
            return Cells(hashes(batch), bits, shards, depth).ask()

        self.told: DataFrame = materialize(gather(chunks, depth * shards, TEAM, ask, lambda e: merge(e, hot)))

    def reader(self) -> Callable[[np.ndarray, dict[int, bytes]], Estimates]:
        """Estimates of a chunk's hashes, all of them given, from what it was told."""
        bits, shards, depth = self.bits, self.shards, self.depth
        return lambda hashes, told: Cells(hashes, bits, shards, depth).told(told)
