"""Exact grouping of windows by 96-bit hashes through the chunk exchange."""

from __future__ import annotations

import numpy as np

from quernel.llm.chunks import Rows, expand, expand_sorted, shard_cuts, squeeze, squeeze_sorted


class Local:
    """A chunk's windows: distinct hashes in order, how each window maps to them, and which occur twice in the chunk."""

    def __init__(self, first: np.ndarray, second: np.ndarray) -> None:
        order = np.argsort(first, kind="stable")
        a, b = first[order], second[order]
        new = np.r_[True, (a[1:] != a[:-1])] if len(a) else np.zeros(0, bool)
        clash = ~new
        clash[1:] &= b[1:] != b[:-1]
        if clash.any():  # equal first halves, other second halves: order by both
            order = np.lexsort((second, first))
            a, b = first[order], second[order]
            new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        self.first, self.second = a[new], b[new]
        rank = np.cumsum(new) - 1
        self.of = np.empty(len(first), np.int64)
        self.of[order] = rank
        self.twice = np.bincount(rank, minlength=len(self.first)) > 1

    def ask(self, shards: int) -> Rows:
        cut = shard_cuts(self.first, shards)
        for s in np.flatnonzero(np.diff(cut)).tolist():
            i = slice(cut[s], cut[s + 1])
            one, two, three = squeeze_sorted(self.first[i]), squeeze(self.second[i]), np.packbits(self.twice[i]).tobytes()
            yield s, len(one).to_bytes(4, "little") + len(two).to_bytes(4, "little") + one + two + three

    def answered(self, shards: int, answers: dict[int, bytes]) -> np.ndarray:
        """For every window of the chunk: it occurs elsewhere."""
        cut = shard_cuts(self.first, shards)
        got = [np.unpackbits(np.frombuffer(answers[s], np.uint8), count=int(cut[s + 1] - cut[s])).astype(bool) for s in np.flatnonzero(np.diff(cut)).tolist()]
        return (np.concatenate(got) if got else np.zeros(0, bool))[self.of]


def combine(entries: list[bytes]) -> list[bytes]:
    """One shard: which of each chunk's distinct windows occur at least twice in all chunks."""
    first, second, twice = [], [], []
    for e in entries:
        n, m = int.from_bytes(e[:4], "little"), int.from_bytes(e[4:8], "little")
        first.append(expand_sorted(e[8 : 8 + n]))
        second.append(expand(e[8 + n : 8 + n + m], np.uint32))
        twice.append(np.unpackbits(np.frombuffer(e[8 + n + m :], np.uint8), count=len(first[-1])))
    all_ = Local(np.concatenate(first), np.concatenate(second))
    found = (np.bincount(all_.of, np.concatenate(twice), len(all_.first)) > 0) | all_.twice
    flags = found[all_.of]
    cut = np.cumsum([len(x) for x in first])[:-1]
    return [np.packbits(x).tobytes() for x in np.split(flags, cut)]
