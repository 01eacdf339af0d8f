"""SimHash near-duplicate detection with covering locality-sensitive hashing.

A document's fingerprint is the bitwise majority of the XXH64 hashes of its word shingles. Two fingerprints link when at
most ``RADIUS`` bits differ. Covering family: every bit position gets a non-zero vector of RADIUS + 1 bits; table v (each
non-zero vector) keeps the positions whose vector has an odd product with v. RADIUS differing positions span less than
the whole space, so some v is orthogonal to all of them and its table keeps none: every linked pair collides there.

Only distinct fingerprints are hashed. A bucket of more than ``bucket_rows`` fingerprints is split by a second covering
family on the positions that its table dropped, which again separates no linked pair; after that a bucket agrees on all
but about a quarter of the positions, so its size is bounded (2**16 or so) whatever the input. Inside a bucket a breadth-first sweep finds the
connected groups and emits one link for each fingerprint to its group's least one, never the pairs. Components over
all buckets come from iterated minima, as joins and aggregates.

Null, empty and wordless texts have fingerprint zero and link like any other. Null doc_ids keep their row and component
but never name one, unless all of a component's ids are null. Repeated rows stay. Other columns are not read.

The pipeline's stage links texts whose sets of shingles have a Jaccard similarity of SIMILARITY or more. Candidates are
pairs of distinct sets with fingerprints at most CANDIDATE_RADIUS bits apart: of that many bits one of three parts of the
fingerprint has at most PART_RADIUS, so a covering family on each part separates no such pair. A bucket's rows come
sorted by size of set and meet only those whose size allows the similarity. Each candidate is then decided by its sets:
first by counts of the hashes in 256 classes, which bound the difference from below, and what is left by the sets.
A first round takes one candidate of each row of a bucket (FIRST) and names the sets with others left out. A second round
looks again at every pair among these, and takes for each row one of those that the counts in classes allow, which are as a
rule similar: it joins what belongs together. A third takes every such pair that is not joined yet. So no large group of
near copies gives the square of its size in pairs, and no pair is missed.
Documents are at most shuffled to fetch the sets of candidates, and not even that where those are few.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm import textblocks as tb
from quernel.llm.components import components
from quernel.llm.shared import fresh, materialize, table

RADIUS = 4
CANDIDATE_RADIUS = 14
PART_RADIUS = 4
PARTS = ((0, 21), (21, 21), (42, 22))  # first bit and bits
SIMILARITY = (4, 5)
FIRST = 1  # candidates of a row of a bucket in the first round
FEW = 200_000  # row keys, of under 100 bytes, that are broadcast at most
ONES = np.array([bin(x).count("1") for x in range(1 << 16)], np.uint8)


def fingerprint(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Majority of each group's 64-bit hashes; ``first``: where groups start, and the end. Empty groups: zero."""
    out = np.zeros(len(first) - 1, np.uint64)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        sums = np.add.reduceat(bits, first[:-1][full], axis=0, dtype=np.int32)
        major = sums * 2 > np.diff(first)[full][:, None]
        out[full] = np.packbits(major, axis=1).view(">u8")[:, 0]
    return out


def shingle_hashes(text: bytes, size: int) -> list[int]:
    """XXH64 (seed 42) of each run of ``size`` words joined by spaces; of all words, if fewer."""
    parts = text.lower().split()
    if not parts:
        return []
    h = xxhash.xxh64_intdigest
    if len(parts) <= size:
        return [h(b" ".join(parts), 42)]
    joined, ends, at = b" ".join(parts), [], 0
    for p in parts:
        at += len(p) + 1
        ends.append(at)
    starts = [0, *ends[: len(ends) - size]]
    return [h(joined[a : b - 1], 42) for a, b in zip(starts, ends[size - 1 :], strict=True)]


def fingerprints(docs: DataFrame, text: str = "text", keep: str = "doc_id", size: int = 4) -> DataFrame:
    """The column ``keep`` and fp, the fingerprint as a long, of every row."""
    kind = docs.schema[keep].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in tb.blocks(batches, text="text", most=1 << 20):
            raw = data.tobytes()
            each = [shingle_hashes(raw[a:b], size) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            first = np.zeros(len(each) + 1, np.int64)
            np.cumsum([len(x) for x in each], out=first[1:])
            fp = fingerprint(np.array([x for e in each for x in e], np.uint64), first)
            yield pa.record_batch([tb.column(batch, keep), pa.array(fp.view(np.int64))], [keep, "fp"])

    return docs.select(keep, F.col(text).alias("text")).mapInArrow(run, f"`{keep}` {kind}, fp long")


@cache
def covering_masks(positions: int, radius: int, seed: int = 0) -> np.ndarray:
    """2**(radius+1) - 1 masks over ``positions`` bits: any ``radius`` bits are absent from one of them.

    All vectors share one bit, and the rest runs evenly through all values: a first-order Reed-Muller code, whose masks
    keep half of the positions or all. Where positions do not suffice for that, the best of several draws is taken, by
    the fewest positions that a mask keeps: a mask of few positions would put most fingerprints in one bucket."""
    values, rng = 1 << radius, np.random.default_rng(seed)
    v = np.arange(1, 2 * values, dtype=np.uint64)[:, None]
    best, most = np.zeros((2 * values - 1, positions), bool), -1
    for _ in range(200 if positions % values else 1):
        drawn = np.concatenate([rng.permutation(values) for _ in range(-(-positions // values) or 1)])[:positions]
        kept = np.bitwise_count(v & (values + drawn).astype(np.uint64)) % 2 == 1
        if (least := kept.sum(1).min()) > most:
            best, most = kept, least
    return np.array([sum(1 << i for i in np.flatnonzero(row).tolist()) for row in best], np.uint64)


def spread_masks(mask: int, radius: int) -> list[int]:
    """Covering masks over the positions that ``mask`` lacks, joined to it."""
    free = [i for i in range(64) if not mask >> i & 1]
    return [mask | sum(1 << free[j] for j in range(len(free)) if int(m) >> j & 1) for m in covering_masks(len(free), radius, 1)]


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def groups(fps: np.ndarray, radius: int) -> np.ndarray:
    """For each distinct fingerprint of a bucket the index of the first of its connected group."""
    root = np.full(len(fps), -1)
    rest = np.arange(len(fps))
    while len(rest):
        top, rest = int(rest[0]), rest[1:]
        root[top] = top
        queue = [top]
        while queue and len(rest):
            near = popcount(fps[rest] ^ fps[queue.pop()]) <= radius
            if near.any():
                found = rest[near]
                root[found] = top
                queue.extend(found.tolist())
                rest = rest[~near]
    return root


def tables(fps: DataFrame, radius: int) -> DataFrame:
    """Rows (table, key, fp), one for each covering mask."""
    masks = [F.struct(F.lit(i).alias("t"), F.lit(int(np.int64(np.uint64(m)))).alias("m")) for i, m in enumerate(covering_masks(64, radius).tolist())]
    return fps.select("fp", F.explode(F.array(*masks)).alias("x")).select(F.col("x.t").alias("t"), F.col("fp").bitwiseAND(F.col("x.m")).alias("key"), "fp")


def bucket_links(rows: DataFrame, radius: int, most: int | None) -> DataFrame:
    """Rows (t, a, b): with t = -1 links a, b that connect each bucket (t, key) of distinct fingerprints as far as its
    pairs do; otherwise a fingerprint a of a bucket of table t that holds more than ``most``."""
    size = most or 1 << 62

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a partition's rows come sorted by bucket; what is held is the last bucket, until it is whole or too large
        held = (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))
        large: tuple[int, int] | None = None
        for batch in batches:
            t, key, fp = (np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns, strict=True))
            if large is not None:
                same = (t == large[0]) & (key == large[1])
                n = len(t) if same.all() else int(np.argmin(same))
                yield _rows(t[:n], fp[:n], np.zeros(n, np.int64))
                t, key, fp = t[n:], key[n:], fp[n:]
            cut = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
            whole = int(cut[-1]) if len(cut) else 0
            if whole:
                yield from _links(t[:whole], key[:whole], fp[:whole].view(np.uint64), radius, size)
            if len(t):
                large = None
            t, key, fp = t[whole:], key[whole:], fp[whole:]
            if len(t) > size:
                yield _rows(t, fp, np.zeros(len(t), np.int64))
                large = (int(t[0]), int(key[0]))
                t, key, fp = t[:0], key[:0], fp[:0]
            held = (t, key, fp)
        if len(held[0]):
            yield from _links(held[0], held[1], held[2].view(np.uint64), radius, size)

    return rows.repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(run, "t int, a long, b long")


def _rows(t: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(t, pa.int32()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["t", "a", "b"])


def _links(t: np.ndarray, key: np.ndarray, fp: np.ndarray, radius: int, most: int) -> Iterator[pa.RecordBatch]:
    """Links within whole buckets, and the rows of those with more than ``most``."""
    begin = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (key[1:] != key[:-1])])
    size = np.diff(np.r_[begin, len(fp)])
    large = np.repeat(size > most, size)
    if large.any():
        yield _rows(t[large], fp[large], np.zeros(int(large.sum()), np.int64))
    two = begin[(size == 2) & (size <= most)]
    near = popcount(fp[two] ^ fp[two + 1]) <= radius
    a, b = [fp[two][near]], [fp[two + 1][near]]
    several = (size > 2) & (size <= most)
    for s, n in zip(begin[several].tolist(), size[several].tolist(), strict=True):
        own = np.sort(fp[s : s + n])
        root = groups(own, radius)
        linked = np.flatnonzero(root != np.arange(n))
        a.append(own[root[linked]])
        b.append(own[linked])
    a, b = np.concatenate(a), np.concatenate(b)
    yield _rows(np.full(len(a), -1, np.int32), a, b)


def links(fps: DataFrame, radius: int = RADIUS, bucket_rows: int = 20_000) -> DataFrame:
    """Distinct links (a, b) between distinct fingerprints (column fp): the same components as all linked pairs have."""
    first = materialize(bucket_links(tables(fps, radius), radius, bucket_rows))
    masks = covering_masks(64, radius).tolist()
    second = F.create_map(*[x for i, m in enumerate(masks) for x in (F.lit(i), F.array(*[F.lit(int(np.int64(np.uint64(y)))) for y in spread_masks(m, radius)]))])
    split = first.where("t >= 0").select(F.col("t").alias("t0"), F.col("a").alias("fp"), F.posexplode(F.element_at(second, F.col("t"))).alias("j", "m"))
    split = split.select((F.col("t0") * 4096 + F.col("j")).alias("t"), F.col("fp").bitwiseAND(F.col("m")).alias("key"), "fp")
    again = bucket_links(split, radius, None).where("t = -1")
    return first.where("t = -1").select("a", "b").unionAll(again.select("a", "b")).distinct()


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", size: int = 4, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable) of every row."""
    marked = materialize(fingerprints(docs, text, id_col, size))
    fps = materialize(marked.groupBy("fp").agg(F.min(id_col).alias("least")))
    labels = components(materialize(links(fps.select("fp"), radius)))
    # fingerprints without links are components of their own
    named = fps.join(labels.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = materialize(named)
    lowest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.join(lowest, "root").select("fp", "component_id")
    return marked.join(of, "fp").select(F.col(id_col).alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def part_masks() -> list[int]:
    """Masks of the covering families on the three parts."""
    return [int(m) << first for first, n in PARTS for m in covering_masks(n, PART_RADIUS).tolist()]


def near_pairs(t: np.ndarray, n: np.ndarray, fp: np.ndarray, start: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indexes x < y, ``start`` <= y, of rows of one bucket within CANDIDATE_RADIUS whose sizes allow the similarity, for the
    first table in which a pair meets. Rows are sorted by bucket and size."""
    masks = np.array(part_masks(), np.uint64)
    key = fp & masks[t]
    cut = np.r_[np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (key[1:] != key[:-1])]), len(t)].tolist() if len(t) else [0]
    low, high = SIMILARITY
    for s, e in zip(cut[:-1], cut[1:], strict=True):
        if e - s < 2 or e <= start:
            continue
        reach = s + np.searchsorted(n[s:e] * low, n[s:e] * high, "right")
        for i in range(s, e, 64):
            k = min(i + 64, e)
            for c in range(max(i + 1, start), int(reach[k - 1 - s]), 4096):
                x, y = np.nonzero(popcount(fp[i:k, None] ^ fp[c : min(c + 4096, int(reach[k - 1 - s]))]) <= CANDIDATE_RADIUS)
                x, y = x + i, y + c
                fits = (y > x) & (y < reach[x - s])
                x, y = x[fits], y[fits]
                for j in range(0, len(x), 8192):
                    a, b = x[j : j + 8192], y[j : j + 8192]
                    met = np.argmax((fp[a] ^ fp[b])[:, None] & masks == 0, axis=1) == t[s]
                    yield a[met], b[met]


def candidates(prints: DataFrame, most: int | None = None) -> DataFrame:
    """Rows (a, b, left): pairs of sets s whose fingerprints fp and sizes n allow the similarity, and, if ``prints`` has these
    columns, whose groups r differ and whose counts in ``classes`` allow it. With ``most``, of each row of a bucket at most so
    many; ``left`` is 1 where a has pairs left out, 2 where b has, 3 for both, and a = b where a set has only such."""
    low, high = SIMILARITY
    more = [c for c in ("r", "classes") if c in prints.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by bucket and size; what is held is the part of the last bucket that later rows can match
        masks = np.array(part_masks(), np.uint64)
        held = (np.zeros(0, np.int32), *(np.zeros(0, np.int64) for _ in range(4 if more else 3)), *([np.zeros((0, 256), np.uint8)] if more else []))
        for batch in batches:
            start, columns = len(held[0]), [c.to_numpy(zero_copy_only=False) for c in batch.columns[: 5 if more else 4]]
            if more:
                columns.append(np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint8).reshape(-1, 256))
            held = tuple(np.concatenate([h, c]) for h, c in zip(held, columns, strict=True))
            t, n, fp, s = held[0], held[1], held[2].view(np.uint64), held[3]
            pairs = near_pairs(t, n, fp, start)
            if more:
                pairs = _differing(pairs, n, held[4], held[5])
            yield from _pairs(pairs, s) if most is None else [_limited(pairs, s, most)]
            if len(t):
                last = (t == t[-1]) & (fp & masks[t] == fp[-1] & masks[t[-1]]) & (n * high >= n[-1] * low)
                held = tuple(x[last] for x in held)

    masks = part_masks()
    # sets of fewer shingles than this are similar to themselves alone
    rows = prints.where(F.col("n") * (high - low) >= low).select(F.explode(F.array(*map(F.lit, range(len(masks))))).alias("t"), "n", "fp", "s", *more)
    key = F.col("fp").bitwiseAND(F.element_at(F.array(*[F.lit(int(np.int64(np.uint64(m)))) for m in masks]), F.col("t") + 1))
    return rows.repartition(F.col("t"), key).sortWithinPartitions(F.col("t"), key, F.col("n")).mapInArrow(run, "a long, b long, left int")


def _pairs(pairs: Iterator[tuple[np.ndarray, np.ndarray]], s: np.ndarray) -> Iterator[pa.RecordBatch]:
    for x, y in pairs:
        yield pa.record_batch([pa.array(s[x]), pa.array(s[y]), pa.array(np.zeros(len(x), np.int32))], ["a", "b", "left"])


def _limited(pairs: Iterator[tuple[np.ndarray, np.ndarray]], s: np.ndarray, most: int) -> pa.RecordBatch:
    """The first ``most`` pairs of each row, and which rows have more."""
    given, left, a, b = np.zeros(len(s), np.int64), np.zeros(len(s), bool), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for x, y in pairs:
        order = np.argsort(y, kind="stable")
        x, y = x[order], y[order]
        keep = given[y] + np.arange(len(y)) - np.searchsorted(y, y) < most
        np.add.at(given, y, 1)
        left[x[~keep]] = left[y[~keep]] = True
        a.append(x[keep])
        b.append(y[keep])
    a, b, alone = np.concatenate(a), np.concatenate(b), left.copy()
    alone[a] = alone[b] = False
    alone = np.flatnonzero(alone)
    a, b = np.r_[a, alone], np.r_[b, alone]
    return pa.record_batch([pa.array(s[a]), pa.array(s[b]), pa.array((left[a] + 2 * left[b]).astype(np.int32))], ["a", "b", "left"])


def _differing(pairs: Iterator[tuple[np.ndarray, np.ndarray]], n: np.ndarray, r: np.ndarray, classes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of different groups that can be similar by their counts in classes."""
    low, high = SIMILARITY
    for x, y in pairs:
        other = r[x] != r[y]
        x, y = x[other], y[other]
        differ = np.abs(classes[x].astype(np.int16) - classes[y]).sum(1)
        both = n[x] + n[y]
        fits = (both - differ) * (low + high) >= 2 * low * both
        yield x[fits], y[fits]


def shingle_sets(docs: DataFrame, keep: str, whole: bool) -> DataFrame:
    """The column ``keep`` with s, the hash of the text's set of five-word shingles; and the set itself as bytes, or the
    fingerprint fp, the set's size n and its counts in 256 classes (capped, which lowers no bound) as bytes."""
    kind = docs.schema[keep].dataType.simpleString()
    more = "shingles binary" if whole else "fp long, n long, classes binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in tb.blocks(batches, text="text", most=1 << 20):
            raw = data.tobytes()
            each = [np.array(shingle_hashes(raw[a:b], 5), np.uint64) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            sets = [np.unique(x) for x in each]
            out = [tb.column(batch, keep), pa.array([xxhash.xxh64_intdigest(x.tobytes(), 7) for x in sets], pa.uint64()).view(pa.int64())]
            if whole:
                out.append(pa.array([x.tobytes() for x in sets], pa.binary()))
            else:
                first = np.zeros(len(each) + 1, np.int64)
                np.cumsum([len(x) for x in each], out=first[1:])
                classes = [np.minimum(np.bincount((x & np.uint64(255)).astype(np.int64), minlength=256), 255).astype(np.uint8).tobytes() for x in sets]
                out += [pa.array(fingerprint(np.concatenate(each), first).view(np.int64)), pa.array([len(x) for x in sets], pa.int64()), pa.array(classes, pa.binary())]
            yield pa.record_batch(out, [keep, "s", *(x.split()[0] for x in more.split(", "))])

    return docs.select(keep, "text").mapInArrow(run, f"`{keep}` {kind}, s long, {more}")


def possible(n: int, m: int, x: bytes, y: bytes) -> bool:
    """Whether sets of n and m elements can be similar by their counts in classes."""
    differ = int(np.abs(np.frombuffer(x, np.uint8).astype(np.int64) - np.frombuffer(y, np.uint8)).sum())
    return enough(n + m, (n + m - differ) / 2)


def enough(both: int, common: float) -> bool:
    """Whether ``common`` elements suffice for sets of ``both`` elements together."""
    low, high = SIMILARITY
    return common * (low + high) >= low * both


def similar(x: bytes, y: bytes) -> bool:
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    return enough(len(x) + len(y), len(np.intersect1d(x, y, assume_unique=True)))


def _where(pairs: DataFrame, holds) -> DataFrame:
    """The pairs (a, b) for which ``holds`` is true of the other columns' values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [holds(*(v.as_py() for v in row)) for row in zip(*batch.columns[2:], strict=True)]
            yield pa.record_batch(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long")


def similar_links(docs: DataFrame, key: str, nodes: DataFrame, prints: DataFrame) -> DataFrame:
    """Links (a, b) that connect what all pairs of sets at SIMILARITY or more within CANDIDATE_RADIUS do. ``nodes``: each
    distinct set s with n, classes and least, the ``key`` of a row of ``docs`` that has it; ``prints``: s, fp and n, several
    fp of a set whose texts repeat shingles differently."""
    met = materialize(candidates(prints, FIRST))
    # a pair of two sets with pairs left out comes again in the second round
    links = materialize(_verified(docs, key, nodes, _possible(nodes, met.where("a != b and left != 3"))))
    for most in (FIRST, None):
        open_ = met.where("left % 2 = 1").select(F.col("a").alias("s")).unionAll(met.where("left >= 2").select(F.col("b").alias("s"))).distinct()
        joined = components(links).select(F.col("node").alias("s"), "root")
        rest = prints.join(open_, "s", "left_semi").join(joined, "s", "left").join(nodes.select("s", "classes"), "s")
        met = materialize(candidates(rest.select("s", "fp", "n", F.coalesce("root", "s").alias("r"), "classes"), most))
        links = materialize(links.unionAll(_verified(docs, key, nodes, met.where("a != b"))))
    return links


def _possible(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs that can be similar by their counts in classes."""
    own = [nodes.select(F.col("s").alias(x), F.col("n").alias(f"n{x}"), F.col("classes").alias(f"c{x}")) for x in "ab"]
    return _where(pairs.select("a", "b").join(own[0], "a").join(own[1], "b").select("a", "b", "na", "nb", "ca", "cb"), possible)


def _verified(docs: DataFrame, key: str, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs at SIMILARITY or more."""
    met = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    needed = met.select(F.col("a").alias("s")).unionAll(met.select(F.col("b").alias("s"))).distinct()
    chosen = materialize(nodes.join(needed, "s", "left_semi").select(F.col("least").alias(key)))
    if chosen.limit(FEW + 1).count() <= FEW:  # documents need no shuffle then
        chosen = F.broadcast(chosen)
    rows = docs.join(chosen, key, "left_semi")
    sets = materialize(shingle_sets(rows, key, True).select("s", "shingles").dropDuplicates(["s"]))
    own = [sets.select(F.col("s").alias(x), F.col("shingles").alias(f"w{x}")) for x in "ab"]
    return _where(met.join(own[0], "a").join(own[1], "b").select("a", "b", "wa", "wb"), similar)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: the one of least doc_id, and of equal ids the one of least text hash."""
    key = fresh("__nd_row", docs.columns)
    keyed = docs.withColumn(key, F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.xxhash64("text").alias("h")))
    marked = materialize(shingle_sets(keyed, key, False))
    nodes = materialize(marked.groupBy("s").agg(F.min(key).alias("least"), F.first("n").alias("n"), F.first("classes").alias("classes")))
    labels = components(materialize(similar_links(keyed, key, nodes, marked.select("s", "fp", "n").distinct())))
    named = nodes.join(labels.select(F.col("node").alias("s"), "root"), "s", "left").select(F.coalesce("root", "s").alias("root"), "least")
    kept = named.groupBy("root").agg(F.min("least").alias(key)).select(key)
    chosen = keyed.join(kept, key, "left_semi")
    # rows equal in id and text are copies of each other; one stays
    return chosen.dropDuplicates([key]).select(*docs.columns)
