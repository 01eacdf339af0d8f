"""Language-model scores of documents by stupid backoff over the corpus's own n-gram counts.

Count tables of all orders up to ``order`` are partitioned by hash of the n-gram: each chunk of documents sends its
distinct n-grams with their counts to the shards, a shard adds up what all chunks sent, and the counts come back joined
to the chunk's n-grams in the order sent. n-grams of order two and more that occur fewer than ``min_count`` times in the
corpus are pruned, as in large count tables. A word's score is the count of the longest kept n-gram that ends with it
over the count of that n-gram without its last word, times ``alpha`` for each order backed off from the longest that
fits in the document; a single word's is its share of all words. A document's score is the sum of natural logarithms,
each rounded to millionths so that sums do not depend on their order.

n-grams are known by 64 bits of hash, whatever the corpus's size; frequent ones cost each chunk one entry. A sketch, which
never counts too low, first tells which n-grams occur once: their count is known, and they never leave their chunk. Null and
wordless texts have no words, score 0 and no mean. A text longer than a chunk is scored whole in one task. Repeated rows count as often as they occur. An empty table gives no rows. Other columns are kept
unless they have the names added.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from quernel.llm import textblocks as tb
from quernel.llm.chunks import CHUNK, Rows, expand, expand_sorted, finish, gather, pack, shard_cuts, squeeze, squeeze_sorted, sub_blocks
from quernel.llm.shared import table
from quernel.llm.sketch import Sketch

BLOCK = 1 << 20
SHARD = 4 << 20  # bytes of text for which a shard gets the n-grams, about
TEAM = 4  # shards that travel together
SPACING = 2  # bytes of text for each n-gram, about
ALL = np.uint64(0)  # stands for the empty n-gram, whose count is the number of words


def ngrams(batch: pa.RecordBatch, text: str, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Per order the hash of the n-gram that ends at each word (ALL where it would cross a text's start), and the number
    of words of each text."""
    out: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)] for _ in range(order)]
    counts = [np.zeros(0, np.int64)]
    for _, data, off in sub_blocks(batch, text, BLOCK):
        starts, ends, first = tb.words(data, off)
        h = tb.word_hashes(data, starts, ends, 1)
        counts.append(np.diff(first))
        since = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
        for n in range(1, order + 1):
            g = np.full(len(h), ALL)
            w = tb.Rolling(h, 10 + n).windows(n)
            g[n - 1 :] = np.maximum(w, np.uint64(1))
            g[since < n - 1] = ALL
            out[n - 1].append(g)
    return [np.concatenate(x) for x in out], np.concatenate(counts)


def _distinct(grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of all orders, their counts (ALL: the number of words), and where each n-gram is among them."""
    every = np.concatenate(grams)
    order = np.argsort(every)
    s = every[order]
    new = np.r_[True, s[1:] != s[:-1]] if len(s) else np.zeros(0, bool)
    of = np.empty(len(every), np.int32)
    of[order] = np.cumsum(new) - 1
    hashes = s[new]
    counts = np.diff(np.r_[np.flatnonzero(new), len(s)]).astype(np.uint32)
    if not len(hashes) or hashes[0] != ALL:
        hashes, counts, of = np.r_[ALL, hashes], np.r_[np.uint32(0), counts].astype(np.uint32), of + 1
    counts[0] = len(grams[0])
    return hashes, counts, of


def _combine(entries: list[bytes]) -> list[bytes]:
    hashes, counts = [], []
    for e in entries:
        n = int.from_bytes(e[:4], "little")
        hashes.append(expand_sorted(e[4 : 4 + n]))
        counts.append(expand(e[4 + n :], np.uint32))
    every = np.concatenate(hashes)
    order = np.argsort(every)
    s = every[order]
    cut = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    totals = np.add.reduceat(np.concatenate(counts)[order].astype(np.uint64), cut)
    back = np.empty(len(every), np.uint64)
    back[order] = np.repeat(totals, np.diff(np.r_[cut, len(s)]))
    return [squeeze(x) for x in np.split(back, np.cumsum([len(x) for x in hashes])[:-1])]


def word_scores(counts: list[np.ndarray], total: int, lengths: np.ndarray, alpha: float, min_count: int) -> np.ndarray:
    """Millionths of the natural logarithm of each word's score. ``counts``: per order, of the n-gram that ends at each
    word (0 where there is none)."""
    order = len(counts)
    since = np.arange(len(counts[0])) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    top = np.minimum(since + 1, order)
    used = np.ones(len(top), np.int64)
    share = counts[0] / max(total, 1)
    for n in range(2, order + 1):
        kept = (top >= n) & (counts[n - 1] >= min_count)
        used[kept] = n
        prefix = np.r_[1, counts[n - 2][:-1]] if len(top) else counts[n - 2]
        share = np.where(kept, counts[n - 1] / np.maximum(prefix, 1), share)
    powers = np.array([alpha**k for k in range(order)])
    return np.rint(1e6 * np.log(powers[top - used] * share)).astype(np.int64)


def lm_scores(docs: DataFrame, text: str = "text", order: int = 3, alpha: float = 0.4, min_count: int = 2, prefix: str = "", chunk_bytes: int = 2 * CHUNK) -> DataFrame:
    """All columns with n_words, score (millionths of nats) and mean, named with ``prefix``."""
    added = [f"{prefix}{x}" for x in ("n_words", "score", "mean")]
    docs = docs.drop(*added)
    names, column = docs.columns, f"c{docs.columns.index(text)}"
    chunks = pack(docs, text, chunk_bytes)
    shards = max(1, -(-chunks.size // SHARD))

    def occurrences(batch: pa.RecordBatch) -> np.ndarray:
        every = np.concatenate(ngrams(batch, column, order)[0])
        return every[every != ALL]

    sketch = Sketch(chunks, occurrences, 1 << 16, SPACING, 1)
    estimates = sketch.reader()

    def several(hashes: np.ndarray, told: dict[int, bytes]) -> np.ndarray:
        """Of a chunk's distinct n-grams those that may occur twice in the corpus, and ALL."""
        return np.r_[True, estimates(hashes[1:], told).twice(hashes[1:])]

    def ask(batch: pa.RecordBatch, told: dict[int, bytes]) -> Rows:
        hashes, counts, _ = _distinct(ngrams(batch, column, order)[0])
        keep = several(hashes, told)
        hashes, counts = hashes[keep], counts[keep]
        cut = shard_cuts(hashes, shards)
        for s in np.flatnonzero(np.diff(cut)).tolist():
            one = squeeze_sorted(hashes[cut[s] : cut[s + 1]])
            yield s, len(one).to_bytes(4, "little") + one + squeeze(counts[cut[s] : cut[s + 1]])

    out_names = [*(f"c{i}" for i in range(len(names))), "x0", "x1", "x2"]

    def answer(batch: pa.RecordBatch, answers: dict[int, bytes], told: dict[int, bytes]) -> pa.Table:
        grams, lengths = ngrams(batch, column, order)
        hashes, _, of = _distinct(grams)
        total = np.ones(len(hashes), np.int64)
        total[several(hashes, told)] = np.concatenate([expand(answers[s], np.uint64) for s in sorted(answers)]).astype(np.int64)
        counts = [np.where(g == ALL, 0, c) for g, c in zip(grams, np.split(total[of], order), strict=True)]
        micro = word_scores(counts, int(total[0]), lengths, alpha, min_count)
        sums = np.r_[0, np.cumsum(micro)]
        end = np.cumsum(lengths)
        score = sums[end] - sums[end - lengths]
        mean = pa.array(score / np.maximum(lengths, 1), mask=lengths == 0)
        return pa.table([*batch.columns, pa.array(lengths), pa.array(score), mean], out_names)

    fields = [*docs.schema, StructField(added[0], LongType()), StructField(added[1], LongType()), StructField(added[2], DoubleType())]
    kinds = StructType([StructField(n, f.dataType) for n, f in zip(out_names, fields, strict=True)])
    answers = gather(chunks, shards, TEAM, ask, _combine, sketch.told)
    return finish(chunks, answers, answer, kinds, sketch.told).toDF(*names, *added)


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), prefix="lm_").select("doc_id", "lm_n_words", "lm_score", "lm_mean")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, w FROM d),
g AS (SELECT doc_id, i, w[i] AS a, CASE WHEN i > 1 THEN w[i - 1] || ' ' || w[i] END AS b,
  CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] || ' ' || w[i] END AS c,
  CASE WHEN i > 1 THEN w[i - 1] END AS pa, CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] END AS pb FROM p),
n AS (SELECT count(*) AS n FROM g),
c1 AS (SELECT a AS k, count(*) AS n FROM g GROUP BY a),
c2 AS (SELECT b AS k, count(*) AS n FROM g WHERE b IS NOT NULL GROUP BY b),
c3 AS (SELECT c AS k, count(*) AS n FROM g WHERE c IS NOT NULL GROUP BY c),
s AS (SELECT g.doc_id, round(1e6 * ln(CASE
    WHEN c3.n >= 2 THEN c3.n / x2.n
    WHEN c2.n >= 2 THEN (CASE WHEN i > 2 THEN 0.4::DOUBLE ELSE 1 END) * (c2.n / x1.n)
    ELSE (CASE WHEN i > 2 THEN 0.4::DOUBLE * 0.4::DOUBLE WHEN i > 1 THEN 0.4::DOUBLE ELSE 1 END) * (c1.n / n.n) END))::BIGINT AS s
  FROM g CROSS JOIN n JOIN c1 ON c1.k = g.a LEFT JOIN c2 ON c2.k = g.b LEFT JOIN c3 ON c3.k = g.c
  LEFT JOIN c1 x1 ON x1.k = g.pa LEFT JOIN c2 x2 ON x2.k = g.pb),
t AS (SELECT doc_id, sum(s)::BIGINT AS s FROM s GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS lm_n_words, coalesce(t.s, 0)::BIGINT AS lm_score, CASE WHEN len(w) > 0 THEN t.s::DOUBLE / len(w) END AS lm_mean
FROM d LEFT JOIN t ON t.doc_id = d.doc_id
"""
