"""Repeated passages and strings, language-model scores: brute force over small chunks and blocks."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quernel.llm import lm, sketch, substring, suffix
from quernel.llm import textblocks as tb
from quernel.llm import windows as wd

SPLIT = re.compile(rb"[^\x20\x09-\x0D]+")


def covered(symbols, size, counts):
    gone = [False] * len(symbols)
    for k in range(len(symbols) - size + 1):
        if counts[tuple(symbols[k : k + size])] > 1:
            gone[k : k + size] = [True] * size
    return gone


def tally(all_symbols, size):
    return Counter(tuple(s[k : k + size]) for s in all_symbols for k in range(len(s) - size + 1))


@pytest.mark.parametrize(("window", "gram"), [(35, 20), (6, 3)])
def test_passages(docs, corpus, window, gram):
    split = [SPLIT.findall((t or "").encode()) for _, t, *_ in corpus]
    counts, want = tally(split, window), Counter()
    for (i, *_), w in zip(corpus, split, strict=True):
        gone = covered(w, window, counts)
        want[i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g)] += 1
    out = substring.remove_repeats(docs, window=window, gram=gram, prefix="p_", chunk_bytes=3000)
    assert out.columns == [*docs.columns, "p_n_words", "p_n_removed", "p_kept"]
    got = Counter((r.doc_id, r.p_n_words, r.p_n_removed, bytes(r.p_kept)) for r in out.collect())
    assert got == want and sum(k[2] for k in want) > 0


@pytest.mark.parametrize("hot", [4096, 3])
def test_strings(docs, corpus, hot, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(suffix, "SHARD", 5000)
    raw = [(t or "").encode() for _, t, *_ in corpus]
    counts, want = tally(raw, 400), Counter()
    for (i, *_), b in zip(corpus, raw, strict=True):
        gone = covered(b, 400, counts)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        want[i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)] += 1
    out = suffix.remove_strings(docs, prefix="p_", chunk_bytes=4000).collect()
    assert Counter((r.doc_id, r.p_n_bytes, sum(b - a for a, b in r.p_spans), len(r.p_spans), bytes(r.p_kept)) for r in out) == want
    assert sum(k[2] for k in want) > 0


def test_refinement_finds_equal_windows():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 99, 600).astype(np.uint8)
    size, window = np.array([200, 150, 250]), 12
    got = suffix.refine(text, size, size - window + 1, window)
    parts = np.split(text, np.cumsum(size)[:-1])
    every = [p[k : k + window].tobytes() for p in parts for k in range(len(p) - window + 1)]
    counts = Counter(every)
    assert got.tolist() == [counts[w] > 1 for w in every]


def test_refinement_of_copies_with_single_edits():
    rng = np.random.default_rng(7)
    for _ in range(6):
        passages = [rng.integers(0, 250, 700).astype(np.uint8) for _ in range(4)]
        parts = []
        for k in range(160):
            one = passages[k % 4].copy()
            one[rng.integers(0, 700)] ^= rng.integers(1, 6).astype(np.uint8)
            parts.append(one)
        size, window = np.full(len(parts), 700), 400
        got = suffix.refine(np.concatenate(parts), size, size - window + 1, window)
        every = [p[k : k + window].tobytes() for p in parts for k in range(len(p) - window + 1)]
        counts = Counter(every)
        assert got.tolist() == [counts[w] > 1 for w in every]


def test_window_grouping_tells_equal_first_halves_apart():
    a, b = np.array([5, 5, 5, 9], np.uint64), np.array([1, 2, 1, 1], np.uint32)
    local = wd.Local(a, b)
    assert local.twice[local.of].tolist() == [True, False, True, False]
    other = wd.Local(np.array([9], np.uint64), np.array([1], np.uint32))
    answers = wd.combine([dict(local.ask(1))[0], dict(other.ask(1))[0]])
    assert local.answered(1, {0: answers[0]}).tolist() == [True, False, True, True]
    assert other.answered(1, {0: answers[1]}).tolist() == [True]


def test_anchor_depends_on_content_alone():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 63, 50).astype(np.uint64)
    twice = np.r_[rng.integers(0, 1 << 63, 13).astype(np.uint64), x, rng.integers(0, 1 << 63, 7).astype(np.uint64), x]
    first = np.array([0, len(twice)])
    grams = tb.Rolling(twice, 2).windows(4)
    pos, begin, count, _ = tb.anchors(grams, first, 10, 4)
    at = {s: p - s for p, b, n in zip(pos, begin, count, strict=True) for s in range(b, b + n)}
    assert all(at[13 + k] == at[70 + k] for k in range(41)) and len(at) == len(twice) - 9


def brute_scores(texts, order=3, alpha=0.4, least=2):
    split = [SPLIT.findall((t or "").encode()) for t in texts]
    counts = Counter(tuple(w[k : k + n]) for w in split for n in range(1, order + 1) for k in range(len(w) - n + 1))
    total, out = sum(map(len, split)), []
    for w in split:
        score = 0
        for i in range(len(w)):
            top = min(order, i + 1)
            n = top
            while n > 1 and counts[tuple(w[i - n + 1 : i + 1])] < least:
                n -= 1
            below = counts[tuple(w[i - n + 1 : i])] if n > 1 else total
            score += round(1e6 * math.log(alpha ** (top - n) * (counts[tuple(w[i - n + 1 : i + 1])] / below)))
        out.append((len(w), score))
    return out


def test_scores(docs, corpus):
    want = Counter((r[0], *s) for r, s in zip(corpus, brute_scores([r[1] for r in corpus]), strict=True))
    rows = lm.lm_scores(docs, prefix="p_", chunk_bytes=3000).collect()
    assert Counter((r.doc_id, r.p_n_words, r.p_score) for r in rows) == want
    assert all((r.p_mean is None) == (r.p_n_words == 0) for r in rows)


def test_words_whose_hashes_begin_alike_are_counted_apart(spark):
    words = [f"w{k}" for k in range(400_000)]
    h = lm.ngrams(pa.record_batch([pa.array([" ".join(words[k : k + 1000]) for k in range(0, len(words), 1000)])], ["t"]), "t", 1)[0][0]
    order = np.argsort(h)
    k = int(np.argmin(np.diff(h[order])))
    a, b = words[order[k]], words[order[k + 1]]
    assert h[order[k]] >> np.uint64(32) == h[order[k + 1]] >> np.uint64(32) and h[order[k]] != h[order[k + 1]]
    texts = [a, b, f"{a} x", f"{b} x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.score) for r in lm.lm_scores(df).collect()}
    assert got == dict(enumerate(brute_scores(texts)))


def test_empty_tables(empty):
    for f in (substring.remove_repeats, suffix.remove_strings, lm.lm_scores):
        assert f(empty).collect() == []


def test_digests_of_the_queries(spark):
    out = substring.op7_substring(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    none = out.where("n_words = n_removed").select("kept_sha256").distinct().collect()
    assert all(r[0] == hashlib.sha256(b"").hexdigest() for r in none)


@pytest.mark.parametrize("size", [1 << 16, 1 << 22])
def test_sketch_never_underestimates_and_keeps_its_accuracy(size):
    """Chunks' cells merged by shards: no repeated hash is missed, and few single ones pass, whatever the input's size."""
    rng = np.random.default_rng(size)
    hashes = size // 32
    single = rng.integers(0, 1 << 64, hashes, dtype=np.uint64)
    shared = rng.integers(0, 1 << 64, 50, dtype=np.uint64)
    bits, shards = max(16, (sketch.CELLS * size // 32).bit_length()), 5
    chunks = [sketch.Cells(np.r_[x, shared[: 10 + 10 * i]], bits, shards) for i, x in enumerate(np.array_split(single, 4))]
    asked = [dict(c.ask()) for c in chunks]
    answers = [{} for _ in chunks]
    for s in range(sketch.DEPTH * shards):
        who = [i for i, a in enumerate(asked) if s in a]
        for i, b in zip(who, sketch.merge([asked[i][s] for i in who], 4) if who else [], strict=True):
            answers[i][s] = b
    told = [c.told(a) for c, a in zip(chunks, answers, strict=True)]
    assert told[0].twice(shared[:10]).all() and told[0].hot(shared[:10]).all() and told[3].twice(shared[10:30]).all()
    passed = sum(int(t.twice(x).sum()) for t, x in zip(told, np.array_split(single, 4), strict=True))
    assert passed < 0.08 * hashes


def test_chunks_are_not_shuffled(docs):
    """Only what is asked and answered is exchanged; the bucketed chunks are read in place."""
    plan = substring.remove_repeats(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(chunk") == 2 and "Bucketed: true" in plan


def test_stage_keeps_untouched_texts_as_they_are(spark, docs):
    kept = {r.doc_id: r.text for r in substring.stage(spark, docs.select("doc_id", "text", F.length("text").alias("n_chars")), "").collect()}
    assert kept[62] == "MiXed CaSe Of Words Here" or "MiXed CaSe Of Words Here" in kept.values()
