"""Near-duplicates: fingerprints, the covering guarantee, links and components against brute force."""

import itertools
import re

import numpy as np
import xxhash

from quernel.llm import simhash
from quernel.llm.components import components


def fingerprint(text, size=4):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(items, linked):
    root = {x: x for x in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(items, 2):
        if linked(a, b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in items}


def test_covering_masks_miss_no_pair():
    rng = np.random.default_rng(0)
    for radius in (2, 4, 6):
        masks = [int(m) for m in simhash.covering_masks(64, radius)]
        assert len(masks) == 2 ** (radius + 1) - 1
        for _ in range(300):
            differing = sum(1 << int(b) for b in rng.choice(64, radius, replace=False))
            assert any(not m & differing for m in masks)
            first = next(m for m in masks if not m & differing)
            assert any(not m & differing for m in simhash.spread_masks(first, radius))


def test_no_mask_keeps_few_positions():
    for radius in (4, 6):
        masks = [int(m) for m in simhash.covering_masks(64, radius)]
        assert min(m.bit_count() for m in masks) == 32
        for m in masks:
            if m.bit_count() < 64:
                assert all(x.bit_count() - m.bit_count() >= 12 for x in simhash.spread_masks(m, radius))


def test_fingerprints_and_components(docs, corpus):
    want = [fingerprint(r[1]) for r in corpus]
    root = classes(sorted(set(want)), lambda a, b: bin(a ^ b).count("1") <= 4)
    least = {}
    for r, f in zip(corpus, want, strict=True):
        if r[0] is not None:
            least[root[f]] = min(least.get(root[f], 1 << 60), r[0])
    rows = simhash.near_duplicates(docs).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.fingerprint, r.component_id) for r in rows)
    assert got == sorted((-1 if r[0] is None else r[0], f"{f:016x}", least.get(root[f])) for r, f in zip(corpus, want, strict=True))


def test_links_connect_what_pairs_connect_when_buckets_split(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 6).astype(np.uint64)
    fps = set(base.tolist())
    for b in base.tolist():
        for _ in range(25):
            fps.add(b ^ sum(1 << int(k) for k in rng.choice(64, int(rng.integers(1, 6)), replace=False)))
    fps = sorted(fps)
    want = classes(fps, lambda a, b: bin(a ^ b).count("1") <= 4)
    df = spark.createDataFrame([(int(np.int64(np.uint64(f))),) for f in fps], "fp long")
    for most in (20_000, 3):
        labels = {np.uint64(np.int64(r.node)): r.root for r in components(simhash.links(df, 4, most)).collect()}
        got = {f: labels.get(np.uint64(f), int(np.int64(np.uint64(f)))) for f in fps}
        assert len(set(got.values())) == len(set(want.values()))
        assert len({(want[f], got[f]) for f in fps}) == len(set(want.values()))


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in range(41)} == {0} and {got[k] for k in range(100, 140)} == {100}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_empty(empty):
    assert simhash.near_duplicates(empty).collect() == []


def test_stage_keeps_one_of_each_group(spark, docs, corpus):
    kept = simhash.stage(spark, docs, "")
    assert kept.columns == docs.columns
    rows = kept.collect()
    sets = lambda t: tuple(sorted(shingle_set(t)))
    root = classes(sorted({sets(r[1]) for r in corpus}), lambda a, b: 5 * len(set(a) & set(b)) >= 4 * len(set(a) | set(b)))
    assert sorted(root[sets(r.text)] for r in rows) == sorted(set(root.values()))


def shingle_set(text, size=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def test_part_masks_miss_no_pair():
    rng = np.random.default_rng(4)
    masks = simhash.part_masks()
    for _ in range(300):
        differing = sum(1 << int(b) for b in rng.choice(64, simhash.CANDIDATE_RADIUS, replace=False))
        assert any(not m & differing for m in masks)


def test_near_pairs_against_all_pairs():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 4).astype(np.uint64)
    fp = np.array([int(base[k % 4]) ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 9)), replace=False)) for k in range(300)], np.uint64)
    n = rng.integers(10, 30, 300)
    found = []
    for t, m in enumerate(simhash.part_masks()):
        key = fp & np.uint64(m)
        order = np.lexsort((n, key))
        for x, y in simhash.near_pairs(np.full(300, t), n[order], fp[order], 0):
            found += zip(order[x].tolist(), order[y].tolist(), strict=True)
    want = {(a, b) for a, b in itertools.combinations(range(300), 2) if int(fp[a] ^ fp[b]).bit_count() <= simhash.CANDIDATE_RADIUS and 5 * min(n[a], n[b]) >= 4 * max(n[a], n[b])}
    assert len(found) == len(set(found)) and {(min(p), max(p)) for p in found} == want


def test_stage_links_by_similarity_of_shingles(spark):
    """Copies at 0.8 and somewhat more are found though 7 bits and more differ; texts somewhat below 0.8 all stay."""
    rng = np.random.default_rng(6)
    texts = []
    for k in range(60):
        w = [f"w{int(x)}" for x in rng.integers(0, 1 << 40, 100)]
        texts.append(" ".join(w))
        # of 96 shingles each replaced word away from others takes 5
        for at in (20, 60) if k % 2 else (20, 40, 60):
            w[at] = "other"
        texts.append(" ".join(w))
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in simhash.stage(spark, df, "").collect()}
    sets = [shingle_set(t) for t in texts]
    alike = [len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) >= 0.8 for i in range(0, 120, 2)]
    assert alike == [bool(k % 2) for k in range(60)]
    far = [(fingerprint(texts[i], 5) ^ fingerprint(texts[i + 1], 5)).bit_count() for i in range(0, 120, 2)]
    assert any(7 <= d <= simhash.CANDIDATE_RADIUS for d, a in zip(far, alike, strict=True) if a) and any(d <= simhash.CANDIDATE_RADIUS for d, a in zip(far, alike, strict=True) if not a)
    for i, a, d in zip(range(0, 120, 2), alike, far, strict=True):
        assert i in kept and (i + 1 in kept) == (not a or d > simhash.CANDIDATE_RADIUS)


def test_large_groups_give_no_squares_of_pairs(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(400):
        fp = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        rows.append((k, int(np.int64(np.uint64(fp))), 100))
    df = spark.createDataFrame(rows, "s long, fp long, n long")
    got = simhash.candidates(df, 2).collect()
    pairs = {frozenset((r.a, r.b)) for r in got if r.a != r.b}
    left = {x for r in got for x, bit in ((r.a, 1), (r.b, 2)) if r.left & bit}
    every = {frozenset(p) for p in itertools.combinations(range(400), 2)}
    assert len(got) < 400 * 2 * 30 and {y for p in pairs for y in p} == set(range(400))
    assert all(p <= left for p in every - pairs)
    rest = df.selectExpr("s", "fp", "n", "s as r", "cast(repeat('a', 256) as binary) as classes")
    assert {frozenset((r.a, r.b)) for r in simhash.candidates(rest).collect()} == every
    assert simhash.candidates(rest.selectExpr("s", "fp", "n", "0L as r", "classes")).count() == 0
    unlike = rest.selectExpr("s", "fp", "n", "r", "cast(concat(repeat('a', cast(s % 2 as int) * 128), repeat('b', 128), repeat('a', 128 - cast(s % 2 as int) * 128)) as binary) as classes")
    assert {frozenset((r.a, r.b)) for r in simhash.candidates(unlike).collect()} == {p for p in every if len({x % 2 for x in p}) == 1}


def test_second_round_joins_what_the_first_leaves_out(spark, monkeypatch):
    """One candidate a row in the first round, and most of these not similar: the groups are those of all pairs."""
    monkeypatch.setattr(simhash, "FIRST", 1)
    monkeypatch.setattr(simhash, "FEW", 3)
    rng = np.random.default_rng(9)
    texts = []
    for _ in range(6):
        w = [f"w{int(x)}" for x in rng.integers(0, 1 << 40, 120)]
        for _ in range(25):
            v = list(w)
            for at in rng.choice(120, int(rng.integers(0, 5)), replace=False):
                v[at] = f"x{int(rng.integers(0, 1 << 40))}"
            texts.append(" ".join(v))
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    sets = [shingle_set(t) for t in texts]
    prints = [fingerprint(t, 5) for t in texts]
    root = classes(range(len(texts)), lambda a, b: sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and (prints[a] ^ prints[b]).bit_count() <= simhash.CANDIDATE_RADIUS)
    assert sorted(r.doc_id for r in simhash.stage(spark, df, "").collect()) == sorted(set(root.values()))
