"""Token counts, language identification, decontamination, mixing, URL filtering, nearest neighbours."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quernel.llm import ann, decontaminate, language, mixing, token_counts, url_filter

SF = "/root/testdata/sf0.001"


def model_path():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def test_token_counts_equal_the_library(docs, corpus):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    want = Counter((r[0], len((r[1] or "").encode()), len(sp.encode(r[1] or ""))) for r in corpus)
    rows = token_counts.token_counts(docs, model_path(), limit=100).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 100) for r in rows)


def test_splitting_is_exact_on_random_strings():
    c = token_counts.Counter(open(model_path(), "rb").read())
    assert c.splits
    rng, bits = random.Random(1), [" ", "  ", "▁", "a", "the", "\n", "\t", "é", "日", "<s>", "\r", ".", "\x00", "\xa0", "😀"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(5000)]
    assert c.count(texts) == c.lengths(texts)


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.op9_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 200 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in rows) and sum(r.rejected for r in rows) <= len(rows) / 100


def test_language_of_nulls_letterless_and_nothing_learned(docs, empty):
    got = language.identify(docs, None, keep=["doc_id"])
    assert {r.lang_pred for r in got.collect()} == {"und"}
    model = language.train(["der die das und ist", "the and of to in", "the that with for", "und nicht ein eine"] * 5, ["de", "en", "en", "de"] * 5)
    rows = {r.doc_id: r for r in language.identify(docs.where("doc_id between 53 and 58"), model).collect()}
    assert rows[53].lang_pred == "und" and rows[55].lang_pred == "und" and rows[55].rejected and rows[57].lang_pred != "und"
    assert language.fit(empty, F.lit(True)) is None and language.identify(empty, None).collect() == []


def leaks(docs, items, size=5, similarity=0.8):
    """All pairs by trying every window of every item's length."""
    out = set()
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    shingles = lambda w: Counter(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))
    for item, text in items:
        w = words(text)
        if not w:
            continue
        s = shingles(w)
        for doc, other in docs:
            d = words(other)
            if not d or not set(s) & set(shingles(d)) and len(d) >= size and len(w) >= size:
                continue
            n = min(len(w), len(d))
            for i in range(len(d) - n + 1):
                t = shingles(d[i : i + n])
                least = sum((s & t).values())
                if least / (s.total() + t.total() - least) >= similarity:
                    out.add((doc, item))
                    break
    return out


def test_decontamination_against_all_windows(spark, corpus):
    rng = random.Random(3)
    texts = [r[1] for r in corpus if r[1] and 20 < len(r[1].split()) < 150][:12]
    items = [(i, " ".join(t.split()[: rng.randint(12, 40)])) for i, t in enumerate(texts)] + [(90, None), (91, ""), (92, "x"), (93, "word")]
    changed = [" ".join([*items[0][1].split()[:-1], "other"]), " ".join(["start", *items[1][1].split()]), items[2][1].upper() + " more text after it"]
    rows = [(r[0], r[1]) for r in corpus if r[0] is not None] + [(900 + i, t) for i, t in enumerate(changed)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == leaks(rows, items)
    assert all(r.similarity >= 0.8 for r in got)
    left = decontaminate.clean(docs, bench).collect()
    bad = {d for d, _ in leaks(rows, items)}
    assert sorted(r.doc_id for r in left) == sorted(d for d, _ in rows if d not in bad)


def test_decontamination_of_nothing(spark, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(empty, bench).collect() == []
    assert decontaminate.clean(empty, bench).collect() == []


def test_probing_finds_all_within_the_radius():
    rng = np.random.default_rng(1)
    items = decontaminate.Items(list(range(50)), [" ".join(f"w{rng.integers(1000)}" for _ in range(20)) for _ in range(50)], 5)
    q = items.fp[rng.integers(0, 50, 40)].copy()
    for k in range(40):
        for b in rng.choice(64, int(rng.integers(0, 24)), replace=False):
            q[k] ^= np.uint64(1 << int(b))
    a, b = items.near(q)
    want = {(i, j) for i in range(40) for j in range(50) if bin(int(q[i] ^ items.fp[j])).count("1") <= decontaminate.RADIUS}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want


def test_mixing_rates_and_copies(spark, docs, corpus):
    rows = mixing.mix(docs, weights={"s0": 3.0, "s1": 1.0}, repeat=2.0).collect()
    assert {r.source for r in rows} <= {"s0", "s1"}
    by = defaultdict(int)
    for r in rows:
        by[r.source] += len((r.text or "").encode())
    total = 2 * sum(len((r[1] or "").encode()) for r in corpus)
    assert 0.4 * total < sum(by.values()) < 2.5 * total
    big = spark.range(20000).selectExpr("id as doc_id", "'abc' as text", "if(id % 4 = 0, 'a', 'b') as source")
    counts = {(r.source, r.n_copies): r["count"] for r in mixing.mix(big, weights={"a": 1, "b": 1}, repeat=1.5).where("copy = 1").groupBy("source", "n_copies").count().collect()}
    mean = sum(k * n for (s, k), n in counts.items() if s == "a") / 5000
    assert abs(mean - 3.0) < 0.1 and abs(counts["a", 3] / 5000 - 0.224) < 0.03
    assert mixing.mix(big, weights={"a": 30, "b": 0}).groupBy("source").count().collect()[0].source == "a"


def test_mixing_edges(docs, empty):
    assert mixing.mix(empty).collect() == []
    rows = mixing.mix(docs, temperature=1.0).collect()
    assert {r.source for r in rows} >= {None, "s1"}
    keys = [r.shuffle_key for r in mixing.mix(docs, temperature=1.0).coalesce(1).collect()]
    assert len(keys) == len(rows)


PAGES = [
    (0, "http://good.example.net/en/1", '<a href="http://friend.com/x">f</a><a href=/local>l</a>'), (1, "http://bad.net/", '<A HREF=\'//friend.com/\'>'), (2, "http://friend.com/a?b=1#c", '<a href="https://BAD.net/z">'), (3, "https://linker.com/x", '<a href="http://bad.net/1"><a href="http://bad.net/2">'),
    (4, None, None), (5, "no scheme", ""), (6, "http://EXAMPLE.net/EN/", None), (7, "ftp://x.example.net/en/q", None), (8, "http://deep.sub.org/fr/x", '<a href="http://friend.com/">'), (9, "http://net", None), (10, "http://h?x://y/", None), (None, "http://bad.net/", None), (3, "https://linker.com/x", None), (11, "http://good.example.net/xx", None),
]


def brute_verdicts(pages, rounds=12, d=0.85):
    def parts(u):
        if u is None or "://" not in u:
            return "", ""
        after = u.split("://", 1)[1]
        raw = re.match(r"[^/?#]*", after)[0]
        return re.sub("[A-Z]", lambda m: m[0].lower(), raw), re.match(r"[^?#]*", after[len(raw) :])[0]

    def rule(h, p):
        fits = [(len(a + b), a + b, v) for a, b, v in url_filter.RULES if (h == a or h.endswith("." + a)) and p.startswith(b)]
        return max(fits)[1:] if fits else (None, None)

    seen = [(i, *parts(u), html) for i, u, html in pages]
    n, t, b, edges = Counter(), Counter(), Counter(), Counter()
    for _, h, p, html in seen:
        if not h:
            continue
        n[h] += 1
        v = rule(h, p)[1]
        t[h] += v == "allow"
        b[h] += v == "block"
        for x in re.findall(url_filter.LINK, html or ""):
            x = x.lower()
            if x != h:
                edges[h, x] += 1
    base_t, base_b = {h: (1 - d) * t[h] / n[h] for h in n}, {h: (1 - d) * b[h] / n[h] for h in n}
    out, into = Counter(), Counter()
    for (a, c), k in edges.items():
        out[a] += k
        into[c] += k
    st, sb = dict(base_t), dict(base_b)
    for _ in range(rounds):
        nt, nb = Counter(base_t), Counter(base_b)
        for (a, c), k in edges.items():
            nt[c] += d * st.get(a, 0) * k / out[a]
            nb[a] += d * sb.get(c, 0) * k / into[c]
        st, sb = nt, nb
    res = []
    for i, h, p, _ in seen:
        r, v = rule(h, p)
        bad = sb.get(h, 0) > st.get(h, 0) and sb.get(h, 0) > 0.5 * (1 - d)
        res.append((i, h, p, r, v or ("block" if bad else "allow")))
    return res


def test_url_verdicts(spark):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, __host string")
    got = [tuple(r) for r in url_filter.judge(pages).collect()]
    want = brute_verdicts(PAGES)
    assert Counter(got) == Counter(want)
    assert (3, "linker.com", "/x", None, "block") in want  # distrust came over the reversed link
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", PAGES)
    r = con.execute(url_filter.ORACLE_SQL)
    assert [x[0] for x in r.description] == ["page_id", "host", "path", "rule", "verdict"]
    assert Counter(r.fetchall()) == Counter(want)
    assert url_filter.judge(pages.limit(0)).collect() == []


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 12))
    x[100:140] = x[100]  # copies
    x[300:320] = x[300] + rng.normal(0, 0.001, (20, 12))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(1000, None), (1001, [0.0] * 12), (1002, [float("nan")] * 12), (1003, [1.0, None] + [0.0] * 10), (1004, [1.0] * 3), (None, [1.0] * 12), (1005, []), (5, x[5].tolist()), (1006, [float("inf")] * 12)]
    return x, spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(4)


def test_nearest_recall_order_and_ties(vectors):
    x, df = vectors
    rows = ann.nearest(df, F.col("id") % 20 == 0, block_rows=300).collect()
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        by[r.query_id].append((r.vec_id, r.score))
    assert set(by) == set(range(0, 900, 20)) and all(len(v) == 20 for v in by.values())
    own = np.arange(0, 900, 20)
    assert ann.recall(x, x[own], own, [{v for v, _ in by[i]} for i in own.tolist()], 20) > 0.9
    for i, got in by.items():
        assert all(abs(s - float(x[i] @ x[v])) < 1e-9 and v != i for v, s in got)
        assert got == sorted(got, key=lambda g: (-g[1], g[0]))
    assert [v for v, _ in by[100]][:3] == [101, 102, 103] or max(s for _, s in by[100]) > float(x[100] @ x[100])


def test_nearest_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r["rank"], r.vec_id) for r in ann.nearest(df, F.col("id") == 0).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert ann.nearest(df.limit(0), F.col("id") == 0).collect() == []


def test_forest_search_is_exact_with_all_candidates():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 8))
    f = ann.Forest(x, 4, 1)
    for q, (found, score) in zip(x[:10], f.search(x[:10], 5, 10**6), strict=True):
        assert set(found.tolist()) == set(np.argsort(-(x @ q))[:5].tolist()) and np.allclose(np.sort(score)[::-1], np.sort(x @ q)[::-1][:5])


def test_recall_of_the_query_on_the_generated_table(spark):
    """All queries of sf0.1 against exact search, and the share of rows that is scored."""
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    found = {}
    for r in ann.op2_nearest(spark, sf).collect():
        found.setdefault(r.query_id, []).append(r)
    own = np.flatnonzero(ids % 20 == 0)
    assert sorted(found) == ids[own].tolist()
    for i in own.tolist():
        got = sorted(found[ids[i]], key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == list(range(1, 21)) and len({r.vec_id for r in got} - {int(ids[i])}) == 20
        exact = (x * x[i]).sum(1)
        assert np.allclose([r.score for r in got], exact[np.searchsorted(ids, [r.vec_id for r in got])], rtol=0, atol=1e-12)
        assert [(-r.score, r.vec_id) for r in got] == sorted((-r.score, r.vec_id) for r in got)
    assert ann.recall(x, x[own], own, [set(np.searchsorted(ids, [r.vec_id for r in found[ids[i]]]).tolist()) for i in own.tolist()], 20) >= 0.95
    forest = ann.Forest(x, 80, 11)
    low, high = forest.ranges(x[own], len(x) // 4)
    scored = [len(set(np.concatenate([forest.order[low[q, t] : high[q, t], t] for t in range(80)]).tolist())) / len(x) for q in range(len(own))]
    assert np.mean(scored) < 0.5
