"""The pipeline: each stage on what its predecessor kept, and the entry points."""

import ast
import hashlib
from pathlib import Path

import pytest

import corpus_pipeline
from quernel.llm import decontaminate, registry, simhash
from quernel.llm.shared import materialize, table

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark):
    out = [table(spark, SF, "documents")]
    for _, f in corpus_pipeline.STAGES:
        out.append(materialize(f(spark, out[-1], SF)))
    return out


def test_stage_columns_and_effects(steps):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(s.columns == COLUMNS for s in steps[:-1]) and set(COLUMNS) < set(steps[-1].columns)
    counts = [s.count() for s in steps]
    assert counts[1] >= 0.98 * counts[0] and counts[2] < counts[1] and counts[4] < counts[3]


def test_exact_copies_are_gone_after_dedup(steps):
    texts = [r.text for r in steps[2].select("text").collect()]
    assert len(texts) == len(set(texts))


def test_substring_stage_against_brute_force(steps):
    from collections import Counter

    before = {r.doc_id: r.text.split() for r in steps[2].collect()}
    counts = Counter(tuple(w[k : k + 50]) for w in before.values() for k in range(len(w) - 49))
    after = {r.doc_id: r for r in steps[3].collect()}
    for i, w in before.items():
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if counts[tuple(w[k : k + 50])] > 1:
                gone[k : k + 50] = [True] * 50
        if all(gone):
            assert i not in after
        else:
            assert after[i].text.split() == [x for x, g in zip(w, gone, strict=True) if not g] and after[i].n_chars == len(after[i].text)


def test_decontamination_stage(spark, steps):
    bad = {r.doc_id for r in decontaminate.contaminated(steps[3], table(spark, SF, "benchmark")).collect()}
    assert {r.doc_id for r in steps[4].collect()} == {r.doc_id for r in steps[3].collect()} - bad


def test_mixing_stage_repeats_whole_documents(steps):
    texts = {r.doc_id: hashlib.md5(r.text.encode()).digest() for r in steps[4].collect()}
    rows = steps[5].collect()
    assert all(texts[r.doc_id] == hashlib.md5(r.text.encode()).digest() and 1 <= r.copy <= r.n_copies for r in rows)
    assert len({(r.doc_id, r.copy) for r in rows}) == len(rows)


def test_run_is_the_stages_one_after_another(spark, steps):
    key = lambda df: sorted((r.doc_id, r.copy, r.text) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(steps[-1])


def test_registry_names_each_operator_once():
    assert sorted(int(k[2:].split("_")[0]) for k in registry.QUERIES) == list(range(1, 11))
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


def test_nothing_else_imports_the_subpackage():
    root = Path(corpus_pipeline.__file__).parent
    for p in (root / "quernel").rglob("*.py"):
        if "llm" in p.relative_to(root).parts:
            continue
        for n in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in n.names] if isinstance(n, ast.Import) else [n.module or ""] if isinstance(n, ast.ImportFrom) else []
            assert not any(x.startswith("quernel.llm") for x in names), p


def test_stages_on_an_empty_table(spark, empty):
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, empty, SF).collect() == [], name


def test_near_duplicate_stage_of_repeated_rows(spark):
    rows = [(1, "a b c d e f", "en", "s", 11)] * 3 + [(None, "q w e r t y u", None, None, None)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.text for r in simhash.stage(spark, df, SF).collect()) == ["a b c d e f", "q w e r t y u"]
