import random

import pytest

SF = "/root/testdata/sf0.001"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefgéß") for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source): copies, near copies, shared passages, periodic, long, empty, null and odd texts."""
    rng = random.Random(5)
    passage, longest = words(rng, 60), words(rng, 3000)
    base = [words(rng, rng.randint(20, 200)) for _ in range(40)]
    texts = [*base, base[0], base[0], base[1], base[2].replace(base[2].split()[5], "zzz"), base[3] + " tail", f"{base[4]} {passage} {base[5]}", f"{passage}\n{base[6]}", passage, longest, longest + " x"]
    texts += ["same " * 300, "same " * 170, "ab " * 500, "", " \t\n", None, "x", "Word", "\u2581 a \u2581", "\x00 nul", "<s> tag </s>", "MiXed CaSe Of Words Here", "a" * 900, "a" * 401]
    rows = [(i, t, ("en", "fr", None)[i % 3], None if i % 11 == 0 else f"s{i % 4}") for i, t in enumerate(texts)]
    rows += [(7, base[7], "en", "s1"), (7, base[7], "en", "s1"), (None, base[8], None, None), (None, "no id", None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with columns whose names clash with what operators add."""
    return spark.createDataFrame([(*r, 1, 2, 3) for r in corpus], "doc_id long, text string, lang string, source string, fp long, n_words long, c0 long").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
