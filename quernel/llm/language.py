"""Language identification: averaged hashed subword embeddings under a linear softmax.

Subwords are 3- and 4-grams of bytes of the text, ASCII letters lower-cased and every other ASCII byte read as a space;
grams of spaces alone are skipped. Each gram is hashed to a bucket with a learned embedding; a text's embedding is their
mean; a linear softmax names the language. Training is stochastic gradient descent in numpy over at most
``sample_rows`` labelled rows of at most ``row_bytes`` bytes (the ones of smallest hash), so the driver's share is
bounded. A temperature fitted on a fifth of that sample calibrates the score; a document is rejected when the calibrated
probability of its language is under ``reject_below`` (more likely wrong than right) or when it has no letter.

Prediction reads whole texts. Since embedding and softmax layer are both linear, executors hold one row of class logits
for each bucket. Null, empty and letterless texts: lang_pred ``und``, score 0, rejected. Rows with a null label, or
eligible rows without letters, are not learned from; with nothing to learn from every text is ``und``. A null doc_id
counts as held out. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm import textblocks as tb
from quernel.llm.shared import fresh, table

BUCKETS = 1 << 15
DIM = 16
FOLD = np.full(256, 0x20, np.uint32)
FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
FOLD[0x80:] = np.arange(0x80, 0x100)


@dataclass
class Model:
    langs: list[str]
    logits: np.ndarray  # a row for each bucket and a last one of zeros; a column for each language
    bias: np.ndarray
    temperature: float


def grams(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """Bucket of the 3- and the 4-gram at each byte; BUCKETS where it is blank or crosses a text's end."""
    x = FOLD[data]
    n, out = len(x), []
    for size in (3, 4):
        b = np.full(n, BUCKETS, np.int32)
        if n >= size:
            g = x[: n - size + 1].copy()
            for k in range(1, size):
                g = g << np.uint32(8) | x[k : n - size + 1 + k]
            h = ((g * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.int32)
            h = (h + size * 0x2A5D) % BUCKETS
            blank = np.uint32(sum(0x20 << 8 * k for k in range(size)))
            b[: n - size + 1] = np.where(g == blank, BUCKETS, h)
            for k in range(1, size):
                ends = off[1:] - k
                b[ends[(ends >= 0) & (ends < n)]] = BUCKETS
        out.append(b)
    return out


def _segments(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1)
    np.cumsum(values, out=sums[1:])
    return sums[off[1:]] - sums[off[:-1]]


def score(model: Model, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Calibrated probabilities, a row for each text."""
    both, total = grams(data, off), np.zeros((len(off) - 1, len(model.langs)))
    count = sum(_segments((b < BUCKETS).astype(np.float64), off) for b in both)
    for c in range(len(model.langs)):
        column = np.ascontiguousarray(model.logits[:, c])
        total[:, c] = sum(_segments(column[b], off) for b in both)
    z = (total / np.maximum(count, 1)[:, None] + model.bias) / model.temperature
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def _examples(texts: list[bytes], labels: list[int], rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Whole texts, and two short pieces of each so that short texts are learned too."""
    out = []
    for t, y in zip(texts, labels, strict=True):
        cuts = [int(rng.integers(0, max(1, len(t) - 160))) for _ in range(2)]
        for piece in (t, *(t[c : c + 160] for c in cuts)):
            d = np.frombuffer(piece, np.uint8)
            b = np.concatenate(grams(d, np.array([0, len(d)])))
            ids, n = np.unique(b[b < BUCKETS], return_counts=True)
            if len(ids):
                out.append((ids, n / n.sum(), y))
    return out


def train(texts: list[str], labels: list[str], epochs: int = 4, rate: float = 0.5, seed: int = 7) -> Model | None:
    """Stochastic gradient descent over four fifths of the rows, then the temperature over the rest."""
    langs = sorted(set(labels))
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    held = set(order[: len(texts) // 5].tolist())
    pick = lambda keep: _examples([t.encode() for i, t in enumerate(texts) if (i in held) != keep], [langs.index(y) for i, y in enumerate(labels) if (i in held) != keep], rng)
    fit, check = pick(True), pick(False)
    emb, out, bias = rng.normal(0, 0.1, (BUCKETS + 1, DIM)), rng.normal(0, 0.1, (DIM, len(langs))), np.zeros(len(langs))
    emb[BUCKETS] = 0
    steps = max(1, epochs * len(fit))
    for step in range(steps):
        if step % len(fit) == 0:
            order = rng.permutation(len(fit))
        ids, w, y = fit[order[step % len(fit)]]
        lr = rate * (1 - step / steps)
        h = w @ emb[ids]
        z = h @ out + bias
        p = np.exp(z - z.max())
        p /= p.sum()
        p[y] -= 1
        back = out @ p
        out -= lr * np.outer(h, p)
        bias -= lr * p
        emb[ids] -= (lr * len(ids) ** 0.5) * np.outer(w, back)
    logits, temperature = emb @ out, 1.0
    if check:
        z = np.array([w @ logits[ids] + bias for ids, w, _ in check])
        y = np.array([e[2] for e in check])

        def loss(t: float) -> float:
            s = z / t
            s = s - s.max(1, keepdims=True)
            return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]))

        temperature = min(np.geomspace(0.25, 4, 33), key=loss)
    return Model(langs, logits, bias, float(temperature))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(True))


def has_letter(text: str = "text") -> Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def fit(docs: DataFrame, eligible: Column, text: str = "text", lang: str = "lang", id_col: str = "doc_id", sample_rows: int = 3000, row_bytes: int = 1 << 16) -> Model | None:
    """A model from the labelled, eligible rows of smallest hash; at most sample_rows * row_bytes bytes reach the driver."""
    labelled = docs.where(eligible & F.col(lang).isNotNull())
    # rows over a bound on the hash, of which about twice the sample remains: tasks send no more than those
    share = min(1.0, 2.0 * sample_rows / max(1, labelled.count()))
    bound = F.lit(min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63)))
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.xxhash64(F.col(id_col).cast("string")).alias("h"))
    rows = rows.where((F.col("h") <= bound) & has_letter("text") & (F.octet_length("text") <= row_bytes))
    got = rows.orderBy("h", "lang", "text").limit(sample_rows).collect()
    return train([r.text for r in got], [r.lang for r in got])


def identify(docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None, reject_below: float = 0.5, prefix: str = "") -> DataFrame:
    """The columns ``keep`` (all by default) with lang_pred, score and rejected, named with ``prefix``."""
    keep = docs.columns if keep is None else keep
    names = [f"{prefix}{x}" for x in ("lang_pred", "score", "rejected")]
    keep = [c for c in keep if c not in names]
    letter = f"{prefix}has_letter"
    while letter in docs.columns:
        letter += "_"
    shown = list(dict.fromkeys([*keep, text]))
    kept = [docs.schema.names.index(c) for c in keep]
    schema = [docs.schema[i] for i in kept]
    source = docs.select(*shown, has_letter(text).alias(letter))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in tb.blocks(batches, text=text):
            ok = np.array(tb.column(batch, letter).to_pylist(), bool)
            if model is None:
                lang, best = ["und"] * len(ok), np.zeros(len(ok))
            else:
                p = score(model, data, off)
                best = np.where(ok, p.max(1), 0.0)
                lang = [model.langs[i] if o else "und" for i, o in zip(p.argmax(1).tolist(), ok.tolist(), strict=True)]
            rejected = ~ok | (best < reject_below)
            yield pa.record_batch([*(tb.column(batch, c) for c in keep), pa.array(lang, pa.string()), pa.array(best), pa.array(rejected)], [*keep, *names])

    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

    out = StructType([*schema, StructField(names[0], StringType()), StructField(names[1], DoubleType()), StructField(names[2], BooleanType())])
    return source.mapInArrow(run, out)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, ~held_out())
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    return identify(rows, model, keep=["doc_id", "held_out"])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the identifier rejects; learns from every labelled row of its input's sample."""
    model = fit(docs, F.lit(True))
    if model is None:
        return docs
    prefix = fresh("__lid_", docs.columns)
    return identify(docs, model, prefix=prefix).where(f"not {prefix}rejected").select(*docs.columns)
