"""Removal of passages that repeat: windows of whole words, prefiltered by a count-min sketch.

First pass: every window of ``window`` words has an anchor, its leftmost word gram of least hash, which depends on the
window's content alone; a window that starts twice has an anchor gram that occurs twice. Each chunk of documents counts
its anchors in a count-min sketch; the merged sketch overestimates how often each window can occur. Second pass: only
windows whose estimate is two or more are grouped, exactly, by 96-bit hashes; none that repeats is lost. Each word
covered by a window that also starts elsewhere goes. Windows are judged on the input.

Frequent windows cost each chunk one entry, so no passage is hot. A text longer than a chunk is scanned whole in one task,
as a chunk of its own. Null and wordless texts have no words and lose none;
texts shorter than a window lose none; the two rows of a repeated document are two places. Extra columns are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from quernel.llm import textblocks as tb
from quernel.llm import windows
from quernel.llm.chunks import CHUNK, finish, gather, pack, sub_blocks
from quernel.llm.shared import fresh, table
from quernel.llm.sketch import Sketch

BLOCK = 1 << 20
SHARD = 1 << 21  # windows a shard gets on average, at most
TEAM = 4  # shards that travel together
SPACING = 32  # bytes of text for each anchor, at least, as a rule


def _scan(batch: pa.RecordBatch, text: str, window: int, gram: int):
    """For each block: first row, words, windows' runs by anchor, the anchors' gram hashes, and the words' hashes."""
    for at, data, off in sub_blocks(batch, text, BLOCK):
        starts, ends, first = tb.words(data, off)
        h = tb.word_hashes(data, starts, ends, 1)
        grams = tb.Rolling(h, 2).windows(gram)
        pos, begin, count, doc = tb.anchors(grams, first, window, gram)
        yield at, data, off, starts, ends, first, h, grams[pos], begin, count


def _anchors(blocks) -> np.ndarray:
    # anchors are least hashes, all small: mixed again before they are counted
    return tb.mix(np.concatenate([np.zeros(0, np.uint64), *(x[7] for x in blocks)]))


def _candidates(batch: pa.RecordBatch, text: str, window: int, gram: int, estimates, told: dict[int, bytes]) -> tuple[windows.Local, list[np.ndarray]]:
    """The chunk's windows that may repeat, and for each block their first words."""
    one, two, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)], []
    blocks = list(_scan(batch, text, window, gram))
    seen = estimates(_anchors(blocks), told)
    for _, data, _, starts, ends, _, h, anchor, begin, count in blocks:
        keep = seen.twice(tb.mix(anchor))
        b, n = begin[keep], count[keep]
        s = np.repeat(b - (np.cumsum(n) - n), n) + np.arange(n.sum())
        at.append(s)
        if len(s):
            one.append(tb.Rolling(h, 3).windows(window)[s])
            two.append((tb.Rolling(tb.word_hashes(data, starts, ends, 4), 5).windows(window)[s] >> np.uint64(32)).astype(np.uint32))
    return windows.Local(np.concatenate(one), np.concatenate(two)), at


def remove_repeats(docs: DataFrame, text: str = "text", window: int = 35, gram: int = 20, prefix: str = "", chunk_bytes: int = CHUNK) -> DataFrame:
    """All columns with n_words, n_removed and kept (the words left, joined by one space, as bytes), named with
    ``prefix``; input columns of these names are replaced."""
    added = [f"{prefix}{x}" for x in ("n_words", "n_removed", "kept")]
    docs = docs.drop(*added)
    names, column = docs.columns, f"c{docs.columns.index(text)}"
    chunks = pack(docs, text, chunk_bytes)
    shards = max(1, -(-chunks.size // (6 * SHARD)))
    sketch = Sketch(chunks, lambda batch: _anchors(_scan(batch, column, window, gram)), 1 << 16, SPACING)
    estimates = sketch.reader()

    def ask(batch: pa.RecordBatch, told: dict[int, bytes]):
        return _candidates(batch, column, window, gram, estimates, told)[0].ask(shards)

    fields = [*docs.schema, StructField(added[0], LongType()), StructField(added[1], LongType()), StructField(added[2], BinaryType())]
    out_names = [*(f"c{i}" for i in range(len(names))), "x0", "x1", "x2"]

    def answer(batch: pa.RecordBatch, answers: dict[int, bytes], told: dict[int, bytes]) -> pa.Table:
        local, at = _candidates(batch, column, window, gram, estimates, told)
        again, used, kept, n_words, n_removed = local.answered(shards, answers), 0, [], [], []
        for (_, data, off), s in zip(sub_blocks(batch, column, BLOCK), at, strict=True):
            starts, ends, first = tb.words(data, off)
            gone = tb.covered(len(starts), s[again[used : used + len(s)]], window)
            used += len(s)
            raw, per_doc = data.tobytes(), np.add.reduceat(np.r_[gone, False].astype(np.int64), first[:-1]) if len(first) > 1 else np.zeros(0, np.int64)
            per_doc[np.diff(first) == 0] = 0
            n_words += np.diff(first).tolist()
            n_removed += per_doc.tolist()
            for d, lost in enumerate(per_doc.tolist()):
                if not lost:
                    kept.append(b" ".join(raw[off[d] : off[d + 1]].split()))
                else:
                    i = np.flatnonzero(~gone[first[d] : first[d + 1]]) + first[d]
                    kept.append(b" ".join([raw[a:b] for a, b in zip(starts[i].tolist(), ends[i].tolist(), strict=True)]))
        return pa.table([*batch.columns, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())], out_names)

    kinds = StructType([StructField(n, f.dataType) for n, f in zip(out_names, fields, strict=True)])
    answers = gather(chunks, shards, TEAM, ask, windows.combine, sketch.told)
    return finish(chunks, answers, answer, kinds, sketch.told).toDF(*names, *added)


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of repeated passages of 50 words or more; untouched texts stay as they are, n_chars
    follows, and documents left without words go."""
    p = fresh("__ss_", docs.columns)
    out = remove_repeats(docs, window=50, gram=30, prefix=p)
    changed = F.col(f"{p}n_removed") > 0
    text = F.when(changed, F.col(f"{p}kept").cast("string")).otherwise(F.col("text"))
    left = out.where(~changed | (F.col(f"{p}n_removed") < F.col(f"{p}n_words"))).withColumn("text", text)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return left.select(*docs.columns)
