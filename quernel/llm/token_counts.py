"""Token counts of whole texts by a SentencePiece model.

Arrow functions return lengths only. Each Arrow batch is cut into slices balanced by bytes; inside a slice every text
is split at *safe boundaries*, before a space that follows a character other than a space: no piece of the vocabulary
holds a word-start mark after another character (checked when the model is loaded), so merges never cross such a
boundary and the counts of the parts add up to the count of the whole. Distinct parts of a slice are encoded once. Where
the check fails, whole texts are encoded.

Null and empty texts have no bytes and no tokens. Null or repeated doc_ids and repeated rows stay, one result row for
each input row. Other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm import textblocks as tb
from quernel.llm.shared import table

MARK = "▁"
SLICE = 1 << 20
_models: dict = {}


class Counter:
    """Token counts by one model, with the parts of texts encoded once for each call."""

    def __init__(self, proto: bytes) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        pieces = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        probe = "a b  c"
        kept = self.model.decode(self.model.encode(probe)) == probe and len(self.model.encode(" ")) > 0
        self.splits = kept and not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        self.lone = len(self.model.encode("a ")) - len(self.model.encode("a"))

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]

    def count(self, texts: list[str]) -> list[int]:
        if not self.splits:
            return self.lengths(texts)
        seen: dict[str, int] = {}
        parts = []
        for t in texts:
            if not t:
                parts.append([])
                continue
            p = t.split(" ")
            if "" in p or MARK in t:
                p = self.parts(t)
            parts.append(p)
            seen.update(dict.fromkeys(p, 0))
        keys = list(seen)
        seen.update(zip(keys, self.lengths(keys), strict=True))
        seen[""] = self.lone
        return [sum(map(seen.__getitem__, p)) for p in parts]

    @staticmethod
    def parts(text: str) -> list[str]:
        """Split before each space that follows neither a space nor a mark; the encoder puts that space back."""
        first, *rest = re.split(f"(?<=[^ {MARK}]) ", text)
        return [first, *rest]


def _model(name: str) -> Counter:
    if name not in _models:
        with open(SparkFiles.get(name), "rb") as f:
            _models[name] = Counter(f.read())
    return _models[name]


def token_counts(docs: DataFrame, model_path: str, text: str = "text", id_col: str = "doc_id", limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row. ``model_path``: a file on the driver, sent
    to the executors once."""
    spark = docs.sparkSession
    spark.sparkContext.addFile(model_path)
    name = model_path.rpartition("/")[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _model(name)
        for batch, data, off in tb.blocks(batches, text="text", most=SLICE):
            texts = tb.column(batch, "text").fill_null("").to_pylist()
            yield pa.record_batch([tb.column(batch, "doc_id"), pa.array(np.diff(off)), pa.array(counter.count(texts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
