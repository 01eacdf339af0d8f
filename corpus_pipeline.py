"""The corpus pipeline: stages over documents, each written and read again by the next.

language ID drops documents it rejects; near-dedup keeps one document of each group; substring dedup removes passages of
50 words or more that repeat; decontamination drops documents that hold benchmark items; mixing replicates sources to
their target weights and shuffles. All but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quernel.llm import decontaminate, language, mixing, simhash, substring
from quernel.llm.shared import materialize, table

STAGES = [
    ("language ID", language.stage),
    ("SimHash near-dedup", simhash.stage),
    ("substring dedup", substring.stage),
    ("benchmark decontamination", decontaminate.stage),
    ("mixing sources to target weights", mixing.stage),
]
#: A classifier trained by gradient descent starts the chain; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
