"""Approximate nearest neighbours by inner product: a forest of sorted hash-string arrays.

Rows are dealt by a hash of their id into blocks of at most ``block_rows`` vectors on average; every row is indexed, and
every block holds a whole forest. A tree hashes a vector to a string of symbols, each the nearest corner of a randomly turned
cross-polytope (such symbols tell neighbours apart better than signs of projections), and keeps its block's strings in one
sorted array. A query descends in every tree to its longest prefix match by binary search, then all trees ascend together,
one symbol at a time, until the items under the current prefixes reach ``candidates`` of the block; exact inner products in double precision rank these. Prefixes of all trees shrink in step,
so every tree contributes its closest items first. Inner products become angles by one more coordinate that makes all
items of a block equally long.

Equal vectors are searched once: a class of equal vectors keeps its smallest ids, as many as an answer can hold and one
more, since larger ones can never enter an answer. Queries are grouped alike. The query set is stated (a share of all
rows) and meets the blocks in blocks of its own; only each block's best rows leave it. The candidates of a query are a
fixed share of the rows, so recall does not fall as the table grows.

Vectors that are null, empty, zero, of another length than most, or that hold null or non-finite components take no
part. Rows with a null id cannot be named and take no part either. Repeated rows of one id and vector count once. An
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernel.llm.shared import materialize, table

SYMBOLS = 4  # of a string
AXES = 64  # of the cross-polytopes at most; a symbol has 2 * AXES values, 7 bits


class Forest:
    """Sorted arrays of the hash strings of one block's vectors, and the search in them."""

    def __init__(self, items: np.ndarray, trees: int, seed: int) -> None:
        norms = (items * items).sum(1)
        longest = norms.max() if len(norms) else 0.0
        self.items, self.trees = items, trees
        width = items.shape[1] + 1
        self.axes = min(width, AXES)
        self.bits = (2 * self.axes - 1).bit_length()
        rng = np.random.default_rng(seed)
        turns = [np.linalg.qr(rng.normal(size=(width, self.axes)))[0] for _ in range(trees * SYMBOLS)]
        self.turns = np.array(turns, np.float32).reshape(trees, SYMBOLS, width, self.axes).transpose(0, 2, 1, 3).reshape(trees, width, -1)
        strings = self.strings(np.c_[items, np.sqrt(np.maximum(longest - norms, 0))])
        self.order = np.argsort(strings, axis=0, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, 0)

    def strings(self, vectors: np.ndarray) -> np.ndarray:
        """One string of SYMBOLS symbols for each vector and tree: which of a turned cross-polytope's corners is nearest."""
        v, out = vectors.astype(np.float32), np.zeros((len(vectors), self.trees), np.uint64)
        for t in range(self.trees):
            turned = (v @ self.turns[t]).reshape(len(v), SYMBOLS, self.axes)
            axis = np.abs(turned).argmax(2)
            corner = 2 * axis + (np.take_along_axis(turned, axis[..., None], 2)[..., 0] > 0)
            for k in range(SYMBOLS):
                out[:, t] = out[:, t] << np.uint64(self.bits) | corner[:, k].astype(np.uint64)
        return out

    def ranges(self, queries: np.ndarray, candidates: int) -> tuple[np.ndarray, np.ndarray]:
        """Per query and tree the range of sorted items under the prefix at which the ascent stops."""
        q = self.strings(np.c_[queries, np.zeros(len(queries))])
        low, high = np.zeros((len(q), self.trees), np.int64), np.zeros((len(q), self.trees), np.int64)
        open_ = np.ones(len(q), bool)
        for length in range(SYMBOLS, -1, -1):
            at = np.flatnonzero(open_)
            if not len(at):
                break
            rest = np.uint64((1 << self.bits * (SYMBOLS - length)) - 1)
            first = q[at] & ~rest
            for t in range(self.trees):
                low[at, t] = np.searchsorted(self.sorted[:, t], first[:, t], "left")
                high[at, t] = np.searchsorted(self.sorted[:, t], first[:, t] | rest, "right")
            open_[at] = (high[at] - low[at]).sum(1) < candidates
        return low, high

    def search(self, queries: np.ndarray, k: int, candidates: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per query the items found, best k by score and all that tie with the last, with their scores."""
        low, high = self.ranges(queries, candidates)
        out = []
        for i, q in enumerate(queries):
            hit = np.zeros(len(self.items), bool)
            for t in np.flatnonzero(high[i] > low[i]):
                hit[self.order[low[i, t] : high[i, t], t]] = True
            found = np.flatnonzero(hit)
            if len(found) < k:  # under several trees the same few rows: up to the empty prefix
                found = np.arange(len(self.items))
            score = (self.items[found] * q).sum(1)
            if len(found) > k:
                keep = score >= np.partition(score, len(score) - k)[len(score) - k]
                found, score = found[keep], score[keep]
            out.append((found, score))
        return out


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """id (long) and v (array of double) of the rows that take part."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = ~F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & ~F.coalesce(zero, F.lit(True)))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector: str = "embedding", trees: int = 80, share: float = 0.25, block_rows: int = 8192, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row its k nearest rows found, its own excepted.

    ``is_query``: condition on a column ``id``. ``share``: the ascent stops when the trees together hold this many times
    a block's rows under the current prefixes (rows under several trees count for each), and enough for k + 1 rows.
    """
    rows = materialize(usable(vectors, id_col, vector))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not lengths:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    rows = rows.where(F.size("v") == lengths[0].n)
    # -0.0 and 0.0 are one value to inner products
    keyed = rows.withColumn("v", F.transform("v", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)))
    # the smallest ids of each class, limited within tasks before anything is shuffled by vector
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    least = keyed.dropDuplicates(["id", "v"]).withColumn("r", rank).where(F.col("r") <= k + 1)
    classes = least.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    classes = materialize(classes.withColumn("cls", F.col("ids")[0]))
    n = classes.count()
    blocks = max(1, -(-n // block_rows))
    items = classes.select(F.pmod(F.xxhash64("cls"), F.lit(blocks)).cast("int").alias("block"), "cls", "ids", "v")
    asked = keyed.where(is_query).select("id", "v").distinct()
    # a query is known by its vector's class; its own row is taken out of the answer at the end
    qclass = materialize(asked.join(classes.select("cls", "v"), "v").select("id", "cls", "v"))
    wanted = qclass.select("cls", "v").distinct()
    parts = max(1, -(-wanted.count() // 2048))
    sent = wanted.select("cls", "v", F.pmod(F.xxhash64("cls", F.lit(1)), F.lit(parts)).cast("int").alias("part")).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "part", "cls", "v")
    # every query part meets every block once, with the block's vectors
    placed = items.select("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "cls", "ids", "v")

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("cls", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        matrix = lambda t: t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        items, queries = matrix(right), matrix(left)
        forest = Forest(items, trees, seed)
        ids = right.column("ids").to_pylist()
        out = [(c, x, s) for c, (found, score) in zip(left.column("cls").to_pylist(), forest.search(queries, k + 1, max(4 * (k + 1), int(share * len(items)))), strict=True) for i, s in zip(found.tolist(), score.tolist(), strict=True) for x in ids[i]]
        # only the best k + 1 of a block can be among the best k of all but the query's own row
        best = pd.DataFrame(out, columns=["cls", "vec_id", "score"]).sort_values(["cls", "score", "vec_id"], ascending=[True, False, True]).groupby("cls").head(k + 1)
        return pa.Table.from_pandas(best, schema=schema, preserve_index=False)

    found = sent.groupBy("block", "part").cogroup(placed.groupBy("block", "part")).applyInArrow(find, "cls long, vec_id long, score double")
    order = Window.partitionBy("cls").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).drop("r")
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    answers = qclass.select(F.col("id").alias("query_id"), "cls").join(best, "cls").where("query_id != vec_id")
    return answers.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def recall(vectors: np.ndarray, queries: np.ndarray, own: np.ndarray, found: list[set[int]], k: int) -> float:
    """Share of the exact k nearest, the query's own row excepted, that was found."""
    hits = total = 0
    for q, o, f in zip(queries, own, found, strict=True):
        s = vectors @ q
        s[o] = -np.inf
        best = set(np.lexsort((np.arange(len(s)), -s))[:k].tolist())
        hits, total = hits + len(best & f), total + len(best)
    return hits / max(total, 1)
