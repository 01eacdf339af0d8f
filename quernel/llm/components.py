"""Connected components by alternating large-star and small-star steps, as joins and aggregates.

Each step keeps at most as many links as there are, hot nodes are met by joins that split skewed keys and by minima with
partial aggregation, and lineage is cut in the shared folder after every round. No link list reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.shared import materialize


def _star(links: DataFrame, both: bool) -> DataFrame:
    """Links (hi, lo), lo < hi, after a large-star (both directions) or small-star (each node's lesser neighbours) step."""
    if both:
        ways = links.unionAll(links.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))).toDF("u", "v")
    else:
        ways = links.toDF("u", "v")
    least = ways.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    met = ways.join(least, "u")
    if both:
        moved = met.where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    else:
        moved = met.select(F.col("v").alias("hi"), F.col("m").alias("lo")).unionAll(least.select(F.col("u").alias("hi"), F.col("m").alias("lo")))
    return moved.where("hi != lo").distinct()


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """node, root for every node of ``links`` (a, b): root is the least node of its component."""
    now = materialize(links.where("a != b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    for _ in range(most):
        # stars: every node has one link, and no centre has one itself
        state = now.groupBy("hi").agg(F.count("*").alias("n"))
        centres = now.select(F.col("lo").alias("hi")).distinct()
        if not state.where("n > 1").limit(1).count() and not now.join(centres, "hi", "left_semi").limit(1).count():
            break
        now = materialize(_star(_star(now, True), False))
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionAll(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
