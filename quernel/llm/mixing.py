"""Mixing sources to target weights by Poisson replication.

Each source s has a share w(s) of the output. Its repetition rate is ``w(s) * total / size(s)``, sizes in bytes. A
document's number of copies inverts the Poisson distribution of that mean at a uniform number hashed from seed and
doc_id; large means are sums of independent Poissons of at most ``PIECE``, so no power underflows. Copies are exploded
and shuffled globally: dealt to partitions by a hash of seed, doc_id and copy, and sorted by it inside them.

Null sources form a source of their own; null texts have size zero and a source without any bytes is weighted by its
rows. A null doc_id hashes like the empty string. Repeated rows are replicated alike. An empty table stays empty. Every
input column is kept; n_copies, copy and shuffle_key are added, and replace input columns of these names.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm.shared import materialize, table

PIECE = 8.0
TERMS = 64
SOURCES = 100_000  # rates that are broadcast at most; a rate takes under 1 KB
SALTS = 64


def hashed(*parts: Column) -> Column:
    """52 bits of MD5 of the parts, as a non-negative long."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 13), 16, 10).cast("long")


def source_rates(docs: DataFrame, source: str = "source", text: str = "text", weights: Mapping[str, float] | None = None, temperature: float = 2.0, repeat: float = 1.0) -> DataFrame:
    """Per source: rate of repetition. ``weights``: target share of each source (others: none); without it a source's
    share follows its size to the power 1/temperature. ``repeat``: size of the output relative to the input."""
    sizes = materialize(docs.groupBy(F.col(source).alias("__source")).agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0))).cast("double").alias("__bytes"), F.count("*").cast("double").alias("__rows")))
    if weights is None:
        target = F.pow("__bytes", F.lit(1.0 / temperature))
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        target = F.coalesce(F.try_element_at(F.create_map(*pairs), F.coalesce("__source", F.lit(""))), F.lit(0.0)) if pairs else F.lit(0.0)
    sizes = sizes.withColumn("__target", target)
    total = sizes.agg(F.sum("__bytes").alias("__all"), F.sum("__target").alias("__targets"))
    rate = F.when((F.col("__bytes") > 0) & (F.col("__targets") > 0), F.col("__target") / F.col("__targets") * F.col("__all") * F.lit(float(repeat)) / F.col("__bytes")).otherwise(F.lit(float(repeat)))
    return sizes.join(F.broadcast(total)).select("__source", rate.alias("__rate"))  # total is one row


def poisson_table(rates: DataFrame) -> DataFrame:
    """Adds the number of pieces of each rate and the cumulative distribution of one piece at 0 .. TERMS - 1."""
    piece = F.col("__rate") / F.col("__pieces")
    step = lambda acc, k: F.struct(
        (acc["p"] * piece / (k + 1)).alias("p"),
        (acc["c"] + acc["p"]).alias("c"),
        F.concat(acc["cdf"], F.array(acc["c"] + acc["p"])).alias("cdf"),
    )
    start = F.struct(F.exp(-piece).alias("p"), F.lit(0.0).alias("c"), F.array().cast("array<double>").alias("cdf"))
    return rates.withColumn("__pieces", F.greatest(F.ceil(F.col("__rate") / PIECE), F.lit(1)).cast("int")).withColumn("__cdf", F.aggregate(F.sequence(F.lit(0), F.lit(TERMS - 1)), start, step, lambda a: a["cdf"]))


def with_rates(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """Rows with their source's rate. Documents are not shuffled for it where all rates together are small; otherwise a
    source's rows are spread over SALTS keys, so that a source with a third of all rows fills no single task."""
    if rates.limit(SOURCES + 1).count() <= SOURCES:
        return rows.join(F.broadcast(rates), F.col("__of").eqNullSafe(F.col("__source")))
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64("__id", "__text"), F.lit(SALTS)).cast("int"))
    every = rates.withColumn("__salts", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(every, F.col("__of").eqNullSafe(F.col("__source")) & (F.col("__salt") == F.col("__salts")))


def mix(docs: DataFrame, source: str = "source", text: str = "text", id_col: str = "doc_id", weights: Mapping[str, float] | None = None, temperature: float = 2.0, repeat: float = 1.0, seed: int = 42) -> DataFrame:
    """Replicated and globally shuffled documents; see the module's text."""
    # whole rows travel as one struct, so no input column can clash with the columns added on the way
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.col(source).alias("__of"), F.col(text).alias("__text"), F.col(id_col).alias("__id"))
    rates = poisson_table(source_rates(rows, "__of", "__text", weights, temperature, repeat))
    s = F.lit(str(seed))
    uniform = lambda j: (hashed(s, j, F.col("__id")) + 0.5) / F.lit(float(1 << 52))
    below = F.aggregate(F.sequence(F.lit(1), F.col("__pieces")), F.lit(0), lambda acc, j: acc + F.size(F.filter("__cdf", lambda c: c < uniform(j))))
    counted = with_rates(rows, rates).withColumn("n_copies", below)
    copies = counted.where("n_copies > 0").select("__row", "__id", "n_copies", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy"))
    keyed = copies.withColumn("shuffle_key", hashed(s, F.lit("copy"), F.col("__id"), F.col("copy")))
    kept = [F.col(f"__row.`{c}`") for c in docs.columns if c not in ("n_copies", "copy", "shuffle_key")]
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key").select(*kept, "n_copies", "copy", "shuffle_key")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replicated and shuffled documents."""
    return mix(docs)


ORACLE_SQL = f"""
WITH RECURSIVE sizes AS (
  SELECT source, sum(coalesce(strlen(text), 0))::DOUBLE AS b FROM documents GROUP BY source),
total AS (SELECT sum(b) AS a, sum(pow(b, 0.5)) AS t FROM sizes),
rates AS (SELECT source, CASE WHEN b > 0 AND t > 0 THEN pow(b, 0.5) / t * a / b ELSE 1.0 END AS rate FROM sizes, total),
pieces AS (SELECT source, rate, greatest(ceil(rate / {PIECE}), 1)::INT AS m FROM rates),
cdf(source, m, lam, k, p, c) AS (
  SELECT source, m, rate / m, 0, exp(-(rate / m)), exp(-(rate / m)) FROM pieces
  UNION ALL SELECT source, m, lam, k + 1, p * lam / (k + 1), c + p * lam / (k + 1) FROM cdf WHERE k < {TERMS - 1}),
cdfs AS (SELECT source, m, list(c ORDER BY k) AS cs FROM cdf GROUP BY source, m),
u AS (
  SELECT d.*, cs, unnest(range(1, m + 1)) AS j FROM documents d JOIN cdfs ON d.source IS NOT DISTINCT FROM cdfs.source),
n AS (
  SELECT doc_id, text, lang, source, n_chars, sum(len(list_filter(cs, lambda x: x < (('0x' || substr(md5('42:' || j || ':' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5) / {float(1 << 52)})))::INT AS n_copies
  FROM u GROUP BY ALL),
x AS (SELECT *, unnest(range(1, n_copies + 1))::INT AS copy FROM n)
SELECT doc_id, text, lang, source, n_chars, n_copies, copy,
  ('0x' || substr(md5('42:copy:' || coalesce(doc_id::VARCHAR, '') || ':' || copy), 1, 13))::BIGINT AS shuffle_key
FROM x
"""
