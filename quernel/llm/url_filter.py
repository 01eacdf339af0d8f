"""URL filtering by rules, and by trust and distrust that spread over the host graph.

Rules have a host, a path prefix and an action; a rule fits its host and all subdomains where the url's path starts with
the rule's path; the longest rule decides. Pages without a rule are judged by their host: trust is personalised PageRank
along host links from hosts in proportion to the share of their pages that rules allow; distrust runs along the reversed
links from hosts in proportion to the share that rules block. A host is blocked when its distrust exceeds both its trust
and ``threshold`` of what a wholly blocked host has of itself.

All steps are DataFrame operations: links are counted for each pair of hosts before anything is shuffled by host, so a
host with a third of all pages costs no more than its distinct links; rules meet distinct hosts, not pages.

A null url, or one without ``://``, has empty host and path, fits no rule and is allowed by the method, which has no
evidence against it. Null html has no links. Null or repeated page_ids and repeated rows stay. Other columns are not read.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm.shared import materialize, table

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
LINK = r"""(?i)href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def with_host_path(df: DataFrame, url: str) -> DataFrame:
    """Adds __host and __path."""
    after = F.when(F.instr(url, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    raw = F.regexp_extract("__after", r"^[^/?#]*", 0)
    rest = F.expr("substring(__after, length(__raw) + 1)")
    return df.withColumn("__after", after).withColumn("__raw", raw).withColumn("__path", F.regexp_extract(rest, r"^[^?#]*", 0)).withColumn("__host", lower_ascii(F.col("__raw"))).drop("__after", "__raw")


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """For each distinct __host the rules that fit it, longest first."""
    parts = F.split("__host", r"\.", -1)
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    fits = hosts.select("__host", F.explode(tails).alias("__tail")).join(rules.select(lower_ascii(F.col("host")).alias("__tail"), "path", "action"), "__tail")
    rule = F.struct((-F.length(F.concat("__tail", "path"))).alias("o"), F.concat("__tail", "path").alias("rule"), "path", "action")
    return fits.groupBy("__host").agg(F.array_sort(F.collect_set(rule)).alias("__rules"))


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """src, dst, n: links between different hosts, counted."""
    linked = with_host_path(pages.select(url, html), url).select(F.col("__host").alias("src"), F.explode(F.regexp_extract_all(F.col(html), F.lit(LINK), 1)).alias("dst"))
    return linked.withColumn("dst", lower_ascii(F.col("dst"))).where("src != '' and src != dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int, damping: float, cut: int = 4) -> DataFrame:
    """__host, trust, distrust after ``rounds`` rounds from seeds (__host, trust, distrust)."""
    out, into = edges.groupBy("src").agg(F.sum("n").alias("w")), edges.groupBy("dst").agg(F.sum("n").alias("w"))
    along = edges.join(out, "src").select(F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("n") / F.col("w")).alias("t"), F.lit(0.0).alias("d"))
    back = edges.join(into, "dst").select(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit(0.0).alias("t"), (F.col("n") / F.col("w")).alias("d"))
    flow = materialize(along.unionAll(back))
    base = seeds.select("__host", ((1 - damping) * F.col("trust")).alias("trust"), ((1 - damping) * F.col("distrust")).alias("distrust"))
    state = base
    if flow.limit(1).count() == 0:
        return state
    for i in range(rounds):
        moved = state.join(flow, state["__host"] == flow["a"]).groupBy("b").agg((damping * F.sum(F.col("trust") * F.col("t"))).alias("trust"), (damping * F.sum(F.col("distrust") * F.col("d"))).alias("distrust"))
        state = base.unionAll(moved).groupBy("__host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        if i % cut == cut - 1:
            state = materialize(state)
    return state


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url", html: str = "html", id_col: str = "page_id", rounds: int = 12, damping: float = 0.85, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule and verdict of every page, with its host's trust and distrust."""
    spark = pages.sparkSession
    listed = spark.createDataFrame(list(rules), "host string, path string, action string")
    parsed = with_host_path(pages.select(F.col(id_col).alias("page_id"), url), url)
    hosts = parsed.groupBy("__host").agg(F.count("*").alias("pages"))
    fitting = materialize(hosts.join(host_rules(hosts.select("__host"), listed), "__host", "left"))
    ruled = parsed.join(fitting, "__host", "left").withColumn("__rule", F.get(F.filter("__rules", lambda r: F.startswith(F.col("__path"), r["path"])), 0))
    share = lambda action: F.count_if(F.col("__rule.action") == action) / F.count("*")
    seeds = ruled.where("__host != ''").groupBy("__host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    ranks = propagate(materialize(links(pages, url, html)), materialize(seeds), rounds, damping)
    judged = fitting.join(ranks, "__host", "left").na.fill(0.0, ["trust", "distrust"])
    bad = (F.col("distrust") > F.col("trust")) & (F.col("distrust") > threshold * (1 - damping))
    judged = judged.select("__host", "__rules", "trust", "distrust", F.when(bad, "block").otherwise("allow").alias("__by_host"))
    final = parsed.join(judged, "__host", "left").withColumn("__rule", F.get(F.filter("__rules", lambda r: F.startswith(F.col("__path"), r["path"])), 0))
    return final.select("page_id", F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule.rule").alias("rule"), F.coalesce("__rule.action", "__by_host").alias("verdict"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def _sql(rounds: int = 12, damping: float = 0.85, threshold: float = 0.5) -> str:
    rules = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in RULES)
    steps = ["s0 AS (SELECT * FROM base)"]
    for i in range(rounds):
        steps.append(f"""s{i + 1} AS (SELECT h, sum(t) AS t, sum(d) AS d FROM (SELECT * FROM base UNION ALL
          SELECT e.dst, {damping} * s.t * e.n / e.w, 0.0 FROM eo e JOIN s{i} s ON s.h = e.src UNION ALL
          SELECT e.src, 0.0, {damping} * s.d * e.n / e.w FROM ei e JOIN s{i} s ON s.h = e.dst) GROUP BY h)""")
    return rf"""
WITH a AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS a FROM pages),
p AS (SELECT page_id, html, translate(regexp_extract(a, '^[^/?#]*'), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS h,
  regexp_extract(substr(a, length(regexp_extract(a, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM a),
rules(rh, rp, action) AS (VALUES {rules}),
k AS (SELECT DISTINCT h, path FROM p),
m AS (SELECT h, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(action, length(rh || rp)) AS action FROM k
  JOIN rules ON (h = rh OR ends_with(h, '.' || rh)) AND starts_with(path, rp) GROUP BY h, path),
r AS (SELECT p.page_id, p.h, p.path, m.rule, m.action FROM p LEFT JOIN m ON p.h = m.h AND p.path = m.path),
base AS (SELECT h, {1 - damping} * (count(*) FILTER (action = 'allow') / count(*)) AS t, {1 - damping} * (count(*) FILTER (action = 'block') / count(*)) AS d FROM r WHERE h != '' GROUP BY h),
l AS (SELECT h AS src, translate(unnest(regexp_extract_all(html, '{LINK.replace("'", "''")}', 1)), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS dst FROM p),
e AS (SELECT src, dst, count(*)::DOUBLE AS n FROM l WHERE src != '' AND src != dst GROUP BY src, dst),
eo AS (SELECT *, sum(n) OVER (PARTITION BY src) AS w FROM e),
ei AS (SELECT *, sum(n) OVER (PARTITION BY dst) AS w FROM e),
{", ".join(steps)}
SELECT r.page_id, r.h AS host, r.path, r.rule,
  coalesce(r.action, CASE WHEN s.d > s.t AND s.d > {threshold * (1 - damping)} THEN 'block' ELSE 'allow' END) AS verdict
FROM r LEFT JOIN s{rounds} s ON s.h = r.h
"""


ORACLE_SQL = _sql()
