"""Arrow-batched functions for JSON and interval operations that Spark SQL has no expression for."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf

from quernel.errors import BadInput
from quernel.functions.types import parse_interval


def dump(v: object) -> str:
    return json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def holds(a: object, b: object, top: bool = False) -> bool:
    """JSON containment: a contains b."""
    if isinstance(a, dict) and isinstance(b, dict):
        return all(k in a and holds(a[k], v) for k, v in b.items())
    if isinstance(a, list) and isinstance(b, list):
        return all(any(holds(x, y) for x in a) for y in b)
    if isinstance(a, list) and top:
        return any(holds(x, b) for x in a)
    return a == b and isinstance(a, bool) == isinstance(b, bool)


def minus(a: object, what: object) -> object:
    """Without a key, the equal strings, or the element at an index."""
    if isinstance(what, list):
        if isinstance(a, dict):
            return {k: v for k, v in a.items() if k != what[0]}
        return [x for x in a if x != what[0]] if isinstance(a, list) else a
    if isinstance(a, list):
        i = what + len(a) if what < 0 else what
        return [x for k, x in enumerate(a) if k != i]
    return a


def merge(a: object, b: object) -> object:
    if isinstance(a, dict) and isinstance(b, dict):
        return a | b
    return (a if isinstance(a, list) else [a]) + (b if isinstance(b, list) else [b])


def member(a: object, key: str) -> object:
    return a.get(key) if isinstance(a, dict) else None


def register(spark: SparkSession) -> None:
    """Registers the helpers in a session."""

    def pairwise(f):
        def run(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([None if x is None or y is None else f(json.loads(x), json.loads(y)) for x, y in zip(a, b, strict=True)], dtype=object)

        return run

    spark.udf.register("quernel_json_merge", pandas_udf(pairwise(lambda a, b: dump(merge(a, b))), "string"))
    spark.udf.register("quernel_json_minus", pandas_udf(pairwise(lambda a, b: dump(minus(a, b))), "string"))
    spark.udf.register("quernel_json_contains", pandas_udf(pairwise(lambda a, b: holds(a, b, True)), "boolean"))

    def get(a: pd.Series, k: pd.Series, text: pd.Series) -> pd.Series:
        out = []
        for x, key, t in zip(a, k, text, strict=True):
            v = None if x is None or key is None else member(json.loads(x), key)
            out.append(None if v is None else v if t and isinstance(v, str) else dump(v))
        return pd.Series(out, dtype=object)

    def interval(s: pd.Series) -> pd.DataFrame:
        got = []
        for x in s:
            try:
                got.append(parse_interval(x) if x is not None else (None, None, None))
            except BadInput as e:
                raise ValueError(f"22P02|{e}") from None
        return pd.DataFrame(got, columns=["months", "days", "micros"])

    spark.udf.register("quernel_json_get", pandas_udf(get, "string"))
    spark.udf.register("quernel_interval", pandas_udf(interval, "months int, days int, micros long"))
