"""Constraint probes: NOT NULL and CHECK in one aggregate, keys as grouped counts, references as anti joins."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.catalog import Constraint, Table
from quernel.errors import Violation
from quernel.functions.types import q
from quernel.plans.lower import Lower, Rel, Scope


def scope_of(t: Table, alias: str | None = None) -> Scope:
    return Scope([Rel(alias or t.name, [(c.name, c.t) for c in t.cols])])


def check_rows(engine, t: Table, rows: DataFrame) -> None:
    """NOT NULL and CHECK constraints of new rows."""
    s, tests = scope_of(t), []
    for c in t.cols:
        if c.not_null:
            tests.append((f"count_if({q(c.name)} IS NULL)", "23502", f"null value in column {c.name!r} of relation {t.name!r} violates not-null constraint"))
    for k in t.constraints:
        if k.kind == "check":
            tests.append((f"count_if(NOT ({Lower(engine).condition(k.expr, s)}))", "23514", f"check constraint {k.name!r} is violated by some row"))
    if tests:
        got = rows.alias(t.name).agg(*[F.expr(x).alias(f"v{i}") for i, (x, _, _) in enumerate(tests)]).collect()[0]
        for n, (_, code, message) in zip(got, tests, strict=True):
            if n:
                raise Violation(message, code)


def key_columns(engine, t: Table, k: Constraint) -> list[str]:
    """Spark text of a unique constraint's key parts."""
    s = scope_of(t)
    return [Lower(engine).ex(e, s).sql for e in k.exprs] if k.exprs else [f"{q(t.name)}.{q(c)}" for c in k.cols]


def keyed(engine, t: Table, k: Constraint, rows: DataFrame, all_rows: bool = False) -> DataFrame:
    """Rows that the constraint binds, with key columns __k0, ...; a null key part binds nothing. ``all_rows``: the others
    too, with a null key part."""
    parts = key_columns(engine, t, k)
    df = rows.alias(t.name)
    if k.predicate is not None:
        held = Lower(engine).condition(k.predicate, scope_of(t))
        parts = [f"CASE WHEN {held} THEN {p} END" for p in parts]
    df = df.select("*", *[F.expr(p).alias(f"__k{i}") for i, p in enumerate(parts)])
    return df if all_rows else df.dropna(subset=[f"__k{i}" for i in range(len(parts))])


def uniques(t: Table) -> list[Constraint]:
    return [k for k in t.constraints if k.kind in ("primary", "unique")]


def check_keys(engine, t: Table, version: DataFrame, rows: DataFrame, sure: Iterable[Constraint] = ()) -> None:
    """No key of ``rows`` occurs twice in the new ``version``, which holds them; ``sure``: constraints that hold already."""
    for k in uniques(t):
        if k not in sure:
            keys = [f"__k{i}" for i in range(len(k.exprs or k.cols))]
            touched = keyed(engine, t, k, rows).select(*keys)
            of = keyed(engine, t, k, version).select(*keys)
            _refuse(k, of.join(touched, keys, "left_semi").groupBy(*keys).count().where("count > 1").limit(1).collect())


def check_new_keys(engine, t: Table, old: DataFrame, rows: DataFrame) -> None:
    """No key of added ``rows`` occurs twice in them, or in the ``old`` rows."""
    for k in uniques(t):
        keys = [f"__k{i}" for i in range(len(k.exprs or k.cols))]
        new = keyed(engine, t, k, rows).select(*keys)
        twice = new.groupBy(*keys).count().where("count > 1").select(*keys)
        known = keyed(engine, t, k, old).select(*keys).join(new, keys, "left_semi")
        _refuse(k, twice.unionAll(known).limit(1).collect())


def _refuse(k: Constraint, found: list) -> None:
    if found:
        key = tuple(found[0])[: len(k.exprs or k.cols)]
        raise Violation(f"duplicate key value violates unique constraint {k.name!r}: {key}", "23505")


def check_references(engine, t: Table, rows: DataFrame) -> None:
    """Every non-null reference of ``rows`` exists."""
    for k in t.constraints:
        if k.kind != "foreign":
            continue
        parent = engine.state.get(*k.table, "table")
        left = rows.select(*[F.col(q(c)).alias(f"__k{i}") for i, c in enumerate(k.cols)]).dropna()
        right = parent.df.select(*[F.col(q(c)).alias(f"__k{i}") for i, c in enumerate(k.ref)])
        if left.join(right, [f"__k{i}" for i in range(len(k.cols))], "left_anti").limit(1).collect():
            raise Violation(f"insert or update on table {t.name!r} violates foreign key constraint {k.name!r}", "23503")
