"""Data changes: each computes the table's next immutable version and the rows it affected."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernel.catalog import Column, Constraint, Table
from quernel.errors import ColumnNotFound, QueryError, SyntaxProblem, Violation
from quernel.functions.types import E, cast, lit, q, spark_type
from quernel.operators import constraints as ck
from quernel.operators.rows import RID, with_rids, written
from quernel.plans.lower import Lower, Query, Rel, Scope, dedupe
from quernel.plans.nodes import Node

DEPTH = 6  # changes after which a table's version is written out


def repeatable(*texts: str) -> bool:
    """Whether expressions give the same values whenever they are evaluated: they read only their own row, no clock and no
    registered function."""
    return not any(re.search(r"\bSELECT\b|quernel_(fn|op)_|\b(current_|local|now|rand|uuid|shuffle|monotonically)", x) for x in texts)


class Changes:
    """Data changes of one engine."""

    def __init__(self, engine) -> None:
        self.engine = engine

    def target(self, name: tuple[str | None, str]) -> Table:
        if name[0] in ("pg_catalog", "information_schema") or name[0] is None and self.engine.is_system(name[1]):
            raise QueryError(f"permission denied: {name[1]!r} is a system catalog", "42501")
        t = self.engine.state.get(*name, "table")
        if t.readonly:
            raise QueryError(f"table {t.name!r} is attached read-only", "25006")
        return t

    def low(self, params, ctes) -> Lower:
        return Lower(self.engine, params, ctes)

    def store(self, t: Table, df: DataFrame, affected: DataFrame | None) -> None:
        depth = t.depth + 1
        if depth >= DEPTH:
            df, depth = written(df), 0
        self.engine.save(t, df, depth)

    # ---- insert

    def insert(self, n: Node, params, ctes) -> tuple[Table, DataFrame, DataFrame]:
        t = self.target(n.table)
        names = n.cols or [c.name for c in t.cols]
        for c in names:
            col = t.col(c)
            if col is None:
                raise ColumnNotFound(f"column {c!r} of relation {t.name!r} does not exist")
        if len(set(names)) < len(names):
            raise SyntaxProblem("a column is specified more than once", "42701")
        rows = self.new_rows(t, n, names, params, ctes)
        if n.conflict is not None:
            return self.upsert(t, n, rows, params, ctes)
        version = t.df.unionByName(rows)
        self.verify(t, version, rows, added=True)
        self.store(t, version, rows)
        return t, rows, rows

    def verify(self, t: Table, version: DataFrame, rows: DataFrame, sure: Iterable[Constraint] = (), added: bool = False) -> None:
        """Checks ``rows`` of a new version of a table; ``added``: the version is the old rows and these."""
        ck.check_rows(self.engine, t, rows)
        if added:
            ck.check_new_keys(self.engine, t, t.df, rows)
        else:
            ck.check_keys(self.engine, t, version, rows, sure)
        saved = self.engine.state.rels[t.key]
        self.engine.state.rels[t.key] = t.with_(df=version)  # a row may refer to one of its own statement
        try:
            ck.check_references(self.engine, t, rows)
        finally:
            self.engine.state.rels[t.key] = saved

    def given(self, c: Column, n: Node) -> bool:
        """Whether an explicit value for the column counts."""
        if c.generated is not None:
            raise QueryError(f"cannot insert a non-DEFAULT value into column {c.name!r}", "428C9")
        if c.identity == "always" and n.overriding != "system":
            if n.overriding == "user":
                return False
            raise QueryError(f"cannot insert a non-DEFAULT value into column {c.name!r}", "428C9")
        return not (c.identity and n.overriding == "user")

    def new_rows(self, t: Table, n: Node, names: list[str], params, ctes) -> DataFrame:
        """The statement's rows with every column of the table, evaluated once."""
        low, cols = self.low(params, ctes), [t.col(c) for c in names]
        source = n.source
        while source.kind == "nested":
            source = source.body
        if source.kind == "values":
            return self.literal_rows(t, n, source, cols, low)
        b = low.query(source)
        if len(b.cols) > len(cols) or n.cols and len(b.cols) < len(cols):
            raise SyntaxProblem("INSERT has more expressions than target columns" if len(b.cols) > len(cols) else "INSERT has more target columns than expressions")
        used = [(i, c) for i, c in enumerate(cols[: len(b.cols)]) if self.given(c, n)]
        lits = [low.literal_column(source, i) if source.kind == "select" else False for i in range(len(b.cols))]
        cells = [f"{cast(E(q(b.cols[i][0]), b.cols[i][1], literal=False), c.t, implicit=not lits[i]).sql} AS {q(c.name)}" for i, c in used]
        rows = self.engine.run(f"SELECT {', '.join(cells) or '1 AS __none'} FROM ({b.sql})")
        return self.completed(t, rows, {c.name for _, c in used}, low)

    def literal_rows(self, t: Table, n: Node, source: Node, cols: list[Column], low: Lower) -> DataFrame:
        """Rows of VALUES: one local query, however many rows."""
        texts, s = [], Scope()
        width = max((len(r) for r in source.rows), default=0)
        if any(len(r) != width for r in source.rows):
            raise SyntaxProblem("VALUES lists must all be the same length")
        if width > len(cols) or n.cols and width < len(cols):
            raise SyntaxProblem("INSERT has more expressions than target columns" if width > len(cols) else "INSERT has more target columns than expressions")
        numbers = [c for c in t.cols if c.sequence]
        for r in source.rows:
            values: dict[str, str] = {}
            for c, e in zip(cols, r, strict=False):
                if e.kind == "default" or not self.given(c, n):
                    continue
                low.typed_param(e, c.t)
                values[c.name] = cast(low.ex(e, s), c.t).sql
            for c in numbers:
                if c.name not in values:
                    values[c.name] = str(self.engine.next_value(c.sequence))
            for c in t.cols:
                if c.name not in values and c.generated is None:
                    values[c.name] = cast(low.ex(c.default, s), c.t).sql if c.default is not None else "NULL"
            texts.append("SELECT " + ", ".join(f"CAST({values[c.name]} AS {spark_type(c.t)}) AS {q(c.name)}" for c in t.cols if c.generated is None))
        df = self.engine.run(" UNION ALL ".join(texts))
        local = df.collect()  # as many rows as the statement spells out
        rows = with_rids(self.engine.spark.createDataFrame(local, df.schema).coalesce(1))
        return self.generated(t, rows, low)

    def completed(self, t: Table, rows: DataFrame, have: set[str], low: Lower) -> DataFrame:
        """Adds defaults, sequence numbers and row identities, and writes the rows: each value is made once."""
        missing = [c for c in t.cols if c.name not in have and c.generated is None]
        numbers = [c for c in missing if c.sequence]
        rows = self.numbers(written(rows), [(c, c.sequence) for c in numbers]) if numbers else rows
        for c in missing:
            if not c.sequence:
                e = cast(low.ex(c.default, Scope()), c.t).sql if c.default is not None else "NULL"
                rows = rows.withColumn(c.name, F.expr(f"CAST({e} AS {spark_type(c.t)})"))
        return written(self.generated(t, with_rids(rows.drop("__none")), low))

    def numbers(self, rows: DataFrame, columns: list[tuple[Column, tuple[str, str]]]) -> DataFrame:
        """Written rows with a next value of a sequence in each of these columns."""
        for c, sequence in columns:
            rows = self.engine.next_values(rows, c.name, sequence).withColumn(c.name, F.col(q(c.name)).cast(spark_type(c.t)))
        return rows

    def generated(self, t: Table, rows: DataFrame, low: Lower) -> DataFrame:
        s, out = ck.scope_of(t), rows.alias(t.name)
        cells = []
        for c in t.cols:
            if c.generated is not None:
                cells.append(F.expr(cast(low.ex(c.generated, s), c.t).sql).cast(spark_type(c.t)).alias(c.name))
            else:
                cells.append(F.col(f"{q(t.name)}.{q(c.name)}"))
        return out.select(*cells, RID)

    def arbiters(self, t: Table, c: Node) -> list[Constraint]:
        """The unique constraints that ON CONFLICT names."""
        if c.constraint:
            got = [k for k in ck.uniques(t) if k.name == c.constraint]
        elif c.target:
            want = [e.name if e.kind == "ref" else repr(e) for e in c.target]
            got = [k for k in ck.uniques(t) if sorted([e.name if e.kind == "ref" else repr(e) for e in k.exprs] if k.exprs else k.cols) == sorted(want)]
        else:
            if c.action == "update":
                raise SyntaxProblem("ON CONFLICT DO UPDATE requires inference specification or constraint name")
            return ck.uniques(t)
        if not got:
            raise QueryError("there is no unique or exclusion constraint matching the ON CONFLICT specification", "42P10")
        return got[:1]

    def upsert(self, t: Table, n: Node, rows: DataFrame, params, ctes) -> tuple[Table, DataFrame, DataFrame]:
        keys = self.arbiters(t, n.conflict)
        if n.conflict.action == "nothing":
            fresh = rows
            for k in keys:
                names = [f"__k{i}" for i in range(len(k.exprs or k.cols))]
                first = F.row_number().over(Window.partitionBy(*names).orderBy(RID)) == 1
                unbound = F.array_contains(F.array(*[F.col(x).isNull() for x in names]), True)
                mine = ck.keyed(self.engine, t, k, fresh, all_rows=True).withColumn("__first", first | unbound).where("__first")
                fresh = mine.join(ck.keyed(self.engine, t, k, t.df).select(*names), names, "left_anti").select(*rows.columns)
            fresh = written(fresh)
            version = t.df.unionByName(fresh)
            self.verify(t, version, fresh, keys)
            self.store(t, version, fresh)
            return t, fresh, fresh
        (k,), low, alias = keys, self.low(params, ctes), n.alias or t.name
        names = [f"__k{i}" for i in range(len(k.exprs or k.cols))]
        mine = ck.keyed(self.engine, t, k, rows)
        if mine.groupBy(*names).count().where("count > 1").limit(1).collect():
            raise QueryError("ON CONFLICT DO UPDATE command cannot affect row a second time", "21000")
        s = Scope([Rel(alias, [(x.name, x.t) for x in t.cols]), Rel("excluded", [(x.name, x.t) for x in t.cols])])
        s.merged = {x.name: (f"{q(alias)}.{q(x.name)}", x.t) for x in t.cols}
        where = low.condition(n.conflict.where, s) if n.conflict.where is not None else "true"
        sets, numbers = self.setters(t, n.conflict.sets, low, s)
        both = ck.keyed(self.engine, t, k, t.df).alias(alias).join(mine.alias("excluded"), [F.col(f"{q(alias)}.{x}") == F.col(f"excluded.{x}") for x in names])
        old = {x.name: f"{q(alias)}.{q(x.name)}" for x in t.cols}
        cells = [F.expr((f"CASE WHEN {where} THEN {sets[x]} ELSE {c} END" if x in sets else c) + f" AS {q(x)}") for x, c in old.items()]
        # each new row that meets an old one, whether WHERE changes that, and how
        met = written(both.select(*cells, F.col(f"{q(alias)}.{RID}").alias(RID), F.col(f"excluded.{RID}").alias("__new"), F.expr(where).alias("__do")))
        fresh = rows.join(met.select(F.col("__new").alias(RID)), RID, "left_anti").select(*rows.columns)
        changed = met.where("__do").drop("__new", "__do")
        if numbers:
            changed = written(self.numbers(written(changed), numbers))
        changed = self.generated(t, changed, low)
        version = t.df.join(changed.select(RID), RID, "left_anti").select(*t.df.columns).unionByName(changed).unionByName(fresh)
        affected = changed.unionByName(fresh)
        self.verify(t, version, affected, [k] if k.cols and not set(k.cols) & set(sets) and k.predicate is None else [])
        self.cascade_update(t, changed, version)
        self.store(t, version, affected)
        return t, affected, affected

    # ---- update

    def setters(self, t: Table, sets: list[tuple[str, Node]], low: Lower, s: Scope) -> tuple[dict[str, str], list[tuple[Column, tuple[str, str]]]]:
        """The new value of each column that is set, and the columns that take the next value of a sequence in each row."""
        out, numbers = {}, []
        for name, e in sets:
            c = t.col(name)
            if c is None:
                raise ColumnNotFound(f"column {name!r} of relation {t.name!r} does not exist")
            if c.generated is not None and e.kind != "default":
                raise QueryError(f"column {name!r} can only be updated to DEFAULT", "428C9")
            sequence = c.sequence if e.kind == "default" else self.engine.definitions.nextval_of(e)
            if sequence:
                numbers.append((c, sequence))
                out[name] = f"CAST(NULL AS {spark_type(c.t)})"
                continue
            if e.kind == "default":
                e = c.default or Node("null")
            low.typed_param(e, c.t)
            x = low.ex(e, s)
            out[name] = f"CAST({cast(x, c.t, implicit=not x.literal).sql} AS {spark_type(c.t)})"
        return out, numbers

    def update(self, n: Node, params, ctes) -> tuple[Table, DataFrame, DataFrame]:
        t, low = self.target(n.table), self.low(params, ctes)
        alias = n.alias or t.name
        s = low.sources(n.sources or [], None)
        low.add(s, alias, [(c.name, c.t) for c in t.cols])
        where = low.condition(n.where, s) if n.where is not None else "true"
        sets, numbers = self.setters(t, n.sets, low, s)
        cells = [f"{sets.get(c.name, f'{q(alias)}.{q(c.name)}')} AS {q(c.name)}" for c in t.cols]
        own = f"{t.view} AS {q(alias)}"
        direct = not s.sql and not numbers and all(c.generated is None for c in t.cols) and repeatable(where, *sets.values())
        extra = [f"{q(r.alias)}.{q(c)} AS {q(f'__f_{r.alias}_{c}')}" for r in s.rels if r.alias != alias for c, _ in r.cols]
        source = f"{s.sql} CROSS JOIN {own}" if s.sql else own
        found = self.engine.run(f"SELECT {', '.join([*cells, *extra])}, {q(alias)}.{RID} FROM {source} WHERE {where}")
        if s.sql:  # a row that several match takes one of them
            found = found.dropDuplicates([RID])
        found = written(found)
        if numbers:
            found = written(self.numbers(found, numbers))
        changed = self.generated(t, found, low)
        if direct:  # one projection of the table; a join on row identities only where the new values cannot be told again
            new = [f"CASE WHEN {where} THEN {sets[c.name]} ELSE {q(alias)}.{q(c.name)} END AS {q(c.name)}" if c.name in sets else f"{q(alias)}.{q(c.name)}" for c in t.cols]
            version = self.engine.run(f"SELECT {', '.join(new)}, {q(alias)}.{RID} FROM {own}")
        else:
            version = t.df.join(changed.select(RID), RID, "left_anti").select(*t.df.columns).unionByName(changed)
        self.verify(t, version, changed)
        self.cascade_update(t, changed, version)
        self.store(t, version, changed)
        return t, changed, found

    # ---- delete

    def delete(self, n: Node, params, ctes) -> tuple[Table, DataFrame, DataFrame]:
        t, low = self.target(n.table), self.low(params, ctes)
        alias = n.alias or t.name
        s = low.sources(n.sources or [], None)
        low.add(s, alias, [(c.name, c.t) for c in t.cols])
        where = low.condition(n.where, s) if n.where is not None else "true"
        own = f"{t.view} AS {q(alias)}"
        source = f"{s.sql} CROSS JOIN {own}" if s.sql else own
        gone = self.engine.run(f"SELECT {q(alias)}.* FROM {source} WHERE {where}")
        if not s.sql and repeatable(where):
            left = self.engine.run(f"SELECT {q(alias)}.* FROM {own} WHERE NOT coalesce({where}, false)")
            self.remove(t, gone, left)
            return t, gone, gone
        if s.sql:
            gone = gone.dropDuplicates([RID])
        gone = written(gone)
        self.remove(t, gone)
        return t, gone, gone

    def remove(self, t: Table, gone: DataFrame, left: DataFrame | None = None) -> None:
        """Drops rows, and does what references to them ask for. ``left``: the other rows, if known."""
        t = self.engine.state.get(*t.key, "table")
        version = left if left is not None else t.df.join(gone.select(RID), RID, "left_anti").select(*t.df.columns)
        self.store(t, version, gone)
        self.cascade(t, gone, version, "on_delete")

    def truncate(self, n: Node) -> None:
        todo, emptied = [self.target(name) for name in n.tables], {}
        while todo:
            t = todo.pop()
            emptied[t.key] = t
            todo += [c for c, _ in self.referrers(t) if n.cascade and c.key not in emptied]
        if any(c.key not in emptied for t in emptied.values() for c, _ in self.referrers(t)):
            raise QueryError("cannot truncate a table referenced in a foreign key constraint", "0A000")
        for t in emptied.values():
            self.store(t, t.df.limit(0), None)
            for c in t.cols:
                if n.restart and c.sequence:
                    self.engine.reset(c.sequence)

    # ---- references

    def referrers(self, t: Table) -> list[tuple[Table, Constraint]]:
        return [(c, k) for c in self.engine.state.tables() for k in c.constraints if k.kind == "foreign" and k.table == t.key]

    def cascade_update(self, t: Table, changed: DataFrame, version: DataFrame) -> None:
        if not self.referrers(t):
            return
        old = t.df.join(changed.select(RID), RID, "left_semi").select(*t.df.columns)
        self.cascade(t, written(old), version, "on_update", changed)

    def cascade(self, t: Table, old: DataFrame, version: DataFrame, what: str, changed: DataFrame | None = None) -> None:
        for child, k in self.referrers(t):
            child = self.engine.state.get(*child.key, "table")
            names = [f"__k{i}" for i in range(len(k.ref))]
            lost = old.select(*[F.col(q(c)).alias(x) for c, x in zip(k.ref, names, strict=True)], F.col(RID).alias("__parent")).dropna()
            left = version.select(*[F.col(q(c)).alias(x) for c, x in zip(k.ref, names, strict=True)])
            lost = lost.join(left, names, "left_anti")
            kids = child.df.select("*", *[F.col(q(c)).alias(x) for c, x in zip(k.cols, names, strict=True)]).join(lost, names)
            action = getattr(k, what)
            if action in ("no action", "restrict"):
                if kids.limit(1).collect():
                    raise Violation(f"update or delete on table {t.name!r} violates foreign key constraint {k.name!r} on table {child.name!r}", "23503")
                continue
            kids = written(kids)
            if not kids.limit(1).collect():
                continue
            if action == "cascade" and what == "on_delete":
                self.remove(child, kids.select(*child.df.columns))
                continue
            if action == "cascade":
                new = changed.select(F.col(RID).alias("__parent"), *[F.col(q(c)).alias(f"__v{i}") for i, c in enumerate(k.ref)])
                kids = kids.join(new, "__parent")
            cells = []
            for c in child.cols:
                if c.name in k.cols:
                    i = k.cols.index(c.name)
                    default = cast(Lower(self.engine).ex(c.default, Scope()), c.t).sql if c.default is not None and action == "set default" else "NULL"
                    cells.append(F.col(f"__v{i}").alias(c.name) if action == "cascade" else F.expr(f"CAST({default} AS {spark_type(c.t)})").alias(c.name))
                else:
                    cells.append(F.col(q(c.name)))
            moved = written(kids.select(*cells, RID))
            new_version = child.df.join(moved.select(RID), RID, "left_anti").select(*child.df.columns).unionByName(moved)
            ck.check_rows(self.engine, child, moved)
            ck.check_keys(self.engine, child, new_version, moved)
            self.cascade_update(child, moved, new_version)
            self.store(child, new_version, moved)
            if action == "set default":
                ck.check_references(self.engine, self.engine.state.get(*child.key, "table"), moved)

    # ---- RETURNING

    def returned(self, n: Node, t: Table, affected: DataFrame, found: DataFrame, params, ctes) -> Query | None:
        if not n.returning:
            return None
        low, alias = self.low(params, ctes), n.alias or t.name
        view = self.engine.view_of(found if n.kind == "update" else affected)
        s = Scope([Rel(alias, [(c.name, c.t) for c in t.cols])])
        source = f"{view} AS {q(alias)}"
        if n.kind == "update" and n.sources:
            probe = low.sources(n.sources, None)
            moved = [(r.alias, r.cols) for r in probe.rels]
            flat = ", ".join([*(f"{q(c.name)}" for c in t.cols)])
            structs = ", ".join("named_struct(" + ", ".join(f"{lit(c)}, {q(f'__f_{a}_{c}')}" for c, _ in cols) + f") AS {q(a)}" for a, cols in moved)
            source = f"(SELECT named_struct({', '.join(f'{lit(c.name)}, {q(c.name)}' for c in t.cols)}) AS {q(alias)}, {structs} FROM {view})" if moved else f"(SELECT {flat} FROM {view}) AS {q(alias)}"
            s.rels += [Rel(a, cols) for a, cols in moved]
        items = low.items(n.returning, s, True)
        names = dedupe([e.name for e in items])
        text = ", ".join(f"{e.sql} AS {q(x)}" for e, x in zip(items, names, strict=True))
        return Query(f"SELECT {text} FROM {source}", [(x, e.t) for x, e in zip(names, items, strict=True)])
