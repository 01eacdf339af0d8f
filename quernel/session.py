"""The engine: statements in, rows or DataFrames out, over one Spark session and an immutable catalog state."""

from __future__ import annotations

import datetime
import decimal
import json
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.catalog import Column, Constraint, Enum, Sequence, State, Table, View
from quernel.errors import AlreadyExists, CastProblem, NoFunction, NotSupported, QueryError, RelationNotFound, SyntaxProblem, TypeMismatch, from_spark
from quernel.functions import helpers
from quernel.functions.types import BIGINT, NUMBERS, SYNONYMS, TEXT, E, T, cast, from_spark_type, lit, literal, q, spark_type
from quernel.operators.ddl import Definitions
from quernel.operators.dml import Changes
from quernel.operators.rows import RID, numbered, with_rids, written
from quernel.plans.lower import Lower, Query
from quernel.plans.nodes import Node, rewrite
from quernel.plans.parser import parse
from quernel.sources import catalogs

CONF = {"spark.sql.ansi.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.caseSensitive": "true", "spark.sql.adaptive.enabled": "true"}


@dataclass
class Result:
    """What one statement gave."""

    command: str
    row_count: int
    fields: list[tuple[str, str]]
    rows: list[dict]


@dataclass
class Function:
    """A registered function: argument types, result type and the Spark name of its implementation."""

    name: str
    args: tuple[T, ...]
    returns: T
    spark: str
    strict: bool = True
    variadic: T | None = None


@dataclass
class SqlFunction:
    """A function whose body is one query."""

    name: str
    args: list[tuple[str | None, Node]]
    body: Node
    returns: Node | None = None
    table: list[tuple[str, Node]] | None = None

    def arguments(self, engine) -> list[tuple[str | None, T]]:
        return [(n, engine.type(t)) for n, t in self.args]

    def result(self, engine) -> T:
        return engine.type(self.returns)

    def columns(self, engine) -> list[tuple[str, T]]:
        return [(n, engine.type(t)) for n, t in self.table]


class Engine:
    """``query``/``many``/``one``/``none`` run scripts; ``sql`` gives a lazy DataFrame; the rest manages the catalog.

    A new Spark session (sharing the context) keeps the engine's settings and temporary views to itself.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark.newSession()
        for k, v in CONF.items():
            self.spark.conf.set(k, v)
        self.spark.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
        helpers.register(self.spark)
        self.state = State()
        self.stack: list[State] = []
        self.changes, self.definitions = Changes(self), Definitions(self)
        self.functions: dict[str, list[Function]] = {}
        self.sql_functions: dict[str, list[SqlFunction]] = {}
        self.operators: dict[str, list[Function]] = {}
        self.equivalents: dict[str, T] = {}
        self.languages: dict[str, Callable] = {}
        self.extensions: dict[str, Callable] = {}
        self.installed: set[str] = set()
        self.handlers: dict[str, list[Callable]] = {}
        self.interceptors: list[Callable] = []
        self.last_sequence: tuple[str, str] | None = None
        self.touched: set[tuple[str, str]] = set()
        self.later: dict[str, str] = {}

    # ---- running

    def run(self, sql: str) -> DataFrame:
        try:
            return self.spark.sql(sql)
        except PySparkException as e:
            raise from_spark(e) from e

    def collect(self, df: DataFrame) -> list[tuple]:
        try:
            return df.collect()
        except Exception as e:
            if isinstance(e, QueryError):
                raise
            raise from_spark(e) from e

    def sql(self, text: str, args: list | None = None) -> DataFrame:
        """The last query of a script as a lazy DataFrame; what stands before runs."""
        *before, last = parse(text)
        for n in before:
            self.execute(n, args)
        return self.frame(last, args)

    def frame(self, n: Node, args: list | None = None) -> DataFrame:
        b, _ = self.compiled(n, args)
        return self.run(b.sql).select(*[F.col(q(c)) for c, _ in b.cols]) if b.cols else self.run(b.sql)

    def compiled(self, n: Node, args: list | None) -> tuple[Query, str]:
        """A query's text; data changes in it run, and give their RETURNING."""
        ctes: dict[str, Query] = {}
        if n.kind == "with":
            before = self.state.copy()
            changing = [c for c in n.ctes if c.body.kind in ("insert", "update", "delete")]
            if changing:
                plain = [c for c in n.ctes if c not in changing]
                results = {}
                for c in changing:
                    body = Node("with", ctes=plain, body=c.body) if plain else c.body
                    got = self.changed(body, args)
                    if got is not None:
                        results[c.name] = self.renamed(got, c.cols)
                ctes = results
            if n.body.kind in ("insert", "update", "delete"):
                got = self.changed(Node("with", ctes=[c for c in n.ctes if c not in changing], body=n.body), args, ctes)
                return (got or Query("SELECT 1 AS none WHERE false", [])), n.body.kind
            after, self.state = self.state, before if changing else self.state
            try:
                return Lower(self, args, ctes).query(n), "select"
            finally:
                self.state = after
        if n.kind in ("insert", "update", "delete"):
            return (self.changed(n, args) or Query("SELECT 1 AS none WHERE false", [])), n.kind
        return Lower(self, args).query(n), "select"

    @staticmethod
    def renamed(b: Query, cols: list[str] | None) -> Query:
        names = Lower.renamed([c for c, _ in b.cols], cols)
        return Query(f"(SELECT {', '.join(f'{q(c)} AS {q(x)}' for (c, _), x in zip(b.cols, names, strict=True))} FROM ({b.sql}))", [(x, t) for x, (_, t) in zip(names, b.cols, strict=True)])

    def changed(self, n: Node, args, ctes: dict[str, Query] | None = None) -> Query | None:
        """Runs a data change; the text of its RETURNING."""
        ctes = dict(ctes or {})
        if n.kind == "with":
            low = Lower(self, args, ctes)
            for c in n.ctes:
                b = low.query(Node("with", ctes=[x for x in n.ctes if x is not c], body=c.body)) if len(n.ctes) > 1 else low.query(c.body)
                ctes[c.name] = self.renamed(b, c.cols)
            n = n.body
        t, affected, found = getattr(self.changes, n.kind)(n, args, ctes)
        self.count = affected
        return self.changes.returned(n, t, affected, found, args, ctes)

    def execute(self, n: Node, args: list | None = None) -> Result:
        """Runs one statement."""
        k = n.kind
        if k in ("select", "setop", "values", "ordered", "nested", "with", "insert", "update", "delete"):
            self.count = None
            b, command = self.compiled(n, args)
            if command != "select" and not b.cols:
                return Result(command.upper(), self.count.count(), [], [])
            rows = [self.clean(r, b) for r in self.collect(self.run(b.sql))]
            return Result(command.upper(), len(rows), [(c, str(t)) for c, t in b.cols], rows)
        if k == "begin":
            self.stack.append(self.state.copy())
        elif k == "commit":
            if self.stack:
                self.stack.pop()
        elif k == "rollback":
            if self.stack:
                self.state = self.stack.pop()
        elif k == "set":
            self.state.settings[n.name] = n.value
        elif k == "show":
            if n.name not in self.state.settings:
                raise QueryError(f"unrecognized configuration parameter {n.name!r}", "42704")
            return Result("SHOW", 1, [(n.name, "text")], [{n.name: self.state.settings[n.name]}])
        elif k == "truncate":
            self.changes.truncate(n)
        elif k == "explain":
            text = self.explain(n.body, args)
            return Result("EXPLAIN", 1, [("QUERY PLAN", "text")], [{"QUERY PLAN": text}])
        elif k not in ("ignored",):
            self.define(n)
        return Result(k.upper().replace("_", " "), 0, [], [])

    def define(self, n: Node) -> None:
        """Definitions commit what was open, and count as a change of the schema."""
        if n.kind == "refresh":
            self.state.get(*n.name, "view")
            return
        if n.kind == "do":
            self.language(n.language)(n.code, [], None)()
            return
        for s in self.stack:  # definitions cannot be rolled back
            s.rels, s.schemas = {}, set()
        if n.kind == "create_function":
            self.create_function(n)
        elif n.kind == "create_extension":
            self.create_extension(n)
        else:
            getattr(self.definitions, n.kind)(n)
        for s in self.stack:
            s.rels, s.schemas = dict(self.state.rels), set(self.state.schemas)
        self.state.version += 1
        self.emit("schema-change")

    def clean(self, row: tuple, b: Query) -> dict:
        return {c: self.value(v, t) for (c, t), v in zip(b.cols, row, strict=True)}

    def value(self, v: object, t: T) -> object:
        """A result value as Python sees it: JSON parsed, intervals as differences."""
        if v is None:
            return None
        if t.kind in ("json", "jsonb"):
            return json.loads(v)
        if t.kind == "array":
            return [self.value(x, t.of) for x in v]
        if t.kind == "interval":
            return {k: x for k, x in (("months", v[0]), ("days", v[1]), ("micros", v[2])) if x} or {"micros": 0}
        if t.kind == "record":
            return {n: self.value(x, k) for (n, k), x in zip(t.fields, v, strict=True)}
        if isinstance(v, bytearray):
            return bytes(v)
        return v

    def query(self, text: str, args: list | None = None) -> Result:
        """Runs a script; the last statement's result. An error undoes the whole script."""
        out = Result("", 0, [], [])
        for out in self.queries(text, args):
            pass
        return out

    def queries(self, text: str, args: list | None = None) -> Iterator[Result]:
        """Runs a script statement by statement."""
        for f in self.interceptors:
            rows = f(text)
            if rows is not None:
                yield Result("SELECT", len(rows), [], rows)
                return
        before, depth = self.state.copy(), len(self.stack)
        try:
            for n in parse(text):
                yield self.execute(n, args)
        except Exception as e:
            if len(self.stack) <= depth:
                self.state = before
            self.emit("query-failed", text)
            if isinstance(e, PySparkException):
                raise from_spark(e) from e
            raise
        self.emit("query", text)

    def many(self, text: str, args: list | None = None) -> list[dict]:
        return self.query(text, args).rows

    def one(self, text: str, args: list | None = None) -> dict:
        rows = self.many(text, args)
        if len(rows) != 1:
            raise QueryError(f"expected one row, got {len(rows)}", "P0003" if rows else "P0002")
        return rows[0]

    def none(self, text: str, args: list | None = None) -> None:
        self.query(text, args)

    def together(self, scripts: Iterable[tuple[str, list | None]]) -> None:
        """Runs scripts one after another; an error undoes all of them."""
        before, stack = self.state.copy(), list(self.stack)
        try:
            for text, args in scripts:
                if text.strip():
                    self.none(text, args)
        except Exception:
            self.state, self.stack = before, stack
            raise

    def explain(self, n: Node | str, args: list | None = None) -> str:
        """Spark's formatted plan of a query."""
        n = parse(n)[-1] if isinstance(n, str) else n
        return self.frame(n, args)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def prepare(self, text: str) -> Prepared:
        return Prepared(self, text)

    # ---- snapshots

    def backup(self) -> Backup:
        """A restore point: a copy of the catalog's dictionaries, whatever the data's size."""
        return Backup(self, self.state.copy())

    # ---- relations

    def view_of(self, df: DataFrame) -> str:
        name = f"quernel_{uuid.uuid4().hex}"
        df.createOrReplaceTempView(name)
        return name

    def create(self, t: Table, df: DataFrame | None, depth: int = 0) -> Table:
        """Registers a table with these rows (None: none yet)."""
        if df is None:
            kinds = ", ".join([*(f"CAST(NULL AS {spark_type(c.t)}) AS {q(c.name)}" for c in t.cols), f"CAST(NULL AS STRING) AS {RID}"])
            df = self.spark.createDataFrame([], self.spark.sql(f"SELECT {kinds}").schema)
        elif RID not in df.columns:
            # identities must not differ between two evaluations of the rows
            df = written(with_rids(df))
        t = t.with_(df=df, view=self.view_of(df), depth=depth)
        self.state.put(t, True)
        return t

    def save(self, t: Table, df: DataFrame, depth: int) -> None:
        now = self.state.get(*t.key, "table")
        self.state.put(now.with_(df=df, view=self.view_of(df), depth=depth), True)

    def attach(self, name: str, df: DataFrame | str, primary: list[str] | None = None) -> None:
        """A read-only table over a DataFrame, or over a Parquet path that Spark opens."""
        df = self.spark.read.parquet(df) if isinstance(df, str) else self.adopted(df)
        cols = tuple(Column(f.name, from_spark_type(f.dataType)) for f in df.schema.fields)
        keys = (Constraint("primary", f"{name}_pkey", tuple(primary)),) if primary else ()
        self.state.put(Table("public", name, cols, keys, df=df, view=self.view_of(df), readonly=True), True)

    def adopted(self, df: DataFrame) -> DataFrame:
        """A DataFrame of another session of the same application, in this engine's session."""
        if df.sparkSession._jsparkSession.equals(self.spark._jsparkSession):
            return df
        jvm = self.spark._jvm
        return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.spark._jsparkSession, df._jdf.logicalPlan()), self.spark)

    def attach_later(self, name: str, path: str) -> None:
        """Like ``attach``, but the path is opened when a statement first names the table."""
        self.later[name] = path

    def load(self, name: str, df: DataFrame, primary: list[str] | None = None) -> None:
        """A writable table that starts with the rows of a DataFrame, written once."""
        cols = tuple(Column(f.name, from_spark_type(f.dataType)) for f in df.schema.fields)
        keys = (Constraint("primary", f"{name}_pkey", tuple(primary)),) if primary else ()
        self.create(Table("public", name, cols, keys), self.adopted(df))

    def open_attached(self, name: str | None = None) -> None:
        """Opens the attached path of a name, or all of them."""
        for n in list(self.later) if name is None else [name]:
            path = self.later.pop(n, None)
            if path is not None and ("public", n) not in self.state.rels:
                self.attach(n, path)

    def is_system(self, name: str) -> bool:
        return ("pg_catalog", name) in catalogs.names()

    def relation(self, schema: str | None, name: str, low: Lower) -> tuple[str, list[tuple[str, T]]]:
        if schema in ("pg_catalog", "information_schema") or schema is None and self.is_system(name):
            self.open_attached()
            got = catalogs.relation(self, schema or "pg_catalog", name)
            if got is None:
                raise RelationNotFound(f"relation {name!r} does not exist")
            return got
        self.open_attached(name)
        r = self.state.find(schema, name)
        if r is None:
            raise RelationNotFound(f"relation {name!r} does not exist")
        if r.kind == "table":
            self.emit("seq-scan", name)
            return r.view, [(c.name, c.t) for c in r.cols]
        if r.kind == "view":
            b = Lower(self, low.params).query(r.body)
            b = self.renamed(b, r.cols)
            return b.sql, b.cols
        if r.kind == "sequence":
            return f"(SELECT {r.value if r.value is not None else r.start}L AS last_value, {str(r.value is not None).lower()} AS is_called)", [("last_value", BIGINT), ("is_called", T("bool"))]
        raise QueryError(f"{name!r} is not a table or view", "42809")

    def registered(self, name: str, kind: str) -> str:
        """The canonical name of a type or relation that regtype or regclass reads."""
        if kind == "regtype":
            self.type(Node("type", name=name.lower(), args=[]))
            return name.lower()
        clean = name.strip('"').rpartition(".")[2]
        if self.state.find(None, clean) is None and not self.is_system(clean):
            raise RelationNotFound(f"relation {name!r} does not exist")
        return clean

    def table(self, name: str, schema: str | None = None) -> TableApi:
        return TableApi(self, self.state.get(schema, name, "table").key)

    def tables(self, schema: str = "public") -> list[str]:
        return [t.name for t in self.state.tables() if t.schema == schema]

    def declare_table(self, name: str, fields: list[dict], constraints: list[str] | None = None) -> TableApi:
        """A table from column dictionaries: name, type, and constraints as SQL."""
        cols = [f'"{f["name"]}" {f["type"]} {" ".join(f.get("constraints", []))}' for f in fields]
        self.none(f'create table "{name}" ({", ".join([*cols, *(constraints or [])])})')
        return self.table(name)

    # ---- types

    def type(self, n: Node) -> T:
        if n.kind == "type" and n.name == "array" and n.of is not None:
            return T("array", of=self.type(n.of))
        if n.schema in (None, "pg_catalog") and n.name in SYNONYMS:
            kind = SYNONYMS[n.name]
            if kind == "char" and not n.args:
                return T("char", ("1",)) if n.name != "bpchar" else T("char")
            if kind in ("timestamp", "timestamptz", "time", "timetz", "float", "real"):
                return T(kind)
            if kind == "numeric":
                return T("numeric", (min(38, int(n.args[0])), int(n.args[1]) if len(n.args) > 1 else 0)) if n.args else T("float")
            return T(kind, tuple(n.args or ()))
        if n.name in self.equivalents:
            return self.equivalents[n.name]
        r = self.state.find(n.schema, n.name)
        if r is not None and r.kind == "type":
            return self.enum_type(r)
        raise QueryError(f"type {n.name!r} does not exist", "42704")

    def enum_type(self, e: Enum) -> T:
        return T("enum", (e.name, e.values))

    def register_enum(self, name: str, values: list[str]) -> None:
        self.state.put(Enum("public", name, tuple(values)))

    def register_equivalent_type(self, name: str, equivalent_to: str, is_valid: Callable[[object], bool] | None = None) -> None:
        """A named alias of a type, with a predicate that its values pass."""
        base, check = self.type(Node("type", name=equivalent_to, args=[])), ""
        if is_valid:
            check = f"quernel_valid_{uuid.uuid4().hex}"
            self.spark.udf.register(check, F.udf(lambda v: bool(is_valid(v)), "boolean", useArrow=True))
        self.equivalents[name] = T("equivalent", (name, check), of=base)

    # ---- functions

    def register_function(self, name: str, args: Iterable[str], returns: str, implementation: Callable, *, variadic: str | None = None, allow_nulls: bool = False, pure: bool = True, replace_: bool = False) -> None:
        """A Python function, called over Arrow batches. Overloads differ in their argument types."""
        kinds, t = tuple(self.named_type(a) for a in args), self.named_type(returns)
        more = self.named_type(variadic) if variadic else None
        held = self.functions.setdefault(name.lower(), [])
        same = [f for f in held if f.args == kinds and f.variadic == more]
        if same and not replace_:
            raise QueryError(f"function {name}({', '.join(map(str, kinds))}) already exists", "42723")
        udf_name = f"quernel_fn_{uuid.uuid4().hex}"

        def call(*values: object) -> object:
            out = implementation(*[json.loads(v) if k.kind in ("json", "jsonb") and v is not None else v for v, k in zip(values, [*kinds, *([more] * (len(values) - len(kinds)))], strict=False)])
            return json.dumps(out, sort_keys=True, separators=(",", ":")) if t.kind in ("json", "jsonb") and out is not None else out

        f = F.udf(call, spark_type(t) if t.kind != "null" else "string", useArrow=True)
        self.spark.udf.register(udf_name, f if pure else f.asNondeterministic())
        self.functions[name.lower()] = [x for x in held if x not in same] + [Function(name.lower(), kinds, t, udf_name, not allow_nulls, more)]

    def named_type(self, name: str | T) -> T:
        if isinstance(name, T):
            return name
        from quernel.plans.parser import Parser

        return self.type(Parser(name).type_name())

    def has_function(self, name: str) -> bool:
        return name in self.functions

    def resolve(self, overloads: list[Function], args: list[E]) -> Function | None:
        """The overload that takes the arguments with the fewest conversions."""
        best: list[tuple[int, Function]] = []
        for f in overloads:
            kinds = list(f.args) + ([f.variadic] * (len(args) - len(f.args)) if f.variadic else [])
            if len(kinds) != len(args):
                continue
            cost = 0
            for a, t in zip(args, kinds, strict=True):
                if a.t.kind == t.kind:
                    continue
                if a.t.kind == "null":
                    cost += 1
                    continue
                try:
                    cast(a, t, implicit=True)
                except (QueryError, ValueError):
                    break
                if a.t.kind in NUMBERS and t.kind in NUMBERS and NUMBERS.index(a.t.kind) > NUMBERS.index(t.kind):
                    break
                cost += 2 + (abs(NUMBERS.index(a.t.kind) - NUMBERS.index(t.kind)) if a.t.kind in NUMBERS and t.kind in NUMBERS else 10)
            else:
                best.append((cost, f))
        if not best:
            return None
        best.sort(key=lambda x: x[0])
        if len(best) > 1 and best[0][0] == best[1][0]:
            raise QueryError(f"function {best[0][1].name} is not unique", "42725")
        return best[0][1]

    def call_text(self, f: Function, args: list[E]) -> str:
        kinds = list(f.args) + [f.variadic] * (len(args) - len(f.args))
        cells = [cast(a, t, implicit=True).sql if a.t.kind != t.kind else a.sql for a, t in zip(args, kinds, strict=True)]
        text = f"{f.spark}({', '.join(cells)})"
        if f.strict and cells:
            text = f"(CASE WHEN {' OR '.join(f'{c} IS NULL' for c in cells)} THEN NULL ELSE {text} END)"
        return text

    def function_call(self, schema: str | None, name: str, args: list[E]) -> E | None:
        held = self.functions.get(name, [])
        f = self.resolve(held, args) if held else None
        return E(self.call_text(f, args), f.returns, name) if f else None

    def register_operator(self, op: str, left: str, right: str, returns: str, implementation: Callable, *, commutative: bool = False, allow_nulls: bool = False) -> None:
        """A binary operator over two types; a commutative one is also found with its sides swapped."""
        a, b, t = self.named_type(left), self.named_type(right), self.named_type(returns)
        name = f"quernel_op_{uuid.uuid4().hex}"
        self.spark.udf.register(name, F.udf(implementation, spark_type(t), useArrow=True))
        self.operators.setdefault(op, []).append(Function(op, (a, b), t, name, not allow_nulls))
        if commutative and a != b:
            self.spark.udf.register(name + "_r", F.udf(lambda x, y: implementation(y, x), spark_type(t), useArrow=True))
            self.operators[op].append(Function(op, (b, a), t, name + "_r", not allow_nulls))

    def operator(self, op: str, a: E, b: E) -> E | None:
        for f in self.operators.get(op, []):
            if f.args[0].kind == a.t.kind and f.args[1].kind == b.t.kind:
                return E(self.call_text(f, [a, b]), f.returns)
        return None

    def sql_function(self, schema: str | None, name: str, count: int) -> SqlFunction | None:
        return next((f for f in self.sql_functions.get(name.lower(), []) if len(f.args) == count), None)

    def inline(self, f: SqlFunction, args: list[Node]) -> Node:
        """The function's body with its arguments in place."""
        names = {n: a for (n, _), a in zip(f.args, args, strict=True) if n}

        def put(x: Node) -> object:
            if x.kind == "param" and x.n <= len(args):
                return args[x.n - 1]
            if x.kind == "ref" and not x.table and x.name in names:
                return names[x.name]
            if x.kind == "ref" and x.table == f.name and x.name in names:
                return names[x.name]
            return x

        return rewrite(f.body, put)

    def create_function(self, n: Node) -> None:
        name = n.name[1].lower()
        args = [(a.name, a.type) for a in n.args if a.mode in (None, "in", "inout")]
        kinds = [self.type(t) for _, t in args]
        language = (n.language or "sql").lower()
        if n.code is None:
            raise SyntaxProblem("no function body specified", "42P13")
        if language != "sql":
            compiled = self.language(language)(n.code, [x for x, _ in args], n.returns)
            self.register_function(name, kinds, self.type(n.returns) if n.returns is not None else T("null"), compiled, allow_nulls=not n.strict, replace_=bool(n.replace))
            return
        body = [b for b in parse(n.code)]
        if len(body) != 1:
            raise NotSupported("SQL functions of several statements")
        f = SqlFunction(name, args, body[0], n.returns, n.table)
        held = self.sql_functions.setdefault(name, [])
        same = [x for x in held if [self.type(t) for _, t in x.args] == kinds]
        if same and not n.replace:
            raise QueryError(f"function {name} already exists with same argument types", "42723")
        if same and (repr(same[0].returns), repr(same[0].table)) != (repr(n.returns), repr(n.table)):
            raise QueryError("cannot change return type of existing function", "42P13")
        probe = [Node("lowered", value=E(f"CAST(NULL AS {spark_type(t)})", t)) for t in kinds]
        b = Lower(self).query(self.inline(f, probe))
        wanted = [t for _, t in f.columns(self)] if n.table else [f.result(self)]
        if len(b.cols) != len(wanted):
            raise QueryError(f"return type mismatch in function {name}: final statement returns {len(b.cols)} columns", "42P13")
        for (_, got), want in zip(b.cols, wanted, strict=True):
            try:
                cast(E("x", got), want, implicit=got.kind not in NUMBERS)
            except CastProblem:
                raise QueryError(f"return type mismatch in function {name}: {got} is not {want}", "42P13") from None
        self.sql_functions[name] = [x for x in held if x not in same] + [f]

    def drop_function(self, name: tuple, args: list[Node] | None, ie: bool) -> None:
        n = name[1].lower()
        kinds = [self.type(a) for a in args] if args is not None else None
        mine = [(self.sql_functions, f) for f in self.sql_functions.get(n, []) if kinds is None or [self.type(t) for _, t in f.args] == kinds]
        mine += [(self.functions, f) for f in self.functions.get(n, []) if kinds is None or list(f.args) == kinds]
        if not mine:
            if ie:
                return
            raise NoFunction(f"function {n} does not exist")
        if len(mine) > 1:
            raise QueryError(f"function name {n!r} is not unique", "42725")
        table, f = mine[0]
        table[n] = [x for x in table[n] if x is not f]

    def register_language(self, name: str, compiler: Callable) -> None:
        """``compiler(code, argument names, returned type)`` gives a Python callable."""
        self.languages[name.lower()] = compiler

    def language(self, name: str) -> Callable:
        if name.lower() not in self.languages:
            raise QueryError(f"language {name!r} does not exist", "42704")
        return self.languages[name.lower()]

    def register_extension(self, name: str, install: Callable) -> None:
        """``install(engine)`` runs at CREATE EXTENSION."""
        self.extensions[name] = install

    def create_extension(self, n: Node) -> None:
        if n.name in self.installed:
            if n.ine:
                return
            raise AlreadyExists(f"extension {n.name!r} already exists", "42710")
        if n.name not in self.extensions:
            raise QueryError(f"extension {n.name!r} is not available", "58P01")
        self.extensions[n.name](self)
        self.installed.add(n.name)
        self.emit("create-extension", n.name)

    # ---- sequences

    @property
    def settings(self) -> dict[str, str]:
        return self.state.settings

    def named_sequence(self, name: str) -> Sequence:
        schema, _, bare = name.rpartition(".")
        return self.state.get(schema.strip('"') or None, bare.strip('"'), "sequence")

    def sequence(self, key: tuple[str, str]) -> Sequence:
        return self.state.get(*key, "sequence")

    def peek(self, key: tuple[str, str]) -> int:
        s = self.sequence(key)
        n = s.start if s.value is None else s.value + s.increment
        over = s.most is not None and n > s.most
        under = s.least is not None and n < s.least
        if over or under:
            if not s.cycle:
                raise QueryError(f"nextval: reached {'maximum' if over else 'minimum'} value of sequence {s.name!r}", "2200H")
            n = (s.least if s.least is not None else s.start) if over else (s.most if s.most is not None else s.start)
        return n

    def next_value(self, key: tuple[str, str]) -> int:
        n = self.peek(key)
        self.set_value(key, n)
        return n

    def next_values(self, rows: DataFrame, name: str, key: tuple[str, str]) -> DataFrame:
        """Written rows with the column ``name`` set to a next value each; the sequence moves on by as many."""
        s, first = self.sequence(key), self.peek(key)
        out, count = numbered(rows, name, first, s.increment)
        if not count:
            return out
        last = first + s.increment * (count - 1)
        if s.most is not None and last > s.most or s.least is not None and last < s.least:
            if s.cycle:
                raise NotSupported("a cycling sequence that starts anew within one statement")
            raise QueryError(f"nextval: reached {'maximum' if s.increment > 0 else 'minimum'} value of sequence {s.name!r}", "2200H")
        self.set_value(key, last)
        return out

    def set_value(self, key: tuple[str, str], n: int | None) -> None:
        self.state.put(replace(self.sequence(key), value=n), True)
        self.last_sequence = key
        self.touched.add(key)

    def reset(self, key: tuple[str, str]) -> None:
        self.state.put(replace(self.sequence(key), value=None), True)

    def sequence_key(self, args: list[E]) -> tuple[str, str]:
        s = self.named_sequence(str(args[0].value if args[0].value is not None else args[0].sql.strip("'")))
        return (s.schema, s.name)

    def sequence_call(self, name: str, args: list[E]) -> E:
        """nextval, currval, lastval and setval on the driver, once; nextval over rows is numbered before (``Lower.q_select``)."""
        if name == "lastval":
            if not self.last_sequence:
                raise QueryError("lastval is not yet defined in this session", "55000")
            return E(f"{self.sequence(self.last_sequence).value}L", BIGINT, name)
        key = self.sequence_key(args)
        s = self.sequence(key)
        if name == "nextval":
            return E(f"{self.next_value(key)}L", BIGINT, name)
        if name == "currval":
            if key not in self.touched or s.value is None:
                raise QueryError(f"currval of sequence {s.name!r} is not yet defined in this session", "55000")
            return E(f"{s.value}L", BIGINT, name)
        n = int(args[1].value)
        called = args[2].value if len(args) > 2 else True
        self.state.put(replace(s, value=n) if called else replace(s, value=None, start=n), True)
        self.touched.add(key)
        self.last_sequence = key
        return E(f"{n}L", BIGINT, name)

    # ---- events

    def on(self, event: str, handler: Callable) -> Callable[[], None]:
        """Calls ``handler`` at an event; the returned function stops that."""
        self.handlers.setdefault(event, []).append(handler)
        return lambda: self.handlers[event].remove(handler)

    def emit(self, event: str, *args: object) -> None:
        for h in list(self.handlers.get(event, [])):
            h(*args)

    def intercept(self, f: Callable[[str], list[dict] | None]) -> Callable[[], None]:
        """``f`` sees each script first; rows that it returns are the result."""
        self.interceptors.append(f)
        return lambda: self.interceptors.remove(f)

    # ---- migrations

    def migrate(self, migrations: list | str, force: bool = False, table: str = "migrations") -> list[int]:
        from quernel.migrations import migrate

        return migrate(self, migrations, force, table)


@dataclass
class Backup:
    engine: Engine
    state: State

    def restore(self) -> None:
        if self.engine.state.version != self.state.version:
            raise QueryError("cannot restore a backup after the schema has changed", "55000")
        self.engine.state = self.state.copy()
        self.engine.stack.clear()


@dataclass
class Prepared:
    """A script whose $n are bound later."""

    engine: Engine
    text: str
    nodes: tuple = field(init=False)

    def __post_init__(self) -> None:
        self.nodes = parse(self.text)

    def describe(self) -> tuple[list[str], list[tuple[str, str]]]:
        """Types of the parameters, and names and types of the result's columns."""
        low, cols = Lower(self.engine), []
        for n in self.nodes:
            if n.kind in ("insert", "update", "delete"):
                t = self.engine.state.get(*n.table, "table")
                if n.kind == "insert" and n.source.kind == "values":
                    names = n.cols or [c.name for c in t.cols]
                    for r in n.source.rows:
                        for c, e in zip(names, r, strict=False):
                            low.typed_param(e, t.col(c).t)
                for c, e in n.sets or []:
                    low.typed_param(e, t.col(c).t)
                if n.where is not None:
                    from quernel.operators.constraints import scope_of

                    low.condition(n.where, scope_of(t, n.alias))
            elif n.kind in ("select", "setop", "values", "ordered", "with", "nested"):
                cols = low.query(n).cols
        return [str(low.param_types.get(i + 1, TEXT)) for i in range(low.param_count)], [(c, str(t)) for c, t in cols]

    def bind(self, args: list | None = None) -> Bound:
        return Bound(self.engine, self.text, list(args or []))


@dataclass
class Bound:
    engine: Engine
    text: str
    args: list

    def execute_all(self) -> Result:
        return self.engine.query(self.text, self.args)

    def iterate(self) -> Iterator[Result]:
        return self.engine.queries(self.text, self.args)


@dataclass
class TableApi:
    """A table as an object."""

    engine: Engine
    key: tuple[str, str]

    @property
    def columns(self) -> list[tuple[str, str]]:
        return [(c.name, str(c.t)) for c in self.engine.state.get(*self.key, "table").cols]

    def name(self) -> str:
        return ".".join(f'"{x}"' for x in self.key)

    def insert(self, row: dict) -> dict:
        """Inserts one row; the row with its defaults."""
        if not row:
            return self.engine.one(f"insert into {self.name()} default values returning *")
        cols = ", ".join(f'"{c}"' for c in row)
        return self.engine.one(f"insert into {self.name()} ({cols}) values ({', '.join(f'${i + 1}' for i in range(len(row)))}) returning *", list(row.values()))

    def find(self, template: dict | None = None, columns: list[str] | None = None) -> list[dict]:
        """Rows that equal a template: null means IS NULL, a dictionary means containment."""
        tests, args = [], []
        for c, v in (template or {}).items():
            if v is None:
                tests.append(f'"{c}" is null')
                continue
            args.append(v)
            tests.append(f'"{c}" {"@>" if isinstance(v, dict) else "="} ${len(args)}')
        cols = ", ".join(f'"{c}"' for c in columns) if columns else "*"
        return self.engine.many(f"select {cols} from {self.name()}" + (f" where {' and '.join(tests)}" if tests else ""), args)
