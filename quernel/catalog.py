"""What a database holds at one moment: immutable relations in a dictionary, so that a snapshot is a copy of it."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from quernel.errors import AlreadyExists, RelationNotFound
from quernel.functions.types import T
from quernel.plans.nodes import Node


@dataclass(frozen=True)
class Column:
    name: str
    t: T
    not_null: bool = False
    default: Node | None = None
    sequence: tuple[str, str] | None = None  # of a serial or identity
    identity: str | None = None  # always, by default
    generated: Node | None = None
    comment: str | None = None


@dataclass(frozen=True)
class Constraint:
    kind: str  # primary, unique, check, foreign
    name: str
    cols: tuple[str, ...] = ()
    expr: Node | None = None
    exprs: tuple[Node, ...] = ()  # of a unique index over expressions
    predicate: Node | None = None  # of a partial unique index
    table: tuple[str, str] | None = None
    ref: tuple[str, ...] = ()
    on_delete: str = "no action"
    on_update: str = "no action"


@dataclass(frozen=True)
class Table:
    schema: str
    name: str
    cols: tuple[Column, ...]
    constraints: tuple[Constraint, ...] = ()
    df: DataFrame | None = None
    view: str = ""
    depth: int = 0  # unmaterialised changes in df's plan
    readonly: bool = False
    comment: str | None = None
    kind: str = "table"

    @property
    def key(self) -> tuple[str, str]:
        return (self.schema, self.name)

    def col(self, name: str) -> Column | None:
        return next((c for c in self.cols if c.name == name), None)

    @property
    def primary(self) -> Constraint | None:
        return next((c for c in self.constraints if c.kind == "primary"), None)

    def with_(self, **changes: object) -> Table:
        return replace(self, **changes)


@dataclass(frozen=True)
class View:
    schema: str
    name: str
    body: Node
    cols: list[str] | None = None
    materialized: bool = False
    kind: str = "view"


@dataclass(frozen=True)
class Sequence:
    schema: str
    name: str
    start: int = 1
    increment: int = 1
    least: int | None = None
    most: int | None = None
    cycle: bool = False
    owner: tuple | None = None
    value: int | None = None
    kind: str = "sequence"


@dataclass(frozen=True)
class Index:
    schema: str
    name: str
    table: tuple[str, str]
    constraint: str | None = None  # of a unique index
    kind: str = "index"


@dataclass(frozen=True)
class Enum:
    schema: str
    name: str
    values: tuple[str, ...]
    kind: str = "type"


@dataclass
class State:
    """All relations of one moment. One namespace for each schema."""

    rels: dict[tuple[str, str], object] = field(default_factory=dict)
    schemas: set[str] = field(default_factory=lambda: {"public", "pg_catalog", "information_schema"})
    settings: dict[str, str] = field(default_factory=dict)
    version: int = 0  # of the definitions

    def copy(self) -> State:
        return State(dict(self.rels), set(self.schemas), dict(self.settings), self.version)

    def find(self, schema: str | None, name: str) -> object | None:
        for s in [schema] if schema else ["pg_catalog", "public"]:
            if r := self.rels.get((s, name)):
                return r
        return None

    def get(self, schema: str | None, name: str, kind: str) -> object:
        r = self.find(schema, name)
        if r is None:
            raise RelationNotFound(f"{'relation' if kind == 'table' else kind} {name!r} does not exist")
        if r.kind != kind:
            raise RelationNotFound(f"{name!r} is not a {kind}", "42809")
        return r

    def put(self, r: object, replace_: bool = False) -> None:
        key = (r.schema, r.name)
        if not replace_ and key in self.rels:
            raise AlreadyExists(f"relation {r.name!r} already exists")
        self.rels[key] = r

    def tables(self) -> list[Table]:
        return [r for r in self.rels.values() if r.kind == "table"]
