"""SQL types, how Spark stores them, and casts between them as Spark SQL text.

Values that Spark has no type for are kept as canonical text (jsonb, uuid, inet, enums, geometry, time) or as a struct
(interval: months, days, microseconds).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from quernel.errors import BadInput, CastProblem, QueryError, TypeMismatch


@dataclass(frozen=True)
class T:
    """A type: kind, and what the kind needs."""

    kind: str
    args: tuple = ()
    of: T | None = None
    fields: tuple = ()

    def __str__(self) -> str:
        if self.kind == "array":
            return f"{self.of}[]"
        return self.kind + (f"({', '.join(map(str, self.args))})" if self.args and self.kind not in ("enum", "equivalent") else "")


BOOL, INT, BIGINT, SMALLINT, FLOAT, REAL, NUMERIC = (T(k) for k in ("bool", "int", "bigint", "smallint", "float", "real", "numeric"))
TEXT, DATE, TIMESTAMP, TIMESTAMPTZ, TIME, INTERVAL, JSONB, NULL, BYTEA, UUID = (T(k) for k in ("text", "date", "timestamp", "timestamptz", "time", "interval", "jsonb", "null", "bytea", "uuid"))

#: fixed values: type names and their synonyms
SYNONYMS = {
    "bool": "bool", "boolean": "bool",
    "int": "int", "int4": "int", "integer": "int", "serial": "int", "serial4": "int",
    "smallint": "smallint", "int2": "smallint", "smallserial": "smallint", "serial2": "smallint",
    "bigint": "bigint", "int8": "bigint", "bigserial": "bigint", "serial8": "bigint", "oid": "bigint",
    "float": "float", "float8": "float", "double precision": "float", "money": "float",
    "real": "real", "float4": "real", "numeric": "numeric", "decimal": "numeric",
    "text": "text", "varchar": "varchar", "char": "char", "bpchar": "char", "name": "text", "citext": "citext",
    "uuid": "uuid", "bytea": "bytea", "date": "date", "timestamp": "timestamp", "timestamptz": "timestamptz",
    "time": "time", "timetz": "timetz", "interval": "interval", "json": "json", "jsonb": "jsonb", "inet": "inet",
    "point": "point", "line": "line", "lseg": "lseg", "box": "box", "path": "path", "polygon": "polygon", "circle": "circle",
    "regtype": "regtype", "regclass": "regclass", "record": "record", "void": "null", "null": "null",
}
SERIALS = {"serial", "serial4", "smallserial", "serial2", "bigserial", "serial8"}
NUMBERS = ["smallint", "int", "bigint", "numeric", "real", "float"]
INTEGERS = {"smallint", "int", "bigint"}
TEXTS = {"text", "varchar", "char", "citext"}
KEPT_AS_TEXT = {"uuid", "inet", "time", "timetz", "json", "jsonb", "point", "line", "lseg", "box", "path", "polygon", "circle", "enum", "equivalent", "regtype", "regclass"}
SPARK = {"bool": "BOOLEAN", "int": "INT", "bigint": "BIGINT", "smallint": "SMALLINT", "float": "DOUBLE", "real": "FLOAT", "date": "DATE", "timestamp": "TIMESTAMP_NTZ", "timestamptz": "TIMESTAMP", "bytea": "BINARY", "null": "VOID", "interval": "STRUCT<months: INT, days: INT, micros: BIGINT>"}
NUM = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
PT = rf"\(?\s*{NUM}\s*,\s*{NUM}\s*\)?"
#: shapes of values that are kept as text
SHAPES = {
    "uuid": r"^\{?[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}\}?$",
    "inet": r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:/(?:3[0-2]|[12]?\d))?$",
    "time": r"^(?:[01]?\d|2[0-4]):[0-5]\d(?::[0-5]\d(?:\.\d+)?)?$",
    "timetz": r"^(?:[01]?\d|2[0-4]):[0-5]\d(?::[0-5]\d(?:\.\d+)?)?(?:Z|[+-]\d\d(?::?\d\d)?)?$",
    "point": rf"^{PT}$",
    "line": rf"^\{{\s*{NUM}\s*,\s*{NUM}\s*,\s*{NUM}\s*\}}$",
    "lseg": rf"^[\[(]?\s*{PT}\s*,\s*{PT}\s*[\])]?$",
    "box": rf"^\(?\s*{PT}\s*,\s*{PT}\s*\)?$",
    "path": rf"^[\[(]?\s*{PT}(?:\s*,\s*{PT})*\s*[\])]?$",
    "polygon": rf"^\(?\s*{PT}(?:\s*,\s*{PT})*\s*\)?$",
    "circle": rf"^[<(]\s*{PT}\s*,\s*{NUM}\s*[>)]$",
}


def lit(s: str) -> str:
    """A Spark string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t").replace("\0", "\\0") + "'"


def q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def spark_type(t: T) -> str:
    if t.kind == "array":
        return f"ARRAY<{spark_type(t.of)}>"
    if t.kind == "record":
        return f"STRUCT<{', '.join(f'{q(n)}: {spark_type(x)}' for n, x in t.fields)}>"
    if t.kind == "numeric":
        return f"DECIMAL({t.args[0]}, {t.args[1] if len(t.args) > 1 else 0})" if t.args else "DECIMAL(38, 10)"
    return SPARK.get(t.kind, "STRING")


def from_spark_type(d) -> T:
    """The type of a Spark column."""
    name = d.typeName()
    if name == "array":
        return T("array", of=from_spark_type(d.elementType))
    if name == "struct":
        if [f.name for f in d.fields] == ["months", "days", "micros"]:
            return INTERVAL
        return T("record", fields=tuple((f.name, from_spark_type(f.dataType)) for f in d.fields))
    if name == "decimal":
        return T("numeric", (d.precision, d.scale))
    return T({"boolean": "bool", "integer": "int", "long": "bigint", "short": "smallint", "byte": "smallint", "double": "float", "float": "real", "string": "text", "varchar": "text", "char": "text", "date": "date", "timestamp": "timestamptz", "timestamp_ntz": "timestamp", "binary": "bytea", "void": "null", "variant": "jsonb"}.get(name, "text"))


@dataclass
class E:
    """A lowered expression: Spark SQL text, type, output name, and what is known of it."""

    sql: str
    t: T
    name: str = "column"
    value: object = None  # of a literal
    literal: bool = False
    rows: list = field(default_factory=list)  # the items of a list

    def named(self, name: str) -> E:
        return E(self.sql, self.t, name, self.value, self.literal, self.rows)


def fail(code: str, message: str) -> str:
    """Spark SQL text that raises."""
    return f"raise_error(concat('{code}|', {message}))"


def is_number(t: T) -> bool:
    return t.kind in NUMBERS


def is_text(t: T) -> bool:
    return t.kind in TEXTS


# ---- intervals

UNITS = {"year": (12, 0, 0), "mon": (1, 0, 0), "month": (1, 0, 0), "week": (0, 7, 0), "day": (0, 1, 0), "hour": (0, 0, 3_600_000_000), "hr": (0, 0, 3_600_000_000), "minute": (0, 0, 60_000_000), "min": (0, 0, 60_000_000), "second": (0, 0, 1_000_000), "sec": (0, 0, 1_000_000), "millisecond": (0, 0, 1000), "ms": (0, 0, 1000), "microsecond": (0, 0, 1), "decade": (120, 0, 0), "century": (1200, 0, 0), "y": (12, 0, 0), "d": (0, 1, 0), "h": (0, 0, 3_600_000_000), "m": (0, 0, 60_000_000), "s": (0, 0, 1_000_000)}


def parse_interval(text: str) -> tuple[int, int, int]:
    """Months, days and microseconds of an interval's text."""
    s = text.strip().lower()
    sign = -1 if s.endswith(" ago") else 1
    s = s.removesuffix(" ago").removeprefix("@").strip()
    total = [0.0, 0.0, 0.0]
    if m := re.fullmatch(r"p(?:(\d+)y)?(?:(\d+)m)?(?:(\d+)w)?(?:(\d+)d)?(?:t(?:(\d+)h)?(?:(\d+)m)?(?:([\d.]+)s)?)?", s):
        y, mo, w, d, h, mi, se = (float(x or 0) for x in m.groups())
        return int(12 * y + mo), int(7 * w + d), round((h * 3600 + mi * 60 + se) * 1e6)
    at = 0
    for m in re.finditer(r"\s*(?:([+-]?)(\d+):(\d+)(?::(\d+(?:\.\d+)?))?|([+-]?\d+(?:\.\d+)?)\s*([a-z]+))", s):
        if m.start() != at:
            raise BadInput(f"invalid input syntax for type interval: {text!r}")
        at = m.end()
        if m[2]:
            total[2] += (-1 if m[1] == "-" else 1) * (int(m[2]) * 3600 + int(m[3]) * 60 + float(m[4] or 0)) * 1e6
            continue
        unit = UNITS.get(m[6]) or UNITS.get(m[6].rstrip("s"))
        if not unit:
            raise BadInput(f"invalid input syntax for type interval: {text!r}")
        n = float(m[5])
        total = [a + n * b for a, b in zip(total, unit, strict=True)]
    if at != len(s) or not s:
        raise BadInput(f"invalid input syntax for type interval: {text!r}")
    days = total[1] + (total[0] - int(total[0])) * 30
    return sign * int(total[0]), sign * int(days), sign * round(total[2] + (days - int(days)) * 86_400e6)


def interval_literal(v: tuple[int, int, int]) -> E:
    return E(f"named_struct('months', {v[0]}, 'days', {v[1]}, 'micros', {v[2]}L)", INTERVAL, "interval", v, True)


def interval_micros(sql: str) -> str:
    """Length with months of 30 days, for comparisons."""
    return f"((({sql}).months * 30L + ({sql}).days) * 86400000000L + ({sql}).micros)"


def add_interval(moment: str, i: E, sign: int) -> str:
    minus = "-" if sign < 0 else ""
    if i.literal:
        m, d, u = (sign * x for x in i.value)
        out = moment
        if m:
            out = f"({out} + make_ym_interval(0, {m}))"
        if d or u:
            out = f"({out} + make_dt_interval({d}, 0, 0, {u}BD / 1000000))" if u else f"({out} + make_dt_interval({d}))"
        return out
    return f"({moment} + make_ym_interval(0, {minus}({i.sql}).months) + make_dt_interval({minus}({i.sql}).days, 0, 0, CAST({minus}({i.sql}).micros AS DECIMAL(18, 0)) / 1000000))"


# ---- casts


def bool_text(s: str) -> str:
    """Prefixes of true, false, yes, no, on, off, and 1, 0."""
    x = f"lower(trim({s}))"
    yes = " OR ".join(f"(startswith('{w}', {x}) AND {x} != '' AND length({x}) >= {n})" for w, n in (("true", 1), ("yes", 1), ("on", 2)))
    no = " OR ".join(f"(startswith('{w}', {x}) AND {x} != '' AND length({x}) >= {n})" for w, n in (("false", 1), ("no", 1), ("off", 2)))
    bad = fail("22P02", f"'invalid input syntax for type boolean: ', {s}")
    return f"(CASE WHEN {s} IS NULL THEN NULL WHEN {x} = '1' OR {yes} THEN true WHEN {x} = '0' OR {no} THEN false ELSE {bad} END)"


def shaped(s: str, t: T, to: str | None = None) -> str:
    bad = fail("22P02", f"'invalid input syntax for type {t.kind}: ', {s}")
    return f"(CASE WHEN {s} IS NULL THEN NULL WHEN trim({s}) rlike {lit(SHAPES[t.kind])} THEN {to or f'trim({s})'} ELSE {bad} END)"


def array_items(text: str) -> list:
    """Items of an array literal; nested literals become lists."""
    s, i = text.strip(), 0
    if not (s.startswith("{") and s.endswith("}")):
        raise BadInput(f"malformed array literal: {text!r}")

    def group() -> list:
        nonlocal i
        i += 1
        out: list = []
        while True:
            while i < len(s) and s[i].isspace():
                i += 1
            if i >= len(s):
                raise BadInput(f"malformed array literal: {text!r}")
            if s[i] == "}":
                i += 1
                return out
            if s[i] == ",":
                i += 1
                continue
            if s[i] == "{":
                out.append(group())
            elif s[i] == '"':
                m = re.compile(r'"((?:[^"\\]|\\.)*)"').match(s, i)
                if not m:
                    raise BadInput(f"malformed array literal: {text!r}")
                out.append(re.sub(r"\\(.)", r"\1", m[1]))
                i = m.end()
            else:
                m = re.compile(r"[^,{}]*").match(s, i)
                word = m[0].strip()
                out.append(None if word.lower() == "null" else word)
                i = m.end()

    got = group()
    if s[i:].strip():
        raise BadInput(f"malformed array literal: {text!r}")
    return got


def literal(v: object) -> E:
    """A Python value as a literal."""
    import datetime
    import decimal
    import json

    if v is None:
        return E("NULL", NULL, value=None, literal=True)
    if isinstance(v, bool):
        return E("true" if v else "false", BOOL, value=v, literal=True)
    if isinstance(v, int):
        big = not -(1 << 31) <= v < 1 << 31
        return E(f"{v}L" if big else str(v), BIGINT if big else INT, value=v, literal=True)
    if isinstance(v, float):
        return E(f"CAST({lit(repr(v))} AS DOUBLE)", FLOAT, value=v, literal=True)
    if isinstance(v, decimal.Decimal):
        return E(f"{v}BD", NUMERIC, value=v, literal=True)
    if isinstance(v, datetime.datetime):
        return E(f"TIMESTAMP_NTZ '{v.replace(tzinfo=None).isoformat(sep=' ')}'", TIMESTAMP, value=v)
    if isinstance(v, datetime.date):
        return E(f"DATE '{v.isoformat()}'", DATE, value=v)
    if isinstance(v, datetime.timedelta):
        return interval_literal((0, v.days, v.seconds * 1_000_000 + v.microseconds))
    if isinstance(v, bytes | bytearray):
        return E(f"X'{bytes(v).hex()}'", BYTEA, value=v)
    if isinstance(v, dict):
        return E(lit(json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)), JSONB, value=v)
    if isinstance(v, list | tuple):
        items = [literal(x) for x in v]
        t = common([x.t for x in items]) if items else TEXT
        return E(f"CAST(array({', '.join(x.sql for x in items)}) AS ARRAY<{spark_type(t)}>)", T("array", of=t), value=v)
    return E(lit(str(v)), TEXT, value=str(v), literal=True)


def common(types: list[T], literals: list[bool] | None = None) -> T:
    """The type that values of all the types take; literals of text give way to any type."""
    out: T | None = None
    soft = True
    for i, t in enumerate(types):
        is_lit = bool(literals and literals[i])
        if t.kind == "null":
            continue
        if out is None:
            out, soft = t, is_lit and is_text(t)
        elif out == t:
            soft = soft and is_lit
        elif is_number(out) and is_number(t):
            a, b = NUMBERS.index(out.kind), NUMBERS.index(t.kind)
            if out.kind == t.kind == "numeric":
                out = NUMERIC if not (out.args and t.args) else T("numeric", (min(38, max(out.args[0] - out.args[1], t.args[0] - t.args[1]) + max(out.args[1], t.args[1])), max(out.args[1], t.args[1])))
            else:
                out = out if a >= b else t
        elif is_text(out) and is_text(t):
            out = T("citext") if "citext" in (out.kind, t.kind) else TEXT
        elif soft and is_text(out):
            out, soft = t, False
        elif is_lit and is_text(t):
            continue
        elif {out.kind, t.kind} <= {"date", "timestamp", "timestamptz"}:
            out = T(max(out.kind, t.kind, key=["date", "timestamp", "timestamptz"].index))
        elif {out.kind, t.kind} <= {"json", "jsonb"}:
            out = JSONB
        elif out.kind == t.kind == "array":
            out = T("array", of=common([out.of, t.of]))
        elif out.kind == t.kind == "record":
            out = T("record", fields=tuple((n, common([a, b])) for (n, a), (_, b) in zip(out.fields, t.fields, strict=True)))
        elif t.kind in ("enum", "equivalent", "uuid", "inet") and is_text(out) or out.kind in ("enum", "equivalent", "uuid", "inet") and is_text(t):
            out = TEXT
        else:
            raise TypeMismatch(f"types {out} and {t} cannot be matched")
    return out or TEXT


def cast(e: E, t: T, implicit: bool = False) -> E:
    """``e`` as type ``t``."""
    out = E(_cast(e, t, implicit), t, e.name, e.value if e.literal and t.kind == e.t.kind else None, e.literal and t == e.t)
    if t.kind == "interval" and e.literal and is_text(e.t):
        return interval_literal(parse_interval(str(e.value))).named(e.name)
    return out


def _cast(e: E, t: T, implicit: bool) -> str:
    a, b, s = e.t.kind, t.kind, e.sql
    no = CastProblem(f"cannot cast type {e.t} to {t}", "42804" if implicit else "42846")
    if a == "null":
        return f"CAST({s} AS {spark_type(t)})" if b != "null" else s
    if e.t == t or b == "null":
        return s
    if b in ("varchar", "char"):
        text = _cast(e, TEXT, implicit) if not is_text(e.t) else s
        if not t.args:
            return text
        n = int(t.args[0])
        if e.literal and is_text(e.t) and len(str(e.value)) > n:
            raise QueryError(f"value too long for type {t}", "22001")
        return f"(CASE WHEN length({text}) > {n} THEN {fail('22001', lit(f'value too long for type {t}'))} ELSE {text} END)"
    if b in ("text", "citext"):
        if a == "interval":
            return interval_text(s)
        if a == "array":
            return f"concat('{{', array_join(transform({s}, x -> CAST(x AS STRING)), ',', 'NULL'), '}}')"
        if a == "bytea":
            return f"concat('\\\\x', lower(hex({s})))"
        return s if is_text(e.t) or a in KEPT_AS_TEXT else f"CAST({s} AS STRING)"
    if b == "bool":
        if is_text(e.t):
            return bool_text(s)
        if is_number(e.t) and not implicit:
            return f"({s} != 0)"
        raise no
    if b in NUMBERS:
        if a == "bool" and b in INTEGERS and not implicit:
            return f"CAST({s} AS {spark_type(t)})"
        if a == "numeric" and b == "numeric" and not t.args:
            return s
        if is_number(e.t):
            if b in INTEGERS and a in ("float", "real", "numeric"):
                if implicit:
                    raise no
                return f"CAST(round({s}) AS {spark_type(t)})"
            return f"CAST({s} AS {spark_type(t)})"
        if is_text(e.t) or a in ("json", "jsonb", "enum"):
            if implicit and not e.literal:
                raise no
            if e.literal and b in INTEGERS and not re.fullmatch(r"\s*[+-]?\d+\s*", str(e.value)):
                raise BadInput(f"invalid input syntax for type {t}: {str(e.value)!r}")
            if b == "numeric" and not t.args and e.literal:
                return f"{str(e.value).strip()}BD" if re.fullmatch(r"\s*-?\d+(\.\d+)?\s*", str(e.value)) else f"CAST({s} AS DOUBLE)"
            return f"CAST({s} AS {spark_type(t)})"
        if a in ("regtype", "regclass") and b in INTEGERS:
            return s
        raise no
    if implicit and is_text(e.t) and not e.literal and b not in ("json", "jsonb"):
        raise no
    if b in ("date", "timestamp", "timestamptz"):
        if is_text(e.t):
            if e.literal and str(e.value).strip().lower() in ("now", "today"):
                return f"CAST(current_timestamp() AS {spark_type(t)})"
            return f"CAST({s} AS {spark_type(t)})"
        if a in ("date", "timestamp", "timestamptz"):
            return f"CAST({s} AS {spark_type(t)})"
        raise no
    if b == "interval":
        if is_text(e.t):
            return f"quernel_interval({s})"
        raise no
    if b == "uuid" and (is_text(e.t)):
        x = f"lower(regexp_replace({s}, '[{{}}-]', ''))"
        return shaped(s, t, f"concat_ws('-', substring({x}, 1, 8), substring({x}, 9, 4), substring({x}, 13, 4), substring({x}, 17, 4), substring({x}, 21, 12))")
    if b in ("time", "timetz"):
        if is_text(e.t) or a in ("time", "timetz"):
            full = f"(CASE WHEN length(split_part(trim({s}), ':', 1)) = 1 THEN concat('0', trim({s})) ELSE trim({s}) END)"
            return shaped(s, t, f"(CASE WHEN {full} rlike '^[0-9]+:[0-9]+$' THEN concat({full}, ':00') ELSE {full} END)")
        if a in ("timestamp", "timestamptz"):
            return f"date_format({s}, 'HH:mm:ss')"
        raise no
    if b in SHAPES and is_text(e.t):
        return shaped(s, t, f"regexp_replace({s}, '\\\\s', '')" if b not in ("inet",) else None)
    if b in ("json", "jsonb"):
        if is_text(e.t):
            return f"to_json(parse_json({s}))"
        if a in ("json", "jsonb"):
            return s
        return json_text(e)
    if b == "array":
        if e.t.kind == "array":
            return s if e.t.of == t.of else f"transform({s}, x -> {_cast(E('x', e.t.of), t.of, False)})"
        if is_text(e.t) and e.literal:
            return array_literal(array_items(str(e.value)), t)
        if is_text(e.t):
            return f"transform(split(regexp_replace({s}, '^\\\\{{|\\\\}}$', ''), ','), x -> {_cast(E('x', TEXT), t.of, False)})"
        raise no
    if b == "bytea" and is_text(e.t):
        return f"(CASE WHEN startswith({s}, '\\\\x') THEN unhex(substring({s}, 3)) ELSE CAST({s} AS BINARY) END)"
    if b == "enum":
        if not (is_text(e.t) or a == "enum"):
            raise no
        name, values = t.args
        if e.literal and e.value not in values:
            raise BadInput(f"invalid input value for enum {name}: {e.value!r}")
        listed = ", ".join(map(lit, values)) or "NULL"
        bad = fail("22P02", lit(f"invalid input value for enum {name}: ") + f", {s}")
        return f"(CASE WHEN {s} IS NULL THEN NULL WHEN {s} IN ({listed}) THEN {s} ELSE {bad} END)"
    if b == "equivalent":
        base, check = t.of, t.args[1]
        x = _cast(e, base, implicit)
        if not check:
            return x
        bad = fail("22P02", lit(f"invalid input syntax for type {t.args[0]}: ") + f", CAST({x} AS STRING)")
        return f"(CASE WHEN {x} IS NULL THEN NULL WHEN {check}({x}) THEN {x} ELSE {bad} END)"
    if b in ("regtype", "regclass") and (is_text(e.t) or a in INTEGERS):
        return f"CAST({s} AS STRING)"
    if b == "record" and a == "record":
        return f"CAST({s} AS {spark_type(t)})"
    raise no


def array_literal(items: list, t: T) -> str:
    cells = [array_literal(x, t.of) if isinstance(x, list) else _cast(literal(x), t.of, False) for x in items]
    return f"CAST(array({', '.join(cells)}) AS {spark_type(t)})"


def variant(sql: str) -> str:
    """The variant of a JSON text; the one that the text was just made of, if so."""
    inner = sql[len("to_json(") : -1]
    if sql.startswith("to_json(") and inner.startswith(("parse_json(", "try_variant_get(")) and _closed(inner):
        return inner
    return f"parse_json({sql})"


def json_source(sql: str) -> str:
    """An expression that is null where the JSON text is, without parsing it."""
    v = variant(sql)
    return v[len("parse_json(") : -1] if v.startswith("parse_json(") else v


def _closed(sql: str) -> bool:
    """Whether the parenthesis that a call opens closes at its end."""
    depth, quote, i = 0, "", 0
    while i < len(sql):
        c = sql[i]
        if quote:
            i += c == "\\"
            quote = "" if c == quote else quote
        elif c in "'`\"":
            quote = c
        else:
            depth += (c == "(") - (c == ")")
            if c == ")" and not depth:
                return i == len(sql) - 1
        i += 1
    return False


def json_text(e: E) -> str:
    """JSON text of a value."""
    if e.t.kind in ("json", "jsonb"):
        return e.sql
    if e.t.kind in ("int", "bigint", "smallint", "bool", "float", "real", "numeric"):
        return f"CAST({e.sql} AS STRING)"
    if e.t.kind == "null":
        return "CAST(NULL AS STRING)"
    if e.t.kind == "array" and e.t.of.kind in ("json", "jsonb"):
        return f"concat('[', array_join({e.sql}, ',', 'null'), ']')"
    x = f"to_json({e.sql})" if e.t.kind in ("array", "record") else None
    if x:
        return f"to_json(parse_json({x}))"
    return f"(CASE WHEN {e.sql} IS NULL THEN NULL ELSE substring(to_json(array({_cast(e, TEXT, False)})), 2, length(to_json(array({_cast(e, TEXT, False)}))) - 2) END)"


def interval_text(s: str) -> str:
    part = lambda n, unit: f"CASE WHEN {n} != 0 THEN concat({n}, ' {unit}', CASE WHEN abs({n}) = 1 THEN '' ELSE 's' END) END"
    y, m, d, u = f"CAST(({s}).months div 12 AS INT)", f"CAST(({s}).months % 12 AS INT)", f"({s}).days", f"({s}).micros"
    a = f"abs({u})"
    clock = f"CASE WHEN {u} != 0 THEN concat(CASE WHEN {u} < 0 THEN '-' ELSE '' END, lpad({a} div 3600000000, greatest(2, length({a} div 3600000000)), '0'), ':', lpad(({a} div 60000000) % 60, 2, '0'), ':', lpad(({a} div 1000000) % 60, 2, '0'), CASE WHEN {a} % 1000000 != 0 THEN concat('.', regexp_replace(lpad({a} % 1000000, 6, '0'), '0+$', '')) ELSE '' END) END"
    body = f"concat_ws(' ', {part(y, 'year')}, {part(m, 'mon')}, {part(d, 'day')}, {clock})"
    return f"(CASE WHEN {s} IS NULL THEN NULL WHEN {body} = '' THEN '00:00:00' ELSE {body} END)"
