"""Built-in scalar functions as Spark SQL text, with their result types."""

from __future__ import annotations

from collections.abc import Callable

from quernel.errors import NoFunction, NotSupported, QueryError
from quernel.functions.types import BIGINT, BOOL, DATE, FLOAT, INT, INTEGERS, JSONB, NULL, NUMERIC, TEXT, TEXTS, TIMESTAMP, TIMESTAMPTZ, E, T, cast, common, fail, interval_literal, interval_micros, is_number, is_text, json_text, lit, variant

Builder = Callable[..., E]
FUNCTIONS: dict[str, Builder] = {}


def builtin(*names: str):
    def add(f: Builder) -> Builder:
        for n in names:
            FUNCTIONS[n] = f
        return f

    return add


def text(e: E) -> str:
    return e.sql if is_text(e.t) else cast(e, TEXT).sql


def strict_text(e: E, fn: str) -> str:
    if not (is_text(e.t) or e.t.kind in ("null", "enum", "uuid")):
        raise NoFunction(f"function {fn}({e.t}) does not exist")
    return text(e)


def simple(name: str, template: str, result: T, *kinds: str) -> None:
    """A function whose arguments go into {0}, {1}, ...; kinds: text, number or any for each."""

    def build(low, args: list[E]) -> E:
        if len(args) != len(kinds):
            raise NoFunction(f"function {name}({', '.join(str(a.t) for a in args)}) does not exist")
        cells = []
        for a, k in zip(args, kinds, strict=True):
            if k == "text":
                cells.append(strict_text(a, name))
            elif k == "number" and not is_number(a.t) and a.t.kind != "null":
                cells.append(cast(a, FLOAT, True).sql if a.literal else _no(name, args))
            else:
                cells.append(a.sql)
        return E(template.format(*cells), result or args[0].t, name)

    FUNCTIONS[name] = build


def _no(name: str, args: list[E]) -> str:
    raise NoFunction(f"function {name}({', '.join(str(a.t) for a in args)}) does not exist")


for _n in ("lower", "upper", "initcap", "reverse", "md5"):
    simple(_n, f"{_n}({{0}})", TEXT, "text")
simple("length", "length({0})", INT, "text")
simple("char_length", "length({0})", INT, "text")
simple("octet_length", "octet_length({0})", INT, "text")
simple("ascii", "ascii({0})", INT, "text")
simple("strpos", "instr({0}, {1})", INT, "text", "text")
simple("replace", "replace({0}, {1}, {2})", TEXT, "text", "text", "text")
simple("repeat", "repeat({0}, {1})", TEXT, "text", "number")
simple("starts_with", "startswith({0}, {1})", BOOL, "text", "text")
simple("translate", "translate({0}, {1}, {2})", TEXT, "text", "text", "text")
simple("split_part", "split_part({0}, {1}, {2})", TEXT, "text", "text", "number")
simple("left", "left({0}, {1})", TEXT, "text", "number")
simple("right", "right({0}, {1})", TEXT, "text", "number")
for _n in ("sqrt", "exp", "ln", "sin", "cos", "tan", "asin", "acos", "atan", "degrees", "radians", "cbrt"):
    simple(_n, f"{_n}({{0}})", FLOAT, "number")
simple("pi", "pi()", FLOAT)
simple("random", "rand()", FLOAT)
simple("abs", "abs({0})", None, "number")
simple("sign", "sign({0})", FLOAT, "number")
simple("date_part_year", "year({0})", INT, "any")


@builtin("trim", "btrim", "ltrim", "rtrim")
def _trim(low, args):
    side = {"ltrim": "LEADING", "rtrim": "TRAILING"}.get(low.calling, "BOTH")
    chars = text(args[1]) if len(args) > 1 else "' '"
    return E(f"trim({side} {chars} FROM {text(args[0])})", TEXT, low.calling)


@builtin("lpad", "rpad")
def _pad(low, args):
    return E(f"{low.calling}({text(args[0])}, {args[1].sql}, {text(args[2]) if len(args) > 2 else lit(' ')})", TEXT, low.calling)


@builtin("floor", "ceil", "ceiling", "trunc")
def _floor(low, args):
    a, f = args[0], {"ceiling": "ceil"}.get(low.calling, low.calling)
    if a.t.kind in INTEGERS:
        return a.named(low.calling)
    if f == "trunc":
        return E(f"(CASE WHEN {a.sql} < 0 THEN ceil({a.sql}) ELSE floor({a.sql}) END)" if len(args) < 2 else f"(CAST({a.sql} * pow(10, {args[1].sql}) AS BIGINT) / pow(10, {args[1].sql}))", FLOAT if a.t.kind != "numeric" else NUMERIC, f)
    return E(f"CAST({f}({a.sql}) AS DOUBLE)" if a.t.kind != "numeric" else f"{f}({a.sql})", FLOAT if a.t.kind != "numeric" else NUMERIC, low.calling)


@builtin("round")
def _round(low, args):
    return E(f"round({', '.join(a.sql for a in args)})", args[0].t, "round")


@builtin("mod")
def _mod(low, args):
    return E(f"({args[0].sql} % {args[1].sql})", common([a.t for a in args]), "mod")


@builtin("power", "pow")
def _power(low, args):
    return E(f"power({args[0].sql}, {args[1].sql})", FLOAT, low.calling)


@builtin("log")
def _log(low, args):
    return E(f"log10({args[0].sql})" if len(args) == 1 else f"log({args[0].sql}, {args[1].sql})", FLOAT, "log")


@builtin("concat")
def _concat(low, args):
    if not args:
        return E("''", TEXT, "concat")
    return E(f"concat({', '.join(f'coalesce({text(a)}, {lit(str())})' for a in args)})", TEXT, "concat")


@builtin("concat_ws")
def _concat_ws(low, args):
    return E(f"concat_ws({', '.join(text(a) for a in args)})", TEXT, "concat_ws")


@builtin("substring", "substr")
def _substring(low, args):
    s, start = text(args[0]), args[1].sql
    if len(args) > 1 and is_text(args[1].t):
        return E(f"nullif(regexp_extract({s}, {start}, 0), '')", TEXT, low.calling)
    if len(args) == 2:
        return E(f"substring({s}, greatest({start}, 1))", TEXT, low.calling)
    n = args[2].sql
    bad = fail("22011", lit("negative substring length not allowed"))
    return E(f"(CASE WHEN {n} < 0 THEN {bad} ELSE substring({s}, greatest({start}, 1), greatest({n} + least({start} - 1, 0), 0)) END)", TEXT, low.calling)


@builtin("overlay")
def _overlay(low, args):
    s, r, at = text(args[0]), text(args[1]), args[2].sql
    return E(f"overlay({s} PLACING {r} FROM {at}" + (f" FOR {args[3].sql})" if len(args) > 3 else ")"), TEXT, "overlay")


@builtin("coalesce")
def _coalesce(low, args):
    t = common([a.t for a in args], [a.literal for a in args])
    return E(f"coalesce({', '.join(cast(a, t, True).sql for a in args)})", t, "coalesce")


@builtin("greatest", "least")
def _extreme(low, args):
    t = common([a.t for a in args], [a.literal for a in args])
    cells = [cast(a, t, True).sql for a in args]
    return E(f"{low.calling}({', '.join(cells)})" if len(cells) > 1 else cells[0], t, low.calling)


@builtin("nullif")
def _nullif(low, args):
    t = common([a.t for a in args], [a.literal for a in args])
    return E(f"nullif({cast(args[0], t, True).sql}, {cast(args[1], t, True).sql})", args[0].t if args[0].t.kind != "null" else t, "nullif")


@builtin("now", "transaction_timestamp", "statement_timestamp", "clock_timestamp")
def _now(low, args):
    return E("current_timestamp()", TIMESTAMPTZ, low.calling)


#: fixed values: date pattern letters of to_date / to_char and what Spark calls them, longest first
PATTERNS = [("YYYY", "yyyy"), ("yyyy", "yyyy"), ("YY", "yy"), ("yy", "yy"), ("Month", "MMMM"), ("Mon", "MMM"), ("MM", "MM"), ("mm", "MM"), ("DDD", "DDD"), ("DD", "dd"), ("dd", "dd"), ("HH24", "HH"), ("hh24", "HH"), ("HH12", "hh"), ("HH", "HH"), ("MI", "mm"), ("mi", "mm"), ("SS", "ss"), ("ss", "ss"), ("MS", "SSS"), ("Day", "EEEE"), ("Dy", "E"), ("AM", "a"), ("PM", "a"), ("Q", "q")]


def pattern(p: str) -> str:
    out, i = "", 0
    while i < len(p):
        for a, b in PATTERNS:
            if p.startswith(a, i):
                out, i = out + b, i + len(a)
                break
        else:
            out, i = out + (f"'{p[i]}'" if p[i].isalpha() and p[i] != "T" else "'T'" if p[i] == "T" else p[i]), i + 1
    return out


@builtin("to_date", "to_timestamp")
def _to_date(low, args):
    if len(args) == 1 and is_number(args[0].t):
        return E(f"timestamp_seconds({args[0].sql})", TIMESTAMPTZ, low.calling)
    if len(args) != 2:
        _no(low.calling, args)
    if not args[1].literal:
        raise NotSupported(f"{low.calling} with a computed pattern")
    t = DATE if low.calling == "to_date" else TIMESTAMPTZ
    if args[0].t.kind == "null" or args[1].t.kind == "null":
        return E(f"CAST(NULL AS {'DATE' if t == DATE else 'TIMESTAMP'})", t, low.calling)
    return E(f"{low.calling}({text(args[0])}, {lit(pattern(str(args[1].value)))})", t, low.calling)


@builtin("to_char")
def _to_char(low, args):
    if not args[1].literal or args[0].t.kind not in ("date", "timestamp", "timestamptz"):
        raise NotSupported("to_char of such arguments")
    return E(f"date_format({args[0].sql}, {lit(pattern(str(args[1].value)))})", TEXT, "to_char")


@builtin("date_trunc")
def _date_trunc(low, args):
    t = TIMESTAMP if args[1].t.kind != "timestamptz" else TIMESTAMPTZ
    return E(f"CAST(date_trunc({args[0].sql}, {args[1].sql}) AS {'TIMESTAMP_NTZ' if t == TIMESTAMP else 'TIMESTAMP'})", t, "date_trunc")


@builtin("date_part")
def _date_part(low, args):
    return extract(str(args[0].value), args[1]).named("date_part")


@builtin("age")
def _age(low, args):
    a, b = args if len(args) == 2 else (E("current_date()", DATE), args[0])
    m = f"CAST(months_between({a.sql}, {b.sql}) AS INT)"
    return E(f"named_struct('months', {m}, 'days', datediff({a.sql}, add_months({b.sql}, {m})), 'micros', 0L)", T("interval"), "age")


@builtin("timezone")
def _timezone(low, args):
    zone, ts = args
    if ts.t.kind == "timestamptz":
        return E(f"CAST(from_utc_timestamp({ts.sql}, {zone.sql}) AS TIMESTAMP_NTZ)", TIMESTAMP, "timezone")
    return E(f"to_utc_timestamp({ts.sql}, {zone.sql})", TIMESTAMPTZ, "timezone")


@builtin("make_interval")
def _make_interval(low, args):
    v = [int(a.value or 0) for a in args] + [0] * (7 - len(args))
    return interval_literal((v[0] * 12 + v[1], v[2] * 7 + v[3], (v[4] * 3600 + v[5] * 60 + v[6]) * 1_000_000))


@builtin("set_config")
def _set_config(low, args):
    if len(args) > 1 and args[0].literal and args[1].literal:
        low.engine.settings[str(args[0].value)] = str(args[1].value)
    return args[1].named("set_config")


@builtin("obj_description", "col_description", "pg_get_expr", "shobj_description")
def _described(low, args):
    return E("CAST(NULL AS STRING)", TEXT, low.calling)


@builtin("pg_get_constraintdef", "pg_get_indexdef")
def _definition(low, args):
    return E("CAST(NULL AS STRING)", TEXT, low.calling)


@builtin("version")
def _version(low, args):
    return E("'quernel on Spark'", TEXT, "version")


@builtin("current_database", "current_schema", "current_user")
def _current(low, args):
    return E({"current_database": "'db'", "current_schema": "'public'", "current_user": "'user'"}[low.calling], TEXT, low.calling)


@builtin("gen_random_uuid", "uuid_generate_v4")
def _uuid(low, args):
    return E("uuid()", T("uuid"), low.calling)


@builtin("array_length", "cardinality")
def _array_length(low, args):
    return E(f"nullif(size({args[0].sql}), 0)" if low.calling == "array_length" else f"size({args[0].sql})", INT, low.calling)


@builtin("array_to_string")
def _array_to_string(low, args):
    a = args[0].sql if args[0].t.of and is_text(args[0].t.of) else cast(args[0], T("array", of=TEXT)).sql
    return E(f"array_join({a}, {', '.join(text(x) for x in args[1:])})", TEXT, low.calling)


@builtin("string_to_array")
def _string_to_array(low, args):
    return E(f"split({text(args[0])}, concat('\\\\Q', {text(args[1])}, '\\\\E'))", T("array", of=TEXT), low.calling)


@builtin("array_append", "array_prepend", "array_remove", "array_cat", "array_position")
def _array_fn(low, args):
    if low.calling == "array_prepend":
        return E(f"array_prepend({args[1].sql}, {args[0].sql})", args[1].t, low.calling)
    if low.calling == "array_cat":
        return E(f"concat({args[0].sql}, {args[1].sql})", args[0].t, low.calling)
    if low.calling == "array_position":
        return E(f"nullif(CAST(array_position({args[0].sql}, {args[1].sql}) AS INT), 0)", INT, low.calling)
    return E(f"{low.calling}({args[0].sql}, {args[1].sql})", args[0].t, low.calling)


@builtin("unnest")
def _unnest(low, args):
    if args[0].t.kind != "array":
        _no("unnest", args)
    return E(f"explode({args[0].sql})", args[0].t.of, "unnest")


@builtin("generate_series")
def _series(low, args):
    step = "" if len(args) < 3 else (", " + (args[2].sql if args[2].t.kind != "interval" else f"make_ym_interval(0, {args[2].value[0]})" if args[2].value[0] else f"make_dt_interval({args[2].value[1]}, 0, 0, {args[2].value[2]}BD / 1000000)"))
    return E(f"explode(CASE WHEN {args[0].sql} <= {args[1].sql} THEN sequence({args[0].sql}, {args[1].sql}{step}) END)" if not step else f"explode(sequence({args[0].sql}, {args[1].sql}{step}))", args[0].t, "generate_series")


@builtin("jsonb_build_object", "json_build_object")
def _build_object(low, args):
    pairs = [f"concat(substring(to_json(array({text(k)})), 2, length(to_json(array({text(k)}))) - 2), ':', coalesce({json_text(v)}, 'null'))" for k, v in zip(args[::2], args[1::2], strict=True)]
    return E(f"to_json(parse_json(concat('{{', concat_ws(',', {', '.join(pairs) or lit('')}), '}}')))", JSONB, low.calling)


@builtin("jsonb_build_array", "json_build_array")
def _build_array(low, args):
    cells = [f"coalesce({json_text(a)}, 'null')" for a in args]
    return E(f"concat('[', concat_ws(',', {', '.join(cells) or lit('')}), ']')", JSONB, low.calling)


@builtin("to_json", "to_jsonb", "row_to_json")
def _to_json(low, args):
    return E(json_text(args[0]), JSONB, low.calling)


@builtin("jsonb_typeof", "json_typeof")
def _typeof(low, args):
    s = f"schema_of_variant({variant(args[0].sql)})"
    return E(f"(CASE WHEN {args[0].sql} IS NULL THEN NULL WHEN {s} LIKE 'ARRAY%' THEN 'array' WHEN {s} LIKE 'OBJECT%' THEN 'object' WHEN {s} = 'STRING' THEN 'string' WHEN {s} = 'BOOLEAN' THEN 'boolean' WHEN {s} = 'VOID' THEN 'null' ELSE 'number' END)", TEXT, low.calling)


@builtin("jsonb_array_length", "json_array_length")
def _json_length(low, args):
    return E(f"json_array_length({args[0].sql})", INT, low.calling)


@builtin("regexp_replace")
def _regexp_replace(low, args):
    if len(args) > 3 and "g" in str(args[3].value):
        return E(f"regexp_replace({text(args[0])}, {text(args[1])}, {text(args[2])})", TEXT, low.calling)
    return E(f"regexp_replace({text(args[0])}, concat('^(?s)(.*?)', {text(args[1])}), concat('$1', {text(args[2])}))", TEXT, low.calling)


# ---- fields of dates and intervals


def extract(field: str, e: E) -> E:
    """EXTRACT(field FROM e)."""
    f, s, k = field.lower(), e.sql, e.t.kind
    f = {"years": "year", "months": "month", "days": "day", "hours": "hour", "minutes": "minute", "seconds": "second"}.get(f, f)
    if is_text(e.t) and e.literal:
        e = cast(e, TIMESTAMP)
        s, k = e.sql, "timestamp"
    if k == "interval":
        u = f"({s}).micros"
        parts = {
            "year": (f"CAST(({s}).months div 12 AS INT)", INT), "month": (f"CAST(({s}).months % 12 AS INT)", INT), "day": (f"({s}).days", INT),
            "hour": (f"CAST({u} div 3600000000 AS INT)", INT), "minute": (f"CAST(({u} div 60000000) % 60 AS INT)", INT), "second": (f"(({u} % 60000000) / 1e6D)", FLOAT),
            "milliseconds": (f"(({u} % 60000000) / 1e3D)", FLOAT), "microseconds": (f"CAST({u} % 60000000 AS DOUBLE)", FLOAT), "epoch": (f"({interval_micros(s)} / 1e6D)", FLOAT),
            "quarter": (f"CAST((({s}).months % 12) div 3 + 1 AS INT)", INT), "decade": (f"CAST(({s}).months div 120 AS INT)", INT), "century": (f"CAST(({s}).months div 1200 AS INT)", INT), "millennium": (f"CAST(({s}).months div 12000 AS INT)", INT),
        }
    else:
        if k not in ("date", "timestamp", "timestamptz", "time"):
            raise NoFunction(f"function extract({field}, {e.t}) does not exist")
        ts = s if k in ("timestamp", "timestamptz") else f"CAST({s} AS TIMESTAMP_NTZ)" if k == "date" else f"CAST(concat('1970-01-01 ', {s}) AS TIMESTAMP_NTZ)"
        sec = f"CAST(extract(SECOND FROM {ts}) AS DOUBLE)"
        epoch = f"(unix_micros(CAST({ts} AS TIMESTAMP)) / 1e6D)"
        parts = {
            "year": (f"year({ts})", INT), "month": (f"month({ts})", INT), "day": (f"day({ts})", INT), "quarter": (f"quarter({ts})", INT), "doy": (f"dayofyear({ts})", INT),
            "hour": (f"hour({ts})", INT), "minute": (f"minute({ts})", INT), "second": (sec, FLOAT), "milliseconds": (f"({sec} * 1e3D)", FLOAT), "microseconds": (f"({sec} * 1e6D)", FLOAT),
            "dow": (f"(dayofweek({ts}) - 1)", INT), "isodow": (f"(weekday({ts}) + 1)", INT), "week": (f"weekofyear({ts})", INT), "isoyear": (f"CAST(extract(YEAROFWEEK FROM {ts}) AS INT)", INT),
            "century": (f"CAST(ceil(year({ts}) / 100D) AS INT)", INT), "millennium": (f"CAST(ceil(year({ts}) / 1000D) AS INT)", INT), "decade": (f"CAST(floor(year({ts}) / 10D) AS INT)", INT),
            "epoch": (epoch, FLOAT), "timezone": ("0", INT),
        }
    if f not in parts:
        raise QueryError(f"unit {field!r} not recognized", "22023")
    sql, t = parts[f]
    return E(sql, t, "extract")


# ---- aggregates

AGGREGATES = set("count sum avg min max array_agg json_agg jsonb_agg bool_and bool_or every string_agg bit_and bit_or json_object_agg jsonb_object_agg stddev stddev_samp stddev_pop variance var_samp var_pop corr covar_pop covar_samp regr_slope regr_intercept mode".split())
WINDOW_ONLY = {"row_number": BIGINT, "rank": BIGINT, "dense_rank": BIGINT, "percent_rank": FLOAT, "cume_dist": FLOAT, "ntile": INT, "lag": None, "lead": None, "first_value": None, "last_value": None, "nth_value": None}


def aggregate(low, name: str, args: list[E], distinct: bool, star: bool, order: list[tuple[E, bool]], chosen: str = "") -> E:
    """An aggregate call; ``chosen``: its FILTER."""
    d = "DISTINCT " if distinct else ""
    if star or name == "count" and not args:
        if name != "count":
            raise NoFunction(f"function {name}(*) does not exist")
        return E(f"count(1){chosen}", BIGINT, name)
    a = args[0]
    if name == "count":
        return E(f"count({d}{a.sql}){chosen}", BIGINT, name)
    if name in ("sum", "avg"):
        if a.t.kind == "interval":
            raise NotSupported(f"{name}(interval)")
        if not is_number(a.t) and a.t.kind != "null":
            raise NoFunction(f"function {name}({a.t}) does not exist")
        t = FLOAT if a.t.kind in ("float", "real", "null") or name == "avg" and a.t.kind != "numeric" else BIGINT if a.t.kind in INTEGERS else NUMERIC
        return E(f"{name}({d}{a.sql}){chosen}", t, name)
    if name in ("min", "max"):
        if not (is_number(a.t) or is_text(a.t) or a.t.kind in ("date", "timestamp", "timestamptz", "time", "timetz", "null", "interval", "inet", "enum")):
            raise NoFunction(f"function {name}({a.t}) does not exist")
        return E(f"{name}({a.sql}){chosen}", a.t, name)
    if name in ("bool_and", "bool_or", "every"):
        return E(f"{'bool_and' if name == 'every' else name}({cast(a, BOOL, True).sql}){chosen}", BOOL, name)
    if name == "array_agg":
        return E(f"nullif({_collected(a.sql, d, order, chosen)}, array())", T("array", of=a.t), name)
    if name in ("json_agg", "jsonb_agg"):
        j = json_text(a)
        return E(f"(CASE WHEN count({a.sql}){chosen} > 0 THEN concat('[', array_join({_collected(j, d, order, chosen, False)}, ','), ']') END)", JSONB, name)
    if name == "string_agg":
        sep = args[1].sql if len(args) > 1 else "''"
        return E(f"(CASE WHEN count({a.sql}){chosen} > 0 THEN array_join({_collected(text(a), d, order, chosen, False)}, {sep}) END)", TEXT, name)
    if name in ("json_object_agg", "jsonb_object_agg"):
        return E(f"to_json(parse_json(concat('{{', array_join(collect_list(concat(substring(to_json(array({text(a)})), 2, length(to_json(array({text(a)}))) - 2), ':', coalesce({json_text(args[1])}, 'null'))){chosen}, ','), '}}')))", JSONB, name)
    if name in ("bit_and", "bit_or"):
        return E(f"{name}({a.sql}){chosen}", a.t, name)
    return E(f"{name}({d}{', '.join(x.sql for x in args)}){chosen}", a.t if name == "mode" else FLOAT, name)


def _collected(x: str, d: str, order: list[tuple[E, bool]], chosen: str = "", nulls: bool = True) -> str:
    """All values as an array, in order if one is given."""
    if not order:
        if nulls:
            return f"transform(collect_{'set' if d else 'list'}(named_struct('v', {x})){chosen}, r -> r.v)"
        return f"sort_array(collect_set({x}){chosen})" if d else f"collect_list({x}){chosen}"
    keys = ", ".join(f"{e.sql} AS k{i}" for i, (e, _) in enumerate(order))
    compare = "CASE " + " ".join(f"WHEN a.k{i} IS NULL AND b.k{i} IS NOT NULL THEN {-1 if down else 1} WHEN a.k{i} IS NOT NULL AND b.k{i} IS NULL THEN {1 if down else -1} WHEN a.k{i} < b.k{i} THEN {1 if down else -1} WHEN a.k{i} > b.k{i} THEN {-1 if down else 1}" for i, (_, down) in enumerate(order)) + " ELSE 0 END"
    got = f"transform(array_sort(collect_{'set' if d else 'list'}(struct({keys}, {x} AS v)){chosen}, (a, b) -> {compare}), r -> r.v)"
    return got if nulls else f"filter({got}, v -> v IS NOT NULL)"
