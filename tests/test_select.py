"""Queries over small inline data: goldens and errors by code."""

import datetime

import pytest

from quernel.errors import QueryError


def one(db, expr):
    (row,) = db.many(f"select {expr} as x")
    return row["x"]


SCALARS = [
    ("7 / 2", 3), ("-7 / 2", -3), ("7 / 2.0::float", 3.5), ("7 % 3", 1), ("2 ^ 3", 8.0), ("null + 1", None),
    ("'a' || 'b'", "ab"), ("'a' || null", None), ("concat('a', null, 1)", "a1"), ("concat_ws('-', 'a', null, 'b')", "a-b"),
    ("lower('AbC')", "abc"), ("substring('hello' from 2 for 3)", "ell"), ("substring('hello', -1, 4)", "he"), ("substring('hello', 3)", "llo"), ("overlay('abcdef' placing 'XX' from 2 for 3)", "aXXef"),
    ("greatest(1, null, 3)", 3), ("least('b', 'a')", "a"), ("coalesce(null, 2)", 2), ("nullif(1, 1)", None),
    ("'abc' like 'a%'", True), ("'abc' not like '_b_'", False), ("'ABC' ilike 'a%'", True), ("null like 'a'", None), ("'abc' like any(array['x', 'a%'])", True),
    ("1 in (1, 2)", True), ("1 in (2, null)", None), ("1 not in (2, null)", None), ("2 between 1 and 3", True), ("2 not between 1 and 3", False),
    ("null is null", True), ("(null = 1) is true", False), ("null and false", False), ("null or true", True), ("not null::bool", None), ("1 is distinct from null", True),
    ("case 2 when 1 then 'a' when 2 then 'b' end", "b"), ("case when false then 1 end", None),
    ("'t'::bool", True), ("'no'::bool", False), ("2.5::float::int", 3), ("'12'::int", 12), ("true::int", 1), ("1::bool", True), ("true::text", "true"),
    ("date '2020-01-31' + interval '1 month'", datetime.datetime(2020, 2, 29)), ("date '2020-03-01' - date '2020-02-01'", 29), ("date '2020-01-01' + 5", datetime.date(2020, 1, 6)), ("date '2020-01-10' - 3", datetime.date(2020, 1, 7)),
    ("extract(dow from date '2021-01-03')", 0), ("extract(isodow from date '2021-01-03')", 7), ("extract(isoyear from date '2006-01-01')", 2005), ("extract(week from date '2006-01-01')", 52), ("extract(century from date '2001-01-01')", 21), ("extract(millennium from date '2001-01-01')", 3), ("extract(decade from date '1999-01-01')", 199), ("extract(epoch from timestamp '1970-01-01 00:00:01.5')", 1.5), ("extract(second from timestamp '2020-01-01 00:00:01.25')", 1.25), ("extract(day from interval '3 days 4 hours')", 3), ("extract(epoch from interval '1 day')", 86400.0),
    ("(interval '1 day' > interval '23 hours')", True), ("(interval '1 day 2 hours')::text", "1 day 02:00:00"), ("(interval '2 hours' * 2)::text", "04:00:00"), ("to_date('2021-02-03', 'YYYY-MM-DD')", datetime.date(2021, 2, 3)),
    ("(array[1, 2, 3])[2]", 2), ("(array[1, 2])[0]", None), ("(array[1, 2])[9]", None), ("array[1, 2] && array[2, 3]", True), ("array[1] && array[2]", False), ("2 = any('{1,2}')", True), ("2 > all(array[0, 1])", True), ("'{a,b}'::text[]", ["a", "b"]), ("(array[[1,2],[3,4]])[2][1]", 3),
    ("""'{"a": {"b": [1, "x"]}}'::jsonb->'a'->'b'->>1""", "x"), ("""'{"a": 1}'::jsonb->>'z'""", None), ("""'{"a": null}'::jsonb->>'a'""", None), ("""'{"a": null}'::jsonb->'a' is null""", False), ("""'[1,2,3]'::jsonb->-1""", 3), ("""'{"a": 1, "b": 2}'::jsonb @> '{"a": 1}'""", True), ("""'[1, [2]]'::jsonb @> '[[2]]'""", True), ("""'{"a": 1}'::jsonb @> '{"a": 2}'""", False), ("""'{"a": 1, "b": 2}'::jsonb - 'a'""", {"b": 2}), ("""'[1, 2, 3]'::jsonb - 1""", [1, 3]), ("""'{"b":1,"a":2}'::jsonb = '{"a":2, "b":1}'::jsonb""", True), ("""'null'::jsonb is null""", False), ("""'{"a":1}'::jsonb || '{"b":2}'::jsonb""", {"a": 1, "b": 2}),
    ("'A0EEBC99-9C0B-4EF8-BB6D-6BB9BD380A11'::uuid", "a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11"), ("'192.168.0.1/24'::inet", "192.168.0.1/24"), ("'5:30'::time", "05:30:00"), ("'(1, 2)'::point = '(1,2)'::point", True), ("'Abc'::citext = 'aBC'::citext", True), ("'\\x01ff'::bytea", b"\x01\xff"),
    ("(1, 2) = (1, 2)", True), ("(1, 2) < (1, 3)", True), ("(1, 2) in ((1, 2), (3, 4))", True), ("exists (select 0 where true)", True), ("(select 5)", 5), ("array(select 1 union select 2 order by 1)", [1, 2]),
]


def test_scalars(db):
    """All scalars in few queries: each value on its own, compared one by one."""
    for at in range(0, len(SCALARS), 30):
        part = SCALARS[at : at + 30]
        row = db.one("select " + ", ".join(f"{e} as x{i}" for i, (e, _) in enumerate(part)))
        for i, (e, want) in enumerate(part):
            assert row[f"x{i}"] == want, e


ERRORS = [
    ("select 'abc'::int", "22P02"), ("select 'abcd'::varchar(3)", "22001"), ("select 1 = '1.10'", "22P02"), ("select nope", "42703"), ("select * from nope", "42P01"), ("select nope(1)", "42883"),
    ("select 1 + 'a'::text", "42883"), ("select * ", "42601"), ("select sum(a) from (values ('x')) t(a)", "42883"), ("select 1 union select 'a'::text", "42804"), ("select 1 union select 1, 2", "42601"),
    ("select (select 1 union all select 2)", "21000"), ("select a from (values (1)) t(a) where sum(a) > 1", "42803"), ("select a from (values (1)) t(a) where a", "42804"), ("select 1 order by 3", "42P10"),
    ("select x.a from (values (1)) t(a)", "42P01"), ("select a from (values (1)) t(a), (values (2)) u(a)", "42702"), ("select 1 from (values (1)) t(a), (values (2)) t(a)", "42712"), ("select 'x'::uuid", "22P02"), ("select '300.1.1.1'::inet", "22P02"),
    ("select 'maybe'::bool", "22P02"), ("select 1 / 0", "22012"), ("select row_number()", "42P20"), ("select a, b from (values (1, 2)) t(a, b) group by a", "42803"), ("values (1), (1, 2)", "42601"), ("select 'x' = any(1)", "42809"), ("select current_time", "0A000"), ("select 'x'::nope", "42704"), ("select extract(nope from date '2020-01-01')", "22023"), ("select substring('a', 1, -1)", "22011"),
]


@pytest.mark.parametrize(("sql", "code"), ERRORS)
def test_errors(db, sql, code):
    with pytest.raises(QueryError) as e:
        db.many(sql)
    assert e.value.code == code, str(e.value)


T = "(values (1, 'a', null), (2, 'b', 5), (3, 'a', 7), (null, 'c', 7)) as t(id, name, v)"
ROWS = [
    (f"select id from {T} order by id", [1, 2, 3, None]), (f"select id from {T} order by id desc", [None, 3, 2, 1]), (f"select id from {T} order by id nulls first limit 2", [None, 1]), (f"select v from {T} order by v desc, id limit 2 offset 1", [7, 7]),
    (f"select name from {T} group by name order by count(*) desc, name limit 1", ["a"]), (f"select distinct name from {T} order by name", ["a", "b", "c"]), (f"select distinct on (name) id from {T} order by name, id desc", [3, 2, None]),
    (f"select array_agg(v order by id) from {T} where id is not null", [[None, 5, 7]]), (f"select count(*) from {T} where v > 5", [2]), (f"select count(v) from {T}", [3]), (f"select count(distinct (name, v)) from {T}", [4]), (f"select sum(v) from {T} where false", [None]), (f"select array_agg(v) from {T} where false", [None]), (f"select jsonb_agg(name) from {T} where id = 1", [["a"]]), (f"select bool_or(v > 6) from {T}", [True]), (f"select string_agg(name, ',' order by name desc) from {T}", ["c,b,a,a"]), (f"select 3 + sum(v) from {T}", [22]),
    (f"select upper(name) as n from {T} group by n order by n", ["A", "B", "C"]), (f"select name as v from {T} where v = 5", ["b"]), ("select a from (select 1 as a union select 1 union all select 2) x order by a", [1, 2]), ("with x(k) as (select 1), y as (select k + 1 as k from x) select k from y", [2]), ("select column2 from (values (1, 'z')) v", ["z"]), ("select t.x from (values (1), (2)) as t(x) where exists (select 1 from (values (2)) u(y) where u.y = t.x)", [2]),
    ("select a.x from (values (1), (2)) a(x) left join (values (2)) b(y) on a.x = b.y where b.y is null", [1]), ("select id from (values (1, 2)) a(id, p) join (values (1, 3)) b(id, q) using (id)", [1]), ("select x from (values (1)) a(x) natural join (values (1)) b(x)", [1]), ("select n from generate_series(2, 4) as n order by 1", [2, 3, 4]), ("values (1), (2)", [1, 2]),
]


@pytest.mark.parametrize(("sql", "want"), ROWS)
def test_rows(db, sql, want):
    assert [next(iter(r.values())) for r in db.many(sql)] == want


def test_output_names(db):
    row = db.one("select 1 + 1, 2 * 2, count(*), max(a), a2.a as z, a2.* from (values (1)) a2(a) group by a2.a")
    assert list(row) == ["column", "column1", "count", "max", "z", "a"]


def test_star_of_using_join_lists_key_once(db):
    assert db.many("select * from (values (1, 'x')) a(id, p) join (values (1, 'y')) b(id, q) using (id)") == [{"id": 1, "p": "x", "q": "y"}]


def test_record_value(db):
    assert db.one("select t from (values (1, 'x')) t(a, b)") == {"t": {"a": 1, "b": "x"}}


def test_filters_reach_the_scan(db, spark, tmp_path):
    spark.range(1000).selectExpr("id as k", "id * 2 as v", "cast(id as string) as s").write.parquet(f"file://{tmp_path}/t")
    db.attach("t", f"file://{tmp_path}/t")
    plan = db.explain("select v from t where k > 5 and k < 9")
    assert "PushedFilters: [IsNotNull(k), GreaterThan(k,5), LessThan(k,9)]" in plan and "struct<k:bigint,v:bigint>" in plan
    assert sorted(r["v"] for r in db.many("select v from t where k > 5 and k < 9")) == [12, 14, 16]


def test_filter_on_collecting_aggregates(db):
    q = "select array_agg(a order by a desc) filter (where a > 1) as x, string_agg(a::text, ',' order by a) filter (where a < 3) as y, jsonb_agg(a) filter (where a = 2) as z, json_object_agg(a::text, a) filter (where a = 3) as w, array_agg(a) filter (where a > 9) as none from (values (1), (2), (3)) t(a)"
    assert db.one(q) == {"x": [3, 2], "y": "1,2", "z": [2], "w": {"3": 3}, "none": None}


def test_json_containment(db):
    yes = [("{\"a\": [1, {\"b\": 2}]}", "{\"a\": [{\"b\": 2}]}"), ("[1, 2]", "1"), ("{\"a\": 1}", "{}"), ("{\"a\": null}", "{\"a\": null}"), ("9007199254740993", "9007199254740993"), ("1.0", "1")]
    no = [("{\"a\": 1}", "{\"a\": \"1\"}"), ("{\"a\": 1}", "[]"), ("[1]", "{}"), ("9007199254740993", "9007199254740992"), ("{\"a\": {\"b\": 1}}", "{\"b\": 1}"), ("1.0000000001", "1")]
    for pairs, want in ((yes, True), (no, False)):
        for x, y in pairs:
            assert db.one(f"select '{x}'::jsonb @> '{y}' as v") == {"v": want}, (x, y)
    assert db.one("select null::jsonb @> '{}' as v") == {"v": None}
