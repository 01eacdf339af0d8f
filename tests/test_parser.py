"""Syntax: shapes of statements and errors."""

import pytest

from quernel.errors import NotSupported, QueryError, SyntaxProblem
from quernel.functions.types import array_items, parse_interval
from quernel.plans.lexer import tokens
from quernel.plans.parser import parse


def test_tokens_keep_quoted_case_and_unescape():
    got = [(t.kind, t.text) for t in tokens("""select "A""b", 'it''s', E'a\\nb', $1, 1.5e3, $$x$$ -- note""")][1:]
    assert got[0] == ("quoted", 'A"b')
    assert ("string", "it's") in got and ("string", "a\nb") in got and ("param", "$1") in got and ("number", "1.5e3") in got and ("string", "x") in got


def test_precedence():
    e = parse("select 1 + 2 * 3 = 7 and not false or true")[0].items[0].expr
    assert e.op == "or" and e.left.op == "and" and e.left.left.op == "=" and e.left.left.left.right.op == "*"


@pytest.mark.parametrize(
    "sql", ["selec 1", "select 1 from", "select (1", "insert into t values (1) garbage", "create table t (a", "select * from t where", "update t set a = 1, a = 2", "with a as (select 1), a as (select 2) select 1"]
)
def test_syntax_errors(sql):
    with pytest.raises(QueryError) as e:
        parse(sql)
    assert e.value.code in ("42601", "42712")


@pytest.mark.parametrize("sql", ["create table a (like b)", "alter index i rename to j", "create type t as (a int)", "prepare x as select 1", "drop trigger t on x"])
def test_rejected_statements(sql):
    with pytest.raises((NotSupported, SyntaxProblem)):
        parse(sql)


def test_scripts_and_cache():
    assert len(parse("select 1; ; select 2;")) == 2
    assert parse("select 1") is parse("select 1")


@pytest.mark.parametrize(
    ("text", "want"),
    [("1 day 2 hours", (0, 1, 7_200_000_000)), ("1 year 2 mons", (14, 0, 0)), ("-3 days", (0, -3, 0)), ("01:02:03.5", (0, 0, 3_723_500_000)), ("P1Y2M3DT4H", (14, 3, 14_400_000_000)), ("2 weeks ago", (0, -14, 0)), ("1.5 days", (0, 1, 43_200_000_000))],
)
def test_intervals(text, want):
    assert parse_interval(text) == want


def test_array_literals():
    assert array_items('{a,"b,c",null,{1,2}}') == ["a", "b,c", None, ["1", "2"]]
    with pytest.raises(QueryError):
        array_items("{a")
