"""Tables: changes, constraints, definitions, transactions, functions, catalogs, migrations."""

import pytest

from quernel.errors import QueryError


def code(db, sql, args=None):
    with pytest.raises(QueryError) as e:
        db.many(sql, args)
    return e.value.code


def test_insert_defaults_and_returning(db):
    db.none("create table t (id serial primary key, a text not null default 'x', b int, c text generated always as (a || '!') stored)")
    assert db.many("insert into t (a, b) values ('p', 1), (default, null) returning *") == [{"id": 1, "a": "p", "b": 1, "c": "p!"}, {"id": 2, "a": "x", "b": None, "c": "x!"}]
    assert db.many("insert into t (b) select b + 1 from t where b is not null returning id, b") == [{"id": 3, "b": 2}]
    assert code(db, "insert into t (id) values (1)") == "23505"
    assert code(db, "insert into t (a) values (null)") == "23502"
    assert code(db, "insert into t (c) values ('no')") == "428C9"
    assert code(db, "insert into t (nope) values (1)") == "42703"
    assert code(db, "insert into t (a, b) values (1)") == "42601"
    assert code(db, "insert into t (b) select 'x'::text") == "42804"
    assert db.one("select count(*) as n from t") == {"n": 3}


def test_upsert(db):
    db.none("create table t (k int primary key, v text, n int default 0); insert into t values (1, 'a', 5), (2, 'b', 5)")
    got = db.many("insert into t values (1, 'z'), (3, 'c') on conflict (k) do update set v = excluded.v || t.v, n = t.n + 1 where t.n > 1 returning k, v, n")
    assert sorted(got, key=lambda r: r["k"]) == [{"k": 1, "v": "za", "n": 6}, {"k": 3, "v": "c", "n": 0}]
    assert db.many("insert into t values (1, 'q'), (9, 'new'), (9, 'twice') on conflict do nothing returning k") == [{"k": 9}]
    assert code(db, "insert into t values (5, 'a'), (5, 'b') on conflict (k) do update set v = 'x'") == "21000"
    assert code(db, "insert into t values (5, 'a') on conflict (v) do nothing") == "42P10"


def test_update_and_delete(db):
    db.none("create table t (id int primary key, v int); insert into t values (1, 10), (2, 20), (3, null)")
    assert sorted(r["v"] for r in db.many("update t set v = v + 1 where v is not null returning v")) == [11, 21]
    db.none("update t x set v = s.n from (values (1, 100), (7, 1)) s(k, n) where s.k = x.id")
    assert db.many("select v from t where id = 1") == [{"v": 100}]
    assert db.many("delete from t where v is null returning id") == [{"id": 3}]
    assert code(db, "update t set id = 1") == "23505"
    assert code(db, "update t set nope = 1") == "42703"
    assert db.query("delete from t").row_count == 2
    assert db.many("select * from t") == []


def test_writable_cte_sees_the_state_before(db):
    db.none("create table t (a int); insert into t values (1), (2)")
    assert db.many("with d as (delete from t where a = 1 returning a) select d.a, (select count(*) from t) as n from d") == [{"a": 1, "n": 2}]
    assert db.many("select * from t") == [{"a": 2}]
    db.none("with s as (select 5 as a) insert into t select a from s")
    assert db.one("select count(*) as n from t") == {"n": 2}


def test_foreign_keys(db):
    db.none("""create table p (id int primary key); create table c (id int, p int references p on delete cascade);
      create table n (id int, p int default 1 references p(id) on delete set null on update cascade);
      create table d (p int default 1 references p(id) on delete set default);
      create table r (p int references p(id));
      insert into p values (1), (2), (3); insert into c values (1, 2), (2, 3); insert into n values (1, 2), (2, null); insert into d values (2)""")
    assert code(db, "insert into c values (3, 9)") == "23503"
    db.none("delete from p where id = 2")
    assert db.many("select id from c") == [{"id": 2}]
    assert db.many("select p from n where id = 1") == [{"p": None}]
    assert db.many("select p from d") == [{"p": 1}]
    db.none("insert into r values (3)")
    assert code(db, "delete from p where id = 3") == "23503"
    db.none("update n set p = 1 where id = 1; delete from d; update p set id = 10 where id = 1")
    assert db.many("select p from n where id = 1") == [{"p": 10}]
    assert code(db, "truncate p") == "0A000"
    assert code(db, "drop table p") == "2BP01"


def test_checks_and_unique(db):
    db.none("create table t (a int check (a > 0), b text, c int, unique (b, c)); insert into t values (null, 'x', null), (1, 'x', null)")
    assert code(db, "insert into t values (0, 'y', 1)") == "23514"
    db.none("insert into t values (1, 'y', 1)")
    assert code(db, "insert into t values (2, 'y', 1)") == "23505"
    db.none("create unique index u on t (lower(b)) where a = 5; insert into t values (5, 'Q', 1)")
    assert code(db, "insert into t values (5, 'q', 2)") == "23505"
    db.none("drop index u; insert into t values (5, 'q', 2)")
    assert code(db, "create unique index v on t (a)") == "23505"


def test_alter_table(db):
    db.none("create table t (a int, b text); insert into t values (1, '5'), (2, '6')")
    db.none("alter table t add column c int default 7; alter table t rename column a to k; alter table t alter column b type int using b::int; alter table t alter column k set not null")
    assert sorted(db.many("select k, b, c from t"), key=lambda r: r["k"]) == [{"k": 1, "b": 5, "c": 7}, {"k": 2, "b": 6, "c": 7}]
    assert code(db, "insert into t (b) values (1)") == "23502"
    db.none("alter table t drop column c; alter table t add constraint pk primary key (k); alter table t rename to u")
    assert list(db.many("select * from u")[0]) == ["k", "b"]
    assert code(db, "insert into u values (1, 1)") == "23505"
    db.none("alter table u drop constraint pk; insert into u values (1, 1)")
    assert code(db, "alter table u drop column nope") == "42703"
    assert code(db, "alter table u add column k int") == "42701"


def test_views_and_names(db):
    db.none("create table t (a int); insert into t values (1), (2); create view v(x) as select a + 1 from t; create materialized view m as select * from v")
    db.none("insert into t values (3); refresh materialized view m")
    assert sorted(r["x"] for r in db.many("select x from m")) == [2, 3, 4]
    assert code(db, "create table v (a int)") == "42P07"
    db.none("create or replace view v(x) as select a from t; drop view m")
    assert code(db, "select * from m") == "42P01"
    db.none("create table if not exists t (z int)")


def test_sequences(db):
    db.none("create sequence s start 5 increment 2 maxvalue 8")
    assert [db.one("select nextval('s') as n")["n"] for _ in range(2)] == [5, 7]
    assert db.one("select currval('s') as c, lastval() as l") == {"c": 7, "l": 7}
    assert code(db, "select nextval('s')") == "2200H"
    db.none("alter sequence s restart with 6; create table t (id int default nextval('s'), v int)")
    assert db.many("insert into t (v) values (1), (2) returning id") == [{"id": 6}, {"id": 8}]
    assert code(db, "drop sequence s") == "2BP01"


def test_identity(db):
    db.none("create table t (id int generated always as identity, v int); insert into t (v) values (1)")
    assert code(db, "insert into t (id, v) values (5, 5)") == "428C9"
    assert db.many("insert into t (id, v) overriding system value values (9, 9) returning id") == [{"id": 9}]
    db.none("truncate t restart identity; insert into t (v) values (3)")
    assert db.many("select * from t") == [{"id": 1, "v": 3}]


def test_transactions_and_snapshots(db):
    db.none("create table t (a int); insert into t values (1)")
    db.none("begin; insert into t values (2); rollback")
    assert db.one("select count(*) as n from t")["n"] == 1
    db.none("begin; insert into t values (2); commit")
    point = db.backup()
    db.none("delete from t")
    point.restore()
    assert db.one("select count(*) as n from t")["n"] == 2
    with pytest.raises(QueryError):
        db.none("insert into t values (7); insert into nope values (1)")
    assert db.one("select count(*) as n from t")["n"] == 2
    db.none("create table u (a int)")
    with pytest.raises(QueryError) as e:
        point.restore()
    assert e.value.code == "55000"


def test_enums_and_types(db):
    db.none("create type mood as enum ('low', 'high'); create table t (m mood, e email)" if False else "create type mood as enum ('low', 'high'); create table t (m mood)")
    db.none("insert into t values ('high'), ('low'); alter type mood add value 'mid' before 'high'; insert into t values ('mid')")
    assert [r["m"] for r in db.many("select m from t order by m")] == ["low", "mid", "high"]
    assert code(db, "insert into t values ('none')") == "22P02"
    assert code(db, "drop type mood") == "2BP01"
    db.register_equivalent_type("email", "text", lambda v: "@" in v)
    db.none("create table u (e email); insert into u values ('a@b')")
    assert code(db, "insert into u values ('nope')") == "22P02"


def test_functions(db):
    db.none("create function add(a int, b int) returns int as 'select a + b' language sql; create function pos() returns table (k int, s text) as $$ select * from (values (1, 'x'), (2, 'y')) v $$ language sql")
    assert db.one("select add(1, 2) as x") == {"x": 3}
    assert [r["s"] for r in db.many("select s from pos() p where k > 1")] == ["y"]
    assert code(db, "create function add(a int, b int) returns int as 'select 1' language sql") == "42723"
    assert code(db, "create or replace function add(a int, b int) returns text as 'select 1' language sql") == "42P13"
    assert code(db, "create function bad() returns int as 'select 1, 2' language sql") == "42P13"
    db.none("drop function add(int, int)")
    assert code(db, "select add(1, 2)") == "42883"
    db.register_function("twice", ["int"], "int", lambda n: n * 2)
    db.register_function("twice", ["text"], "text", lambda s: s + s)
    db.register_function("total", [], "int", lambda *n: sum(n), variadic="int")
    assert db.one("select twice(4) as a, twice('x') as b, twice(null::int) as c, total(1, 2, 3) as d") == {"a": 8, "b": "xx", "c": None, "d": 6}
    db.register_operator("#", "text", "int", "text", lambda s, n: s * n, commutative=True)
    assert db.one("select 'a'::text # 2 as x, 3 # 'b'::text as y") == {"x": "aa", "y": "bbb"}
    db.register_language("py", lambda body, names, returns: eval(body))
    db.none("create function inc(x int) returns int as 'lambda x: x + 1' language py")
    assert db.one("select inc(1) as x") == {"x": 2}
    assert code(db, "create function z() returns int as 'x' language nope") == "42704"


def test_extensions_events_intercept(db):
    seen = []
    off = db.on("schema-change", lambda: seen.append("schema"))
    db.register_extension("ext", lambda e: e.register_function("hello", [], "text", lambda: "hi"))
    db.none("create extension ext; create extension if not exists ext")
    assert db.one("select hello() as h") == {"h": "hi"}
    off()
    db.none("create table z (a int)")
    assert seen == ["schema", "schema"]
    stop = db.intercept(lambda q: [{"a": 1}] if "magic" in q else None)
    assert db.many("magic words") == [{"a": 1}]
    stop()
    assert code(db, "create extension nope") == "58P01"


def test_prepared(db):
    db.none("create table t (a int, b text); insert into t values (1, 'x'), (2, 'y')")
    p = db.prepare("select b, a + 1 as n from t where a = $1")
    assert p.describe() == (["int"], [("b", "text"), ("n", "int")])
    assert p.bind([2]).execute_all().rows == [{"b": "y", "n": 3}]
    assert [r.rows for r in db.prepare("select 1 as a; select 2 as a").bind().iterate()] == [[{"a": 1}], [{"a": 2}]]
    assert db.prepare("insert into t values ($1, $2)").describe()[0] == ["int", "text"]
    assert code(db, "select $2", [1]) == "42P02"


def test_catalogs(db):
    db.none("create table t (a int not null, b varchar(5)); create schema s; create table s.u (z int); create view v as select 1 as one")
    assert [tuple(r.values()) for r in db.many("select column_name, is_nullable, data_type, character_maximum_length from information_schema.columns where table_name = 't' order by ordinal_position")] == [("a", "NO", "int", None), ("b", "YES", "varchar", 5)]
    assert [tuple(r.values()) for r in db.many("select table_schema, table_name, table_type from information_schema.tables order by 2")] == [("public", "t", "BASE TABLE"), ("s", "u", "BASE TABLE"), ("public", "v", "VIEW")]
    assert db.many("select * from pg_class") == [] and db.many("select * from pg_catalog.pg_type") == []
    assert code(db, "insert into pg_class values (1)") == "42501"
    assert db.one("select 't'::regclass::text as c") == {"c": "t"}


def test_table_api(db):
    t = db.declare_table("t", [{"name": "id", "type": "serial", "constraints": ["primary key"]}, {"name": "j", "type": "jsonb"}, {"name": "s", "type": "text"}])
    assert t.insert({"j": {"a": 1, "b": 2}}) == {"id": 1, "j": {"a": 1, "b": 2}, "s": None}
    t.insert({"j": {"a": 2}, "s": "x"})
    assert t.find({"j": {"a": 1}, "s": None}, ["id"]) == [{"id": 1}]
    assert [c for c, _ in t.columns] == ["id", "j", "s"]
    assert db.tables() == ["t"]


def test_settings_comments_and_ignored(db):
    db.none("set x = 'y'; set timezone to utc; create table t (a int); comment on table t is 'note'; comment on column t.a is 'c'")
    assert db.many("show x") == [{"x": "y"}]
    assert code(db, "show nope") == "42704"


STEPS = [
    {"id": 1, "name": "a", "up": "create table t (a int)", "down": "drop table t"},
    {"id": 2, "name": "b", "up": "insert into t values (1)", "down": "delete from t"},
    {"id": 4, "name": "c", "up": "insert into t values (2)", "down": "delete from t where a = 2"},
]


def test_migrations_run_and_are_undone(db):
    assert db.migrate(STEPS) == [1, 2, 4]
    assert db.migrate(STEPS) == [1, 2, 4]
    assert db.migrate(STEPS[:2]) == [1, 2]  # what is gone is undone
    assert db.many("select * from t") == [{"a": 1}]
    assert db.migrate(STEPS) == [1, 2, 4]
    db.none("insert into t values (2)")
    assert db.migrate(STEPS, force=True) == [1, 2, 4]  # the last step runs anew
    assert sorted(r["a"] for r in db.many("select a from t")) == [1, 2]


def test_migrations_changed_scripts_stay_as_they_ran(db):
    db.migrate(STEPS)
    changed = [STEPS[0], STEPS[1] | {"up": "insert into t values (77)", "down": "insert into t values (88)"}, STEPS[2]]
    assert db.migrate(changed) == [1, 2, 4]
    assert db.migrate(changed[:1]) == [1]  # undone with the scripts that were recorded
    assert db.many("select * from t") == []


def test_migrations_fail_whole(db):
    db.migrate(STEPS[:2])
    with pytest.raises(QueryError):
        db.migrate([*STEPS[:2], {"id": 3, "name": "x", "up": "insert into t values (9); insert into nowhere values (1)", "down": ""}])
    assert db.many("select * from t") == [{"a": 1}]
    assert [r["id"] for r in db.many("select id from migrations order by id")] == [1, 2]
    with pytest.raises(QueryError):
        db.migrate([])
    with pytest.raises(QueryError):
        db.migrate([STEPS[0], STEPS[0]])


def test_migrations_from_files(db, tmp_path):
    (tmp_path / "001-first.sql").write_text("-----\n-- Up\n-----\ncreate table t (v text);\n-----\n-- Down\n-----\ndrop table t;\n")
    (tmp_path / "002-second.sql").write_text("insert into t values ('--BEGIN\n-----\n\n--END');")
    (tmp_path / "notes.sql").write_text("not a migration")
    assert db.migrate(str(tmp_path)) == [1, 2]
    assert db.many("select v from t") == [{"v": "--BEGIN\n-----\n\n--END"}]
    assert db.many("select name from migrations order by id") == [{"name": "first"}, {"name": "second"}]


def test_loaded_rows_keep_their_identity(db, spark):
    from pyspark.sql import functions as F

    shuffled = spark.range(2000).select((F.col("id") % 90).alias("k"), F.col("id").alias("v")).groupBy("v").agg(F.max("k").alias("k")).repartition(5)
    db.load("t", shuffled)
    db.none("delete from t where k % 7 = 0; update t set k = -1 where k % 7 = 1")
    assert db.one("select count(*) as n from t") == {"n": sum((i % 90) % 7 != 0 for i in range(2000))}
    assert db.one("select count(*) as n from t where k % 7 = 0 or k % 7 = 1") == {"n": 0}


def test_values_are_made_once(db):
    db.none("create table s (a int); insert into s values (1), (2), (3)")
    db.none("create table t (id serial primary key, a int, at timestamptz default now(), r float default random()); insert into t (a) select a from s")
    db.none("alter table t add column later timestamptz default now()")
    first = db.many("select id, at, r, later from t order by id")
    assert db.many("select id, at, r, later from t order by id") == first
    assert len({r["at"] for r in first}) == len({r["later"] for r in first}) == 1
    db.none("update t set id = default")
    assert sorted(r["id"] for r in db.many("select id from t")) == [4, 5, 6]
    db.none("create sequence q start 10 maxvalue 30 increment 5; update t set a = nextval('q')")
    assert sorted(r["a"] for r in db.many("select a from t")) == [10, 15, 20]
    assert sorted(r["v"] for r in db.many("select nextval('q') + a as v from s where a > 1")) == [27, 33]
    assert code(db, "select nextval('q') from s") == "2200H"


def test_updates_fail_at_once_and_read_their_row(db):
    db.none("create table t (a int, b int); insert into t values (1, 10), (0, 20), (null, 30)")
    assert code(db, "update t set b = 1 / a where a = 0") == "22012"
    db.none("update t set a = b, b = a where a > 0; delete from t where a = 0 or b = 7")
    assert sorted(db.many("select * from t"), key=str) == [{"a": 10, "b": 1}, {"a": None, "b": 30}]
    db.none("update t set b = (select max(b) from t) where a in (select a from t)")
    assert db.many("select b from t where a = 10") == [{"b": 30}]


def test_truncate_several(db):
    db.none("create table p (id int primary key); create table c (p int references p); insert into p values (1); insert into c values (1)")
    assert code(db, "truncate p") == "0A000"
    db.none("truncate p, c; insert into p values (1); insert into c values (1); truncate p cascade")
    assert db.many("select * from c") == []


def test_many_changes_keep_plans_short(db):
    db.none("create table t (a int)")
    for i in range(8):
        db.none(f"insert into t values ({i})")
    assert db.state.get(None, "t", "table").depth < 6
    assert db.one("select count(*) as n from t") == {"n": 8}
