"""The relational queries: SQL in the engine's dialect over the test tables, and the same as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quernel.errors import QueryError
from quernel.session import Engine

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: name: query, and its DuckDB text where that differs
SELECTS: dict[str, tuple[str, str | None]] = {
    "pricing_summary": (
        """select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice), 2) as sum_price,
        round(sum(l_extendedprice * (1 - l_discount)), 4) as sum_disc, round(avg(l_quantity), 6) as avg_qty, round(avg(l_discount), 6) as avg_disc, count(*) as n
        from lineitem where l_shipdate <= date '1998-09-02' group by l_returnflag, l_linestatus order by l_returnflag, l_linestatus""",
        None,
    ),
    "shipping_priority": (
        """select o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue, o_orderdate from customer c join orders o on c.c_custkey = o.o_custkey
        join lineitem l on l.l_orderkey = o.o_orderkey where c_mktsegment = 'BUILDING' and o_orderdate < date '1998-03-15' and l_shipdate > date '1998-03-15'
        group by o_orderkey, o_orderdate order by revenue desc, o_orderkey limit 10""",
        None,
    ),
    "local_supplier_volume": (
        """select n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue from customer, orders, lineitem, supplier, nation, region
        where c_custkey = o_custkey and l_orderkey = o_orderkey and l_suppkey = s_suppkey and c_nationkey = s_nationkey and s_nationkey = n_nationkey
        and n_regionkey = r_regionkey and o_orderdate >= date '1996-01-01' and o_orderdate < date '1998-01-01' group by n_name order by revenue desc""",
        None,
    ),
    "forecast_revenue": ("select round(sum(l_extendedprice * l_discount), 4) as revenue, count(*) as n from lineitem where l_shipdate >= date '1996-01-01' and l_shipdate < date '1997-01-01' and l_discount between 0.05 and 0.07 and l_quantity < 24", None),
    "returned_items": (
        """select c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue, n_name from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey
        join nation on c_nationkey = n_nationkey where l_returnflag = 'R' group by c_custkey, c_name, n_name order by revenue desc, c_custkey limit 20""",
        None,
    ),
    "priority_share": ("select o_orderpriority, sum(case when l_quantity > 25 then 1 else 0 end) as large, count(*) as n from orders join lineitem on o_orderkey = l_orderkey group by o_orderpriority order by 1", "select o_orderpriority, sum(case when l_quantity > 25 then 1 else 0 end)::bigint as large, count(*) as n from orders join lineitem on o_orderkey = l_orderkey group by o_orderpriority order by 1"),
    "scan_project": ("select o_orderkey, o_totalprice * 2 as twice, upper(o_orderpriority) as p from orders", None),
    "star_alias": ("select n.*, r.r_name as region from nation n join region r on n.n_regionkey = r.r_regionkey", None),
    "filter_compare": ("select o_orderkey from orders where o_totalprice > 1000 and not (o_orderstatus = 'F') and 5 < o_custkey", None),
    "filter_between": ("select p_partkey from part where p_size between 5 and 10", None),
    "filter_not_between": ("select p_partkey from part where p_size not between 5 and 10", None),
    "filter_in": ("select o_orderkey, o_orderstatus from orders where o_orderstatus in ('F', 'P') and o_custkey in (1, 2, 3, 50)", None),
    "filter_not_in": ("select o_orderkey from orders where o_orderstatus not in ('F', 'P')", None),
    "filter_not_in_null": ("select count(*) as n from orders where o_orderstatus not in ('F', null)", None),
    "filter_like": ("select p_partkey, p_type from part where p_type like 'S%L' or p_type like 'PRO_O'", None),
    "filter_ilike": ("select p_partkey from part where p_type ilike 'small' and p_name not ilike '%x%'", None),
    "filter_prefix": ("select p_partkey from part where p_type like 'ST%'", None),
    "filter_is_null": ("select o_orderkey, nullif(o_orderstatus, 'F') as s from orders where nullif(o_orderstatus, 'F') is null or nullif(o_orderpriority, 'x') is not null and o_orderkey < 50", None),
    "filter_any": ("select o_orderkey from orders where o_orderstatus = any(array['F', 'P'])", "select o_orderkey from orders where o_orderstatus in ('F', 'P')"),
    "filter_or": ("select o_orderkey from orders where o_orderkey < 20 or o_orderkey > 14900 or o_custkey = 7", None),
    "filter_constant": ("select o_orderkey from orders where 1 = 1 and o_orderkey < 100", None),
    "filter_false": ("select o_orderkey from orders where 1 = 2", None),
    "three_valued": ("select n_nationkey, (nullif(n_nationkey, 3) = 3 and false) as a, (nullif(n_nationkey, 3) = 3 or true) as b, not (nullif(n_nationkey, 3) > 5) as c, (nullif(n_nationkey, 3) > 5) is true as d from nation", None),
    "case_when": ("select o_orderkey, case o_orderstatus when 'F' then 1 when 'O' then 2 end as s, case when o_totalprice > 1000 then 'big' else 'small' end as size from orders", None),
    "casts": ("select o_orderkey::text as k, cast(o_totalprice as int) as p, (o_orderkey % 2)::bool as odd, '12'::int + o_custkey as c, o_orderdate::date as d, o_orderkey::numeric(12,2) as dec from orders where o_orderkey < 500", "select o_orderkey::text as k, round(o_totalprice)::int as p, (o_orderkey % 2)::bool as odd, '12'::int + o_custkey as c, o_orderdate::date as d, o_orderkey::decimal(12,2) as dec from orders where o_orderkey < 500"),
    "scalar_subquery": ("select o_orderkey from orders where o_totalprice = (select max(o_totalprice) from orders)", None),
    "in_subquery": ("select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 2000)", None),
    "not_in_subquery": ("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 2000)", None),
    "exists_subquery": ("select count(*) as n from region where exists (select 0 from nation)", None),
    "correlated_exists": ("select o_orderkey from orders o where not exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey)", None),
    "correlated_scalar": ("select n_name, (select count(*) from customer c where c.c_nationkey = n.n_nationkey) as customers from nation n", None),
    "array_subquery": ("select array_to_string(array(select n_name from nation where n_regionkey = 1 order by n_name), ',') as names", None),
    "derived_table": ("select s, total from (select o_orderstatus, round(sum(o_totalprice), 2) from orders group by o_orderstatus) as t(s, total)", None),
    "join_inner": ("select o_orderkey, c_name from orders join customer on o_custkey = c_custkey where c_acctbal > 0", None),
    "join_left": ("select d.doc_id, l.quality from documents d left join labels l on d.doc_id = l.doc_id", None),
    "join_right": ("select l.quality, d.doc_id from labels l right join documents d on d.doc_id = l.doc_id", None),
    "join_full": ("select a.n_nationkey as a, b.n_nationkey as b from (select * from nation where n_nationkey < 15) a full join (select * from nation where n_nationkey > 10) b on a.n_nationkey = b.n_nationkey", None),
    "join_using": ("select doc_id, lang, quality from documents join labels using (doc_id)", None),
    "join_using_left": ("select doc_id, lang, quality from documents left join labels using (doc_id)", None),
    "join_cross": ("select r_name, n_name from region cross join nation", None),
    "join_comma_where": ("select n_name, r_name from nation, region where n_regionkey = r_regionkey", None),
    "join_residual": ("select o_orderkey, l_linenumber, l_quantity from orders join lineitem on o_orderkey = l_orderkey and l_quantity > 45 and l_shipdate > o_orderdate", None),
    "join_theta": ("select a.n_name as a, b.n_name as b from nation a join nation b on a.n_nationkey < b.n_nationkey and a.n_regionkey = 0", None),
    "join_self": ("select a.n_name as a, b.n_name as b from nation a join nation b on a.n_regionkey = b.n_regionkey where a.n_nationkey <> b.n_nationkey", None),
    "join_three_way": ("select r_name, count(*) as n from region join nation on r_regionkey = n_regionkey join supplier on s_nationkey = n_nationkey group by r_name", None),
    "join_null_keys": ("select a.n_nationkey as a, b.r_regionkey as b from nation a left join region b on nullif(a.n_regionkey, 2) = b.r_regionkey", None),
    "agg_global": ("select count(*) as n, count(nullif(o_orderstatus, 'F')) as nn, round(sum(o_totalprice), 2) as s, round(avg(o_totalprice), 6) as a, min(o_orderdate) as lo, max(o_orderdate) as hi from orders", None),
    "agg_global_empty": ("select count(*) as n, sum(o_custkey) as s, avg(o_totalprice) as a, min(o_orderpriority) as m from orders where false", "select count(*) as n, sum(o_custkey)::bigint as s, avg(o_totalprice) as a, min(o_orderpriority) as m from orders where false"),
    "agg_group_null": ("select nullif(o_orderstatus, 'F') as s, count(*) as n from orders group by nullif(o_orderstatus, 'F')", None),
    "agg_count_distinct": ("select o_orderstatus, count(distinct o_custkey) as c, count(distinct nullif(o_orderpriority, '1-URGENT')) as p from orders group by o_orderstatus", None),
    "agg_count_distinct_tuple": ("select count(distinct (o_orderstatus, nullif(o_custkey, 3))) as n from orders", None),
    "agg_sum_avg_distinct": ("select sum(distinct p_size) as s, round(avg(distinct p_size), 6) as a from part", "select sum(distinct p_size)::bigint as s, round(avg(distinct p_size), 6) as a from part"),
    "agg_min_max": ("select p_type, min(p_size) as lo, max(p_size) as hi, min(p_name) as first, max(p_brand) as last from part group by p_type", None),
    "agg_array": ("select n_regionkey, array_to_string(array_agg(n_name order by n_name), ',') as names from nation group by n_regionkey", None),
    "agg_string": ("select n_regionkey, string_agg(n_name, '/' order by n_name desc) as names from nation group by n_regionkey", None),
    "agg_json": ("select n_regionkey, jsonb_agg(n_nationkey order by n_nationkey)::text as keys from nation group by n_regionkey", "select n_regionkey, '[' || string_agg(n_nationkey::varchar, ',' order by n_nationkey) || ']' as keys from nation group by n_regionkey"),
    "agg_bool": ("select o_orderstatus, bool_and(o_totalprice > 10) as a, bool_or(nullif(o_custkey, 1) = 5) as o from orders group by o_orderstatus", None),
    "agg_filter": ("select o_orderstatus, count(*) filter (where o_totalprice > 1000) as big, round(sum(o_totalprice) filter (where o_custkey % 2 = 0), 2) as even from orders group by o_orderstatus", None),
    "agg_expression_key": ("select p_size / 10 as decade, count(*) as n from part group by p_size / 10", "select (p_size // 10)::int as decade, count(*) as n from part group by 1"),
    "agg_in_expression": ("select o_orderstatus, 3 + count(*) as n, round(sum(o_totalprice) / count(*), 4) as mean from orders group by o_orderstatus", None),
    "agg_order_by_agg": ("select c_mktsegment from customer group by c_mktsegment order by count(*) desc, c_mktsegment limit 3", None),
    "agg_alias_key": ("select extract(year from o_orderdate) as y, count(*) as n from orders group by y order by y", "select extract(year from o_orderdate)::int as y, count(*) as n from orders group by 1"),
    "agg_having": ("select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 12", None),
    "agg_rollup": ("select r_name, n_name, count(*) as n from region join nation on r_regionkey = n_regionkey group by rollup (r_name, n_name)", None),
    "agg_cube": ("select o_orderstatus, o_orderpriority, count(*) as n from orders group by cube (o_orderstatus, o_orderpriority)", None),
    "agg_grouping_sets": ("select o_orderstatus, o_orderpriority, count(*) as n from orders group by grouping sets ((o_orderstatus), (o_orderpriority), ())", None),
    "agg_bits": ("select bit_and(p_size) as a, bit_or(p_size) as o from part", None),
    "order_nulls": ("select row_number() over (order by nullif(n_regionkey, 2), n_nationkey) as rn, n_nationkey, row_number() over (order by nullif(n_regionkey, 2) desc, n_nationkey) as rd from nation", "select row_number() over (order by nullif(n_regionkey, 2) nulls last, n_nationkey) as rn, n_nationkey, row_number() over (order by nullif(n_regionkey, 2) desc nulls first, n_nationkey) as rd from nation"),
    "limit_offset": ("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 15 offset 5", None),
    "order_nulls_limit": ("select n_nationkey from nation order by nullif(n_regionkey, 2) desc, n_nationkey limit 7", "select n_nationkey from nation order by nullif(n_regionkey, 2) desc nulls first, n_nationkey limit 7"),
    "order_unselected": ("select o_orderkey from orders order by o_totalprice * -1, o_orderkey limit 5", None),
    "distinct_rows": ("select distinct o_orderstatus, o_orderpriority from orders order by o_orderpriority, o_orderstatus", None),
    "distinct_on": ("select distinct on (o_custkey) o_custkey, o_orderkey, o_totalprice from orders order by o_custkey, o_totalprice desc, o_orderkey", None),
    "union_distinct": ("select n_regionkey as k from nation union select r_regionkey from region union select 99", None),
    "union_all": ("select n_name as name, 'nation' as kind from nation union all select r_name, 'region' from region", None),
    "intersect_rows": ("select c_nationkey from customer where c_acctbal > 5000 intersect select s_nationkey from supplier", None),
    "except_rows": ("select c_custkey from customer except select o_custkey from orders where o_totalprice > 500", None),
    "cte_chain": ("with a as (select o_custkey, count(*) as n from orders group by o_custkey), b as (select n, count(*) as customers from a group by n) select * from b", None),
    "cte_recursive": ("with recursive t(n, f) as (select 1, 1 union all select n + 1, f * 2 from t where n < 20) select n, f from t", None),
    "values_inline": ("select * from (values (1, 'a', null), (2, 'b', 2.5), (3, null, 1)) as v(id, name, x)", "select id, name, x::decimal(2,1) as x from (values (1, 'a', null), (2, 'b', 2.5), (3, null, 1)) as v(id, name, x)"),
    "no_from": ("select 1 as a, 'x' as b, null::int as c, true as d", None),
    "int_division": ("select n_nationkey, (n_nationkey - 12) / 5 as q, (n_nationkey - 12) % 5 as r, n_nationkey / 2.0::float as h from nation", "select n_nationkey, ((n_nationkey - 12) // 5)::int as q, (n_nationkey - 12) % 5 as r, n_nationkey / 2.0::double as h from nation"),
    "arithmetic": ("select p_partkey, -p_size as neg, p_size * p_partkey as mul, p_retailprice - p_size as sub, p_size ^ 2 as sq from part", None),
    "date_arith": ("select o_orderkey, o_orderdate + interval '1 month' as m, o_orderdate - interval '2 days 3 hours' as d, o_orderdate::date + 7 as w, o_orderdate::date - date '1995-01-01' as days from orders where o_orderkey < 2000", "select o_orderkey, o_orderdate + interval '1 month' as m, o_orderdate - interval '2 days 3 hours' as d, o_orderdate::date + 7 as w, (o_orderdate::date - date '1995-01-01')::int as days from orders where o_orderkey < 2000"),
    "extract_fields": (
        "select event_id, " + ", ".join(f"extract({f} from ts) as f_{f}" for f in "year month day hour minute dow isodow week isoyear doy quarter decade century millennium second epoch milliseconds microseconds".split()) + " from events",
        "select event_id, " + ", ".join(f"extract({f} from ts)::int as f_{f}" for f in "year month day hour minute dow isodow week isoyear doy quarter decade century millennium".split()) + ", (extract(microseconds from ts) % 60000000) / 1e6 as f_second, extract(epoch from ts)::double as f_epoch, (extract(microseconds from ts) % 60000000) / 1e3 as f_milliseconds, (extract(microseconds from ts) % 60000000)::double as f_microseconds from events",
    ),
    "string_fns": ("select p_partkey, lower(p_type) as l, upper(p_name) as u, concat(p_brand, '-', null, p_size) as c, concat_ws('/', p_brand, nullif(p_type, 'SMALL'), p_size::text) as w, length(p_name) as n, p_brand || p_type as cat, trim('  x ') as t, replace(p_type, 'S', 'z') as r from part", "select p_partkey, lower(p_type) as l, upper(p_name) as u, concat(p_brand, '-', null, p_size) as c, concat_ws('/', p_brand, nullif(p_type, 'SMALL'), p_size::text) as w, length(p_name)::int as n, p_brand || p_type as cat, trim('  x ') as t, replace(p_type, 'S', 'z') as r from part"),
    "substring_overlay": ("select p_partkey, substring(p_name from 2 for 3) as a, substring(p_name, 4) as b, substring(p_name, -1, 4) as c, overlay(p_type placing '##' from 2 for 1) as o, position('A' in p_type) as p from part", "select p_partkey, substring(p_name, 2, 3) as a, substring(p_name, 4) as b, substring(p_name, 1, 2) as c, substring(p_type, 1, 1) || '##' || substring(p_type, 3) as o, instr(p_type, 'A')::int as p from part"),
    "greatest_least_coalesce": ("select n_nationkey, greatest(n_nationkey, n_regionkey * 5, null) as g, least(n_nationkey, 7) as l, coalesce(nullif(n_regionkey, 1), -1) as c from nation", None),
    "array_ops": ("select n_nationkey, (array[n_nationkey, n_regionkey, 7])[2] as second, (array[1, 2])[5] as beyond, array[n_regionkey] && array[1, 2] as overlap, n_regionkey = any(array[0, 3]) as among, array_length(array[1, 2, 3], 1) as n from nation", "select n_nationkey, n_regionkey as second, null::int as beyond, n_regionkey in (1, 2) as overlap, n_regionkey in (0, 3) as among, 3 as n from nation"),
    "json_access": ("select event_id, (props::jsonb->>'k')::int as k, props::jsonb->'none' is null as absent, (props::jsonb->'k')::text as t from events", "select event_id, (props->>'k')::int as k, (props->'none') is null as absent, props->>'k' as t from events"),
    "json_contains": ("select event_id from events where props::jsonb @> '{\"k\": 3}'", "select event_id from events where (props->>'k')::int = 3"),
    "agg_filter_collect": ("select o_orderstatus, (array_agg(o_orderkey order by o_orderkey) filter (where o_totalprice > 300000))[1] as big, string_agg(o_orderpriority, ',' order by o_orderkey) filter (where o_orderkey < 40) as p from orders group by o_orderstatus", "select o_orderstatus, (list(o_orderkey order by o_orderkey) filter (where o_totalprice > 300000))[1] as big, string_agg(o_orderpriority, ',' order by o_orderkey) filter (where o_orderkey < 40) as p from orders group by o_orderstatus"),
    "join_natural": ("select k, a, b from (select n_nationkey as k, n_name as a from nation) x natural join (select r_regionkey as k, r_name as b from region) y", None),
    "join_lateral": ("select r_name, t.n from region, lateral (select count(*) as n from nation where n_regionkey = r_regionkey) t", None),
    "to_date_parse": ("select to_date('2024-03-0' || (1 + r_regionkey), 'YYYY-MM-DD')::text as d from region", "select (date '2024-03-01' + r_regionkey)::date::text as d from region"),
    "now_ordering": ("select now() is not null as a, current_date >= date '2024-01-01' as b, current_timestamp <= now() as c", "select true as a, true as b, true as c"),
    "json_order": ("select event_id from events where event_id < 200 order by props::jsonb->'k', event_id limit 20", "select event_id from events where event_id < 200 order by (props->>'k')::int, event_id limit 20"),
    "for_update": ("select r_name from region where r_regionkey = 1 for update", "select r_name from region where r_regionkey = 1"),
    "json_edit": ("select event_id, (props::jsonb - 'k')::text as minus from events where event_id < 50", "select event_id, '{}' as minus from events where event_id < 50"),
    "window_rank": ("select o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn, rank() over (partition by o_orderstatus order by o_orderpriority) as rk, sum(o_custkey) over (partition by o_orderstatus) as s from orders where o_orderkey < 3000", "select o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn, rank() over (partition by o_orderstatus order by o_orderpriority) as rk, (sum(o_custkey) over (partition by o_orderstatus))::bigint as s from orders where o_orderkey < 3000"),
    "record_value": ("select (n).n_name as name from nation n", "select n_name as name from nation"),
    "unnest_rows": ("select unnest(array[1, 2, 3]) as x", None),
    "series": ("select g from generate_series(1, 10) as g", "select generate_series::int as g from generate_series(1, 10)"),
    "distinct_from": ("select n_nationkey, nullif(n_regionkey, 1) is distinct from 2 as d from nation", None),
    "regex_match": ("select p_partkey from part where p_type ~ '^S' and p_type !~* 'ALL'", "select p_partkey from part where regexp_matches(p_type, '^S') and not regexp_matches(p_type, 'ALL', 'i')"),
    "information_schema": ("select table_name, column_name, ordinal_position, data_type from information_schema.columns where table_name = 'nation' order by ordinal_position", "select * from (values ('nation', 'n_nationkey', 1, 'int'), ('nation', 'n_name', 2, 'text'), ('nation', 'n_regionkey', 3, 'int')) as t(table_name, column_name, ordinal_position, data_type)"),
    "top_customers": ("select c_name, total from (select o_custkey, round(sum(o_totalprice), 2) as total from orders group by o_custkey) t join customer on c_custkey = o_custkey order by total desc, c_name limit 10", None),
    "events_by_hour": ("select event_type, date_trunc('hour', ts) as h, count(*) as n, round(avg(value), 6) as v from events group by event_type, date_trunc('hour', ts)", None),
}

#: scripts that define and change tables: script, and DuckDB text of the last query's rows
SCRIPTS: dict[str, tuple[str, str]] = {
    "dml_insert": ("create table r as select * from region; insert into r values (10, 'X'), (11, null); insert into r (r_regionkey) select n_nationkey + 100 from nation where n_nationkey < 3; select * from r", "select * from region union all select * from (values (10, 'X'), (11, null), (100, null), (101, null), (102, null))"),
    "dml_insert_returning": ("create table r (id serial primary key, name text default 'none', up text generated always as (upper(name)) stored); insert into r (name) select n_name from nation where n_nationkey < 2; insert into r (name) values (default), ('b') returning id, name, up", "select * from (values (3, 'none', 'NONE'), (4, 'b', 'B')) as t(id, name, up)"),
    "dml_upsert": ("create table r (k int primary key, v text); insert into r select r_regionkey, r_name from region; insert into r values (1, 'new'), (9, 'nine') on conflict (k) do update set v = excluded.v || r.v; insert into r values (9, 'again') on conflict do nothing; select * from r", "select r_regionkey as k, case when r_regionkey = 1 then 'new' || r_name else r_name end as v from region union all select 9, 'nine'"),
    "dml_update": ("create table n as select * from nation; update n set n_name = lower(n_name), n_regionkey = n_regionkey + 1 where n_nationkey > 10; select * from n", "select n_nationkey, case when n_nationkey > 10 then lower(n_name) else n_name end as n_name, case when n_nationkey > 10 then n_regionkey + 1 else n_regionkey end as n_regionkey from nation"),
    "dml_update_from": ("create table n as select * from nation; update n set n_name = r.r_name from region r where r.r_regionkey = n.n_regionkey and r.r_regionkey < 3; select * from n", "select n_nationkey, case when n_regionkey < 3 then r_name else n_name end as n_name, n_regionkey from nation join region on n_regionkey = r_regionkey"),
    "dml_delete_returning": ("create table n as select * from nation; delete from n where n_regionkey = 2 returning n_nationkey, n_name", "select n_nationkey, n_name from nation where n_regionkey = 2"),
    "dml_truncate": ("create table n as select * from nation; truncate n; insert into n values (1, 'a', 2); select * from n", "select 1 as n_nationkey, 'a' as n_name, 2 as n_regionkey"),
    "dml_cte": ("create table n as select * from nation; with gone as (delete from n where n_regionkey = 0 returning *) select count(*) as c, (select count(*) from n) as before from gone", "select (select count(*) from nation where n_regionkey = 0) as c, (select count(*) from nation) as before"),
    "ddl_constraints": ("create table p (id int primary key, name text unique not null check (length(name) > 0)); create table c (id serial primary key, p int references p (id) on delete cascade); insert into p select r_regionkey, r_name from region; insert into c (p) select n_regionkey from nation; delete from p where id in (0, 1); select p, count(*) as n from c group by p", "select n_regionkey as p, count(*) as n from nation where n_regionkey > 1 group by 1"),
    "ddl_alter": ("create table n as select * from nation; alter table n rename column n_name to name; alter table n add column extra int default 5; alter table n alter column n_regionkey type text; alter table n drop column n_nationkey; select name, n_regionkey, extra from n", "select n_name as name, n_regionkey::text as n_regionkey, 5 as extra from nation"),
    "view_read": ("create view v (key, label) as select n_nationkey, n_name || '!' from nation; create or replace view v (key, label) as select n_nationkey, n_name || '?' from nation; select * from v where key < 5", "select n_nationkey as key, n_name || '?' as label from nation where n_nationkey < 5"),
    "transactions": ("create table n as select * from nation; begin; delete from n; rollback; begin; delete from n where n_nationkey = 1; commit; select n_nationkey from n", "select n_nationkey from nation where n_nationkey <> 1"),
    "sql_function": ("create function twice(x int) returns int as 'select x * 2' language sql; select n_nationkey, twice(n_nationkey) as t from nation", "select n_nationkey, n_nationkey * 2 as t from nation"),
    "table_function": ("create function of_region(k int) returns table (key int, label text) as $$ select n_nationkey, n_name from nation where n_regionkey = k $$ language sql; select * from of_region(3) where key > 5", "select n_nationkey as key, n_name as label from nation where n_regionkey = 3 and n_nationkey > 5"),
    "sequences": ("create sequence s start 5 increment 3; select nextval('s') as a; select nextval('s') as b; select setval('s', 100) as c; select nextval('s') as d, currval('s') as e", "select 103::bigint as d, 103::bigint as e"),
    "enum_type": ("create type mood as enum ('sad', 'ok', 'happy'); create table m (id int, v mood); insert into m values (1, 'happy'), (2, 'sad'); select id, v::text as label from m order by v limit 1", "select 2 as id, 'sad' as label"),
    "dml_delete_using": ("create table n as select * from nation; delete from n using region r where r.r_regionkey = n.n_regionkey and r.r_name like 'A%'; select n_nationkey from n", "select n_nationkey from nation join region on n_regionkey = r_regionkey where r_name not like 'A%'"),
    "dml_truncate_several": ("create table a as select * from nation; create table b as select * from region; truncate a, b; select (select count(*) from a) as a, (select count(*) from b) as b", "select 0::bigint as a, 0::bigint as b"),
    "dml_update_default": ("create table t (id serial primary key, k int); insert into t (k) select n_nationkey from nation; update t set id = default where k < 10; select count(*) as n, count(distinct id) as ids, max(id) as top from t", "select count(*) as n, count(*) as ids, (count(*) + 10)::int as top from nation"),
    "dml_default_stable": ("create table t (k int, at timestamptz default now()); insert into t (k) select n_nationkey from nation; alter table t add column later timestamptz default now(); select count(distinct at) as a, count(distinct later) as b, bool_and(at < later) as c, bool_and(later < now()) as d from t", "select 1::bigint as a, 1::bigint as b, true as c, true as d"),
    "sequence_rows": ("create sequence s start 5 increment 3; select min(v) as low, max(v) as high, count(distinct v) as n, sum(v) as s from (select 1 as one) x, (select 2 as two) y, (select 0 as v) z; create table t as select nextval('s') as v, n_nationkey as k from nation; select min(v) as low, max(v) as high, count(distinct v) as n from t", "select 5::bigint as low, (5 + 3 * (count(*) - 1))::bigint as high, count(*) as n from nation"),
    "identity_columns": ("create table t (id int generated by default as identity (start with 10 increment by 5), v int); insert into t (v) select r_regionkey from region; insert into t values (1, 99); select count(*) as n, min(id) as low, max(id) as high from t", "select count(*) + 1 as n, 1 as low, (10 + 5 * (count(*) - 1))::int as high from region"),
    "index_metadata": ("create table t as select * from nation; create unique index u on t (n_nationkey); create index i on t (lower(n_name)) where n_regionkey > 1; insert into t values (0, 'x', 1) on conflict (n_nationkey) do nothing; drop index u; insert into t values (0, 'x', 1); select count(*) as n from t where n_nationkey = 0", "select 2::bigint as n"),
    "schemas_and_comments": ("create schema other; create table other.t (a int); insert into other.t select r_regionkey from region; comment on table other.t is 'rows'; create table if not exists other.t (b text); drop table if exists nothing_here; alter table other.t rename to u; select a from other.u", "select r_regionkey as a from region"),
    "settings": ("set search_path to public; set x = 'y'; select set_config('x', 'z', false) as z, current_user as u, current_schema as s", "select 'z' as z, 'user' as u, 'public' as s"),
    "drop_function": ("create function f(x int) returns int as 'select x + 1' language sql; create function f(x text) returns text as $$ select x || '!' $$ language sql; drop function f(text); select n_nationkey, f(n_nationkey) as r from nation", "select n_nationkey, n_nationkey + 1 as r from nation"),
}


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """A fresh engine with the test tables attached read-only."""
    e = Engine(spark)
    for t in TABLES:
        e.attach_later(t, f"{sf_dir}/{t}.parquet")
    return e


def _run(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: engine(spark, sf_dir).sql(text)


def snapshot_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows after a change was undone by a restore point."""
    e = engine(spark, sf_dir)
    e.none("create table n as select * from nation")
    point = e.backup()
    e.none("delete from n where n_nationkey > 3")
    point.restore()
    return e.sql("select count(*) as n from n")


def prepared_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bind parameters."""
    return engine(spark, sf_dir).sql("select o_orderkey from orders where o_orderstatus = $1 and o_totalprice > $2", ["F", 1500])


def python_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registered function and a registered operator."""
    e = engine(spark, sf_dir)
    e.register_function("shout", ["text"], "text", lambda s: s.upper() + "!")
    e.register_operator("#", "text", "int", "text", lambda s, n: s * n)
    return e.sql("select n_nationkey, shout(n_name) as s, 'ab' # 2 as r from nation")


def dml_load_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of a table loaded from rows that come out of a shuffle."""
    e = engine(spark, sf_dir)
    e.load("o", e.sql("select o_custkey as k, count(*) as n from orders group by o_custkey").repartition(7))
    e.none("delete from o where k % 7 = 0; update o set n = n + 100 where k % 7 = 1")
    return e.sql("select k, n from o")


def migrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps applied, one undone, one that fails half-way."""
    e = engine(spark, sf_dir)
    steps = [
        {"id": 1, "name": "a", "up": "create table t (k int, v text)", "down": "drop table t"},
        {"id": 2, "name": "b", "up": "insert into t select r_regionkey, r_name from region", "down": "delete from t"},
        {"id": 3, "name": "c", "up": "delete from t where k > 2", "down": "insert into t values (100, 'undone')"},
    ]
    e.migrate(steps)
    e.migrate(steps[:2])
    try:
        e.migrate([*steps[:2], {"id": 4, "name": "d", "up": "delete from t; insert into nowhere values (1)", "down": ""}])
    except QueryError:
        pass
    return e.sql("select k, v, (select count(*) from migrations) as steps from t")


def table_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows put in and found as objects."""
    e = engine(spark, sf_dir)
    t = e.declare_table("t", [{"name": "id", "type": "serial", "constraints": ["primary key"]}, {"name": "j", "type": "jsonb"}])
    for k in range(3):
        t.insert({"j": {"k": k, "odd": k % 2 == 1}})
    found = t.find({"j": {"odd": False}}, ["id"])
    return spark.createDataFrame([(r["id"],) for r in found], "id int")


def overloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overloads by argument type, a language, an extension."""
    e = engine(spark, sf_dir)
    e.register_function("kind", ["int"], "text", lambda x: f"int {x}")
    e.register_function("kind", ["text"], "text", lambda x: f"text {x}")
    e.register_language("shout", lambda code, names, returns: lambda x: x.upper() + code.strip())
    e.register_extension("more", lambda db: db.register_function("more", ["int"], "int", lambda x: x + 1))
    e.none("create extension more; create function loud(x text) returns text as '!' language shout")
    return e.sql("select n_nationkey, kind(n_nationkey) as a, kind(n_name) as b, loud(n_name) as c, more(n_nationkey) as d from nation")


PYTHON: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "snapshot_restore": (snapshot_restore, "select count(*) as n from nation"),
    "prepared_query": (prepared_query, "select o_orderkey from orders where o_orderstatus = 'F' and o_totalprice > 1500"),
    "dml_load_delete": (dml_load_delete, "select o_custkey as k, count(*) + case when o_custkey % 7 = 1 then 100 else 0 end as n from orders where o_custkey % 7 <> 0 group by o_custkey"),
    "migrations": (migrations, "select r_regionkey as k, r_name as v, 2::bigint as steps from region where r_regionkey <= 2 union all select 100, 'undone', 2"),
    "table_api": (table_api, "select 1 as id union all select 3"),
    "overloads": (overloads, "select n_nationkey, 'int ' || n_nationkey as a, 'text ' || n_name as b, upper(n_name) || '!' as c, n_nationkey + 1 as d from nation"),
    "python_function": (python_function, "select n_nationkey, upper(n_name) || '!' as s, 'abab' as r from nation"),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: _run(s) for k, (s, _) in (SELECTS | SCRIPTS).items()} | {k: f for k, (f, _) in PYTHON.items()}
ORACLE_SQL: dict[str, str] = {k: d or s for k, (s, d) in SELECTS.items()} | {k: d for k, (_, d) in SCRIPTS.items()} | {k: d for k, (_, d) in PYTHON.items()}
