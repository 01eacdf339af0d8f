"""System catalogs as relations: information_schema from the definitions, the others by their columns only."""

from __future__ import annotations

from quernel.functions.types import BIGINT, BOOL, INT, TEXT, T, lit, q, spark_type

NAMES = T("array", of=TEXT)
TABLES = [(c, TEXT) for c in "table_catalog table_schema table_name table_type self_referencing_column_name reference_generation user_defined_type_catalog user_defined_type_schema user_defined_type_name is_insertable_into is_typed commit_action".split()]
#: fixed values: the columns of information_schema.columns
COLUMNS = [(c, INT if c in ("ordinal_position", "character_maximum_length", "character_octet_length", "numeric_precision", "numeric_precision_radix", "numeric_scale", "datetime_precision", "interval_precision", "maximum_cardinality") else TEXT) for c in "table_catalog table_schema table_name column_name ordinal_position column_default is_nullable data_type character_maximum_length character_octet_length numeric_precision numeric_precision_radix numeric_scale datetime_precision interval_type interval_precision character_set_catalog character_set_schema character_set_name collation_catalog collation_schema collation_name domain_catalog domain_schema domain_name udt_catalog udt_schema udt_name scope_catalog scope_schema scope_name maximum_cardinality dtd_identifier is_self_referencing is_identity identity_generation identity_start identity_increment identity_maximum identity_minimum identity_cycle is_generated generation_expression is_updatable".split()]
EMPTY = {
    ("information_schema", "table_constraints"): [(c, TEXT) for c in "constraint_catalog constraint_schema constraint_name table_catalog table_schema table_name constraint_type is_deferrable initially_deferred".split()],
    ("information_schema", "key_column_usage"): [*((c, TEXT) for c in "constraint_catalog constraint_schema constraint_name table_catalog table_schema table_name column_name".split()), ("ordinal_position", INT), ("position_in_unique_constraint", INT)],
    ("information_schema", "constraint_column_usage"): [(c, TEXT) for c in "table_catalog table_schema table_name column_name constraint_catalog constraint_schema constraint_name".split()],
    ("pg_catalog", "pg_constraint"): [("oid", BIGINT), ("conname", TEXT), ("connamespace", BIGINT), ("contype", TEXT), ("conrelid", BIGINT), ("confrelid", BIGINT), ("conkey", T("array", of=INT)), ("confkey", T("array", of=INT))],
    ("pg_catalog", "pg_class"): [("oid", BIGINT), ("relname", TEXT), ("relnamespace", BIGINT), ("reltype", BIGINT), ("relowner", BIGINT), ("relkind", TEXT), ("relnatts", INT), ("reltuples", INT), ("relhasindex", BOOL)],
    ("pg_catalog", "pg_namespace"): [("oid", BIGINT), ("nspname", TEXT), ("nspowner", BIGINT), ("nspacl", TEXT)],
    ("pg_catalog", "pg_attribute"): [("attrelid", BIGINT), ("attname", TEXT), ("atttypid", BIGINT), ("attnum", INT), ("attnotnull", BOOL), ("atthasdef", BOOL), ("attisdropped", BOOL), ("atttypmod", INT)],
    ("pg_catalog", "pg_index"): [("indexrelid", BIGINT), ("indrelid", BIGINT), ("indnatts", INT), ("indisunique", BOOL), ("indisprimary", BOOL), ("indkey", T("array", of=INT))],
    ("pg_catalog", "pg_type"): [("oid", BIGINT), ("typname", TEXT), ("typnamespace", BIGINT), ("typlen", INT), ("typtype", TEXT), ("typrelid", BIGINT), ("typelem", BIGINT), ("typarray", BIGINT)],
    ("pg_catalog", "pg_range"): [("rngtypid", BIGINT), ("rngsubtype", BIGINT)],
    ("pg_catalog", "pg_proc"): [("oid", BIGINT), ("proname", TEXT), ("pronamespace", BIGINT), ("prolang", BIGINT), ("prorettype", BIGINT)],
    ("pg_catalog", "pg_enum"): [("oid", BIGINT), ("enumtypid", BIGINT), ("enumsortorder", INT), ("enumlabel", TEXT)],
    ("pg_catalog", "pg_sequences"): [("schemaname", TEXT), ("sequencename", TEXT), ("start_value", BIGINT), ("last_value", BIGINT)],
    ("pg_catalog", "pg_user"): [("usename", TEXT), ("usesysid", BIGINT), ("usesuper", BOOL)],
    ("pg_catalog", "pg_database"): [("oid", BIGINT), ("datname", TEXT)],
    ("pg_catalog", "pg_statio_user_tables"): [("relid", BIGINT), ("schemaname", TEXT), ("relname", TEXT), ("heap_blks_read", BIGINT), ("heap_blks_hit", BIGINT)],
}


def names() -> set[tuple[str, str]]:
    return {*EMPTY, ("information_schema", "tables"), ("information_schema", "columns")}


def relation(engine, schema: str, name: str) -> tuple[str, list[tuple[str, T]]] | None:
    """Spark text and columns of a system catalog."""
    rows: list[dict] = []
    if (schema, name) == ("information_schema", "tables"):
        cols = TABLES
        for r in engine.state.rels.values():
            if r.kind in ("table", "view"):
                rows.append({"table_catalog": "db", "table_schema": r.schema, "table_name": r.name, "table_type": "BASE TABLE" if r.kind == "table" else "VIEW", "is_insertable_into": "YES" if r.kind == "table" and not r.readonly else "NO", "is_typed": "NO"})
    elif (schema, name) == ("information_schema", "columns"):
        cols = COLUMNS
        for t in engine.state.tables():
            for i, c in enumerate(t.cols):
                size = int(c.t.args[0]) if c.t.kind in ("varchar", "char") and c.t.args else None
                rows.append({"table_catalog": "db", "table_schema": t.schema, "table_name": t.name, "column_name": c.name, "ordinal_position": i + 1, "is_nullable": "NO" if c.not_null else "YES", "data_type": str(c.t).partition("(")[0] if c.t.kind != "array" else "ARRAY", "udt_name": c.t.kind, "character_maximum_length": size, "is_identity": "YES" if c.identity else "NO", "identity_generation": c.identity and c.identity.upper(), "is_generated": "ALWAYS" if c.generated is not None else "NEVER", "is_updatable": "YES"})
    elif (schema, name) in EMPTY:
        cols = EMPTY[schema, name]
        if name == "pg_database":
            rows = [{"oid": i + 1, "datname": s} for i, s in enumerate(sorted(engine.state.schemas))]
        if name == "pg_statio_user_tables":
            rows = [{"relid": i + 1, "schemaname": t.schema, "relname": t.name, "heap_blks_read": 0, "heap_blks_hit": 0} for i, t in enumerate(engine.state.tables()) if t.schema == "public"]
    else:
        return None
    cell = lambda v, t: f"CAST({'NULL' if v is None else lit(v) if isinstance(v, str) else v} AS {spark_type(t)})"
    texts = ["SELECT " + ", ".join(f"{cell(r.get(c), t)} AS {q(c)}" for c, t in cols) for r in rows]
    none = "SELECT " + ", ".join(f"{cell(None, t)} AS {q(c)}" for c, t in cols) + " WHERE false"
    return f"({' UNION ALL '.join(texts) if texts else none})", cols
