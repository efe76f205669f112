"""Live catalogs to the model: databases over JDBC, and Spark's own catalog.

Each dialect gives the same flat frames (fields, keys, refs, checks, enums) by one query each, pushed to the
database; folding them into tables is ours. The frames are of catalog size; rows of data are never read.
"""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import DEFAULT_SCHEMA, Check, Column, Database, Default, Endpoint, EnumType, EnumValue, Index, IndexPart, Ref, Table
from ..plans.catalog import default_kind

_STANDARD = {
    "fields": """SELECT table_schema AS schema_name, table_name, column_name, ordinal_position AS ordinal, data_type,
        character_maximum_length AS length, numeric_precision AS numeric_precision, numeric_scale AS numeric_scale, is_nullable, column_default
        FROM information_schema.columns WHERE {schemas}""",
    "keys": """SELECT k.table_schema AS schema_name, k.table_name, k.constraint_name, c.constraint_type, k.column_name, k.ordinal_position AS ordinal
        FROM information_schema.key_column_usage k JOIN information_schema.table_constraints c
        ON c.constraint_name = k.constraint_name AND c.table_schema = k.table_schema AND c.table_name = k.table_name
        WHERE c.constraint_type IN ('PRIMARY KEY', 'UNIQUE') AND {k_schemas}""",
    "refs": """SELECT k.table_schema AS schema_name, k.table_name, k.constraint_name, k.column_name, k.ordinal_position AS ordinal,
        p.table_schema AS parent_schema, p.table_name AS parent_table, p.column_name AS parent_column, r.delete_rule, r.update_rule
        FROM information_schema.referential_constraints r
        JOIN information_schema.key_column_usage k ON k.constraint_name = r.constraint_name AND k.constraint_schema = r.constraint_schema
        JOIN information_schema.key_column_usage p ON p.constraint_name = r.unique_constraint_name AND p.constraint_schema = r.unique_constraint_schema
        AND p.ordinal_position = k.position_in_unique_constraint WHERE {k_schemas}""",
    "checks": """SELECT t.table_schema AS schema_name, t.table_name, c.constraint_name, c.check_clause AS expression
        FROM information_schema.check_constraints c JOIN information_schema.table_constraints t
        ON t.constraint_name = c.constraint_name AND t.constraint_schema = c.constraint_schema
        WHERE c.check_clause NOT LIKE '%IS NOT NULL' AND {t_schemas}""",
}
_POSTGRES = _STANDARD | {
    "fields": _STANDARD["fields"].replace("data_type,", "udt_name AS data_type,"),
    "enums": """SELECT n.nspname AS schema_name, t.typname AS enum_name, e.enumlabel AS label, e.enumsortorder AS sort_order
        FROM pg_type t JOIN pg_enum e ON e.enumtypid = t.oid JOIN pg_namespace n ON n.oid = t.typnamespace WHERE {n_schemas}""",
}
_MYSQL = _STANDARD | {
    "refs": """SELECT table_schema AS schema_name, table_name, k.constraint_name, column_name, ordinal_position AS ordinal,
        referenced_table_schema AS parent_schema, k.referenced_table_name AS parent_table, referenced_column_name AS parent_column, r.delete_rule, r.update_rule
        FROM information_schema.key_column_usage k JOIN information_schema.referential_constraints r
        ON r.constraint_name = k.constraint_name AND r.constraint_schema = k.constraint_schema WHERE {k_schemas}""",
    "fields": _STANDARD["fields"].replace("data_type,", "column_type AS data_type,"),
}
_ORACLE = {
    "fields": """SELECT owner AS schema_name, table_name, column_name, column_id AS ordinal, data_type, data_length AS length,
        data_precision AS numeric_precision, data_scale AS numeric_scale, nullable AS is_nullable, data_default_vc AS column_default FROM all_tab_columns WHERE {o_schemas}""",
    "keys": """SELECT k.owner AS schema_name, k.table_name, k.constraint_name, CASE c.constraint_type WHEN 'P' THEN 'PRIMARY KEY' ELSE 'UNIQUE' END AS constraint_type,
        k.column_name, k.position AS ordinal FROM all_cons_columns k JOIN all_constraints c ON c.owner = k.owner AND c.constraint_name = k.constraint_name
        WHERE c.constraint_type IN ('P', 'U') AND {k_owners}""",
    "refs": """SELECT k.owner AS schema_name, k.table_name, k.constraint_name, k.column_name, k.position AS ordinal, p.owner AS parent_schema,
        p.table_name AS parent_table, p.column_name AS parent_column, c.delete_rule, NULL AS update_rule FROM all_constraints c
        JOIN all_cons_columns k ON k.owner = c.owner AND k.constraint_name = c.constraint_name
        JOIN all_cons_columns p ON p.owner = c.r_owner AND p.constraint_name = c.r_constraint_name AND p.position = k.position WHERE c.constraint_type = 'R' AND {k_owners}""",
}
_SNOWFLAKE = {"fields": _STANDARD["fields"], "keys": _STANDARD["keys"]}
_BIGQUERY = {"fields": "SELECT table_schema AS schema_name, table_name, column_name, ordinal_position AS ordinal, data_type, NULL AS length, NULL AS numeric_precision, NULL AS numeric_scale, is_nullable, column_default FROM {dataset}.INFORMATION_SCHEMA.COLUMNS"}
CATALOGS = {"postgres": _POSTGRES, "mysql": _MYSQL, "mssql": _STANDARD, "oracle": _ORACLE, "snowflake": _SNOWFLAKE, "bigquery": _BIGQUERY}

FRAMES = {
    "fields": "schema_name string, table_name string, column_name string, ordinal int, data_type string, length long, numeric_precision int, numeric_scale int, is_nullable string, column_default string",
    "keys": "schema_name string, table_name string, constraint_name string, constraint_type string, column_name string, ordinal int",
    "refs": "schema_name string, table_name string, constraint_name string, column_name string, ordinal int, parent_schema string, parent_table string, parent_column string, delete_rule string, update_rule string",
    "checks": "schema_name string, table_name string, constraint_name string, expression string",
    "enums": "schema_name string, enum_name string, label string, sort_order double",
}


def schema_filter(column: str, schemas: list[str]) -> str:
    """A predicate that the database evaluates; no schema means all but its own."""
    if not schemas:
        return f"{column} NOT IN ('information_schema', 'pg_catalog', 'mysql', 'performance_schema', 'sys', 'SYS', 'SYSTEM', 'INFORMATION_SCHEMA')"
    return f"{column} IN ({', '.join(chr(39) + s.replace(chr(39), chr(39) * 2) + chr(39) for s in schemas)})"


def catalog_queries(dialect: str, schemas: list[str] | None = None, dataset: str = "") -> dict[str, str]:
    columns = {"schemas": "table_schema", "k_schemas": "k.table_schema", "t_schemas": "t.table_schema", "n_schemas": "n.nspname", "o_schemas": "owner", "k_owners": "k.owner"}
    filters = {k: schema_filter(c, schemas or []) for k, c in columns.items()}
    return {k: re.sub(r"\s+", " ", q.format(dataset=dataset, **filters)) for k, q in CATALOGS[dialect].items()}


def parse_connection(text: str) -> tuple[str, dict[str, str], list[str]]:
    """(JDBC url, options, schemas) of a url like postgresql://user:pw@host:5432/db?schemas=a,b."""
    parts = urlsplit(text.removeprefix("jdbc:"))
    query = dict(parse_qsl(parts.query))
    schemas = [s.strip() for s in query.pop("schemas", "").split(",") if s.strip()]
    options = {k: v for k, v in (("user", parts.username), ("password", parts.password)) if v}
    port = f":{parts.port}" if parts.port else ""
    return f"jdbc:{parts.scheme}://{parts.hostname or ''}{port}{parts.path}", options | query, schemas


def read_catalog(spark: SparkSession, connection: str, dialect: str) -> dict[str, DataFrame]:
    """The catalog's frames, a JDBC read each; a BigQuery dataset list gives a union over its datasets."""
    url, options, schemas = parse_connection(connection)

    def frame(query: str) -> DataFrame:
        df = spark.read.format("jdbc").options(url=url, query=query, **options).load()
        return df.toDF(*(c.lower() for c in df.columns))

    if dialect == "bigquery":
        out = None
        for dataset in schemas:
            part = frame(catalog_queries(dialect, dataset=dataset)["fields"])
            out = part if out is None else out.unionByName(part)
        return {"fields": out}
    return {k: frame(q) for k, q in catalog_queries(dialect, schemas).items()}


def type_text(data_type: str, length: int | None, precision: int | None, scale: int | None) -> str:
    """type(length), or type(precision,scale) where both are set and not 0; an array type of a leading underscore as T[]."""
    if "(" in data_type:
        return data_type
    base = data_type[1:] + "[]" if data_type.startswith("_") else data_type
    if length and length > 0 and re.search(r"char|binary|text|raw", base, re.I):
        return f"{base}({length})"
    return f"{base}({precision},{scale})" if precision and scale and re.search(r"numeric|decimal|number", base, re.I) else base


def to_model(frames: dict[str, DataFrame]) -> Database:
    """Folds the frames (FRAMES; a missing one is empty) into tables. Key columns keep their ordinal order and pairing."""
    with ThreadPoolExecutor(len(frames)) as pool:
        rows = dict(zip(frames, pool.map(_collect, frames.items()), strict=True))
    db, tables = Database(), {}
    schema_of = lambda s: None if s in (DEFAULT_SCHEMA, "dbo") else s
    for r in sorted(rows.get("fields", ()), key=lambda r: (r["schema_name"], r["table_name"], r["ordinal"])):
        key = (r["schema_name"], r["table_name"])
        if key not in tables:
            tables[key] = Table(r["table_name"], schema_of(r["schema_name"]))
            db.tables.append(tables[key])
        column = Column(r["column_name"], type_text(r["data_type"], r["length"], r["numeric_precision"], r["numeric_scale"]), not_null=True if r["is_nullable"] in ("NO", "N") else None)
        if r["kind"] == "increment":
            column.increment = True
        elif r["kind"]:
            text = r["column_default"]
            column.default = Default(r["kind"], re.sub(r"^'(.*?)'(::.*)?$", r"\1", text, flags=re.S).replace("''", "'") if r["kind"] == "string" else text)
        tables[key].columns.append(column)
    grouped: dict[tuple, list] = {}
    for r in sorted(rows.get("keys", ()), key=lambda r: (r["schema_name"], r["table_name"], r["constraint_name"], r["ordinal"])):
        grouped.setdefault((r["schema_name"], r["table_name"], r["constraint_name"], r["constraint_type"]), []).append(r["column_name"])
    for (schema, name, constraint, kind), columns in grouped.items():
        table = tables.get((schema, name))
        if table is None:
            continue
        pk = kind == "PRIMARY KEY"
        if len(columns) == 1:
            column = table.column(columns[0])
            column.pk, column.unique = column.pk or pk, not column.pk and not pk or column.unique
        else:
            table.indexes.append(Index([IndexPart(c) for c in columns], pk=pk, unique=not pk, name=None if pk else constraint))
    edges: dict[tuple, list] = {}
    for r in sorted(rows.get("refs", ()), key=lambda r: (r["schema_name"], r["table_name"], r["constraint_name"], r["ordinal"])):
        edges.setdefault((r["schema_name"], r["table_name"], r["constraint_name"]), []).append(r)
    for (schema, name, constraint), parts in edges.items():
        first, action = parts[0], lambda a: a.lower() if a and a.upper() != "NO ACTION" else None
        ends = Endpoint(first["parent_table"], [p["parent_column"] for p in parts], "1", schema_of(first["parent_schema"])), Endpoint(name, [p["column_name"] for p in parts], "*", schema_of(schema))
        db.refs.append(Ref(ends, constraint, action(first["delete_rule"]), action(first["update_rule"])))
    for r in rows.get("checks", ()):
        if table := tables.get((r["schema_name"], r["table_name"])):
            table.checks.append(Check(r["expression"], r["constraint_name"]))
    labels: dict[tuple, list] = {}
    for r in sorted(rows.get("enums", ()), key=lambda r: (r["schema_name"], r["enum_name"], r["sort_order"])):
        labels.setdefault((r["schema_name"], r["enum_name"]), []).append(r["label"])
    db.enums = [EnumType(n, [EnumValue(v) for v in dict.fromkeys(values)], schema_of(s)) for (s, n), values in labels.items()]
    return db


def _collect(item: tuple[str, DataFrame]) -> list:
    name, df = item
    return df.withColumn("kind", default_kind(F.col("column_default"))).collect() if name == "fields" else df.collect()


def from_spark_catalog(spark: SparkSession, database: str | None = None) -> Database:
    """Tables and views of a database of Spark's own catalog."""
    db = Database()
    for t in spark.catalog.listTables(database):
        schema = (t.namespace or [None])[-1]
        table = Table(t.name, None if schema in ("default", None) else schema, note=t.description)
        table.columns = [Column(c.name, c.dataType, not_null=None if c.nullable else True, note=c.description) for c in spark.catalog.listColumns(f"{schema}.{t.name}" if schema and not t.isTemporary else t.name)]
        db.tables.append(table)
    return db
