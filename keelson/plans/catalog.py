"""The contract as queryable frames, one for each kind of entity, and the catalog queries over such frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.types import value_tag
from ..model import DEFAULT_SCHEMA, Database, View

SCHEMAS = {
    "schemas": "schema_name string",
    "tables": "schema_name string, table_name string, alias string, note string, color string, group_name string",
    "fields": "schema_name string, table_name string, field_name string, position int, type_schema string, type_name string, tag string, pk boolean, is_unique boolean, not_null boolean, increment boolean, default_kind string, default_value string, note string, partial string",
    "indexes": "schema_name string, table_name string, index_no int, index_name string, pk boolean, is_unique boolean, type string, note string",
    "index_columns": "schema_name string, table_name string, index_no int, position int, value string, kind string",
    "checks": "schema_name string, table_name string, field_name string, check_name string, expression string, partial string",
    "enums": "schema_name string, enum_name string, note string",
    "enum_values": "schema_name string, enum_name string, position int, value string, note string",
    "refs": "ref_no int, ref_name string, on_delete string, on_update string, inactive boolean, partial string",
    "endpoints": "ref_no int, side int, schema_name string, table_name string, field_name string, position int, relation string",
    "groups": "schema_name string, group_name string, position int, table_schema string, table_name string, note string, color string",
    "partials": "partial_name string, note string, color string",
    "notes": "note_name string, content string, color string",
    "records": "schema_name string, table_name string, columns array<string>, row_count int",
    "project": "name string, note string, key string, value string",
}


def catalog(spark: SparkSession, db: Database) -> dict[str, DataFrame]:
    """A frame for each of SCHEMAS. A contract's metadata is small; its rows aren't here."""
    rows: dict[str, list[tuple]] = {k: [] for k in SCHEMAS}
    grouped = {}
    for g in db.groups:
        for i, (schema, name) in enumerate(g.tables):
            table = db.table(name, schema)
            key = table.key if table else (schema or DEFAULT_SCHEMA, name)
            grouped.setdefault(key, g.name)
            rows["groups"].append((g.schema or DEFAULT_SCHEMA, g.name, i, *key, g.note, g.color))
    names = {DEFAULT_SCHEMA} | {t.key[0] for t in db.tables} | {e.schema or DEFAULT_SCHEMA for e in db.enums}
    rows["schemas"] = [(n,) for n in sorted(names)]
    for t in db.tables:
        rows["tables"].append((*t.key, t.alias, t.note, t.color, grouped.get(t.key)))
        for i, c in enumerate(t.columns):
            tag = value_tag(c.type, db.enum(c.type, c.type_schema) is not None)
            rows["fields"].append((*t.key, c.name, i, c.type_schema or DEFAULT_SCHEMA, c.type, tag, c.pk, c.unique, bool(c.not_null), c.increment, c.default and c.default.kind, c.default and c.default.value, c.note, c.partial))
            rows["checks"] += [(*t.key, c.name, k.name, k.expression, k.partial) for k in c.checks]
        rows["checks"] += [(*t.key, None, k.name, k.expression, k.partial) for k in t.checks]
        for i, x in enumerate(t.indexes):
            rows["indexes"].append((*t.key, i, x.name, x.pk, x.unique, x.type, x.note))
            rows["index_columns"] += [(*t.key, i, j, p.value, p.kind) for j, p in enumerate(x.parts)]
    for e in db.enums:
        key = (e.schema or DEFAULT_SCHEMA, e.name)
        rows["enums"].append((*key, e.note))
        rows["enum_values"] += [(*key, i, v.name, v.note) for i, v in enumerate(e.values)]
    for i, r in enumerate(db.all_refs()):
        rows["refs"].append((i, r.name, r.on_delete, r.on_update, r.inactive, r.partial))
        rows["endpoints"] += [(i, s, e.schema or DEFAULT_SCHEMA, e.table, c, j, e.relation) for s, e in enumerate(r.ends) for j, c in enumerate(e.columns)]
    rows["partials"] = [(p.name, p.note, p.color) for p in db.partials]
    rows["notes"] = [(n.name, n.content, n.color) for n in db.notes]
    rows["records"] = [(r.schema or DEFAULT_SCHEMA, r.table, r.columns, len(r.rows)) for r in db.records]
    if db.project:
        p = db.project
        rows["project"] = [(p.name, p.note, k, v) for k, v in p.values.items()] or [(p.name, p.note, None, None)]
    return {k: spark.createDataFrame(rows[k], schema) for k, schema in SCHEMAS.items()}


def field_enums(fields: DataFrame, enums: DataFrame) -> DataFrame:
    """fields with enum_name, null where the type is no enum."""
    e = enums.select(F.col("schema_name").alias("type_schema"), F.col("enum_name").alias("type_name"), F.lit(True).alias("__found"))
    return fields.join(e, ["type_schema", "type_name"], "left").withColumn("enum_name", F.when(F.col("__found"), F.col("type_name"))).drop("__found")


def record_tables(records: DataFrame, tables: DataFrame) -> DataFrame:
    return records.join(tables, ["schema_name", "table_name"])


def name_collisions(named: DataFrame, keys: list[str]) -> DataFrame:
    return named.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def group_conflicts(groups: DataFrame) -> DataFrame:
    """Tables that are in a group more than once, or in more than one."""
    return name_collisions(groups, ["table_schema", "table_name"])


def view_tables(tables: DataFrame, view: View) -> DataFrame:
    """The tables that a view shows: of its tables, groups and schemas, each None (adds nothing), [] (all) or names.
    With tables, groups and schemas all None nothing is shown."""
    shown: Column = F.lit(False)
    full = F.concat_ws(".", "schema_name", "table_name")
    for names, match in ((view.tables, lambda n: F.col("table_name").isin(n) | full.isin(n)), (view.groups, lambda n: F.col("group_name").isin(n)), (view.schemas, lambda n: F.col("schema_name").isin(n))):
        if names is not None:
            shown = F.lit(True) if not names else shown | F.coalesce(match(names), F.lit(False))
    return tables.where(shown)


def split_constraints(key_columns: DataFrame) -> DataFrame:
    """Constraints (rows: schema_name, table_name, constraint_name, column_name, ordinal) with their columns in order,
    their number, and whether they can stand inline with the column."""
    return key_columns.groupBy("schema_name", "table_name", "constraint_name").agg(ordered_names("column_name", "ordinal").alias("columns"), F.count("*").alias("n")).withColumn("placement", F.when(F.col("n") == 1, "inline").otherwise("composite"))


def ordered_names(name: str, order: str, separator: str = ",") -> Column:
    """Aggregate: the names joined in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(name).cast("string").alias("n")))), lambda x: x["n"]), separator)


def distinct_names(name: str, separator: str = ",") -> Column:
    return F.array_join(F.array_sort(F.collect_set(name)), separator)


def default_kind(c: Column) -> Column:
    """increment, string, boolean, number or expression, of a database's default text; null for none."""
    return (
        F.when(c.isNull() | (F.lower(F.trim(c)) == "null"), F.lit(None).cast("string"))
        .when(c.rlike(r"(?i)^nextval\("), "increment")
        .when(c.rlike(r"^'"), "string")
        .when(F.lower(c).isin("true", "false"), "boolean")
        .when(c.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), "number")
        .otherwise("expression")
    )


def rendered_type(name: Column, length: Column, precision: Column, scale: Column) -> Column:
    """name(length), or name(precision,scale) where both are set and not 0, else name."""
    size = F.when(length > 0, F.format_string("(%s)", length)).when((precision > 0) & (scale > 0), F.format_string("(%s,%s)", precision, scale)).otherwise("")
    return F.concat(name, size)


def flagged_columns(inline_keys: DataFrame) -> DataFrame:
    """Single-column keys (table_name, column_name, kind) folded to flags; a pk isn't unique besides."""
    pk, unique = (F.bool_or(F.col("kind") == k) for k in ("pk", "unique"))
    return inline_keys.groupBy("table_name", "column_name").agg(pk.alias("pk"), (unique & ~pk).alias("is_unique"))


def table_checks(checks: DataFrame) -> DataFrame:
    """Check constraints (table_name, constraint_name, column_name, expression) as of a column where they name one."""
    return checks.groupBy("table_name", "constraint_name", "expression").agg(F.max("column_name").alias("column_name"), F.count("*").alias("n")).withColumn("level", F.when(F.col("n") == 1, "column").otherwise("table"))


def enum_catalog(labels: DataFrame) -> DataFrame:
    """Enums (schema_name, enum_name, label, sort_order; rows may repeat) with their labels in order."""
    return labels.distinct().groupBy("schema_name", "enum_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("sort_order", "label"))), lambda x: x["label"]).alias("labels"))


def literal_list(c: Column) -> Column:
    """The values of a type text like enum('a','it''s')."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"'((?:[^']|'')*)'"), F.lit(1)), lambda x: F.replace(x, F.lit("''"), F.lit("'")))


def without_constraints(indexes: DataFrame, constraints: DataFrame) -> DataFrame:
    """Indexes whose name is no constraint's of the same table. Written as an anti-join: NOT IN would drop all rows once a
    name is null."""
    return indexes.join(constraints.select("table_name", F.col("constraint_name").alias("index_name")).distinct(), ["table_name", "index_name"], "left_anti")


def to_tables(rows_: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Flat rows folded to an array for each key, in order."""
    rest = [c for c in rows_.columns if c not in keys]
    return rows_.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *(c for c in rest if c != order)))).alias(value))
