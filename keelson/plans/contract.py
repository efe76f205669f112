"""A contract bound to DataFrames: its rules as one plan of violations, or as counts."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import decode
from ..functions.types import column_of, is_serial, quoted, spark_type
from ..model import Cell, Database, Endpoint, Index, Records, Ref, Table
from ..operators import keys, rows
from ..sources.language import compile_text

VIOLATIONS = "rule string, schema_name string, table_name string, columns array<string>, key_json string, message string"


@dataclass
class Key:
    kind: str  # pk or unique
    columns: list[str]


@dataclass
class Edge:
    """A direction in which a ref is checked: each key of source must be in target."""

    source: Endpoint
    target: Endpoint


def edges(ref: Ref) -> list[Edge]:
    """From the many side to the one side; both ways for one-to-one and many-to-many. An inactive ref counts too."""
    a, b = ref.ends
    if a.relation == b.relation:
        return [Edge(a, b), Edge(b, a)]
    return [Edge(a, b)] if a.relation == "*" else [Edge(b, a)]


@dataclass
class Contract:
    """strict: any default fills a null in a key, `null` and expressions too, so that nulls of such columns are equal.
    Otherwise only plain values do, as a database would fill them."""

    db: Database
    frames: dict[tuple[str, str], DataFrame] = field(default_factory=dict)
    strict: bool = True

    @classmethod
    def compile(cls, source: str, frames: dict[str, DataFrame], strict: bool = True) -> Contract:
        """frames: by table name, or schema.table."""
        db = compile_text(source).result()
        bound = {}
        for name, df in frames.items():
            schema, _, table = name.rpartition(".")
            found = db.table(table, schema or None)
            if found is None:
                raise KeyError(f"no table {name} in the contract")
            bound[found.key] = df
        return cls(db, bound, strict)

    def frame(self, end: Endpoint | Table) -> DataFrame | None:
        table = end if isinstance(end, Table) else self.db.table(end.table, end.schema)
        return self.frames.get(table.key) if table else None

    # ---- constraints

    def table_keys(self, table: Table) -> list[Key]:
        """The pk of an inline flag, pk and unique indexes, and unique flags; each column tuple once, pk first."""
        found = [Key("pk", [c.name]) for c in table.columns if c.pk]
        found += [Key("pk", i.columns) for i in table.indexes if i.pk and i.columns]
        found += [Key("unique", [c.name]) for c in table.columns if c.unique]
        found += [Key("unique", i.columns) for i in table.indexes if i.unique and not i.pk and i.columns]
        return list({tuple(k.columns): k for k in reversed(found)}.values())[::-1]

    def defaults(self, table: Table, names: list[str]) -> dict[str, str]:
        out = {}
        for n in names:
            spec = table.column(n)
            if spec.default is None or not self.strict and (spec.default.kind == "expression" or spec.default.value.lower() == "null"):
                continue
            out[n] = keys.default_value(spec)
        return out

    def _fills(self, table: Table, name: str) -> bool:
        spec = table.column(name)
        return spec.increment or is_serial(spec.type)

    def _row(self, found: DataFrame, rule: str, table: Table, names: list[str], message: Column) -> DataFrame:
        values = F.to_json(F.struct(*(column_of(found, n).alias(n) for n in names)), {"ignoreNullFields": "false"}) if set(names) <= set(found.columns) else F.lit(None).cast("string")
        schema, name = table.key
        return found.select(F.lit(rule).alias("rule"), F.lit(schema).alias("schema_name"), F.lit(name).alias("table_name"), F.array(*map(F.lit, names)).alias("columns"), values.alias("key_json"), message.alias("message"))

    def key_parts(self, table: Table) -> list[tuple[str, list[str], DataFrame, str, DataFrame | None]]:
        """(rule, columns, bad rows, message, a frame with their number if that is cheaper) of every pk and unique key.

        A pk with an incrementing column has neither nulls nor duplicates to report. A pk column that the frame lacks,
        with nothing to fill it, makes every row bad, and its other pk rules mute.
        """
        df, out = self.frame(table), []
        for key in self.table_keys(table):
            names = key.columns
            lacking = [n for n in names if n not in df.columns]
            defaults, label = self.defaults(table, names), names_of(table, names)
            what = "Composite " if len(names) > 1 else ""
            if key.kind == "pk" and any(n not in defaults and not self._fills(table, n) for n in lacking):
                out.append(("pk_missing_column", names, df, f"PK: column {', '.join(lacking)} of {table.label} is missing and has no default", None))
                continue
            full = df.withColumns({n: F.lit(None).cast(spark_type(table.column(n).type)) for n in lacking}) if lacking else df
            if key.kind == "pk":
                fill = dict.fromkeys((n for n in names if self._fills(table, n)), None)
                out.append(("pk_null", names, keys.null_key_rows(full, [n for n in names if n not in fill], defaults), f"NULL in {what}PK: {label} cannot be NULL", None))
                if fill:
                    continue
            out.append((f"{key.kind}_duplicate", names, keys.duplicate_rows(full, names, defaults), f"Duplicate {what}{key.kind.upper()}: {label}", keys.duplicate_count(full, names, defaults)))
        return out

    def null_keys(self, table: Table) -> list[tuple[str, str, Column]]:
        """(pk_null, columns, predicate) of each pk whose columns the frame has, for counting them with the row rules."""
        df, out = self.frame(table), []
        for key in self.table_keys(table):
            free = [n for n in key.columns if n not in self.defaults(table, key.columns) and not self._fills(table, n)]
            if key.kind == "pk" and free and set(key.columns) <= set(df.columns):
                out.append(("pk_null", ",".join(key.columns), keys.any_null([column_of(df, n) for n in free])))
        return out

    def edge_parts(self) -> list[tuple[Edge, Table, DataFrame]]:
        """Orphans of every direction of every ref, those of partials included. An edge is left out only where neither
        side has a frame; a side without one is empty."""
        out = []
        for ref in self.db.all_refs():
            if all(self.frame(e) is None for e in ref.ends):
                continue
            for edge in edges(ref):
                table, target = (self.db.table(e.table, e.schema) for e in (edge.source, edge.target))
                source, parent = self.frame(table), self.frame(target)
                if source is None:
                    continue
                if parent is None:
                    parent = source.sparkSession.createDataFrame([], T.StructType([T.StructField(n, spark_type(target.column(n).type)) for n in edge.target.columns]))
                defaults, of_target = self.defaults(table, edge.source.columns), self.defaults(target, edge.target.columns)
                out.append((edge, table, keys.orphan_rows(source, edge.source.columns, parent, edge.target.columns, defaults, target_defaults=of_target)))
        return out

    # ---- results

    def violations(self) -> DataFrame:
        """VIOLATIONS, a row for each bad row and rule."""
        parts = []
        for table in self.db.tables:
            df = self.frame(table)
            if df is None:
                continue
            schema, name = table.key
            key = [n for n in table.primary_key() if n in df.columns]
            found, held = rows.rules(df, table, self.db), keys.free_names(["broken"], df)[0]
            values = F.to_json(F.struct(*(F.col(quoted(n)).alias(n) for n in key)), {"ignoreNullFields": "false"}) if key else F.lit(None).cast("string")
            if found:
                bad = rows.broken(df, found, held)
                parts.append(bad.select(F.col(held)["rule"].alias("rule"), F.lit(schema).alias("schema_name"), F.lit(name).alias("table_name"), F.array(F.col(held)["rule_column"]).alias("columns"), values.alias("key_json"), F.col(held)["message"].alias("message")))
            for rule, names, found, message, _ in self.key_parts(table):
                parts.append(self._row(found, rule, table, names, key_message(found, message, names, rule)))
        for edge, table, found in self.edge_parts():
            parts.append(self._row(found, "fk", table, edge.source.columns, fk_message(found, edge)))
        if not parts:
            return SparkSession.active().createDataFrame([], VIOLATIONS)
        return reduce(DataFrame.unionByName, parts)

    def summary(self) -> DataFrame:
        """rule, table_name, column_names and violations (their number, 0 too) of every rule. No message is built."""
        parts = []
        for table in self.db.tables:
            df = self.frame(table)
            if df is None:
                continue
            name = ".".join(table.key)
            nulls = self.null_keys(table)
            parts.append(rows.rule_counts(df, table, self.db, nulls).select("rule", F.lit(name).alias("table_name"), F.col("rule_column").alias("column_names"), F.col("n").alias("violations")))
            counted = {(rule, names) for rule, names, _ in nulls}
            parts += [_count(found, rule, name, names, number) for rule, names, found, _, number in self.key_parts(table) if (rule, ",".join(names)) not in counted]
        parts += [_count(found, "fk", ".".join(table.key), edge.source.columns) for edge, table, found in self.edge_parts()]
        return reduce(DataFrame.unionByName, parts).groupBy("rule", "table_name", "column_names").agg(F.sum("violations").alias("violations"))


def _count(found: DataFrame, rule: str, table: str, names: list[str], number: DataFrame | None = None) -> DataFrame:
    number = found.agg(F.count("*").alias("violations")) if number is None else number
    return number.select(F.lit(rule).alias("rule"), F.lit(table).alias("table_name"), F.lit(",".join(names)).alias("column_names"), "violations")


def names_of(table: Table | Endpoint, names: list[str]) -> str:
    """t.c, or (t.a, t.b)."""
    label = table.label if isinstance(table, Table) else (f"{table.schema}.{table.table}" if table.schema else table.table)
    full = [f"{label}.{n}" for n in names]
    return full[0] if len(full) == 1 else f"({', '.join(full)})"


def values_of(df: DataFrame, names: list[str]) -> Column:
    """v, or (v, w); texts in double quotes, null as null."""
    parts = []
    for n in names:
        c = column_of(df, n)
        text = F.concat(F.lit('"'), c, F.lit('"')) if isinstance(df.schema[n].dataType, T.StringType) else c.cast("string")
        parts.append(F.coalesce(text, F.lit("null")))
    joined = F.concat_ws(", ", *parts)
    return joined if len(names) == 1 else F.concat(F.lit("("), joined, F.lit(")"))


def key_message(df: DataFrame, message: str, names: list[str], rule: str) -> Column:
    return F.concat(F.lit(f"{message} = "), values_of(df, names)) if rule.endswith("_duplicate") else F.lit(message)


def fk_message(df: DataFrame, edge: Edge) -> Column:
    return F.concat(F.lit(f"FK violation: {names_of(edge.source, edge.source.columns)} = "), values_of(df, edge.source.columns), F.lit(f" does not exist in {names_of(edge.target, edge.target.columns)}"))


# ---------------------------------------------------------------- inline records


def raw_records(spark: SparkSession, records: Records) -> DataFrame:
    """The block's rows of the right width as raw cells (struct of kind and value) under their column names; rows of
    another width are dropped, as wrong_width() tells."""
    cell = T.StructType([T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())])

    def text(c: Cell) -> str | None:
        if c.value is None:
            return None
        if isinstance(c.value, bool):
            return "true" if c.value else "false"
        return repr(int(c.value)) if isinstance(c.value, float) and c.value.is_integer() else str(c.value)

    data = [tuple((c.kind, text(c)) for c in row) for row in records.rows if len(row) == len(records.columns)]
    return spark.createDataFrame(data, T.StructType([T.StructField(n, cell) for n in records.columns]))


def wrong_width(records: Records) -> list[int]:
    """Numbers of the rows, from 1, that have more or fewer cells than there are columns."""
    return [i for i, row in enumerate(records.rows, 1) if len(row) != len(records.columns)]


def decoded_records(spark: SparkSession, db: Database, records: Records) -> DataFrame:
    """Each cell as struct(value, tag, warning)."""
    raw, table = raw_records(spark, records), db.table(records.table, records.schema)
    out = []
    for n in records.columns:
        spec = table.column(n)
        enum = db.enum(spec.type, spec.type_schema)
        out.append(decode.decode_cell(raw[n], spec, [v.name for v in enum.values] if enum else None).alias(n))
    return raw.select(*out)


def typed_records(spark: SparkSession, db: Database, records: Records) -> DataFrame:
    """The block as a typed frame; a cell that doesn't fit its type, or is an expression, is null."""
    table, decoded = db.table(records.table, records.schema), decoded_records(spark, db, records)
    return decoded.select(*(decoded[n]["value"].try_cast(spark_type(table.column(n).type, db.enum(table.column(n).type, table.column(n).type_schema) is not None)).alias(n) for n in records.columns))


def record_contract(spark: SparkSession, source: str, strict: bool = True) -> Contract:
    """The contract of a text over its own inline records."""
    db = compile_text(source).result()
    frames = {}
    for r in db.records:
        frames[db.table(r.table, r.schema).key] = typed_records(spark, db, r)
    return Contract(db, frames, strict)


def record_warnings(spark: SparkSession, db: Database) -> DataFrame:
    """table_name, column_name, value and message of every cell with a warning."""
    parts = []
    for r in db.records:
        decoded = decoded_records(spark, db, r)
        cells = F.array(*(F.struct(F.lit(n).alias("column_name"), decoded[n]["value"].alias("value"), decoded[n]["warning"].alias("message")) for n in r.columns))
        parts.append(decoded.select(F.lit(r.table).alias("table_name"), F.inline(cells)).where("message IS NOT NULL"))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "table_name string, column_name string, value string, message string")


def index_of(columns: list[str], **flags: bool) -> Index:
    from ..model import IndexPart

    return Index([IndexPart(c) for c in columns], **flags)
