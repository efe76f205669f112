"""Row checks: every rule of a table in one projection, so one scan, however many rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import decode
from ..functions.types import column_of, is_kind, quoted, split_type, value_tag
from ..model import Database, Table
from .keys import free_names


def rules(df: DataFrame, table: Table, db: Database | None = None, only: set[str] | None = None) -> list[tuple[str, str, Column, str]]:
    """(rule, column, predicate that is true where the row is bad, message) of every check that can fail on these types, or
    of the rules in `only`.

    A null value breaks no rule but not_null, and an unknown check result passes, as in SQL.
    """
    out: list[tuple[str, str, Column, str]] = []
    present = {f.name: f.dataType for f in df.schema.fields}
    for spec in table.columns:
        name = spec.name
        if name not in present:
            continue
        c, kind = column_of(df, name), present[name]
        base, args, dims = split_type(spec.type)
        if decode.requires_value(spec):
            out.append(("not_null", name, c.isNull(), f"NULL not allowed for column '{name}'"))
        enum = db.enum(spec.type, spec.type_schema) if db else None
        tag = value_tag(spec.type, enum is not None)
        for check in spec.checks:
            out.append(("check", name, F.expr(check.expression) == F.lit(False), f"Check failed: {check.expression}"))
        if dims:
            continue
        if enum is not None:
            out.append(("enum", name, ~c.cast("string").isin([v.name for v in enum.values]), f"Invalid enum value for column '{name}'"))
        elif tag in ("integer", "real"):
            number = c.try_cast("double") if isinstance(kind, (T.StringType, T.BooleanType)) else c
            if isinstance(kind, (T.StringType, T.BooleanType)):
                out.append(("type", name, c.isNotNull() & c.cast("string").try_cast("double").isNull(), f"Invalid {base} value for column '{name}'"))
            if tag == "integer" and not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
                out.append(("integer", name, number != F.floor(number), f"Invalid integer value for column '{name}'"))
            if tag == "real" and args and args[0].isdigit():
                out.append(("precision", name, decode.exceeds_precision(number, int(args[0])), f"Column '{name}' exceeds precision {args[0]}"))
                scale = int(args[1]) if len(args) > 1 else 0
                over = decode.exceeds_scale(number, scale) & ~decode.exceeds_precision(number, int(args[0]))
                out.append(("scale", name, over, f"Column '{name}' exceeds scale {scale}"))
        elif tag == "bool" and not isinstance(kind, T.BooleanType):
            out.append(("type", name, c.isNotNull() & decode.boolean_of(c.cast("string")).isNull(), f"Invalid boolean value for column '{name}'"))
        elif tag in ("date", "time", "datetime") and isinstance(kind, T.StringType):
            out.append(("type", name, c.isNotNull() & decode.datetime_of(c).isNull(), f"Invalid {tag} value for column '{name}'"))
        elif is_kind("string", base) and args and args[0].isdigit():
            out.append(("length", name, F.octet_length(c.cast("string")) > int(args[0]), f"Column '{name}' exceeds {args[0]} bytes"))
    for check in table.checks:
        out.append(("check", check.name or "", F.expr(check.expression) == F.lit(False), f"Check failed: {check.expression}"))
    return [r for r in out if only is None or r[0] in only]


def broken(df: DataFrame, found: list[tuple[str, str, Column, str]], name: str) -> DataFrame:
    """df's rows once for each broken rule, with a struct of rule, rule_column and message under `name`."""
    each = F.array(*(F.when(bad, F.struct(F.lit(rule).alias("rule"), F.lit(column).alias("rule_column"), F.lit(message).alias("message"))) for rule, column, bad, message in found))
    return df.withColumn(name, F.explode(F.filter(each, lambda x: x.isNotNull())))


def bad_rows(df: DataFrame, table: Table, db: Database | None = None, only: set[str] | None = None) -> DataFrame:
    """df's rows once for each broken rule (or rule in `only`), with rule, rule_column and message; these get underscores
    where df has columns of these names."""
    names, found = ["rule", "rule_column", "message"], rules(df, table, db, only)
    own, free = [F.col(quoted(c)) for c in df.columns], free_names(names, df)
    if not found:
        return df.limit(0).select(*own, *(F.lit("").alias(n) for n in free))
    held = free_names(["broken"], df)[0]
    return broken(df, found, held).select(*own, *(F.col(held)[n].alias(f) for n, f in zip(names, free, strict=True)))


def rule_counts(df: DataFrame, table: Table, db: Database | None = None, more: list[tuple[str, str, Column]] = ()) -> DataFrame:
    """rule, rule_column and n: all rules, and more (rule, column, predicate), counted in one aggregate over one scan."""
    found = [*rules(df, table, db), *((rule, column, bad, "") for rule, column, bad in more)]
    if not found:
        return df.sparkSession.createDataFrame([], "rule string, rule_column string, n long")
    sums = df.agg(*(F.count(F.when(bad, 1)).alias(f"r{i}") for i, (_, _, bad, _) in enumerate(found)))
    pairs = F.array(*(F.struct(F.lit(rule).alias("rule"), F.lit(column).alias("rule_column"), F.col(f"r{i}").alias("n")) for i, (rule, column, _, _) in enumerate(found)))
    return sums.select(F.inline(pairs))
