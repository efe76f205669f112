"""Rows to literals of SQL dialects and of the contract language, as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that the language escapes. The backslash comes first, as the others bring new ones.
ESCAPES = [("\\", "\\\\"), ("'", "\\'"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r"), ("\b", "\\b"), ("\f", "\\f"), ("\v", "\\v"), ("\0", "\\0")]
IDENTIFIER = r"^[\p{L}\p{M}_][\p{L}\p{M}0-9_]*$"


def escape_string(c: Column) -> Column:
    for raw, escaped in ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(escaped))
    return c


def quote_identifier(c: Column) -> Column:
    """A name as the language writes it: quoted unless it is a plain identifier."""
    return F.when(c.rlike(IDENTIFIER), c).otherwise(F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"')))


def split_identifier(c: Column) -> Column:
    """The parts of a dotted name; dots within double quotes don't split, and the quotes go."""
    parts = F.regexp_extract_all(c, F.lit(r'"(?:[^"\\]|\\.)*"|[^."]+'), F.lit(0))
    return F.transform(parts, lambda p: F.replace(F.regexp_replace(p, r'^"|"$', ""), F.lit('\\"'), F.lit('"')))


def sql_text(c: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))


def iso_datetime(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


def oracle_datetime(text: Column) -> Column:
    """An Oracle timestamp of ISO text: with zone if it has an offset. The wall clock stays as written."""
    form = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2})(?:\.(\d{1,3}))?(Z|[+-]\d{2}:\d{2})?$"
    part = lambda k: F.regexp_extract(text, form, k)
    stamp = F.concat(part(1), F.lit(" "), part(2), F.lit("."), F.rpad(part(3), 3, "0"))
    zone = F.when(part(4) == "Z", "+00:00").otherwise(part(4))
    zoned = F.concat(F.lit("TO_TIMESTAMP_TZ('"), stamp, F.lit(" "), zone, F.lit("', 'YYYY-MM-DD HH24:MI:SS.FF3 TZH:TZM')"))
    plain = F.concat(F.lit("TO_TIMESTAMP('"), stamp, F.lit("', 'YYYY-MM-DD HH24:MI:SS.FF3')"))
    return F.when(~text.rlike(form), sql_text(text)).when(zone == "", plain).otherwise(zoned)


def sql_literal(c: Column, data_type: T.DataType, dialect: str) -> Column:
    """A typed column as literals of postgres, mysql, mssql or oracle."""
    if isinstance(data_type, T.BooleanType):
        yes, no = ("1", "0") if dialect in ("mssql", "oracle") else ("TRUE", "FALSE")
        text = F.when(c, yes).otherwise(no)
    elif isinstance(data_type, T.NumericType):
        text = c.cast("string")
    elif isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        text = oracle_datetime(iso_datetime(c)) if dialect == "oracle" else sql_text(iso_datetime(c))
    else:
        text = sql_text(c.cast("string"))
    return F.when(c.isNull(), "NULL").otherwise(text)


def sql_tuple(columns: list[tuple[Column, T.DataType]], dialect: str) -> Column:
    return F.concat(F.lit("("), F.concat_ws(", ", *(sql_literal(c, t, dialect) for c, t in columns)), F.lit(")"))


def language_literal(c: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.BooleanType):
        text = F.when(c, "true").otherwise("false")
    elif isinstance(data_type, T.NumericType):
        text = c.cast("string")
    elif isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        text = F.concat(F.lit("'"), iso_datetime(c), F.lit("'"))
    else:
        text = F.concat(F.lit("'"), escape_string(c.cast("string")), F.lit("'"))
    return F.when(c.isNull(), "null").otherwise(text)


def language_row(columns: list[tuple[Column, T.DataType]]) -> Column:
    return F.concat_ws(", ", *(language_literal(c, t) for c, t in columns))
