"""SQL type names and what they mean for rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The type names of each category by dialect.
INTEGER = {
    "mysql": {"int", "integer", "smallint", "bigint", "tinyint", "mediumint"},
    "postgres": {"int", "integer", "smallint", "bigint", "serial", "bigserial", "smallserial"},
    "mssql": {"int", "integer", "smallint", "bigint", "tinyint"},
    "oracle": {"int", "integer", "smallint"},
    "snowflake": {"int", "integer", "smallint", "bigint", "tinyint"},
}
FLOAT = {
    "mysql": {"decimal", "numeric", "float", "double", "real"},
    "postgres": {"decimal", "numeric", "real", "float", "double precision"},
    "mssql": {"decimal", "numeric", "float", "real"},
    "oracle": {"number", "decimal", "numeric", "float", "real"},
    "snowflake": {"number", "decimal", "numeric", "float", "double", "real"},
}
BOOLEAN = {"mysql": {"bool", "boolean", "bit"}, "postgres": {"bool", "boolean"}, "mssql": {"bit"}, "oracle": set(), "snowflake": {"boolean"}}
STRING = {
    "mysql": {"varchar", "char", "text", "tinytext", "mediumtext", "longtext"},
    "postgres": {"varchar", "char", "character", "character varying", "text"},
    "mssql": {"varchar", "char", "nvarchar", "nchar", "text", "ntext"},
    "oracle": {"varchar", "varchar2", "nvarchar2", "char", "nchar"},
    "snowflake": {"varchar", "char", "text", "string"},
}
BINARY = {
    "mysql": {"binary", "varbinary", "blob", "tinyblob", "mediumblob", "longblob"},
    "postgres": {"bytea"},
    "mssql": {"binary", "varbinary"},
    "oracle": {"blob", "raw"},
    "snowflake": {"binary", "varbinary"},
}
DATETIME = {
    "mysql": {"date", "datetime", "timestamp", "time"},
    "postgres": {"date", "time", "timetz", "timestamp", "timestamptz", "time with time zone", "time without time zone", "timestamp with time zone", "timestamp without time zone"},
    "mssql": {"date", "datetime", "datetime2", "smalldatetime", "time"},
    "oracle": {"date", "timestamp", "timestamp with time zone", "timestamp with local time zone"},
    "snowflake": {"date", "datetime", "time", "timestamp"},
}
SERIAL = {"serial", "smallserial", "bigserial"}
CATEGORIES = {"integer": INTEGER, "float": FLOAT, "boolean": BOOLEAN, "string": STRING, "binary": BINARY, "datetime": DATETIME}


def split_type(text: str) -> tuple[str, list[str], int]:
    """(name, arguments, number of array brackets) of a type's text."""
    text, dims = text.strip(), 0
    while bracket := re.search(r"\[[^\]]*\]\s*$", text):
        text, dims = text[: bracket.start()], dims + 1
    m = re.fullmatch(r"(.*?)\s*\(([^)]*)\)\s*(.*)", text, re.S)
    name, args = (f"{m[1]} {m[3]}", [a.strip() for a in m[2].split(",")]) if m else (text, [])
    return normalize(name), args, dims


def normalize(name: str) -> str:
    return re.sub(r"\s+", " ", name.strip().lower())


def is_kind(category: str, type_text: str, dialect: str | None = None) -> bool:
    """Whether the type's name is of the category, in the dialect or, without one, in any."""
    by_dialect = CATEGORIES[category]
    names = by_dialect[dialect] if dialect else set().union(*by_dialect.values())
    return split_type(type_text)[0] in names


def is_serial(type_text: str) -> bool:
    return split_type(type_text)[0] in SERIAL


def value_tag(type_text: str, is_enum: bool = False) -> str:
    """integer, real, bool, string, date, time, datetime, or the type's own text."""
    name = split_type(type_text)[0]
    if is_enum or is_kind("string", name):
        return "string"
    if is_kind("integer", name):
        return "integer"
    if is_kind("float", name):
        return "real"
    if is_kind("boolean", name):
        return "bool"
    if is_kind("datetime", name):
        return "date" if name == "date" else "time" if name.startswith("time") and not name.startswith("timestamp") else "datetime"
    return type_text


def spark_type(type_text: str, is_enum: bool = False) -> T.DataType:
    """The column type that a frame of this contract type has."""
    name, args, dims = split_type(type_text)
    if is_enum or is_kind("string", name):
        base: T.DataType = T.StringType()
    elif is_kind("integer", name):
        base = {"smallint": T.ShortType(), "tinyint": T.ShortType(), "smallserial": T.ShortType(), "bigint": T.LongType(), "bigserial": T.LongType()}.get(name, T.IntegerType())
    elif name in ("decimal", "numeric", "number") and args and args[0].isdigit() and int(args[0]) <= 38:
        base = T.DecimalType(int(args[0]), int(args[1]) if len(args) > 1 else 0)
    elif is_kind("float", name):
        base = T.DoubleType()
    elif is_kind("boolean", name):
        base = T.BooleanType()
    elif is_kind("binary", name):
        base = T.BinaryType()
    elif name == "date":
        base = T.DateType()
    elif value_tag(name) == "datetime":
        base = T.TimestampType() if "tz" in name or "with time zone" in name or "local" in name else T.TimestampNTZType()
    else:
        base = T.StringType()
    for _ in range(dims):
        base = T.ArrayType(base)
    return base


def normalized(c: Column) -> Column:
    """normalize() of a column of type names."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def tag_column(c: Column) -> Column:
    """value_tag() of a column of type names without arguments."""
    name = normalized(c)
    names = lambda k: sorted(set().union(*CATEGORIES[k].values()))
    dates = names("datetime")
    return (
        F.when(name.isin(names("string")), "string")
        .when(name.isin(names("integer")), "integer")
        .when(name.isin(names("float")), "real")
        .when(name.isin(names("boolean")), "bool")
        .when(name == "date", "date")
        .when(name.isin([d for d in dates if d.startswith("time") and not d.startswith("timestamp")]), "time")
        .when(name.isin(dates), "datetime")
        .otherwise(c)
    )


def quoted(name: str) -> str:
    """A column's name for Spark, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def column_of(df: DataFrame, name: str) -> Column:
    return df[quoted(name)]
