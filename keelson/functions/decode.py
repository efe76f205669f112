"""Cell decoding and type predicates as Column builders; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import Column as ColumnSpec
from .types import is_serial, split_type, value_tag

# Texts of booleans, and the patterns of accepted dates and times.
TRUE_TEXTS = ["true", "yes", "y", "t", "1"]
FALSE_TEXTS = ["false", "no", "n", "f", "0"]
DATE_FORMATS = [(r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"), (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"), (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy")]
_OFFSET = r"(Z|[+-]\d{2}(?::?\d{2})?)?"
_TIME = rf"^(\d{{2}}:\d{{2}}:\d{{2}})(?:\.(\d{{3}}))?{_OFFSET}$"
_DATETIME = rf"^(\d{{4}}-\d{{2}}-\d{{2}})[T ](\d{{2}}:\d{{2}})(:\d{{2}})?(?:[.,](\d{{1,9}}))?{_OFFSET}$"


def null_like(kind: Column, text: Column, type_text: str, is_enum: bool = False) -> Column:
    """A null, or an empty text for a column that isn't a string."""
    null = kind.isNull() | (kind == "null")
    return null if value_tag(type_text, is_enum) == "string" else null | ((kind == "string") & (text == ""))


def boolean_of(text: Column) -> Column:
    """The boolean that a text or number stands for, else null."""
    low = F.lower(text)
    return F.when(low.isin(TRUE_TEXTS), F.lit(True)).when(low.isin(FALSE_TEXTS), F.lit(False))


def number_of(text: Column) -> Column:
    """The number that a text stands for, else null; true and false count as 1 and 0."""
    return F.when(F.lower(text) == "true", 1.0).when(F.lower(text) == "false", 0.0).otherwise(text.try_cast("double"))


def integer_of(text: Column) -> Column:
    """number_of() where it is whole, else null."""
    n = number_of(text)
    return F.when(n == F.floor(n), n.try_cast("long"))


def exceeds_scale(c: Column, scale: int) -> Column:
    """Whether a number has more digits after the point than that. Of a float its shortest text counts, so it is equal to
    itself rounded to `scale` digits unless it has more; no text is made."""
    return F.round(c, scale) != c


def exceeds_precision(c: Column, precision: int) -> Column:
    """Whether a number has more digits than that, before (the 0 of 0.5 counts) and after the point together, however large
    or small it is. Infinite numbers and NaN exceed any precision."""
    # Of 10^k the double nearest to it is the bound, as its text is read: 10.0**23 is the next one above it.
    size = F.abs(c)
    body = F.when(size.isNull(), F.lit(None).cast("boolean"))
    for k in range(1, precision + 1):
        body = body.when(size < F.lit(float(f"1e{k}") if k > 18 else 10**k), exceeds_scale(c, precision - k))
    return body.otherwise(F.lit(True))


def _offset(text: Column) -> Column:
    return F.when(text.isin("Z", "+00:00", "-00:00", "+00", "-00", "+0000", "-0000"), "Z").when(F.length(text) == 3, F.concat(text, F.lit(":00"))).when(F.length(text) == 5, F.concat(F.substring(text, 1, 3), F.lit(":"), F.substring(text, 4, 2))).otherwise(text)


def _millis(text: Column) -> Column:
    digits = F.rpad(F.substring(text, 1, 3), 3, "0")
    return F.when((text == "") | (digits == "000"), "").otherwise(F.concat(F.lit("."), digits))


def datetime_of(text: Column) -> Column:
    """ISO 8601 text of a time, a date, or a date with time (tried in this order), else null. Milliseconds of 0 go; an
    offset stays as written, that of UTC as Z."""
    part = lambda pattern, k: F.regexp_extract(text, pattern, k)
    clock = F.try_to_timestamp(F.concat(F.lit("2000-01-01 "), part(_TIME, 1)), F.lit("yyyy-MM-dd HH:mm:ss"))
    time = F.when(text.rlike(_TIME) & clock.isNotNull(), F.concat(part(_TIME, 1), _millis(part(_TIME, 2)), _offset(part(_TIME, 3))))
    dates = [F.when(text.rlike(pattern), F.date_format(F.try_to_timestamp(text, F.lit(form)), "yyyy-MM-dd")) for pattern, form in DATE_FORMATS]
    minutes, seconds = part(_DATETIME, 2), F.when(part(_DATETIME, 3) == "", ":00").otherwise(part(_DATETIME, 3))
    moment = F.try_to_timestamp(F.concat(part(_DATETIME, 1), F.lit(" "), minutes, seconds), F.lit("yyyy-MM-dd HH:mm:ss"))
    both = F.when(text.rlike(_DATETIME) & moment.isNotNull(), F.concat(part(_DATETIME, 1), F.lit("T"), minutes, seconds, _millis(part(_DATETIME, 4)), _offset(part(_DATETIME, 5))))
    return F.coalesce(time, *dates, both)


def last_name(text: Column) -> Column:
    """The last name of a dotted enum access."""
    return F.element_at(F.split(text, r"\."), -1)


def requires_value(column: ColumnSpec) -> bool:
    """NOT NULL without increment, serial type or a default other than null."""
    usable = column.default is not None and column.default.value.lower() != "null"
    return bool(column.not_null) and not (usable or column.increment or is_serial(column.type))


def decode_cell(cell: Column, column: ColumnSpec, enum_values: list[str] | None = None) -> Column:
    """struct(value, tag, warning), all text, of a raw cell: struct(kind, value).

    Tried in order: expression, null, enum, number, boolean, date and time, string, anything else. A bad cell keeps
    its text, has its raw kind as tag, and a warning.
    """
    kind, text = cell["kind"], cell["value"]
    name, args, _ = split_type(column.type)
    tag = value_tag(column.type, enum_values is not None)

    def out(value: Column, as_tag: Column | str, warning: Column | str | None = None) -> Column:
        lit = lambda x: F.lit(x) if x is None or isinstance(x, str) else x
        return F.struct(value.cast("string").alias("value"), lit(as_tag).alias("tag"), lit(warning).cast("string").alias("warning"))

    bad = out(text, kind, f"Invalid {name} value for column '{column.name}'")
    if enum_values is not None:
        body = F.when(kind.isin("string", "word", "enum") & text.isin(enum_values), out(text, "string")).otherwise(out(text, kind, f"Invalid enum value for column '{column.name}'"))
    elif tag in ("integer", "real"):
        number, warning = text.try_cast("double"), F.lit(None).cast("string")
        if tag == "integer":
            body = F.when((kind == "number") & (number == F.floor(number)), out(number.cast("long"), tag)).when(kind == "number", out(F.floor(number), tag, f"Invalid integer value for column '{column.name}'")).otherwise(bad)
        else:
            if args and args[0].isdigit():
                precision, scale = int(args[0]), int(args[1]) if len(args) > 1 else 0
                warning = F.when(exceeds_scale(number, scale), f"Column '{column.name}' exceeds scale {scale}")
                warning = F.when(exceeds_precision(number, precision), f"Column '{column.name}' exceeds precision {precision}").otherwise(warning)
            body = F.when(kind == "number", out(text, tag, warning)).otherwise(bad)
    elif tag == "bool":
        known = F.when(kind.isin("bool", "string", "word") | ((kind == "number") & text.isin("0", "1")), boolean_of(text))
        body = F.when(known.isNotNull(), out(known, tag)).otherwise(bad)
    elif tag in ("date", "time", "datetime"):
        moment = F.when(kind == "string", datetime_of(text))
        body = F.when(moment.isNotNull(), out(moment, tag)).otherwise(bad)
    elif tag == "string":
        limit = int(args[0]) if args and args[0].isdigit() else None
        warning = F.when(F.octet_length(text) > limit, f"Column '{column.name}' exceeds {limit} bytes") if limit else None
        body = F.when(kind.isin("string", "number", "bool"), out(text, tag, warning)).otherwise(bad)
    else:
        body = out(text, tag)
    missing = f"NULL not allowed for column '{column.name}'" if requires_value(column) else None
    return F.when(kind == "expression", out(text, "expression")).when(null_like(kind, text, column.type, enum_values is not None), out(F.lit(None), tag, missing)).otherwise(body)
