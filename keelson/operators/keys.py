"""Key constraints: null keys, duplicate keys, missing parents.

Duplicates are found by counting keys and a semi-join, not by a window: a window would hold all rows of a hot
key, whole, in one task. Keys of more than SMALL_MB of input are dealt out to as many tasks as their input needs
before they are counted or joined, so that no task's memory grows with it; of a hot key, a task then reads all
keys, narrow, but keeps one. Below that, partial sums are shuffled.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import column_of
from ..model import Column as ColumnSpec

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)

#: MB of input for each task that holds keys (about 400,000 rows of lineitem), and up to which Spark's number of tasks does.
TASK_MB, SMALL_MB = 4, 16


def default_value(column: ColumnSpec) -> str | None:
    """The text of the default that stands for a null in a key; of an expression or `null` too, since in strict mode any
    default fills nulls, so all nulls of such a column are one key."""
    return None if column.default is None else column.default.value


def _fits(text: str, kind: T.DataType) -> bool:
    """Whether a default surely is a value of this type."""
    if isinstance(kind, T.StringType):
        return True
    if isinstance(kind, _WHOLE):
        return re.fullmatch(rf"[+-]?\d{{1,{2 if isinstance(kind, T.ByteType) else 4 if isinstance(kind, T.ShortType) else 9}}}", text) is not None
    return isinstance(kind, (T.FloatType, T.DoubleType)) and re.fullmatch(r"[+-]?\d{1,9}(\.\d+)?", text) is not None


def _tagged(df: DataFrame, keys: list[str], defaults: dict[str, str] | None) -> list[bool]:
    return [k in (defaults or {}) and not _fits(defaults[k], df.schema[k].dataType) for k in keys]


def filled(df: DataFrame, keys: list[str], defaults: dict[str, str] | None, tagged: list[bool] | None = None, kinds: list[str] | None = None) -> list[Column]:
    """The key columns with nulls filled by defaults. A default that isn't a value of the column's type (an expression,
    `null`, a text) is a key of its own: where tagged, a key is a struct of value and default's text, one of them null.
    kinds: types to cast values to. A key is null only where nothing fills it."""
    out = []
    for i, (k, tag) in enumerate(zip(keys, tagged or _tagged(df, keys, defaults), strict=True)):
        default, c, kind = (defaults or {}).get(k), column_of(df, k), df.schema[k].dataType
        value = c
        if default is not None:
            own = F.lit(default).try_cast(kind)
            if isinstance(kind, (*_WHOLE, T.DecimalType)):  # 1.5 is no whole number, nor 0.125 a decimal(9,2)
                own = F.when(own.cast("double") == F.lit(default).try_cast("double"), own)
            value = F.coalesce(c, own)
        value = value.cast(kinds[i]) if kinds and kinds[i] else value
        if tag:
            text = F.when(value.isNull(), F.lit(default)) if default is not None else F.lit(None).cast("string")
            value = F.when(value.isNotNull() | text.isNotNull(), F.struct(value.alias("value"), text.alias("default")))
        out.append(value)
    return out


def any_null(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, [c.isNull() for c in columns])


def free_names(names: list[str], *frames: DataFrame) -> list[str]:
    """The names, each with as many underscores more as it takes to be no column's."""
    taken, out = {c.lower() for f in frames for c in f.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def null_key_rows(df: DataFrame, keys: list[str], defaults: dict[str, str] | None = None) -> DataFrame:
    """Rows in which a key column without default is null."""
    free = [column_of(df, k) for k in keys if k not in (defaults or {})]
    return df.where(any_null(free)) if free else df.limit(0)


def _input_mb(df: DataFrame) -> float:
    """The size of what df is read from; 0 where Spark doesn't know it. (Its estimate of df itself multiplies the sides of joins.)"""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    sizes = [leaves.apply(i).stats().sizeInBytes() for i in range(leaves.size())]
    return sum(n for n in sizes if n < 1 << 60) / 2**20


def dealt(df: DataFrame, names: list[str], *frames: DataFrame) -> DataFrame:
    """df dealt out by the columns `names`, to as many tasks as the inputs of the frames need.

    With a fixed number of tasks, or with those that adaptive execution joins by compressed bytes, what a task holds to
    count, sort or look up keys would grow with the input. A join's other side is dealt to as many tasks.
    """
    mb = max(map(_input_mb, frames))
    if mb <= SMALL_MB:
        return df
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(mb / TASK_MB)), *names)


def _counted(df: DataFrame, keys: list[str], defaults: dict[str, str] | None) -> tuple[DataFrame, list[str]]:
    """k0, k1, ... and n of every whole key."""
    names = [f"k{i}" for i in range(len(keys))]
    keyed = df.select(*(c.alias(n) for c, n in zip(filled(df, keys, defaults), names, strict=True)))
    return dealt(keyed.dropna(subset=names), names, df).groupBy(*names).agg(F.count("*").alias("n")), names


def duplicate_keys(df: DataFrame, keys: list[str], defaults: dict[str, str] | None = None) -> DataFrame:
    """Each key that occurs more than once, and n. Keys with a null aren't equal to any. The key of an unfit default is null."""
    counted, names = _counted(df, keys, defaults)
    values = [F.col(n)["value"] if tag else F.col(n) for n, tag in zip(names, _tagged(df, keys, defaults), strict=True)]
    return counted.where("n > 1").select(*(v.alias(k) for v, k in zip(values, keys, strict=True)), "n")


def duplicate_count(df: DataFrame, keys: list[str], defaults: dict[str, str] | None = None) -> DataFrame:
    """violations: how many rows have a key that occurs more than once. One shuffle, of partial counts."""
    return _counted(df, keys, defaults)[0].agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0).cast("long")).alias("violations"))


def duplicate_rows(df: DataFrame, keys: list[str], defaults: dict[str, str] | None = None) -> DataFrame:
    """All rows, whole, whose key occurs more than once."""
    names = free_names([f"__key{i}" for i in range(len(keys))], df)
    keyed = df.withColumns(dict(zip(names, filled(df, keys, defaults), strict=True)))
    counted, short = _counted(df, keys, defaults)
    repeated = counted.where("n > 1").select(*(F.col(k).alias(n) for k, n in zip(short, names, strict=True)))
    return keyed.join(repeated, names, "left_semi").drop(*names)


def same_kind(a: T.DataType, b: T.DataType) -> bool:
    return a == b or isinstance(a, _WHOLE) and isinstance(b, _WHOLE) or isinstance(a, T.NumericType) and isinstance(b, T.NumericType)


def _common(a: T.DataType, b: T.DataType) -> str | None:
    """The type in which values of unlike types are compared."""
    if a == b:
        return None
    if isinstance(a, _WHOLE) and isinstance(b, _WHOLE):
        return "long"
    return "double" if isinstance(a, (T.FloatType, T.DoubleType)) or isinstance(b, (T.FloatType, T.DoubleType)) else "decimal(38,9)"


def orphan_rows(source: DataFrame, keys: list[str], target: DataFrame, target_keys: list[str], defaults: dict[str, str] | None = None, unique_target: bool = False, target_defaults: dict[str, str] | None = None) -> DataFrame:
    """Rows of source whose key isn't in target. A row with a null in its key is exempt, unless a default fills it; nulls
    of target's keys are filled by target_defaults.

    Keys must be of one kind: a number never equals a text. unique_target: its keys are known to be distinct, so
    they aren't made so again.
    """
    pairs = [(source.schema[k].dataType, target.schema[t].dataType) for k, t in zip(keys, target_keys, strict=True)]
    for k, t, (a, b) in zip(keys, target_keys, pairs, strict=True):
        if not same_kind(a, b):
            raise TypeError(f"{k} ({a.simpleString()}) can't refer to {t} ({b.simpleString()})")
    tagged = [x or y for x, y in zip(_tagged(source, keys, defaults), _tagged(target, target_keys, target_defaults), strict=True)]
    kinds = [_common(a, b) if tag else None for (a, b), tag in zip(pairs, tagged, strict=True)]
    names = free_names([f"__key{i}" for i in range(len(keys))], source)
    keyed = source.withColumns(dict(zip(names, filled(source, keys, defaults, tagged, kinds), strict=True))).where(~any_null([F.col(n) for n in names]))
    known = target.select(*(c.alias(n) for c, n in zip(filled(target, target_keys, target_defaults, tagged, kinds), names, strict=True))).dropna(subset=names)
    known = dealt(known, names, source, target)
    known = known if unique_target else known.distinct()
    return keyed.join(known, names, "left_anti").drop(*names)


def junction(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of the table that a many-to-many tie needs: the distinct pairs of both sides' keys."""
    return df.select(*keys).dropna().distinct()


def symmetric_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """Unordered pairs, each once, as (low, high)."""
    return df.select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).distinct()


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key, by partial minima of (order, row): no window, so no key's rows meet in one task."""
    rest = [c for c in df.columns if c not in keys]
    ranked = F.struct(*(o.alias(f"__o{i}") for i, o in enumerate(order)), *(F.col(c) for c in rest))
    return df.groupBy(*keys).agg(F.min(ranked).alias("__first")).select(*keys, *(F.col("__first")[c].alias(c) for c in rest)).select(*df.columns)


def last_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    ranked = F.struct(*(o.alias(f"__o{i}") for i, o in enumerate(order)), *(F.col(c) for c in rest))
    return df.groupBy(*keys).agg(F.max(ranked).alias("__last")).select(*keys, *(F.col("__last")[c].alias(c) for c in rest)).select(*df.columns)


def merge_records(frames: list[DataFrame]) -> DataFrame:
    """All rows of all frames; columns in the order first seen, missing ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
