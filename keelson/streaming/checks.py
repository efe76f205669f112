"""Contract checks on streams: an extension of ours, as contracts are batch-only by origin.

Row rules hold row by row, so they run unchanged; a key is unique within the watermark's reach; a foreign key is
checked against a static parent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..model import Database, Table
from ..operators.keys import orphan_rows
from ..operators.rows import bad_rows


def stream_violations(stream: DataFrame, table: Table, db: Database | None = None) -> DataFrame:
    """bad_rows of a stream."""
    return bad_rows(stream, table, db)


def stream_unique(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """The first row of each key among rows no further apart than delay; state older than that is let go."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def stream_orphans(stream: DataFrame, keys: list[str], parents: DataFrame, parent_keys: list[str]) -> DataFrame:
    """Rows of the stream whose key isn't among the static parents."""
    return orphan_rows(stream, keys, parents, parent_keys, unique_target=True)
