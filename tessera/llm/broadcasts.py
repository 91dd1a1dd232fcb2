"""Broadcasts of measured size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BYTES = 64 << 20


def size_of(df: DataFrame) -> int:
    """Bytes of the rows as JSON, which is about what they take in memory."""
    return df.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*"))) + 16), F.lit(0)).alias("size")).first()["size"]


def light(df: DataFrame, most: int = MAX_BYTES) -> DataFrame:
    """The table, to be broadcast if it takes at most so many bytes; else as it is, for a shuffled join. ``df`` is read for it: hand in a written table."""
    return F.broadcast(df) if size_of(df) <= most else df
