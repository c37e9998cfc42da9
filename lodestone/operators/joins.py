"""Broadcasts behind a check of size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side is broadcast; larger sides are left to sort-merge and AQE.
BROADCAST_ROWS = 20_000


def few(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; counting stops there."""
    return df.limit(rows + 1).count() <= rows


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for broadcast if it has at most ``rows`` rows; counting stops there."""
    return F.broadcast(df) if few(df, rows) else df
