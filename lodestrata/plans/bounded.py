"""Broadcasts whose size is checked before they happen."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Rows that a broadcast side may have at most (about 10 MB of narrow rows).
MAX_BROADCAST_ROWS = 200_000


def broadcast_if_bounded(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, else as it is, for a shuffle join.

    The probe reads at most ``max_rows + 1`` rows.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
