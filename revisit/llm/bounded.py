"""Broadcasts behind a check of size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tables of at most so many rows (a few numbers a row, so some megabytes) may be broadcast.
MOST_BROADCAST = 200_000


def small(df: DataFrame) -> DataFrame:
    """``df``, a written table of narrow rows, to be broadcast if it is checked to be small."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df
