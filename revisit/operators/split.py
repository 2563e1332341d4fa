"""Label maturity and the temporal train/test cut."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revisit.functions.columns import ref
from revisit.operators.ranks import order_statistic
from revisit.schema import EventColumns


def matured(rows: DataFrame, ts: str, days: int = 365, events: DataFrame | None = None) -> DataFrame:
    """Rows at least ``days`` days older than the newest event, so their label is complete.

    The newest time comes from ``events`` (default: ``rows``) as a scalar subquery that reads one
    column. Apply after labels and features: they need the later events.
    """
    newest = (rows if events is None else events).agg(F.max(ref(ts)).alias("newest"))
    limit = newest.select(F.col("newest") - F.expr(f"INTERVAL '{int(days)}' DAY")).scalar()
    return rows.where(ref(ts) <= limit)


@dataclass(frozen=True)
class Cut:
    """Position in (time, id) order: rows before it train, the others test."""

    ts: datetime
    event_id: object

    def before(self, cols: EventColumns) -> Column:
        moment = F.expr(f"TIMESTAMP_NTZ'{self.ts.isoformat(sep=' ')}'")
        same = (ref(cols.ts) == moment) & (ref(cols.event_id) < F.lit(self.event_id))
        return (ref(cols.ts) < moment) | same


def temporal_cut(rows: DataFrame, cols: EventColumns, test_share: float = 0.25) -> Cut | None:
    """The exact cut after the first ``int((1 - test_share) * (n - 1))`` rows; None without rows.

    Found by counting passes over (time, id), without sorting or numbering the rows.
    """
    keys = rows.select(ref(cols.ts), ref(cols.event_id))
    count = keys.where(ref(cols.ts).isNotNull()).count()
    if not count:
        return None
    place = int((1 - test_share) * (count - 1))
    ts, below = order_statistic(keys, cols.ts, place)
    moment = F.expr(f"TIMESTAMP_NTZ'{ts.isoformat(sep=' ')}'")
    event_id, _ = order_statistic(keys.where(ref(cols.ts) == moment), cols.event_id, place - below)
    return Cut(ts, event_id)


def temporal_split(
    rows: DataFrame, cols: EventColumns, test_share: float = 0.25
) -> tuple[DataFrame, DataFrame]:
    """Train rows before the cut, test rows from it on. Both are plain filters over ``rows``."""
    cut = temporal_cut(rows, cols, test_share)
    if cut is None:
        return rows, rows
    return rows.where(cut.before(cols)), rows.where(~cut.before(cols))
