"""Rules on top of the scores."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revisit.functions.columns import ref
from revisit.operators.hot import DEFAULT_POLICY, HotPolicy, join_per_key
from revisit.operators.ranks import exact_quantile
from revisit.operators.timeline import events_in_last_months
from revisit.schema import EventColumns


def score_ratio(
    rows: DataFrame,
    predicted: str = "prediction",
    historical: str = "historical_score",
    name: str = "score_ratio",
) -> DataFrame:
    """Predicted score (scaled to 0-100) over historical score; null where history is zero."""
    return rows.withColumn(name, F.try_divide(ref(predicted) * 100, ref(historical)))


def flag_threshold(rows: DataFrame, ratio: str = "score_ratio", flag_share: float = 0.1):
    """The ratio that ``flag_share`` of the rows exceed; exact, by counting passes.

    Rows without a ratio, or with NaN, do not count.
    """
    return exact_quantile(rows.where(~F.isnan(ref(ratio))), ratio, 1 - flag_share)


def flag_over(
    rows: DataFrame, threshold: float, ratio: str = "score_ratio", name: str = "flagged"
) -> DataFrame:
    over = F.coalesce(ref(ratio) > F.lit(float(threshold)), F.lit(False))
    return rows.withColumn(name, over)


def flag_frequent(
    events: DataFrame,
    cols: EventColumns,
    at_least: int,
    months: int = 6,
    name: str = "frequent",
    policy: HotPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Flag events whose entity had at least ``at_least`` events in the last ``months`` months."""
    counted = events_in_last_months(events, cols, months, "_recent", policy)
    return counted.withColumn(name, F.col("_recent") >= at_least).drop("_recent")


def expected_events(
    events: DataFrame,
    reasons: DataFrame,
    key: str,
    item: str,
    expected: Iterable,
    keep: bool = False,
) -> DataFrame:
    """Drop (or, with ``keep``, return only) events that carry one of the expected reasons.

    ``reasons`` has rows (key, item). The expected items are a short list from the caller, so
    the filter reaches the scan of ``reasons``.
    """
    matching = reasons.where(ref(item).isin(list(expected))).select(ref(key))
    return events.join(matching, key, "left_semi" if keep else "left_anti")


def mark_members(
    rows: DataFrame,
    key: str,
    members: DataFrame,
    name: str,
    policy: HotPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Boolean column: is the key of the row among the keys of ``members``."""
    keys = members.select(ref(key)).distinct().withColumn("_member", F.lit(True))
    joined = join_per_key(rows, keys, key, policy)
    return joined.withColumn(name, F.coalesce(F.col("_member"), F.lit(False))).drop("_member")
