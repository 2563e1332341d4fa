"""Weekly ranking quality: rank correlation and overlap of the top fraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revisit.functions import time as clock
from revisit.functions.columns import ref
from revisit.operators.hot import DEFAULT_POLICY, HotPolicy, split_by_heat
from revisit.operators.ranks import average_rank
from revisit.schema import EventColumns


def weekly_means(
    rows: DataFrame, cols: EventColumns, actual: str = "label", predicted: str = "prediction"
) -> DataFrame:
    """Mean actual and predicted score per week and entity."""
    return (
        rows.where(ref(cols.entity).isNotNull() & ref(cols.ts).isNotNull())
        .groupBy(clock.week_index(ref(cols.ts)).alias("week"), ref(cols.entity))
        .agg(F.avg(ref(actual)).alias("actual"), F.avg(ref(predicted)).alias("predicted"))
    )


def top_fraction(
    rows: DataFrame,
    group: str,
    value: str,
    threshold: float,
    name: str = "top",
    policy: HotPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Flag rows with descending rank / rows of the group below ``threshold``."""
    ranked = average_rank(
        rows, [group], value, "_rank", descending=True, policy=policy, size="_size"
    )
    top = (F.col("_rank") / F.col("_size")) < F.lit(threshold)
    return ranked.withColumn(name, top).drop("_rank", "_size")


def weekly_metrics(
    means: DataFrame, threshold: float = 0.5, policy: HotPolicy = DEFAULT_POLICY
) -> DataFrame:
    """Per week: Spearman correlation of actual and predicted, and the share of the predicted
    top fraction that is in the actual top fraction. Null where a week has no spread or no top.

    A week may hold most clients, so ranks come from ``average_rank`` (balanced chunks for large
    weeks), and the metrics are plain aggregates over the ranks with map-side combine.
    """

    def ranks(part: DataFrame, known: HotPolicy) -> DataFrame:
        ranked = average_rank(part, ["week"], "actual", "_a", policy=known, size="_size")
        return average_rank(ranked, ["week"], "predicted", "_p", policy=known)

    ranked = split_by_heat(means, ["week"], ranks, policy)

    def in_top(rank: str):
        return ((F.col("_size") + 1 - F.col(rank)) / F.col("_size")) < F.lit(threshold)

    spread = F.stddev_pop("_a") * F.stddev_pop("_p")
    return ranked.groupBy("week").agg(
        F.try_divide(F.covar_pop("_a", "_p"), spread).alias("spearman"),
        F.avg(F.when(in_top("_p"), in_top("_a").cast("double"))).alias("overlap"),
    )


def evaluate(
    rows: DataFrame,
    cols: EventColumns,
    actual: str = "label",
    predicted: str = "prediction",
    threshold: float = 0.2,
    policy: HotPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """One row: mean Spearman and overlap over the weeks where both exist."""
    weeks = weekly_metrics(weekly_means(rows, cols, actual, predicted), threshold, policy)
    complete = weeks.na.drop(subset=["spearman", "overlap"])
    return complete.agg(F.avg("spearman").alias("spearman"), F.avg("overlap").alias("overlap"))
