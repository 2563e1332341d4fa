"""Batch scoring of payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame

from revisit.operators.flagging import flag_over, flag_threshold, score_ratio
from revisit.operators.hot import DEFAULT_POLICY, HotPolicy
from revisit.operators.timeline import look_back
from revisit.plans.durable import durable
from revisit.plans.train import ScoringModel
from revisit.schema import EventColumns
from revisit.sources.payloads import parse_payloads, payload_tables


def score_payloads(model: ScoringModel, payloads: DataFrame) -> DataFrame:
    """Scores for payloads in the nested shape, which are parsed once."""
    return model.predict(payload_tables(durable(payloads, "payloads")))


def score_json(model: ScoringModel, rows: DataFrame, column: str) -> DataFrame:
    """Scores for payloads held as JSON text, read with all columns the model knows."""
    schema = model.features.consolidation.payload_schema()
    return score_payloads(model, parse_payloads(rows, column, schema))


def support_flags(
    scores: DataFrame,
    events: DataFrame,
    cols: EventColumns,
    flag_share: float = 0.1,
    threshold: float | None = None,
    policy: HotPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Scores with historical score, ratio and flag.

    Without a ``threshold`` it is calibrated so that ``flag_share`` of the events exceed it.
    """
    history = look_back(events, cols, policy=policy).select(cols.event_id, "historical_score")
    renamed = scores.withColumnRenamed("referralinstanceid", cols.event_id)
    rated = score_ratio(renamed.join(history, cols.event_id), "score")
    if threshold is None:
        rated = durable(rated, "ratios")  # read several times by the calibration
        threshold = flag_threshold(rated, flag_share=flag_share)
    return flag_over(rated, float("inf") if threshold is None else threshold)
