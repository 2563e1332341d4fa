"""The feature operators as Spark ML stages.

Subclass ``HistoryStage`` (or ``pyspark.ml.Transformer``) to add a step of your own.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revisit.functions.columns import ref
from revisit.operators import timeline
from revisit.operators.align import align, feature_columns, leftover_columns
from revisit.operators.history import split_current_ever
from revisit.operators.hot import DEFAULT_POLICY, HotPolicy
from revisit.schema import MASTER, NOT_FEATURES, SPLIT_CLASSES, WEEK_WINDOWS, EventColumns


class EventParams(Params):
    """Names of the event columns; defaults are those of the consolidated table."""

    eventId = Param(Params._dummy(), "eventId", "event id column", TypeConverters.toString)
    entity = Param(Params._dummy(), "entity", "entity column", TypeConverters.toString)
    ts = Param(Params._dummy(), "ts", "event time column", TypeConverters.toString)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(eventId=MASTER.event_id, entity=MASTER.entity, ts=MASTER.ts)

    def columns(self) -> EventColumns:
        get = self.getOrDefault
        return EventColumns(get(self.eventId), get(self.entity), get(self.ts))


class HistoryStage(
    Transformer, EventParams, DefaultParamsReadable, DefaultParamsWritable
):
    """A step that can also run inside a hot/ordinary split."""

    def run(self, df: DataFrame, policy: HotPolicy) -> DataFrame:
        raise NotImplementedError

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.run(df, DEFAULT_POLICY)


class FutureScore(HistoryStage):
    """Adds the label. Used on training rows only."""

    window = Param(Params._dummy(), "window", "days ahead", TypeConverters.toInt)
    breakDays = Param(Params._dummy(), "breakDays", "days of silence", TypeConverters.toInt)
    coefficient = Param(Params._dummy(), "coefficient", "gap weight", TypeConverters.toFloat)

    @keyword_only
    def __init__(
        self, *, eventId=None, entity=None, ts=None, window=365, breakDays=28, coefficient=1.0
    ):
        super().__init__()
        self._setDefault(window=365, breakDays=28, coefficient=1.0)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def run(self, df, policy):
        get = self.getOrDefault
        return timeline.look_ahead(
            df, self.columns(), get(self.window), get(self.breakDays), get(self.coefficient),
            policy=policy,
        )


class WeeklyCounts(HistoryStage):
    """Adds the trailing weekly counts."""

    weeks = Param(Params._dummy(), "weeks", "window lengths", TypeConverters.toListInt)
    strictPast = Param(Params._dummy(), "strictPast", "skip later events", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, eventId=None, entity=None, ts=None, weeks=None, strictPast=False):
        super().__init__()
        self._setDefault(weeks=list(WEEK_WINDOWS), strictPast=False)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def run(self, df, policy):
        return timeline.weekly_counts(
            df, self.columns(), self.getOrDefault(self.weeks),
            strict_past=self.getOrDefault(self.strictPast), policy=policy,
        )


class CurrentEver(HistoryStage):
    """Splits count columns into current and ever-seen ones."""

    classes = Param(Params._dummy(), "classes", "name parts", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, eventId=None, entity=None, ts=None, classes=None):
        super().__init__()
        self._setDefault(classes=list(SPLIT_CLASSES))
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def run(self, df, policy, seen=None):
        return split_current_ever(df, self.columns(), self.getOrDefault(self.classes), policy, seen)


class _BurstParams(EventParams):
    breakDays = Param(Params._dummy(), "breakDays", "days of silence", TypeConverters.toInt)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(breakDays=28)


class BurstFeatures(Estimator, _BurstParams, DefaultParamsReadable, DefaultParamsWritable):
    """Learns the first event time, so that ordinals at scoring start where training did."""

    @keyword_only
    def __init__(self, *, eventId=None, entity=None, ts=None, breakDays=28):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> BurstFeaturesModel:
        first = df.agg(F.min(ref(self.columns().ts)).cast("string")).first()[0]
        model = BurstFeaturesModel(start=first)
        return self._copyValues(model)


class BurstFeaturesModel(
    Model, _BurstParams, DefaultParamsReadable, DefaultParamsWritable
):
    """Adds the six sequence features."""

    start = Param(Params._dummy(), "start", "first event time at fit", TypeConverters.toString)

    def __init__(self, start: str | None = None) -> None:
        super().__init__()
        if start is not None:
            self._set(start=start)

    def run(self, df: DataFrame, policy: HotPolicy) -> DataFrame:
        start = None
        if self.isSet(self.start):
            start = F.lit(self.getOrDefault(self.start)).cast("timestamp_ntz")
        return timeline.burst_features(
            df, self.columns(), self.getOrDefault(self.breakDays), start, policy=policy
        )

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.run(df, DEFAULT_POLICY)


class AlignSchema(Estimator, EventParams, DefaultParamsReadable, DefaultParamsWritable):
    """Learns the feature columns: everything that is not on the exclusion list."""

    excluded = Param(Params._dummy(), "excluded", "never features", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, eventId=None, entity=None, ts=None, excluded=None):
        super().__init__()
        self._setDefault(excluded=list(NOT_FEATURES))
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> AlignSchemaModel:
        model = AlignSchemaModel(feature_columns(df.columns, self.getOrDefault(self.excluded)))
        return self._copyValues(model)


class AlignSchemaModel(Model, EventParams, DefaultParamsReadable, DefaultParamsWritable):
    """Leftover columns as they are, then exactly the fitted feature columns as doubles."""

    columnSchema = Param(
        Params._dummy(), "columnSchema", "feature columns in order", TypeConverters.toListString
    )

    def __init__(self, column_schema: list[str] | None = None) -> None:
        super().__init__()
        if column_schema is not None:
            self._set(columnSchema=column_schema)

    def schema(self) -> list[str]:
        return self.getOrDefault(self.columnSchema)

    def _transform(self, df: DataFrame) -> DataFrame:
        known = self.schema()
        kept = [c for c in leftover_columns(df, known)]
        return align(df, known, kept)
