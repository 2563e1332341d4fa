"""Tables to feature matrix, with the state that makes scoring rows match training rows."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revisit.functions.columns import ref
from revisit.operators.align import label
from revisit.operators.consolidate import Consolidation
from revisit.operators.hot import DEFAULT_POLICY, HotPolicy, split_by_heat
from revisit.operators.pivot import MAX_CATEGORIES
from revisit.operators.timeline import valid_events
from revisit.plans.durable import durable
from revisit.plans.stages import (
    AlignSchema,
    AlignSchemaModel,
    BurstFeatures,
    BurstFeaturesModel,
    CurrentEver,
    FutureScore,
    WeeklyCounts,
)
from revisit.schema import CLIENT_KEY, MASTER, SPLIT_CLASSES, WEEK_WINDOWS


@dataclass
class FeatureSettings:
    window: int = 365
    break_days: int = 28
    break_coefficient: float = 1.0
    weeks: Sequence[int] = WEEK_WINDOWS
    split_classes: Sequence[str] = SPLIT_CLASSES
    encode_counts: bool = False
    strict_past: bool = False
    max_categories: int = MAX_CATEGORIES
    sparse: bool = False  # items in sparse vectors instead of columns, without ``max_categories``
    extra_stages: Sequence[Transformer | Estimator] = field(default_factory=list)


@dataclass
class FeaturePipeline:
    """Fitted feature steps: consolidate, label, sequence, weekly counts, split, align."""

    consolidation: Consolidation
    future: FutureScore
    burst: BurstFeaturesModel
    weekly: WeeklyCounts
    ever: CurrentEver
    extra: list[Transformer]
    aligner: AlignSchemaModel | None = None

    @classmethod
    def fit(
        cls,
        tables: Mapping[str, DataFrame],
        as_of: str | datetime,
        settings: FeatureSettings | None = None,
        policy: HotPolicy = DEFAULT_POLICY,
    ) -> FeaturePipeline:
        """Learn vocabularies, first event time and feature columns: two small aggregations."""
        return cls.fit_transform(tables, as_of, settings, policy)[0]

    @classmethod
    def fit_transform(
        cls,
        tables: Mapping[str, DataFrame],
        as_of: str | datetime,
        settings: FeatureSettings | None = None,
        policy: HotPolicy = DEFAULT_POLICY,
    ) -> tuple[FeaturePipeline, DataFrame]:
        """The fitted pipeline and the training rows (leftover columns, features, ``label``).

        ``as_of`` is the moment ages refer to; it is kept, so training and scoring agree.
        """
        s = settings or FeatureSettings()
        consolidation = Consolidation.fit(tables, as_of, s.encode_counts, s.max_categories)
        made = cls.unaligned(consolidation, tables, s)
        rows = made.fit_rows(tables, s.extra_stages, policy)
        made.aligner = AlignSchema().fit(rows)
        return made, made.aligner.transform(label(rows))

    @classmethod
    def unaligned(
        cls, consolidation: Consolidation, tables: Mapping[str, DataFrame], s: FeatureSettings
    ) -> FeaturePipeline:
        """All steps but the user's own and the last, with the first event time learned."""
        events = consolidation.bare_events(tables)
        return cls(
            consolidation=consolidation,
            future=FutureScore(
                window=s.window, breakDays=s.break_days, coefficient=float(s.break_coefficient)
            ),
            burst=BurstFeatures(breakDays=s.break_days).fit(events),
            weekly=WeeklyCounts(weeks=list(s.weeks), strictPast=s.strict_past),
            ever=CurrentEver(classes=list(s.split_classes)),
            extra=[],
        )

    def fit_rows(
        self,
        tables: Mapping[str, DataFrame],
        stages: Sequence[Transformer | Estimator],
        policy: HotPolicy = DEFAULT_POLICY,
    ) -> DataFrame:
        """The labelled training rows after the user's own stages, which become ``extra``.

        Estimators among them are fitted in order, each on the rows that the stages before it make.
        Those are written once for each estimator, which may read them as often as it likes.
        """
        rows = self.rows(tables, labelled=True, policy=policy)
        for stage in stages:
            if isinstance(stage, Estimator):
                rows = durable(rows, "stage-rows")
                stage = stage.fit(rows)
            rows = stage.transform(rows)
            self.extra.append(stage)
        return rows

    @property
    def column_schema(self) -> list[str]:
        return self.aligner.schema()

    @property
    def width(self) -> int:
        return len(self.column_schema)

    def assembler(self) -> list[Transformer]:
        """Stages between the rows and the learner."""
        return [
            VectorAssembler(inputCols=self.column_schema, outputCol="features", handleInvalid="error")
        ]

    def rows(
        self,
        tables: Mapping[str, DataFrame],
        labelled: bool = False,
        policy: HotPolicy = DEFAULT_POLICY,
    ) -> DataFrame:
        """All columns before alignment.

        Order of work: count maps join by event id; then everything keyed by the entity (label,
        sequence, weeks, client row, ever flags) shares one shuffle; count maps become columns
        only after the windows.
        """
        events = valid_events(self.consolidation.events(tables), MASTER)
        narrow = valid_events(self.consolidation.bare_events(tables), MASTER)

        def work(part: DataFrame, known: HotPolicy) -> DataFrame:
            seen = self.consolidation.spread(part)
            if labelled:
                part = self.future.run(part, known)
            part = self.burst.run(part, known)
            part = self.weekly.run(part, known)
            part = self.consolidation.with_clients(part, tables, known)
            part = self.consolidation.spread(part)
            return self.ever.run(part, known, seen)

        made = split_by_heat(events, [MASTER.entity], work, policy, narrow)
        # Weekly counts belong to known clients; other events have 0.
        counts = {
            name: F.when(ref(CLIENT_KEY).isNotNull(), ref(name)).otherwise(F.lit(0))
            for name in (f"window_count_{n}" for n in self.weekly.getOrDefault("weeks"))
        }
        made = made.withColumns(counts)
        for stage in self.extra:
            made = stage.transform(made)
        return made

    def training_rows(
        self, tables: Mapping[str, DataFrame], policy: HotPolicy = DEFAULT_POLICY
    ) -> DataFrame:
        """Leftover columns, features and ``label`` for every event."""
        return self.aligner.transform(label(self.rows(tables, True, policy)))

    def transform(
        self, tables: Mapping[str, DataFrame], policy: HotPolicy = DEFAULT_POLICY
    ) -> DataFrame:
        """Leftover columns and features, no label."""
        return self.aligner.transform(self.rows(tables, False, policy))

    # -------------------------------------------------------------------- storage

    def save(self, spark: SparkSession, path: str, more: Mapping | None = None) -> None:
        """State (and ``more`` of it) as one line of JSON, stages as a Spark ML pipeline."""
        state = json.dumps({**self.consolidation.to_state(), **(more or {})})
        spark.createDataFrame([(state,)], "value string").coalesce(1).write.mode("overwrite").text(
            f"{path}/consolidation"
        )
        stages = [self.future, self.burst, self.weekly, self.ever, self.aligner, *self.extra]
        PipelineModel(stages).write().overwrite().save(f"{path}/stages")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FeaturePipeline:
        state = json.loads(spark.read.text(f"{path}/consolidation").first()[0])
        future, burst, weekly, ever, aligner, *extra = PipelineModel.load(f"{path}/stages").stages
        return cls(Consolidation.from_state(state), future, burst, weekly, ever, extra, aligner)
