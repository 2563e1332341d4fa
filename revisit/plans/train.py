"""Training jobs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from datetime import datetime
from functools import reduce

from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revisit.operators.evaluate import evaluate
from revisit.operators.hot import DEFAULT_POLICY, HotPolicy
from revisit.operators.split import matured, temporal_cut, temporal_split
from revisit.plans.durable import durable
from revisit.plans.extra_trees import ExtraTrees
from revisit.plans.features import FeaturePipeline, FeatureSettings
from revisit.plans.sparse import SparseFeatures, load_features
from revisit.schema import CLIENT_KEY, MASTER
from revisit.sources.sinks import score_rows

# Ensemble sizes of the default and the alternative forest.
DEFAULT_TREES = 120
ALTERNATIVE_TREES = 150


def forest(hyperparams: Mapping | None = None, trees: int = DEFAULT_TREES) -> Estimator:
    """The default regressor. ``hyperparams`` are RandomForestRegressor parameters."""
    settings = {
        "numTrees": trees,
        "featureSubsetStrategy": "onethird",
        "maxDepth": 10,
        "minInstancesPerNode": 1,
        "seed": 17,
        "maxMemoryInMB": 1024,  # more nodes per pass over the data
        **(hyperparams or {}),
    }
    return RandomForestRegressor(featuresCol="features", labelCol="label", **settings)


def alternative_forest(hyperparams: Mapping | None = None) -> Estimator:
    """The larger forest."""
    return forest(hyperparams, ALTERNATIVE_TREES)


def extra_trees(hyperparams: Mapping | None = None, trees: int = DEFAULT_TREES) -> Estimator:
    """Extremely randomised trees. ``hyperparams`` are ExtraTrees parameters."""
    return ExtraTrees(**{"numTrees": trees, **(hyperparams or {})})


def ridge(strength: float = 1.0, solver: str = "auto") -> Estimator:
    """Linear regression with an L2 penalty.

    With some thousand features or more take the solver ``l-bfgs``: the normal equations have the
    square of their number as cells.
    """
    return LinearRegression(
        featuresCol="features", labelCol="label", elasticNetParam=0.0, regParam=strength, solver=solver
    )


def fit_regressor(rows: DataFrame, stages: Sequence[Transformer], learner: Estimator | None = None):
    """Fit on ``rows`` with ``label`` after ``stages`` that make ``features``; returns all as one."""
    vectors = PipelineModel(list(stages)).transform(rows).select("features", "label")
    return PipelineModel([*stages, (learner or forest()).fit(vectors)])


@dataclass
class ScoringModel:
    """Feature steps and regressor, saved and loaded together."""

    features: FeaturePipeline | SparseFeatures
    regressor: PipelineModel
    version: str = "1"

    def predict(
        self, tables: Mapping[str, DataFrame], policy: HotPolicy = DEFAULT_POLICY
    ) -> DataFrame:
        """(referralinstanceid, score, model_version) for every event in the tables."""
        return score_rows(
            self.regressor.transform(self.features.transform(tables, policy)), self.version
        )

    def save(self, spark: SparkSession, path: str) -> None:
        self.features.save(spark, f"{path}/features")
        self.regressor.write().overwrite().save(f"{path}/regressor")
        spark.createDataFrame([(self.version,)], "value string").coalesce(1).write.mode(
            "overwrite"
        ).text(f"{path}/version")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ScoringModel:
        return cls(
            load_features(spark, f"{path}/features"),
            PipelineModel.load(f"{path}/regressor"),
            spark.read.text(f"{path}/version").first()[0],
        )


@dataclass
class Trained:
    model: ScoringModel
    matrix: DataFrame  # matured rows: leftover columns, features, label
    metrics: DataFrame | None  # spearman, overlap of the test part


def training_matrix(
    tables: Mapping[str, DataFrame],
    as_of: str | datetime,
    settings: FeatureSettings | None = None,
    policy: HotPolicy = DEFAULT_POLICY,
) -> tuple[FeaturePipeline | SparseFeatures, DataFrame]:
    """Fit the features and give the rows whose label is complete.

    The rows are written once: learners read them many times, and a lost executor then costs a
    re-read instead of all joins and windows.
    """
    settings = settings or FeatureSettings()
    if settings.sparse:  # written as they are made
        features, rows = SparseFeatures.fit_transform(tables, as_of, settings, policy)
    else:
        features, rows = FeaturePipeline.fit_transform(tables, as_of, settings, policy)
        rows = durable(rows, "features")
    return features, matured(rows, MASTER.ts, settings.window)


def train(
    tables: Mapping[str, DataFrame],
    as_of: str | datetime,
    learner: Estimator | None = None,
    settings: FeatureSettings | None = None,
    test: bool = False,
    test_share: float = 0.25,
    threshold: float = 0.2,
    version: str = "1",
    policy: HotPolicy = DEFAULT_POLICY,
) -> Trained:
    """Train on all matured rows, or with ``test`` on the earlier part and evaluate the later."""
    features, matrix = training_matrix(tables, as_of, settings, policy)
    return _fit(features, matrix, learner, test, test_share, threshold, version, policy)


def compare(
    tables: Mapping[str, DataFrame],
    as_of: str | datetime,
    learners: Mapping[str, Estimator],
    folds: int = 3,
    settings: FeatureSettings | None = None,
    threshold: float = 0.2,
    policy: HotPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Learners by rolling origin: (fold, learner, training_rows, test_rows, test_begin, spearman, overlap).

    The matured rows in (time, id) order are cut exactly into ``folds`` + 1 parts. In fold k each
    learner is fitted to the first k parts and judged on the next one, as ``train`` judges. All folds
    and learners read one written matrix. A learner that finds no week to judge has null metrics;
    without matured rows there are no folds.
    """
    features, matrix = training_matrix(tables, as_of, settings, policy)
    spark = matrix.sparkSession
    cuts = [temporal_cut(matrix, MASTER, 1 - k / (folds + 1)) for k in range(1, folds + 1)]
    by_client = replace(MASTER, entity=CLIENT_KEY)
    narrow = [MASTER.event_id, MASTER.entity, MASTER.ts, CLIENT_KEY, "label", "prediction"]
    made = []
    for k, cut in enumerate(cuts, 1):
        if cut is None:
            continue
        part, later = matrix.where(cut.before(MASTER)), matrix.where(~cut.before(MASTER))
        if k < folds:
            later = later.where(cuts[k].before(MASTER))
        for name, learner in learners.items():
            judge = fit_regressor(part, features.assembler(), learner)
            scored = durable(judge.transform(later).select(*narrow), "scored")
            metrics = evaluate(scored, by_client, threshold=threshold, policy=policy)
            about = [F.lit(k).alias("fold"), F.lit(name).alias("learner"), F.lit(part.count()).alias("training_rows")]
            about += [F.lit(scored.count()).alias("test_rows"), F.lit(cut.ts).cast("timestamp_ntz").alias("test_begin")]
            made.append(metrics.select(*about, "spearman", "overlap"))
    if not made:
        kinds = "fold int, learner string, training_rows bigint, test_rows bigint, test_begin timestamp_ntz"
        return spark.createDataFrame([], f"{kinds}, spearman double, overlap double")
    return durable(reduce(DataFrame.union, made), "comparison")


def _fit(features, matrix, learner, test, test_share, threshold, version, policy) -> Trained:
    by_client = replace(MASTER, entity=CLIENT_KEY)  # events without a client row are not judged
    metrics = None
    part = matrix
    if test:
        part, held_out = temporal_split(matrix, MASTER, test_share)
    regressor = fit_regressor(part, features.assembler(), learner)
    if test:
        # Each row is scored once; the evaluation reads a few narrow columns several times.
        scored = durable(
            regressor.transform(held_out).select(
                MASTER.event_id, MASTER.entity, MASTER.ts, CLIENT_KEY, "label", "prediction"
            ),
            "scored",
        )
        metrics = evaluate(scored, by_client, threshold=threshold, policy=policy)
    return Trained(ScoringModel(features, regressor, version), matrix, metrics)


def retrain(
    tables: Mapping[str, DataFrame],
    as_of: str | datetime,
    path: str,
    version: str,
    learner: Estimator | None = None,
    settings: FeatureSettings | None = None,
    policy: HotPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Evaluate on the held-out part, then fit on everything and save; returns the report.

    Features are computed once and serve both fits.
    """
    features, matrix = training_matrix(tables, as_of, settings, policy)
    tested = _fit(features, matrix, learner, True, 0.25, 0.2, version, policy)
    metrics = durable(tested.metrics, "metrics")
    final = _fit(features, matrix, learner, False, 0.25, 0.2, version, policy)
    final.model.save(matrix.sparkSession, path)
    return report(final, metrics)


def report(trained: Trained, metrics: DataFrame) -> DataFrame:
    """One row: sizes of the matrix, test metrics, model version."""
    rows = trained.matrix.count()
    return metrics.select(
        F.lit(rows).cast("bigint").alias("training_rows"),
        F.lit(trained.model.features.width).alias("feature_columns"),
        "spearman",
        "overlap",
        F.lit(trained.model.version).alias("model_version"),
    )
