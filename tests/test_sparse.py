"""Vocabularies as tables, and sparse vectors against the dense matrix."""

import random
import re

import pytest
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from revisit.operators import vocabulary
from revisit.operators.hot import HotPolicy
from revisit.plans.durable import durable
from revisit.plans.features import FeaturePipeline, FeatureSettings
from revisit.plans.sparse import SparseFeatures, load_features
from revisit.plans.train import ScoringModel, ridge, train
from revisit.schema import MASTER, PAYLOAD_SCHEMA
from revisit.sources.payloads import payload_tables
from revisit.sources.tables import empty_table
from test_pipeline import AS_OF, make_payload

ALL_HOT = HotPolicy(min_rows=3, max_keys=64, chunks=4)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    payloads = [make_payload(c, rng) for c in range(1, 9)]
    return payload_tables(durable(spark.createDataFrame(payloads, PAYLOAD_SCHEMA), "payloads"))


def dense_cells(pipeline, rows):
    made = {}
    for r in rows.collect():
        made[r[MASTER.event_id]] = {c: r[c] for c in pipeline.column_schema if r[c]}
    return made


def sparse_cells(features, rows):
    names = {r.place: r.column for r in features.names().collect()}
    made = {}
    for r in rows.collect():
        v = r["features"]
        assert isinstance(v, SparseVector) and v.size == features.size
        assert list(v.indices) == sorted(set(v.indices))
        made[r[MASTER.event_id]] = {names[i]: x for i, x in zip(v.indices, v.values) if x}
    return made


@pytest.mark.parametrize("encode, policy", [(False, HotPolicy()), (True, ALL_HOT)])
def test_same_cells_as_the_dense_matrix(tables, encode, policy):
    settings = FeatureSettings(encode_counts=encode)
    dense, wide = FeaturePipeline.fit_transform(tables, AS_OF, settings, policy)
    sparse, vectors = SparseFeatures.fit_transform(tables, AS_OF, settings, policy)
    wanted = dense_cells(dense, wide)
    assert sparse_cells(sparse, vectors) == wanted and len(wanted) > 50
    labels = {r[MASTER.event_id]: r.label for r in wide.collect()}
    assert {r[MASTER.event_id]: r.label for r in vectors.collect()} == labels
    assert {r.column for r in sparse.names().collect()} == set(dense.column_schema)


def test_saved_features_and_unseen_items(spark, tables, tmp_path):
    sparse, _ = SparseFeatures.fit_transform(tables, AS_OF, FeatureSettings(encode_counts=True))
    sparse.save(spark, str(tmp_path / "f"))
    loaded = load_features(spark, str(tmp_path / "f"))
    assert isinstance(loaded, SparseFeatures) and loaded.size == sparse.size
    fresh = {**tables, "referraldocument": empty_table(spark, "referraldocument")}
    fresh["referralissue"] = tables["referralissue"].withColumn("clientissueid", F.lit(99).cast("bigint"))
    found = sparse_cells(loaded, loaded.transform(fresh))
    assert len(found) == tables["referral"].count()
    names = {c for cells in found.values() for c in cells}
    assert not any(c.startswith(("referralissue_", "referraldocument_")) for c in names)
    assert any(c.startswith("referralbenefit_") for c in names)


def test_model_on_sparse_features(spark, tables, tmp_path):
    trained = train(tables, AS_OF, ridge(0.1), FeatureSettings(sparse=True), test=True)
    dense = train(tables, AS_OF, ridge(0.1))
    assert trained.metrics.count() == 1
    whole = train(tables, AS_OF, ridge(0.1), FeatureSettings(sparse=True)).model
    whole.save(spark, str(tmp_path / "m"))
    scores = {r.referralinstanceid: r.score for r in ScoringModel.load(spark, str(tmp_path / "m")).predict(tables).collect()}
    for r in dense.model.predict(tables).collect():
        assert scores[r.referralinstanceid] == pytest.approx(r.score, abs=1e-6)


def test_vocabulary_places(spark):
    rows = [("a", 1, "x")] * 5 + [("a", 2, "y"), ("b", 1, "x"), ("b", None, "x"), ("b", 1, None)]
    df = spark.createDataFrame(rows, "t string, key int, item string")
    items = vocabulary.long_items({n: (df.where(F.col("t") == n), "key", "item") for n in ("a", "b")})
    counts = vocabulary.frequencies_of(items)
    placed = vocabulary.with_places(counts, F.col("item") == "x")
    assert sorted(map(tuple, placed.collect())) == [("a", "x", 5, 0, 1), ("a", "y", 1, 2, None), ("b", "x", 1, 3, 4)]
    found = vocabulary.looked_up(items.select("name", "item", "key"), placed, ["place"])
    assert sorted(r.place for r in found.collect()) == [0] * 5 + [2, 3]
    assert vocabulary.with_places(counts.limit(0)).count() == 0


def test_no_plan_grows_with_the_vocabulary(spark, tables):
    """Twenty thousand items: no column per item, and fitting collects none."""
    many = spark.range(20_000).select(
        (F.col("id") % 50 + 1000).alias("referralinstanceid"), F.col("id").alias("clientissueid")
    )
    fitted, rows = SparseFeatures.fit_transform({**tables, "referralissue": many}, AS_OF)
    assert fitted.size > 40_000 and len(fitted.scalar.column_schema) < 30
    assert len(fitted.entries(tables)._jdf.queryExecution().logical().toString()) < 200_000
    assert rows.count() == tables["referral"].count()


def test_counts_move_once(spark):
    """Counting by event, gathering an event's items and joins by event share one exchange."""
    vocabulary = spark.createDataFrame(
        [("a", "1", 3, 0, 1), ("a", "2", 1, 2, None)], "name STRING, item STRING, frequency LONG, place LONG, second LONG"
    )
    rows = [("a", 7, "1"), ("a", 7, "1"), ("a", 8, "1"), ("a", 8, "2"), ("a", 8, "unknown"), ("b", 8, "1")]
    items = spark.createDataFrame(rows, "name STRING, key LONG, item STRING")
    counted = SparseFeatures(None, vocabulary, 3, 4)._counted(items)
    found = sorted((r.key, r.place, r.second, r.n) for r in counted.collect())
    assert found == [(7, 0, 1, 2.0), (8, 0, 1, 1.0), (8, 2, None, 1.0)]
    plan = counted.groupBy("key").count()._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    dealt = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    assert sum("key#" in d for d in dealt) == 1 and not any("place#" in d for d in dealt)
