"""Thresholds from sketches: rank error, states of batches, odd values, empty batches."""

import math
import random
from pathlib import Path

from pyspark.sql import functions as F

from revisit.streaming.thresholds import ThresholdStore, merged, rank_error, sketch, stream_flags


def doubles(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "v DOUBLE")


def share_below(values, limit):
    return sum(v <= limit for v in values) / len(values)


def test_rank_error_over_batches(spark, tmp_path):
    rng = random.Random(3)
    store = ThresholdStore(spark, str(tmp_path / "state"), size=200)
    seen = []
    for batch in range(4):  # later batches have larger values, one value is very common
        new = [rng.gauss(batch, 1) for _ in range(4000)] + [2.5] * 1000
        store.add(doubles(spark, new), "v", batch)
        seen += new
        limit = store.threshold(batch, 0.25)
        error = 2 * rank_error(200)
        assert sum(v < limit for v in seen) / len(seen) <= 0.75 + error
        assert share_below(seen, limit) >= 0.75 - error
    states = sorted(p.name for p in Path(tmp_path / "state").iterdir() if p.is_dir())
    assert states == ["batch=2", "batch=3"]


def test_a_repeated_batch_counts_once(spark, tmp_path):
    store = ThresholdStore(spark, str(tmp_path / "state"))
    store.add(doubles(spark, range(100)), "v", 0)
    for _ in range(3):
        store.add(doubles(spark, range(100, 200)), "v", 1)
    state = spark.read.parquet(str(tmp_path / "state" / "batch=1"))
    assert state.first()["n"] == 200
    assert store.threshold(1, 0.5) in (99.0, 100.0)  # small enough to be exact


def test_odd_values_and_nothing(spark, tmp_path):
    store = ThresholdStore(spark, str(tmp_path / "state"))
    store.add(doubles(spark, [None, math.nan]), "v", 0)
    assert store.threshold(0, 0.1) is None
    store.add(doubles(spark, []), "v", 1)
    assert store.threshold(1, 0.1) is None
    store.add(doubles(spark, [None, math.nan, math.inf, -math.inf, 1.0]), "v", 2)
    assert store.threshold(2, 0.5) == 1.0
    store.add(doubles(spark, []), "v", 3)
    assert store.threshold(3, 0.5) == 1.0
    assert sketch(doubles(spark, []), "v").count() == 0


def test_sketches_of_parts_merge(spark):
    rows = spark.range(1000).select(F.col("id").cast("double").alias("v"), "id")
    parts = [sketch(rows.where(F.col("id") % 4 == i), "v") for i in range(4)]
    whole = parts[0]
    for more in parts[1:]:
        whole = whole.union(more)
    row = merged(whole).select("n", F.kll_sketch_get_quantile_double("sketch", F.lit(0.5))).first()
    assert row[0] == 1000 and abs(row[1] - 499.5) <= 1


def test_stream_of_files(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "id BIGINT, score_ratio DOUBLE"

    def arrive(values):
        spark.createDataFrame(values, schema).coalesce(1).write.mode("append").parquet(source)
        stream_flags(spark.readStream.schema(schema).parquet(source), target, state).awaitTermination()

    arrive([(i, float(i)) for i in range(100)] + [(500, None), (501, math.nan)])
    arrive([(1000 + i, 1000.0 + i) for i in range(100)])
    rows = {r["id"]: r for r in spark.read.parquet(target).collect()}
    assert len(rows) == 202
    # The first part is judged by itself, the second by both.
    assert [i for i in range(100) if rows[i]["flagged"]] in (list(range(90, 100)), list(range(91, 100)))
    assert not rows[500]["flagged"] and not rows[501]["flagged"]
    flagged = sum(rows[1000 + i]["flagged"] for i in range(100))
    assert flagged in (19, 20)
    stream_flags(spark.readStream.schema(schema).parquet(source), target, state).awaitTermination()
    assert spark.read.parquet(target).count() == 202
