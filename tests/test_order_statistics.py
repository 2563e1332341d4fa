"""Order statistics of doubles that are not all ordinary numbers."""

import math

import pytest
from pyspark.sql import functions as F

from revisit.operators import ranks
from revisit.operators.flagging import flag_threshold
from revisit.operators.ranks import exact_quantile, order_statistic

ODD = "CASE id % 9 WHEN 0 THEN DOUBLE('NaN') WHEN 1 THEN DOUBLE('Infinity') WHEN 2 THEN DOUBLE('-Infinity') WHEN 3 THEN -0.0D WHEN 4 THEN NULL WHEN 5 THEN 1e308 WHEN 6 THEN -1e308 ELSE sin(id) END"


def in_order(values):
    return sorted((v for v in values if v is not None), key=lambda v: (math.isnan(v), 0 if math.isnan(v) else v))


@pytest.mark.parametrize("few", [10_000, 50])
def test_every_kind_of_double(spark, monkeypatch, few):
    monkeypatch.setattr(ranks, "_FEW", few)
    rows = spark.range(13_000).select(F.expr(ODD).alias("v")).cache()
    values = in_order(r.v for r in rows.collect())
    for place in (0, 1444, 1445, 3000, 5000, 7000, 8666, 8667, 10_111, len(values) - 1):
        found, below = order_statistic(rows, "v", place)
        assert found == values[place] or (math.isnan(found) and math.isnan(values[place]))
        first = next(i for i, v in enumerate(values) if v == found or (math.isnan(v) and math.isnan(found)))
        assert below == first
    with pytest.raises(ValueError):
        order_statistic(rows, "v", len(values))


@pytest.mark.parametrize("low, high", [(0.0, 5e-324), (-1.7e308, 1.7e308), (1.0, 1.0 + 2**-52)])
def test_ranges_at_the_limits_of_doubles(spark, low, high):
    rows = spark.range(25_000).select(F.when(F.col("id") % 2 == 0, low).otherwise(high).alias("v"))
    assert order_statistic(rows, "v", 12_499) == (low, 0)
    assert order_statistic(rows, "v", 12_500) == (high, 12_500)


def test_thresholds_of_ratios_with_infinities(spark):
    rows = spark.range(12_000).select(F.expr("IF(id % 3 = 0, DOUBLE('Infinity'), IF(id % 3 = 1, DOUBLE('NaN'), 1D))").alias("score_ratio"))
    assert flag_threshold(rows, flag_share=0.1) == float("inf")
    assert flag_threshold(rows, flag_share=0.9) == 1.0
    assert exact_quantile(rows.where("score_ratio = 1"), "score_ratio", 0.5) == 1.0
