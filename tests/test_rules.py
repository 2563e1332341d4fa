"""Hand-made cases; the expected values follow from the rules, not from the code."""

import math

import pytest
from pyspark.sql import functions as F

from revisit.functions import time as clock
from revisit.operators import evaluate, flagging, pivot, split, timeline
from revisit.operators.client import client_features, client_scalars, one_row_per_key
from revisit.operators.encode import count_encode, fit_frequencies, one_hot
from revisit.operators.history import split_current_ever
from revisit.operators.hot import ORDINARY, HotPolicy
from revisit.operators.ranks import exact_quantile, order_statistic
from revisit.schema import EventColumns

C = EventColumns("id", "e", "t")
PLAIN = HotPolicy(decided=ORDINARY)
HOT = HotPolicy(min_rows=0, chunks=4)
COUNT = "futurereferraltargetfeature_futurereferralcount"
GAPS = "futurereferraltargetfeature_futurereferralgaps"
SCORE = "futurereferraltargetfeature_futurereferralscore"


def history(spark, *times, entity=1):
    rows = [(i + 1, entity, t if " " in t else t + " 00:00:00") for i, t in enumerate(times)]
    return spark.createDataFrame(rows, "id bigint, e bigint, s string").select(
        "id", "e", F.col("s").cast("timestamp_ntz").alias("t")
    )


def values(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("id").collect()]


@pytest.fixture(params=["ordinary", "hot"])
def policy(request):
    return PLAIN if request.param == "ordinary" else HOT


def test_single_event(spark, policy):
    one = history(spark, "2018-01-01")
    assert values(timeline.look_ahead(one, C, policy=policy), COUNT, GAPS, SCORE) == [(0, 0, 0.0)]
    burst = timeline.burst_features(one, C, policy=policy)
    assert values(
        burst,
        "timefeature_dayssincelastreferral",
        "timefeature_burstnumber",
        "timefeature_indexinburst",
        "timefeature_startofburst",
    ) == [(0, 1, 1.0, False)]


def test_28_days_is_no_gap(spark, policy):
    two = history(spark, "2018-01-01", "2018-01-29")
    assert values(timeline.look_ahead(two, C, policy=policy), COUNT, GAPS, SCORE)[0] == (
        1, 0, pytest.approx(7 / 365),
    )


def test_29_days_is_a_gap(spark, policy):
    two = history(spark, "2018-01-01", "2018-01-30")
    assert values(timeline.look_ahead(two, C, policy=policy), COUNT, GAPS, SCORE)[0] == (1, 1, 0.0)
    burst = timeline.burst_features(two, C, policy=policy)
    assert values(burst, "timefeature_burstnumber", "timefeature_indexinburst")[1] == (2, 1.0)


def test_gap_that_starts_before_the_trailing_frame(spark, policy):
    three = history(spark, "2018-01-01", "2019-06-01", "2019-06-08")
    back = timeline.look_back(three, C, policy=policy)
    assert values(back, "historical_count", "historical_gaps")[2] == (2, 0)


def test_first_event_has_the_documented_historical_score(spark, policy):
    back = timeline.look_back(history(spark, "2018-01-01"), C, window=364, policy=policy)
    assert values(back, "historical_score")[0][0] == pytest.approx(100 / 52)


@pytest.mark.parametrize(
    ("second", "expected"),
    [("2019-01-01", (1, 1)), ("2019-01-02", (0, 0)), ("2019-01-01 23:00:00", (1, 1))],
)
def test_frame_edge(spark, policy, second, expected):
    two = history(spark, "2018-01-01", second)
    assert values(timeline.look_ahead(two, C, policy=policy), COUNT, GAPS)[0] == expected


def test_tie(spark, policy):
    two = history(spark, "2018-01-01", "2018-01-01")
    burst = timeline.burst_features(two, C, policy=policy)
    assert values(burst, "timefeature_referralnumber") == [(1.5,), (1.5,)]
    assert values(timeline.look_ahead(two, C, policy=policy), COUNT, GAPS) == [(1, 0), (1, 0)]


def test_week_starts_on_monday(spark, policy):
    two = history(spark, "2018-01-07 23:59:00", "2018-01-08 00:00:00")
    made = timeline.weekly_counts(two, C, policy=policy)
    assert values(made, "window_count_1", "window_count_4") == [(1, 1), (1, 2)]


def test_current_week_counts_whole_unless_strict(spark, policy):
    two = history(spark, "2018-01-01", "2018-01-05")
    assert values(timeline.weekly_counts(two, C, policy=policy), "window_count_1") == [(2,), (2,)]
    strict = timeline.weekly_counts(two, C, strict_past=True, policy=policy)
    assert values(strict, "window_count_1") == [(1,), (2,)]


def test_week_index_before_1970(spark):
    row = history(spark, "1969-12-28 12:00:00").select(
        clock.week_end(clock.week_index(F.col("t"))).cast("string").alias("w")
    )
    assert row.first().w == "1969-12-28"


def test_start_hides_earlier_events_from_the_number_only(spark, policy):
    three = history(spark, "2018-01-01", "2018-01-02", "2018-01-03")
    start = F.expr("TIMESTAMP_NTZ'2018-01-02 00:00:00'")
    made = timeline.burst_features(three, C, start=start, policy=policy)
    assert values(made, "timefeature_referralnumber", "timefeature_totalreferralsforclient") == [
        (None, 3), (1.0, 3), (2.0, 3),
    ]


def test_events_without_entity(spark):
    rows = history(spark, "2018-01-01").union(
        history(spark, "2018-01-02").select(F.lit(9), F.lit(None).cast("bigint"), "t")
    )
    assert timeline.burst_features(rows, C).count() == 1
    assert values(timeline.weekly_counts(rows, C), "id", "window_count_1") == [(1, 1), (9, 0)]


def test_ever(spark, policy):
    three = history(spark, "2018-01-01", "2018-01-02", "2018-01-03").withColumn(
        "reason_3", F.when(F.col("id") == 2, F.lit(1).cast("bigint"))
    )
    made = split_current_ever(three, C, ["reason_"], policy)
    assert made.columns == ["id", "e", "t", "reason_3_current", "reason_3_ever"]
    assert values(made, "reason_3_current", "reason_3_ever") == [
        (None, False), (1, True), (None, True),
    ]


def test_ever_follows_id_order_within_a_moment(spark, policy):
    two = history(spark, "2018-01-01", "2018-01-01").withColumn(
        "reason_3", F.when(F.col("id") == 2, F.lit(2).cast("bigint"))
    )
    assert values(split_current_ever(two, C, ["reason_"], policy), "reason_3_ever") == [
        (False,), (True,),
    ]


def test_ages(spark):
    client = spark.sql(
        "SELECT 1L AS clientid, TIMESTAMP_NTZ'2060-01-01 00:00:00' AS clientdateofbirth,"
        " TIMESTAMP_NTZ'2017-01-01 12:00:00' AS addresssincedate, true AS clientismale"
    )
    as_of = F.lit("2018-01-01 00:00:00").cast("timestamp_ntz")
    row = client_scalars(client, as_of).first()
    assert row.age == pytest.approx(100 - 15340 / 365)
    assert row.addresslength == pytest.approx(364 / 365)  # 364.5 days, rounded down
    assert (row.clientismale, row.knownpartner) == (1, 0)  # no partner column at all


def test_floor_days_below_zero(spark):
    two = spark.sql(
        "SELECT TIMESTAMP_NTZ'2018-01-02 00:00:00' AS a, TIMESTAMP_NTZ'2018-01-01 12:00:00' AS b"
    )
    row = two.select(
        clock.floor_days(F.col("a"), F.col("b")).alias("up"),
        clock.floor_days(F.col("b"), F.col("a")).alias("down"),
    ).first()
    assert (row.up, row.down) == (0, -1)


def test_unseen_and_null_categories_are_zero(spark):
    df = spark.createDataFrame([(1, 5), (2, 9), (3, None)], "id int, c bigint")
    made = one_hot(df, {"c": [5, 7]})
    assert [tuple(r) for r in made.orderBy("id").collect()] == [(1, 1, 0), (2, 0, 0), (3, 0, 0)]


def test_count_encoding_of_unseen_is_null(spark):
    fitted = fit_frequencies(spark.createDataFrame([(5,), (5,), (6,)], "c bigint"), "c")
    assert fitted == {5: 2, 6: 1}
    made = count_encode(spark.createDataFrame([(5,), (7,)], "c bigint"), "c", fitted)
    assert sorted(r.c or 0 for r in made.collect()) == [0, 2]


def test_vocabulary_guard(spark):
    df = spark.range(20)
    with pytest.raises(ValueError, match="more than 10"):
        pivot.vocabulary({"id": (df, "id")}, 10)


def test_pivot_by_map_and_by_columns_agree(spark, monkeypatch):
    df = spark.createDataFrame(
        [(1, "a"), (1, "a"), (1, "b'c"), (2, None), (None, "a"), (3, "z")], "k int, v string"
    )
    few = pivot.count_pivot(df, "k", "v", "p", ["a", "b'c"]).orderBy("k").collect()
    monkeypatch.setattr(pivot, "WIDE", 1)
    many = pivot.count_pivot(df, "k", "v", "p", ["a", "b'c"]).orderBy("k").collect()
    assert [tuple(r) for r in few] == [(1, 2, 1), (3, None, None)]
    assert few == many


def test_one_row_per_key(spark):
    df = spark.createDataFrame([(1, 2, None), (1, 3, "x"), (2, None, "y")], "k int, a int, b string")
    assert sorted(tuple(r) for r in one_row_per_key(df, "k").collect()) == [(1, 3, "x"), (2, None, "y")]


def test_client_without_category_columns(spark):
    client = spark.sql(
        "SELECT 1L AS clientid, TIMESTAMP_NTZ'1990-01-01 00:00:00' AS clientdateofbirth,"
        " CAST(NULL AS TIMESTAMP_NTZ) AS addresssincedate, false AS clientismale"
    )
    as_of = F.lit("2018-01-01").cast("timestamp_ntz")
    row = client_features(client, as_of, {}).first()
    assert row.addresslength is None and row.clientid == 1


def test_constant_week_is_dropped(spark):
    rows = spark.createDataFrame(
        [(1, "2018-01-01", 1.0, 5.0), (2, "2018-01-02", 2.0, 5.0),
         (1, "2018-01-08", 1.0, 1.0), (2, "2018-01-09", 2.0, 2.0), (3, "2018-01-09", 3.0, 3.0)],
        "e int, s string, label double, prediction double",
    ).withColumn("t", F.col("s").cast("timestamp_ntz")).withColumn("id", F.col("e"))
    means = evaluate.weekly_means(rows, C)
    weeks = {r.week: r for r in evaluate.weekly_metrics(means, 0.5).collect()}
    first, second = (weeks[w] for w in sorted(weeks))
    assert first.spearman is None
    assert second.spearman == pytest.approx(1.0)
    total = evaluate.evaluate(rows, C, threshold=0.5).first()
    assert (total.spearman, total.overlap) == (pytest.approx(1.0), pytest.approx(1.0))


@pytest.mark.parametrize("few", [10_000, 3])
def test_order_statistics(spark, monkeypatch, few):
    from revisit.operators import ranks

    monkeypatch.setattr(ranks, "_FEW", few)
    numbers = [5, -7, 5, 2**62, -(2**62), 0, 5, 11]
    df = spark.createDataFrame([(n, float(n) / 3) for n in numbers], "a bigint, b double")
    for place, expected in enumerate(sorted(numbers)):
        assert order_statistic(df, "a", place)[0] == expected
        assert order_statistic(df, "b", place)[0] == float(expected) / 3
    assert order_statistic(df, "a", 4) == (5, 3)
    with pytest.raises(ValueError):
        order_statistic(df, "a", 8)
    assert exact_quantile(df, "b", 0.5) == pytest.approx(5 / 3)


def test_temporal_cut_inside_a_tie(spark, monkeypatch):
    from revisit.operators import ranks

    monkeypatch.setattr(ranks, "_FEW", 2)
    rows = spark.range(1, 101).select(
        "id", F.lit(1).alias("e"), F.expr("TIMESTAMP_NTZ'2018-01-01 00:00:00'").alias("t")
    )
    early, late = split.temporal_split(rows, C)
    assert early.count() == int(0.75 * 99) == 74
    assert early.agg(F.max("id")).first()[0] == 74
    assert late.count() == 26


def test_threshold_flags_the_share(spark):
    rows = spark.range(1, 101).select("id", F.col("id").cast("double").alias("score_ratio"))
    threshold = flagging.flag_threshold(rows)
    assert flagging.flag_over(rows, threshold).where("flagged").count() == 10


def test_ratio_of_zero_history_is_null(spark):
    row = flagging.score_ratio(spark.sql("SELECT 0.5D AS prediction, 0D AS historical_score"))
    assert row.first().score_ratio is None


def test_expected_reasons_kept_or_dropped(spark):
    events = spark.range(1, 4).withColumnRenamed("id", "k")
    reasons = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "k bigint, r string")
    dropped = flagging.expected_events(events, reasons, "k", "r", ["x"])
    kept = flagging.expected_events(events, reasons, "k", "r", ["x"], keep=True)
    assert sorted(r.k for r in dropped.collect()) == [2, 3]
    assert [r.k for r in kept.collect()] == [1]


def test_session_zone_does_not_matter(spark, tiny):
    from oracle import rows_of
    from workload.timeline_queries import EVENTS, events

    def run():
        df = timeline.look_ahead(events(spark, tiny), EVENTS, 7, 1)
        df = timeline.weekly_counts(timeline.burst_features(df, EVENTS, 1), EVENTS)
        return rows_of([r.asDict() for r in df.collect()], df.columns)

    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        there = run()
        spark.conf.set("spark.sql.session.timeZone", "Pacific/Auckland")
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        assert run() == there
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_invariants(spark, tiny):
    from workload.timeline_queries import ORDERS, orders

    df = timeline.weekly_counts(timeline.look_ahead(orders(spark, tiny), ORDERS), ORDERS)
    df = timeline.burst_features(df, ORDERS)
    broken = df.where(
        (F.col(GAPS) > F.col(COUNT))
        | (F.col("window_count_1") > F.col("window_count_4"))
        | (F.col("window_count_4") > F.col("window_count_12"))
        | (F.col("window_count_12") > F.col("timefeature_totalreferralsforclient"))
    )
    assert broken.count() == 0
    assert df.count() == orders(spark, tiny).count()
    assert math.isclose(df.agg(F.min(SCORE)).first()[0], 0.0)
