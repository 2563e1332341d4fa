"""Hot keys take another road and must arrive at the same rows."""

import pytest
from pyspark.sql import functions as F

from oracle import rows_of
from revisit.operators import hot, timeline
from revisit.operators.hot import HotPolicy
from revisit.operators.ranks import average_rank
from workload.timeline_queries import EVENTS, ORDERS, events, orders

SOME_HOT = HotPolicy(min_rows=12, chunks=8)
ALL_HOT = HotPolicy(min_rows=0, chunks=4)
NONE_HOT = HotPolicy(decided=hot.ORDINARY)


@pytest.fixture(scope="module")
def histories(spark, tiny):
    """Histories with many ties: half of the times are cut down to the day."""
    e = events(spark, tiny).withColumn(
        "ts",
        F.when(F.col("event_id") % 2 == 0, F.col("ts").cast("date").cast("timestamp_ntz")).otherwise(
            F.col("ts")
        ),
    )
    return e.withColumn("user_id", F.col("user_id") % 7).cache()


def same(a, b):
    assert a.columns == b.columns
    assert [f.dataType for f in a.schema] == [f.dataType for f in b.schema]
    mine = rows_of([r.asDict() for r in a.collect()], a.columns)
    other = rows_of([r.asDict() for r in b.collect()], a.columns)
    assert len(mine) == len(other)
    for x, y in zip(mine, other):
        assert x == pytest.approx(y) if all(isinstance(v, float) for v in x) else _close(x, y), (x, y)


def _close(x, y):
    return all(abs(a - b) < 1e-9 if isinstance(a, float) else a == b for a, b in zip(x, y))


OPERATORS = {
    "ordinal": lambda df, p: timeline.event_ordinal(df, EVENTS, policy=p),
    "burst": lambda df, p: timeline.burst_features(df, EVENTS, break_days=1, policy=p),
    "burst from start": lambda df, p: timeline.burst_features(
        df, EVENTS, break_days=1, start=F.expr("TIMESTAMP_NTZ'2024-01-10 06:00:00'"), policy=p
    ),
    "ahead": lambda df, p: timeline.look_ahead(df, EVENTS, 7, 1, policy=p),
    "back": lambda df, p: timeline.look_back(df, EVENTS, 7, 1, policy=p),
    "months": lambda df, p: timeline.events_in_last_months(df, EVENTS, 1, policy=p),
    "weekly": lambda df, p: timeline.weekly_counts(df, EVENTS, policy=p),
    "weekly past": lambda df, p: timeline.weekly_counts(df, EVENTS, strict_past=True, policy=p),
    "rank": lambda df, p: average_rank(df, ["user_id"], "ts", "r", policy=p),
    "rank down": lambda df, p: average_rank(df, ["user_id"], "ts", "r", True, policy=p),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_key_hot(histories, name):
    run = OPERATORS[name]
    same(run(histories, NONE_HOT), run(histories, ALL_HOT))


@pytest.mark.parametrize("name", ["ordinal", "burst", "ahead", "back", "weekly"])
def test_some_keys_hot(spark, tiny, name):
    rows = orders(spark, tiny).withColumnsRenamed(
        {"o_orderkey": "event_id", "o_custkey": "user_id", "o_orderdate": "ts"}
    )
    run = OPERATORS[name]
    same(run(rows, NONE_HOT), run(rows, SOME_HOT))


def test_one_entity_with_one_moment(spark):
    rows = spark.sql(
        "SELECT id AS event_id, 1L AS user_id, TIMESTAMP_NTZ'2020-01-01 00:00:00' AS ts"
        " FROM range(40)"
    )
    for name in ("ordinal", "burst", "ahead", "back", "weekly"):
        same(OPERATORS[name](rows, NONE_HOT), OPERATORS[name](rows, ALL_HOT))


def test_find_hot_takes_the_heaviest(spark):
    rows = spark.range(100).select((F.sqrt("id")).cast("bigint").alias("k"))
    found = hot.find_hot(rows, ["k"], HotPolicy(min_rows=5, max_keys=2, chunks=2))
    assert sorted(r.k for r in found.collect()) == [8, 9]
    assert hot.find_hot(rows, ["k"], HotPolicy(min_rows=50)) is None


def test_null_key_is_never_hot(spark):
    rows = spark.range(50).select(F.lit(None).cast("bigint").alias("k"))
    assert hot.find_hot(rows, ["k"], HotPolicy(min_rows=1)) is None


def test_ordinary_plan_has_one_shuffle_by_entity(spark, tiny):
    made = timeline.look_ahead(orders(spark, tiny), ORDERS, policy=NONE_HOT)
    made = timeline.burst_features(made, ORDERS, policy=NONE_HOT)
    made = timeline.weekly_counts(made, ORDERS, policy=NONE_HOT)
    made = timeline.look_back(made, ORDERS, policy=NONE_HOT)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Python" not in plan


@pytest.fixture(scope="module")
def awkward(spark):
    """Histories with repeated and null ids, at gaps and inside moments."""
    return spark.sql(
        """
        SELECT CASE WHEN id % 7 = 0 THEN NULL WHEN id % 5 = 0 THEN id - 1 ELSE id END AS event_id,
               id % 3 AS user_id,
               TIMESTAMP_NTZ'2020-01-01 00:00:00' + make_dt_interval(CAST(pow(id DIV 6, 2) AS INT)) AS ts
        FROM range(60)
        UNION ALL SELECT 900L, 1L, TIMESTAMP_NTZ'2024-01-01 00:00:00' FROM range(3)
        UNION ALL SELECT NULL, 2L, TIMESTAMP_NTZ'2024-01-01 00:00:00' FROM range(2)"""
    ).cache()


@pytest.mark.parametrize("name", OPERATORS)
def test_repeated_and_null_ids(awkward, name):
    run = OPERATORS[name]
    same(run(awkward, NONE_HOT), run(awkward, ALL_HOT))


def test_repeated_ids_share_place_and_gap(awkward):
    rows = timeline.burst_features(timeline.event_ordinal(awkward, EVENTS, policy=NONE_HOT), EVENTS, policy=NONE_HOT)
    last = rows.where("event_id = 900").collect()
    assert len({r.ordinal for r in last}) == 1
    assert all(r.timefeature_startofburst for r in last)
    assert len({r.timefeature_burstnumber for r in last}) == 1


def test_ever_flags_agree_on_repeated_ids(spark, monkeypatch):
    from revisit.operators import history

    rows = spark.sql(
        "SELECT * FROM VALUES (1L, 1L, TIMESTAMP_NTZ'2020-01-01 00:00:00', 0, 0),"
        " (1L, 1L, TIMESTAMP_NTZ'2020-01-01 00:00:00', 2, 0), (NULL, 1L, TIMESTAMP_NTZ'2020-01-01 00:00:00', 0, 1),"
        " (3L, 1L, TIMESTAMP_NTZ'2020-01-02 00:00:00', 0, 0) AS t(event_id, user_id, ts, kind_a, kind_b)"
    )
    made = [history.split_current_ever(rows, EVENTS, ["kind_"], NONE_HOT)]
    monkeypatch.setattr(history, "WIDE", 0)
    made.append(history.split_current_ever(rows, EVENTS, ["kind_"], NONE_HOT))
    made.append(history.split_current_ever(rows, EVENTS, ["kind_"], ALL_HOT))
    same(made[0], made[1])
    same(made[0], made[2])


@pytest.mark.parametrize("ahead", [True, False])
def test_chunks_are_even_when_probes_lie_a_window_away(spark, monkeypatch, ahead):
    """20,000 events in one year: all probes lie beyond the points, or before them."""
    rows = spark.sql(
        "SELECT id AS event_id, 1L AS user_id,"
        " TIMESTAMP_NTZ'2020-01-01 00:00:00' + make_dt_interval(0, 0, CAST(id * 26 AS INT)) AS ts"
        " FROM range(20000)"
    )
    sizes = []
    plain = hot.into_chunks

    def noted(*args):
        placed = plain(*args)
        sizes.append(placed.groupBy("_chunk").count())
        return placed

    monkeypatch.setattr(hot, "into_chunks", noted)
    policy = HotPolicy(min_rows=0, chunks=16)
    if ahead:
        timeline.look_ahead(rows, EVENTS, policy=policy)
    else:
        timeline.look_back(rows, EVENTS, policy=policy)
        timeline.events_in_last_months(rows, EVENTS, 12, policy=policy)
    for size in sizes:
        counts = [r["count"] for r in size.collect()]
        assert len(counts) == 16 and max(counts) <= 2 * sum(counts) / len(counts)


@pytest.mark.parametrize("down", [True, False])
def test_a_null_group_is_split_like_others(spark, down):
    rows = spark.sql("SELECT IF(id % 4 = 0, id % 3, NULL) AS g, IF(id % 11 = 0, NULL, id % 37) AS v, id FROM range(400)")
    heavy = HotPolicy(min_rows=50, chunks=4)
    key = rows.select(F.struct("g").alias("_group"))
    assert [r._group.g for r in hot.find_hot(key, ["_group"], heavy).collect()] == [None]
    same(
        average_rank(rows, ["g"], "v", "r", down, NONE_HOT, "n"),
        average_rank(rows, ["g"], "v", "r", down, heavy, "n"),
    )
