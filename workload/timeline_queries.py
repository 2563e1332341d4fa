"""Sequence features, windows in event time and weekly counts."""

from pyspark.sql import functions as F

from revisit.functions import time as clock
from revisit.operators import timeline
from revisit.operators.ranks import average_rank
from revisit.schema import EventColumns
from workload.registry import query, table

ORDERS = EventColumns("o_orderkey", "o_custkey", "o_orderdate")
EVENTS = EventColumns("event_id", "user_id", "ts")

ORDER_ROWS = "SELECT o_orderkey AS id, o_custkey AS e, o_orderdate AS t FROM orders"
EVENT_ROWS = "SELECT event_id AS id, user_id AS e, ts AS t FROM events"
DAY = "86400000000"


def orders(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")


def events(spark, folder):
    return table(spark, folder, "events").select("event_id", "user_id", "ts")


def ahead_sql(rows, names, window, break_days):
    i, e, t = names
    return f"""
    WITH r AS ({rows}),
    x AS (SELECT *, epoch_us(t) AS us,
                 lag(epoch_us(t)) OVER (PARTITION BY e ORDER BY t, id) AS prev FROM r),
    p AS (SELECT a.id, a.e, a.t,
                 count(*) - 1 AS n,
                 count(*) FILTER (WHERE b.us > a.us AND (b.us - b.prev) // {DAY} > {break_days}) AS g
          FROM x a JOIN x b
            ON a.e = b.e AND b.us >= a.us AND (b.us - a.us) // {DAY} <= {window}
          GROUP BY a.id, a.e, a.t)
    SELECT id AS {i}, e AS {e}, t AS {t},
           CAST(n AS BIGINT) AS futurereferraltargetfeature_futurereferralcount,
           (n - g) / ({window} / 7.0::DOUBLE) AS futurereferraltargetfeature_futurereferralscore,
           CAST(g AS BIGINT) AS futurereferraltargetfeature_futurereferralgaps
    FROM p"""


@query("lookahead_orders", ahead_sql(ORDER_ROWS, ("o_orderkey", "o_custkey", "o_orderdate"), 365, 28))
def lookahead_orders(spark, folder):
    return timeline.look_ahead(orders(spark, folder), ORDERS)


@query("lookahead_events", ahead_sql(EVENT_ROWS, ("event_id", "user_id", "ts"), 7, 1))
def lookahead_events(spark, folder):
    return timeline.look_ahead(events(spark, folder), EVENTS, window=7, break_days=1)


def burst_sql(rows, names, break_days):
    i, e, t = names
    return f"""
    WITH r AS ({rows}),
    x AS (SELECT *, coalesce((epoch_us(t) - lag(epoch_us(t)) OVER (PARTITION BY e ORDER BY t, id))
                             // {DAY}, 0) AS gap,
                 row_number() OVER (PARTITION BY e ORDER BY t, id) AS rn FROM r),
    b AS (SELECT *, sum(CASE WHEN gap > {break_days} THEN 1 ELSE 0 END)
                    OVER (PARTITION BY e ORDER BY rn) + 1 AS burst FROM x),
    k AS (SELECT *, row_number() OVER (PARTITION BY e, burst ORDER BY rn) AS bn FROM b)
    SELECT id AS {i}, e AS {e}, t AS {t},
           avg(rn) OVER (PARTITION BY e, t) AS timefeature_referralnumber,
           CAST(gap AS BIGINT) AS timefeature_dayssincelastreferral,
           gap > {break_days} AS timefeature_startofburst,
           CAST(burst AS BIGINT) AS timefeature_burstnumber,
           avg(bn) OVER (PARTITION BY e, burst, t) AS timefeature_indexinburst,
           count(*) OVER (PARTITION BY e) AS timefeature_totalreferralsforclient
    FROM k"""


@query("burst_orders", burst_sql(ORDER_ROWS, ("o_orderkey", "o_custkey", "o_orderdate"), 28))
def burst_orders(spark, folder):
    return timeline.burst_features(orders(spark, folder), ORDERS)


@query("burst_events", burst_sql(EVENT_ROWS, ("event_id", "user_id", "ts"), 1))
def burst_events(spark, folder):
    return timeline.burst_features(events(spark, folder), EVENTS, break_days=1)


@query(
    "referral_number_since_start",
    """
    WITH v AS (SELECT o_orderkey,
                      row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS rn,
                      o_custkey, o_orderdate
               FROM orders WHERE o_orderdate >= TIMESTAMP '1997-06-15'),
    k AS (SELECT o_orderkey, avg(rn) OVER (PARTITION BY o_custkey, o_orderdate) AS n FROM v)
    SELECT o.o_orderkey, k.n AS timefeature_referralnumber
    FROM orders o LEFT JOIN k USING (o_orderkey)""",
)
def referral_number_since_start(spark, folder):
    start = F.expr("TIMESTAMP_NTZ'1997-06-15 00:00:00'")
    made = timeline.burst_features(orders(spark, folder), ORDERS, start=start)
    return made.select("o_orderkey", "timefeature_referralnumber")


@query(
    "event_ordinal",
    """SELECT event_id, user_id, ts,
              row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ordinal
       FROM events""",
)
def event_ordinal(spark, folder):
    return timeline.event_ordinal(events(spark, folder), EVENTS)


@query(
    "average_ranks",
    """
    WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_suppkey,
                 row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) AS up,
                 row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC) AS down
               FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
           avg(up) OVER (PARTITION BY l_suppkey, l_quantity) AS rank_up,
           avg(down) OVER (PARTITION BY l_suppkey, l_quantity) AS rank_down
    FROM a""",
)
def average_ranks(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"
    )
    up = average_rank(lines, ["l_suppkey"], "l_quantity", "rank_up")
    return average_rank(up, ["l_suppkey"], "l_quantity", "rank_down", descending=True)


def weekly_sql(rows, names):
    i, e, t = names
    counts = ",\n".join(
        f"CAST(count(*) FILTER (WHERE b.m > a.m - {7 * n}) AS BIGINT) AS window_count_{n}"
        for n in (1, 4, 12)
    )
    return f"""
    WITH r AS ({rows}),
    x AS (SELECT *, CAST(date_trunc('week', t) AS DATE) AS m FROM r)
    SELECT a.id AS {i}, a.e AS {e}, a.t AS {t}, {counts}
    FROM x a JOIN x b ON a.e = b.e AND b.m <= a.m
    GROUP BY a.id, a.e, a.t, a.m"""


@query("weekly_counts_orders", weekly_sql(ORDER_ROWS, ("o_orderkey", "o_custkey", "o_orderdate")))
def weekly_counts_orders(spark, folder):
    return timeline.weekly_counts(orders(spark, folder), ORDERS)


@query("weekly_counts_events", weekly_sql(EVENT_ROWS, ("event_id", "user_id", "ts")))
def weekly_counts_events(spark, folder):
    return timeline.weekly_counts(events(spark, folder), EVENTS)


@query(
    "weekly_counts_strict_past",
    """
    WITH x AS (SELECT event_id, user_id, ts, CAST(date_trunc('week', ts) AS DATE) AS m FROM events)
    SELECT a.event_id, a.user_id, a.ts,
           CAST(count(*) FILTER (WHERE b.m > a.m - 7) AS BIGINT) AS window_count_1,
           CAST(count(*) FILTER (WHERE b.m > a.m - 28) AS BIGINT) AS window_count_4,
           CAST(count(*) FILTER (WHERE b.m > a.m - 84) AS BIGINT) AS window_count_12
    FROM x a JOIN x b ON a.user_id = b.user_id AND b.ts <= a.ts
    GROUP BY a.event_id, a.user_id, a.ts, a.m""",
)
def weekly_counts_strict_past(spark, folder):
    return timeline.weekly_counts(events(spark, folder), EVENTS, strict_past=True)


@query(
    "weekly_totals",
    """
    SELECT user_id, CAST(date_trunc('week', ts) AS DATE) + 6 AS week_end, count(*) AS events
    FROM events GROUP BY 1, 2""",
)
def weekly_totals(spark, folder):
    totals = timeline.weekly_totals(events(spark, folder), EVENTS)
    return totals.select("user_id", clock.week_end(F.col("week")).alias("week_end"), "events")


@query(
    "dense_weekly_totals",
    """
    WITH x AS (SELECT o_custkey, CAST(date_trunc('week', o_orderdate) AS DATE) AS m FROM orders),
    s AS (SELECT o_custkey, min(m) AS lo, max(m) AS hi FROM x GROUP BY 1),
    g AS (SELECT o_custkey, CAST(unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS DATE) AS m
          FROM s),
    c AS (SELECT o_custkey, m, count(*) AS n FROM x GROUP BY 1, 2)
    SELECT o_custkey, m + 6 AS week_end, CAST(coalesce(n, 0) AS BIGINT) AS events
    FROM g LEFT JOIN c USING (o_custkey, m)""",
)
def dense_weekly_totals(spark, folder):
    return timeline.dense_weekly_totals(orders(spark, folder), ORDERS)


def back_sql(rows, names, window, break_days):
    i, e, t = names
    return f"""
    WITH r AS ({rows}),
    x AS (SELECT *, epoch_us(t) AS us FROM r),
    pairs AS (SELECT a.id, a.e, a.t, b.us,
                     lag(b.us) OVER (PARTITION BY a.id ORDER BY b.us, b.id) AS prev
              FROM x a JOIN x b
                ON a.e = b.e AND b.us <= a.us AND (a.us - b.us) // {DAY} <= {window}),
    p AS (SELECT id, e, t, count(*) AS n,
                 count(*) FILTER (WHERE (us - prev) // {DAY} > {break_days}) AS g
          FROM pairs GROUP BY id, e, t)
    SELECT id AS {i}, e AS {e}, t AS {t},
           CAST(n AS BIGINT) AS historical_count,
           CAST(g AS BIGINT) AS historical_gaps,
           (n - g) / ({window} / 7.0::DOUBLE) * 100 AS historical_score
    FROM p"""


@query("historical_score_orders", back_sql(ORDER_ROWS, ("o_orderkey", "o_custkey", "o_orderdate"), 365, 28))
def historical_score_orders(spark, folder):
    return timeline.look_back(orders(spark, folder), ORDERS)


@query("historical_score_events", back_sql(EVENT_ROWS, ("event_id", "user_id", "ts"), 7, 1))
def historical_score_events(spark, folder):
    return timeline.look_back(events(spark, folder), EVENTS, window=7, break_days=1)
