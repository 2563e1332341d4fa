"""Feature matrix, alignment, splits, training, evaluation, flags, payloads and streams."""

from pyspark.ml.feature import Imputer, SQLTransformer, VectorAssembler
from pyspark.sql import functions as F

from revisit.functions import time as clock
from revisit.functions.columns import quoted
from revisit.operators import align as aligning
from revisit.operators import encode, flagging, history, split, timeline, vocabulary
from revisit.operators import evaluate as quality
from revisit.operators.ranks import exact_quantile, order_statistic
from revisit.plans import train as training
from revisit.plans.durable import durable, forget, new_path
from revisit.plans.features import FeaturePipeline, FeatureSettings
from revisit.plans.score import score_json, support_flags
from revisit.plans.sparse import SparseFeatures
from revisit.schema import CHILD_TABLES, MASTER, TABLE_SCHEMAS
from revisit.sources.json_array import read_payload_array
from revisit.sources.payloads import (
    inferred_text_schema,
    parse_payloads,
    payload_tables,
    read_payloads,
)
from revisit.sources.sinks import read_features, score_rows, update_features, write_features, write_scores
from revisit.sources.tables import check_tables, children_of_events, parquet_tables
from revisit.streaming.scoring import newest_scores, stream_scores
from revisit.streaming.thresholds import rank_error
from revisit.streaming.thresholds import stream_flags as flag_stream
from workload.domain import (
    AS_OF,
    CHILD_ITEMS,
    CLIENT_ISSUES,
    CLIENT_ITEMS,
    DOMAIN_SQL,
    domain_tables,
    master_sql,
)
from workload.registry import query, table
from workload.timeline_queries import (
    EVENTS,
    ORDER_ROWS,
    ORDERS,
    ahead_sql,
    back_sql,
    burst_sql,
    orders,
    weekly_sql,
)

SPLIT = ("referralissue", "referraldomesticcircumstances", "referralreason", "referralbenefit")


LABEL_SQL = "futurereferraltargetfeature_futurereferralscore AS label"


def _feature_sql(own=(LABEL_SQL, "referral_householdsize")) -> str:
    """Every feature of every event, by definition rather than by window."""
    names = ("id", "e", "t")
    over = "OVER (PARTITION BY referral_clientid ORDER BY referral_referraltakendate, referral_referralinstanceid)"
    cells = list(own)
    for name, values in CHILD_ITEMS.items():
        for v in values:
            c = f"{name}_{v}"
            if name in SPLIT:
                cells.append(f"{c} AS {c}_current")
                cells.append(f"CAST(sum({c}) {over} > 0 AS INT) AS {c}_ever")
            else:
                cells.append(c)
    cells += ["client_age", "client_addresslength", "client_clientismale", "client_knownpartner"]
    cells += [f"client_{c}_{v}" for c, values in CLIENT_ITEMS.items() for v in values]
    cells += [f"clientissue_{v}" for v in CLIENT_ISSUES]
    cells += [
        "timefeature_dayssincelastreferral",
        "CAST(timefeature_startofburst AS INT) AS timefeature_startofburst",
        "timefeature_indexinburst",
    ]
    cells += [f"window_count_{n}" for n in (1, 4, 12)]
    return f"""
    WITH {DOMAIN_SQL},
    master AS ({master_sql()}),
    ahead AS ({ahead_sql(ORDER_ROWS, names, 365, 28)}),
    burst AS ({burst_sql(ORDER_ROWS, names, 28)}),
    weekly AS ({weekly_sql(ORDER_ROWS, names)}),
    f AS (SELECT referral_referralinstanceid, {', '.join(cells)}
          FROM master m
          JOIN ahead a ON a.id = m.referral_referralinstanceid
          JOIN burst b ON b.id = m.referral_referralinstanceid
          JOIN weekly w ON w.id = m.referral_referralinstanceid)
    SELECT referral_referralinstanceid,
           CAST(coalesce(COLUMNS(* EXCLUDE (referral_referralinstanceid)), 0) AS DOUBLE)
    FROM f"""


@query("feature_matrix", _feature_sql())
def feature_matrix(spark, folder):
    """The whole default pipeline: tables to aligned features and label."""
    tables = domain_tables(spark, folder)
    features, rows = FeaturePipeline.fit_transform(tables, AS_OF)
    return rows.select(MASTER.event_id, "label", *features.column_schema)


@query(
    "align_schema",
    """
    WITH c AS (SELECT max(o_orderdate) - INTERVAL 365 DAY AS t FROM orders)
    SELECT o_orderkey, o_totalprice, 0.0::DOUBLE AS never_seen,
           CASE WHEN o_orderdate <= c.t THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS settled
    FROM orders, c""",
)
def align_schema(spark, folder):
    """Columns in another order, one missing, one unseen, nulls: all take the fitted shape."""
    rows = table(spark, folder, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    old = split.matured(rows, "o_orderdate").select("o_orderkey", F.lit(1).alias("settled"))
    fresh = rows.join(old, "o_orderkey", "left").withColumn("unknown", F.lit(5))
    schema = aligning.feature_columns(
        ["o_orderkey", "o_totalprice", "never_seen", "settled"], ["O_ORDERKEY"]
    )
    return aligning.align(fresh, schema, ["o_orderkey"])


@query(
    "maturity_clip",
    """
    SELECT o_orderkey, o_custkey, o_orderdate FROM orders
    WHERE o_orderdate <= (SELECT max(o_orderdate) FROM orders) - INTERVAL 365 DAY""",
)
def maturity_clip(spark, folder):
    return split.matured(orders(spark, folder), "o_orderdate")


@query(
    "temporal_split",
    """
    WITH n AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn,
                      count(*) OVER () AS total FROM orders)
    SELECT o_orderkey, CASE WHEN rn <= CAST(floor(0.75 * (total - 1)) AS BIGINT) THEN 'train'
                            ELSE 'test' END AS part
    FROM n""",
)
def temporal_split(spark, folder):
    early, late = split.temporal_split(orders(spark, folder), ORDERS)
    return early.select("o_orderkey", F.lit("train").alias("part")).unionByName(
        late.select("o_orderkey", F.lit("test").alias("part"))
    )


@query(
    "first_and_last_event",
    "SELECT min(ts) AS first_event, max(ts) AS last_event, count(*) AS n FROM events",
)
def first_and_last_event(spark, folder):
    rows = table(spark, folder, "events")
    return rows.agg(
        F.min("ts").alias("first_event"), F.max("ts").alias("last_event"), F.count("*").alias("n")
    )


@query(
    "price_quantiles",
    """
    SELECT quantile_cont(l_extendedprice, 0.9) AS q90, quantile_cont(l_extendedprice, 0.5) AS q50,
           quantile_disc(l_shipdate, 0.0) AS first_ship
    FROM lineitem""",
)
def price_quantiles(spark, folder):
    lines = table(spark, folder, "lineitem")
    q90 = exact_quantile(lines, "l_extendedprice", 0.9)
    q50 = exact_quantile(lines, "l_extendedprice", 0.5)
    first, _ = order_statistic(lines, "l_shipdate", 0)
    return lines.limit(1).select(
        F.lit(q90).alias("q90"),
        F.lit(q50).alias("q50"),
        F.lit(first.isoformat(sep=" ")).cast("timestamp_ntz").alias("first_ship"),
    )


# ------------------------------------------------------------------------------------ evaluation

_MEANS_SQL = """
    s AS (SELECT user_id, ts, value AS y, CAST(event_id * 7919 % 1009 AS DOUBLE) AS p FROM events),
    m AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS w, user_id, avg(y) AS y, avg(p) AS p
          FROM s GROUP BY 1, 2),
    r AS (SELECT w, user_id, y, p, count(*) OVER (PARTITION BY w) AS n,
                 rank() OVER (PARTITION BY w ORDER BY y)
                   + (count(*) OVER (PARTITION BY w, y) - 1) / 2.0::DOUBLE AS ry,
                 rank() OVER (PARTITION BY w ORDER BY p)
                   + (count(*) OVER (PARTITION BY w, p) - 1) / 2.0::DOUBLE AS rp
          FROM m),
    g AS (SELECT w + 6 AS week_end, corr(ry, rp) AS spearman,
                 avg(CASE WHEN (n + 1 - ry) / n < 0.2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)
                   FILTER (WHERE (n + 1 - rp) / n < 0.2) AS overlap
          FROM r GROUP BY w)"""


def _judged(spark, folder):
    return table(spark, folder, "events").select(
        "user_id",
        "ts",
        "event_id",
        F.col("value").alias("label"),
        (F.col("event_id") * 7919 % 1009).cast("double").alias("prediction"),
    )


@query(
    "weekly_metrics",
    f"WITH {_MEANS_SQL} SELECT week_end, round(spearman, 9) AS spearman,"
    " round(overlap, 9) AS overlap FROM g",
)
def weekly_metrics(spark, folder):
    means = quality.weekly_means(_judged(spark, folder), EVENTS)
    weeks = quality.weekly_metrics(means, 0.2)
    return weeks.select(
        clock.week_end(F.col("week")).alias("week_end"),
        F.round("spearman", 9).alias("spearman"),
        F.round("overlap", 9).alias("overlap"),
    )


@query(
    "evaluation",
    f"""WITH {_MEANS_SQL}
    SELECT round(avg(spearman), 9) AS spearman, round(avg(overlap), 9) AS overlap
    FROM g WHERE spearman IS NOT NULL AND overlap IS NOT NULL""",
)
def evaluation(spark, folder):
    made = quality.evaluate(_judged(spark, folder), EVENTS, threshold=0.2)
    return made.select(
        F.round("spearman", 9).alias("spearman"), F.round("overlap", 9).alias("overlap")
    )


@query(
    "top_fraction",
    """
    WITH r AS (SELECT c_custkey, c_mktsegment, c_acctbal,
                      rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC)
                      + (count(*) OVER (PARTITION BY c_mktsegment, c_acctbal) - 1) / 2.0 AS k,
                      count(*) OVER (PARTITION BY c_mktsegment) AS n
               FROM customer)
    SELECT c_custkey, c_mktsegment, k / n < 0.1 AS top FROM r""",
)
def top_fraction(spark, folder):
    rows = table(spark, folder, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    made = quality.top_fraction(rows, "c_mktsegment", "c_acctbal", 0.1)
    return made.select("c_custkey", "c_mktsegment", "top")


# ---------------------------------------------------------------------------------------- flags

_BACK = back_sql(ORDER_ROWS, ("o_orderkey", "o_custkey", "o_orderdate"), 365, 28)


def _predicted(spark, folder):
    """Stands in for a model: a number from the price of the order."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("referralinstanceid"),
        (F.col("o_totalprice") / 1000000.0).alias("score"),
    )


@query(
    "score_ratio_flags",
    f"""
    WITH b AS ({_BACK}),
    r AS (SELECT o_orderkey, historical_score,
                 o_totalprice / 1000000.0::DOUBLE AS score,
                 CASE WHEN historical_score <> 0
                      THEN o_totalprice / 1000000.0::DOUBLE * 100 / historical_score END AS score_ratio
          FROM b JOIN orders USING (o_orderkey))
    SELECT o_orderkey, score, historical_score, score_ratio,
           coalesce(score_ratio > (SELECT quantile_cont(score_ratio, 0.9) FROM r), FALSE) AS flagged
    FROM r""",
)
def score_ratio_flags(spark, folder):
    """Historical score, ratio, threshold that flags one in ten, and the flag."""
    return support_flags(_predicted(spark, folder), orders(spark, folder), ORDERS)


@query(
    "frequent_entities",
    """
    SELECT a.event_id, a.user_id, a.ts, count(*) >= 40 AS frequent
    FROM events a JOIN events b
      ON a.user_id = b.user_id AND b.ts <= a.ts AND b.ts >= a.ts - INTERVAL 6 MONTH
    GROUP BY a.event_id, a.user_id, a.ts""",
)
def frequent_entities(spark, folder):
    rows = table(spark, folder, "events").select("event_id", "user_id", "ts")
    return flagging.flag_frequent(rows, EVENTS, 40)


@query(
    "events_in_last_months",
    """
    SELECT a.o_orderkey, a.o_custkey, a.o_orderdate, count(*) AS recent_events
    FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey
      AND b.o_orderdate <= a.o_orderdate AND b.o_orderdate >= a.o_orderdate - INTERVAL 6 MONTH
    GROUP BY 1, 2, 3""",
)
def events_in_last_months(spark, folder):
    return timeline.events_in_last_months(orders(spark, folder), ORDERS)


@query(
    "expected_reasons",
    """
    SELECT o_orderkey, o_custkey, o_orderdate FROM orders
    WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""",
)
def expected_reasons(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), "l_returnflag"
    )
    return flagging.expected_events(
        orders(spark, folder), lines, "o_orderkey", "l_returnflag", ["R"]
    )


@query(
    "key_membership",
    """
    SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS active
    FROM customer""",
)
def key_membership(spark, folder):
    customers = table(spark, folder, "customer").select("c_custkey")
    members = table(spark, folder, "orders").where(F.col("o_orderstatus") == "P")
    members = members.select(F.col("o_custkey").alias("c_custkey"))
    return flagging.mark_members(customers, "c_custkey", members, "active")


# ------------------------------------------------------------------------------------- payloads


@query(
    "json_column",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
)
def json_column(spark, folder):
    rows = table(spark, folder, "events")
    return rows.select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k"))


def payload_rows(spark, folder):
    """Nested objects from the domain tables: one per event with its child rows, one per client.

    Objects of one client are read back as one history, so none has to hold all of it.
    """
    tables = domain_tables(spark, folder)

    def cells(name, rows):
        declared = {f.name: f.dataType for f in TABLE_SCHEMAS[name]}
        return F.struct(*[F.col(c).cast(declared.get(c, rows.schema[c].dataType)).alias(c) for c in rows.columns])

    def keyed(row, key, names):
        """A child row with its key, which moves once for all rows of the event."""
        return F.struct(*[(F.col(key) if c == key else row[c]).alias(c) for c in names])

    referral = tables["referral"]
    issue = F.struct("clientid", F.expr("issue").alias("clientissueid"))
    events = referral.join(
        table(spark, folder, "orders").selectExpr(
            "o_orderkey AS referralinstanceid",
            "CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS issue",
        ),
        "referralinstanceid",
    ).select(
        "referralinstanceid",
        F.array(cells("referral", referral)).alias("referral"),
        F.array(issue).alias("clientissue"),
    )
    for name, (key, _) in CHILD_TABLES.items():
        rows = tables[name]
        per_event = rows.groupBy(key).agg(F.collect_list(cells(name, rows.drop(key))).alias(name))
        full = F.transform(name, lambda row: keyed(row, key, rows.columns))  # noqa: B023
        events = events.join(per_event, key, "left").withColumn(name, full)
    clients = tables["client"].select(F.array(cells("client", tables["client"])).alias("client"))
    return events.drop("referralinstanceid").unionByName(clients, allowMissingColumns=True)


def _payload_lines(spark, folder):
    return payload_rows(spark, folder).select(F.to_json(F.struct("*")).alias("body"))


@query(
    "json_text_tables",
    f"""
    WITH {DOMAIN_SQL}
    SELECT referralinstanceid, clientid, referraltakendate FROM referral""",
)
def json_text_tables(spark, folder):
    """Rows to nested JSON text (every second one encoded twice) and back to a table."""
    lines = _payload_lines(spark, folder)
    # A one-element array without its brackets: the text as a JSON string.
    twice = F.expr("substring(t, 2, length(t) - 2)")
    mixed = lines.withColumn("t", F.to_json(F.array("body"))).select(
        F.when(F.xxhash64("body") % 2 == 0, twice).otherwise(F.col("body")).alias("body")
    )
    tables = payload_tables(parse_payloads(mixed, "body"))
    return tables["referral"].select(
        "referralinstanceid", "clientid", F.col("referraltakendate").cast("timestamp_ntz").alias(
            "referraltakendate"
        )
    )


@query(
    "json_file_tables",
    """
    SELECT l_orderkey AS referralinstanceid, l_linenumber::BIGINT AS clientissueid, count(*) AS n
    FROM lineitem GROUP BY 1, 2""",
)
def json_file_tables(spark, folder):
    """The same through files of JSON lines, compressed: the text is 20 times as long as the tables."""
    path = new_path(spark, "payloads") + "/lines"
    _payload_lines(spark, folder).write.option("compression", "gzip").text(path)
    tables = payload_tables(read_payloads(spark, path))
    return tables["referralissue"].groupBy("referralinstanceid", "clientissueid").agg(
        F.count("*").alias("n")
    )


@query(
    "json_array_tables",
    """
    SELECT l_orderkey AS referralinstanceid, l_linenumber::BIGINT AS clientissueid, count(*) AS n
    FROM lineitem GROUP BY 1, 2""",
)
def json_array_tables(spark, folder):
    """The same through one file with one array on one line, read by several tasks."""
    path = new_path(spark, "payloads") + "/array"
    lines = _payload_lines(spark, folder)
    # The array's first object has no comma before it.
    parts = spark.createDataFrame([('[{"client": []}',)], "value string").unionByName(
        lines.select(F.concat(F.lit(", "), "body").alias("value"))
    ).unionByName(spark.createDataFrame([("]",)], "value string"))
    parts.coalesce(1).write.option("lineSep", " ").text(path)
    tables = payload_tables(read_payload_array(spark, path))
    return tables["referralissue"].groupBy("referralinstanceid", "clientissueid").agg(
        F.count("*").alias("n")
    )


@query("payload_feature_matrix", _feature_sql(("referral_householdsize",)))
def payload_feature_matrix(spark, folder):
    """JSON text to tables to features, with feature state that went through storage."""
    lines = _payload_lines(spark, folder)
    schema = inferred_text_schema(lines, "body")  # declared columns and what else the text holds
    tables = payload_tables(durable(parse_payloads(lines, "body", schema), "payloads"))
    path = new_path(spark, "features")
    FeaturePipeline.fit(tables, AS_OF).save(spark, path)
    features = FeaturePipeline.load(spark, path)
    return features.transform(tables).select(MASTER.event_id, *features.column_schema)


# --------------------------------------------------------------------------- sparse features


@query("sparse_equivalence", "SELECT count(*) AS events, 0::BIGINT AS different FROM orders")
def sparse_equivalence(spark, folder):
    """Entries of the sparse vectors against the cells of the dense matrix, by event and column."""
    tables = domain_tables(spark, folder)
    dense, rows = FeaturePipeline.fit_transform(tables, AS_OF)
    sparse, _ = SparseFeatures.fit_transform(tables, AS_OF)
    places = {r["column"]: r["place"] for r in sparse.names().collect()}  # as many as the dense matrix has columns
    known = sorted((places.get(c, -1 - k), c) for k, c in enumerate(dense.column_schema))  # below 0: in no vector
    cells = ", ".join(f"named_struct('i', {i}, 'v', {quoted(c)})" for i, c in known)
    wide = rows.select(MASTER.event_id, F.expr(f"filter(array({cells}), x -> x.v <> 0)").alias("cells"))
    wide, long = _by_event(wide, "a"), _by_event(sparse.entries(tables).select(MASTER.event_id, "cells"), "b")
    both = wide.join(long, MASTER.event_id, "left")
    wrong = F.col(MASTER.event_id).isNotNull() & F.expr(_CELLS_DIFFER)
    return both.agg(
        F.coalesce(F.sum("rows_a"), F.lit(0)).alias("events"),
        F.coalesce(F.sum(F.when(wrong, F.col("rows_a"))), F.lit(0)).alias("different"),
    )


def _by_event(rows, side):
    """One row an event: how many rows it had, and the places and values of all their cells."""
    i, v = F.transform("cells", lambda x: x["i"].cast("int")), F.transform("cells", lambda x: x["v"])
    return rows.select(MASTER.event_id, i.alias("i"), v.alias("v")).groupBy(MASTER.event_id).agg(
        F.count("*").alias(f"rows_{side}"),
        F.flatten(F.collect_list("i")).alias(f"i_{side}"), F.flatten(F.collect_list("v")).alias(f"v_{side}"),
    )


# One row on either side: their cells are compared in order of place. Else each with each of its place.
_CELLS_DIFFER = """
    CASE WHEN rows_a = 1 AND rows_b = 1 AND i_a = i_b
    THEN exists(zip_with(v_a, v_b, (x, y) -> abs(x - y) > 1e-9), x -> x)
    ELSE exists(arrays_zip(i_a, v_a), x -> NOT coalesce(array_contains(i_b, x.i_a), FALSE)
           OR exists(arrays_zip(i_b, v_b), y -> y.i_b = x.i_a AND abs(x.v_a - y.v_b) > 1e-9))
      OR coalesce(exists(i_b, y -> NOT array_contains(i_a, y)), FALSE) END"""


@query(
    "part_vocabulary",
    """
    SELECT 'part' AS name, CAST(l_partkey AS VARCHAR) AS item, count(*) AS frequency,
           row_number() OVER (ORDER BY CAST(l_partkey AS VARCHAR)) - 1 AS place
    FROM lineitem WHERE l_partkey IS NOT NULL GROUP BY l_partkey""",
)
def part_vocabulary(spark, folder):
    """A vocabulary of all parts as a table: ids by counting, nothing on the driver."""
    lines = table(spark, folder, "lineitem")
    items = vocabulary.long_items({"part": (lines, "l_orderkey", "l_partkey")})
    return vocabulary.with_places(vocabulary.frequencies_of(items)).drop("second")


def _part_tables(spark, folder):
    """Domain tables in which the issues of an event are its parts, and other children are empty."""
    tables = domain_tables(spark, folder)
    lines = table(spark, folder, "lineitem")
    empty = {name: tables[name].where(F.lit(False)) for name in CHILD_TABLES}
    parts = lines.select(
        F.col("l_orderkey").alias("referralinstanceid"), F.col("l_partkey").cast("bigint").alias("clientissueid")
    )
    return {**tables, **empty, "referralissue": parts}


@query(
    "sparse_part_features",
    """
    WITH l AS (SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2),
    firsts AS (
      SELECT o_custkey, l_partkey, min((o_orderdate, o_orderkey)) AS m
      FROM orders JOIN l ON l_orderkey = o_orderkey GROUP BY 1, 2),
    now AS (SELECT l_orderkey, count(*) AS parts, sum(n) AS lines, sum(l_partkey) AS ids FROM l GROUP BY 1),
    ever AS (
      SELECT o_orderkey, count(*) AS parts, sum(f.l_partkey) AS ids
      FROM orders o JOIN firsts f ON f.o_custkey = o.o_custkey AND f.m <= (o.o_orderdate, o.o_orderkey)
      GROUP BY 1)
    SELECT o.o_orderkey, coalesce(now.parts, 0) AS parts, CAST(coalesce(now.lines, 0) AS DOUBLE) AS lines,
           CAST(coalesce(now.ids, 0) AS BIGINT) AS part_ids, coalesce(ever.parts, 0) AS parts_ever,
           CAST(coalesce(ever.ids, 0) AS BIGINT) AS part_ids_ever
    FROM orders o LEFT JOIN now ON l_orderkey = o.o_orderkey LEFT JOIN ever ON ever.o_orderkey = o.o_orderkey""",
)
def sparse_part_features(spark, folder):
    """Counts and ever flags of all parts (20,000 at sf0.1) in sparse vectors, read back by place."""
    tables = _part_tables(spark, folder)
    fitted, _ = SparseFeatures.fit_transform(tables, AS_OF)
    entries = fitted.entries(tables)
    first = len(fitted.scalar.column_schema)
    places = fitted.vocabulary.where("name = 'referralissue'").select(
        F.col("item").cast("bigint").alias("part"),
        F.inline(F.array(*[
            F.struct((F.col(c) + first).alias("i"), F.lit(c == "second").alias("ever")) for c in ("place", "second")
        ])),
    )
    found = entries.select(MASTER.event_id, F.inline("cells")).join(places, "i")
    now = F.when(~F.col("ever"), F.lit(1))
    sums = found.groupBy(MASTER.event_id).agg(
        F.count(now).alias("parts"),
        F.coalesce(F.sum(F.when(~F.col("ever"), F.col("v"))), F.lit(0.0)).alias("lines"),
        F.coalesce(F.sum(F.when(~F.col("ever"), F.col("part"))), F.lit(0)).alias("part_ids"),
        F.count_if("ever").alias("parts_ever"),
        F.coalesce(F.sum(F.when(F.col("ever"), F.col("part"))), F.lit(0)).alias("part_ids_ever"),
    )
    whole = entries.select(MASTER.event_id).join(sums, MASTER.event_id, "left").fillna(0)
    return whole.withColumnRenamed(MASTER.event_id, "o_orderkey")


@query("sparse_scores", "SELECT count(*) AS events, 0::BIGINT AS different FROM orders")
def sparse_scores(spark, folder):
    """A ridge model on sparse vectors of all parts: trained, saved, loaded, compared with itself."""
    path = new_path(spark, "model")
    tables = _part_tables(spark, folder)
    learner = training.ridge(0.1, "l-bfgs")
    model = training.train(tables, AS_OF, learner, FeatureSettings(sparse=True)).model
    model.save(spark, path)
    return _different(model.predict(tables), training.ScoringModel.load(spark, path).predict(tables))


# --------------------------------------------------------------------------------------- models


@query("forest_scores")
def forest_scores(spark, folder):
    tables = domain_tables(spark, folder)
    trained = training.train(tables, AS_OF, training.forest())
    return trained.model.predict(tables)


@query("alternative_forest_scores")
def alternative_forest_scores(spark, folder):
    tables = domain_tables(spark, folder)
    trained = training.train(tables, AS_OF, training.alternative_forest())
    return trained.model.predict(tables)


@query("extra_trees_bounds", "SELECT count(*) AS events, 0::BIGINT AS outside, 0::BIGINT AS different FROM orders")
def extra_trees_bounds(spark, folder):
    """The default extra trees, saved and loaded: no score outside the labels, none that storage changes."""
    path = new_path(spark, "model")
    tables = domain_tables(spark, folder)
    trained = training.train(tables, AS_OF, training.extra_trees())
    trained.model.save(spark, path)
    rows = trained.model.features.transform(tables)  # features once for both
    again = training.ScoringModel.load(spark, path)
    scored = trained.model.regressor.transform(rows).withColumnRenamed("prediction", "first")
    low, high = trained.matrix.agg(F.min("label"), F.max("label")).first()
    both = again.regressor.transform(scored.drop("features"))
    return both.agg(
        F.count("*").alias("events"),
        F.count_if(~F.col("prediction").between(low - 1e-9, high + 1e-9)).alias("outside"),
        F.count_if(~F.col("prediction").eqNullSafe(F.col("first"))).alias("different"),
    )


@query(
    "ridge_coefficients",
    """
    WITH m AS (
      SELECT avg(l_quantity) AS a1, avg(l_discount) AS a2, avg(l_extendedprice) AS ay,
             stddev_pop(l_quantity) AS s1, stddev_pop(l_discount) AS s2, stddev_pop(l_extendedprice) AS sy,
             corr(l_quantity, l_discount) AS r, corr(l_quantity, l_extendedprice) AS r1,
             corr(l_discount, l_extendedprice) AS r2
      FROM lineitem),
    k AS (SELECT *, 1 + 250 / sy AS d FROM m),
    b AS (SELECT *, (d * r1 - r * r2) / (d * d - r * r) * sy / s1 AS b1,
                 (d * r2 - r * r1) / (d * d - r * r) * sy / s2 AS b2 FROM k)
    SELECT round(b1, 5) AS quantity, round(b2, 5) AS discount, round(ay - b1 * a1 - b2 * a2, 4) AS intercept FROM b""",
)
def ridge_coefficients(spark, folder):
    """The ridge learner on two features, against the closed form on standardised columns."""
    rows = table(spark, folder, "lineitem").select(
        *[F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_discount")],
        F.col("l_extendedprice").cast("double").alias("label"),
    )
    vectors = VectorAssembler(inputCols=["l_quantity", "l_discount"], outputCol="features")
    fitted = training.fit_regressor(rows, [vectors], training.ridge(250.0)).stages[-1]
    quantity, discount = fitted.coefficients.toArray().tolist()
    made = [(quantity, discount, fitted.intercept)]
    return spark.createDataFrame(made, "quantity double, discount double, intercept double").select(
        F.round("quantity", 5).alias("quantity"), F.round("discount", 5).alias("discount"),
        F.round("intercept", 4).alias("intercept"),
    )


@query(
    "model_folds",
    """
    WITH m AS (
      SELECT o_orderdate, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER () AS n
      FROM orders WHERE o_orderdate <= (SELECT max(o_orderdate) FROM orders) - INTERVAL 365 DAY),
    c AS (SELECT k, CAST(floor(k * (max(n) - 1) / 4.0) AS BIGINT) AS place, max(n) AS n
          FROM m, range(1, 4) r(k) GROUP BY k)
    SELECT CAST(k AS INT) AS fold, learner, place AS training_rows,
           coalesce(lead(place) OVER (PARTITION BY learner ORDER BY k), n) - place AS test_rows,
           CAST((SELECT o_orderdate FROM m WHERE i = place) AS TIMESTAMP) AS test_begin, true AS judged
    FROM c, (VALUES ('ridge'), ('strong ridge')) l(learner)""",
)
def model_folds(spark, folder):
    """Two learners by rolling origin: where the folds lie, and that all were judged."""
    learners = {"ridge": training.ridge(0.1), "strong ridge": training.ridge(10.0)}
    made = training.compare(domain_tables(spark, folder), AS_OF, learners)
    return made.select(
        "fold", "learner", "training_rows", "test_rows", "test_begin",
        (F.col("spearman").isNotNull() & F.col("overlap").isNotNull()).alias("judged"),
    )


@query("ridge_scores")
def ridge_scores(spark, folder):
    tables = domain_tables(spark, folder)
    return training.train(tables, AS_OF, training.ridge(0.1)).model.predict(tables)


@query("retrain_report")
def retrain_report(spark, folder):
    """Evaluate on the later quarter, fit on everything, save, report."""
    path = new_path(spark, "model") + "/v2"
    tables = domain_tables(spark, folder)
    return training.retrain(tables, AS_OF, path, "2", training.forest())


@query("saved_model_scores")
def saved_model_scores(spark, folder):
    """Scores of a model after a round trip through storage."""
    path = new_path(spark, "model") + "/v1"
    tables = domain_tables(spark, folder)
    training.train(tables, AS_OF, training.ridge(0.1)).model.save(spark, path)
    return training.ScoringModel.load(spark, path).predict(tables)


@query("payload_scores")
def payload_scores(spark, folder):
    """A model trained on tables scores the same clients from JSON text."""
    model = training.train(domain_tables(spark, folder), AS_OF, training.ridge(0.1)).model
    return score_json(model, _payload_lines(spark, folder), "body")


def _different(a, b):
    """One row: events of ``a`` or ``b``, and how many of them have other scores in the two."""
    a = a.select("referralinstanceid", F.col("score").alias("a"))
    b = b.select("referralinstanceid", F.col("score").alias("b"))
    near = F.coalesce(F.abs(F.col("a") - F.col("b")) <= 1e-9, F.lit(False))
    both = a.join(b, "referralinstanceid", "full")
    return both.agg(F.count("*").alias("events"), F.count_if(~near).alias("different"))


@query("payload_equivalence", "SELECT count(*) AS events, 0::BIGINT AS different FROM orders")
def payload_equivalence(spark, folder):
    """Scores from tables against scores of the same rows as JSON text."""
    tables = domain_tables(spark, folder)
    model = training.train(tables, AS_OF, training.ridge(0.1)).model
    return _different(model.predict(tables), score_json(model, _payload_lines(spark, folder), "body"))


@query("stream_scores")
def scores_of_stream(spark, folder):
    """Payload files scored by a stream that runs until all files are done."""
    model = training.train(domain_tables(spark, folder), AS_OF, training.ridge(0.1)).model
    return _streamed(spark, model, _payload_lines(spark, folder), None, "gzip")


def _streamed(spark, model, lines, max_files, compression):
    base = new_path(spark, "stream")
    lines.write.option("compression", compression).text(f"{base}/in")
    stream = stream_scores(spark, model, f"{base}/in", f"{base}/out", f"{base}/state", max_files)
    stream.awaitTermination()
    for read in ("in", "state-arrivals"):  # what no later batch asks for
        forget(spark, f"{base}/{read}")
    return newest_scores(spark, f"{base}/out")


@query(
    "stream_equivalence",
    """
    SELECT layout, count(*) AS events, 0::BIGINT AS different
    FROM orders, (VALUES ('1 file'), ('9 files'), ('9 files in 2 batches')) x(layout) GROUP BY 1""",
)
def stream_equivalence(spark, folder):
    """Streamed scores against batch scores, however objects lie in files and batches."""
    tables = domain_tables(spark, folder)
    model = training.train(tables, AS_OF, training.ridge(0.1)).model
    batch = durable(model.predict(tables), "scores")
    lines = durable(_payload_lines(spark, folder), "lines")
    made = None
    for layout, files, most in (("1 file", 1, None), ("9 files", 9, None), ("9 files in 2 batches", 9, 5)):
        # A compressed file is read by one task; a single one stays plain.
        streamed = _streamed(spark, model, lines.repartition(files), most, "none" if files == 1 else "gzip")
        row = _different(batch, streamed).select(F.lit(layout).alias("layout"), "*")
        made = row if made is None else made.union(row)
    return made


@query(
    "stream_flags",
    f"""
    WITH r AS (
      SELECT o_orderkey % 3 AS part,
             CASE WHEN historical_score <> 0
                  THEN o_totalprice / 1000000.0::DOUBLE * 100 / historical_score END AS score_ratio
      FROM ({_BACK}) b JOIN orders USING (o_orderkey))
    SELECT part, count(*) AS events, sum(count(score_ratio)) OVER (ORDER BY part)::BIGINT AS gathered,
           TRUE AS rank_in_bound, 0::BIGINT AS wrong_flags
    FROM r GROUP BY part""",
)
def stream_flags(spark, folder):
    """Score ratios arriving in three parts, each flagged by the sketch of all up to it.

    ``rank_in_bound``: the exact rank of each threshold is within twice the stated error (which has
    99 % confidence) of nine tenths.
    """
    base = new_path(spark, "flag-stream")
    rated = support_flags(_predicted(spark, folder), orders(spark, folder), ORDERS, threshold=0.0)
    part = (F.col("o_orderkey") % 3).cast("bigint").alias("part")
    rated = durable(rated.select("o_orderkey", "score_ratio", part), "ratios")
    for p in range(3):
        rated.where(F.col("part") == p).write.mode("append").parquet(f"{base}/in")
        arriving = spark.readStream.schema(rated.schema).parquet(f"{base}/in")
        flag_stream(arriving, f"{base}/out", f"{base}/state").awaitTermination()
    flagged = spark.read.parquet(f"{base}/out")
    over = F.coalesce(F.col("score_ratio") > F.col("threshold"), F.lit(False))
    parts = flagged.groupBy("part").agg(
        F.count("*").alias("events"), F.max("threshold").alias("limit"),
        F.count_if(F.col("flagged") != over).alias("wrong_flags"),
    )
    # Every ratio against the limits of its own and of later parts: three rows at most.
    later = F.explode(F.sequence("part", F.lit(2).cast("bigint"))).alias("upto")
    ranks = rated.where("score_ratio IS NOT NULL").select("score_ratio", later).join(
        F.broadcast(parts.select(F.col("part").alias("upto"), "limit")), "upto"
    )
    ranks = ranks.groupBy("upto").agg(
        F.count("*").alias("gathered"),
        (F.count_if(F.col("score_ratio") < F.col("limit")) / F.count("*")).alias("below"),
        (F.count_if(F.col("score_ratio") <= F.col("limit")) / F.count("*")).alias("upto_limit"),
    )
    error = 2 * rank_error()
    met = (F.col("below") <= 0.9 + error) & (F.col("upto_limit") >= 0.9 - error)
    return parts.join(ranks, F.col("part") == F.col("upto")).select(
        "part", "events", "gathered", met.alias("rank_in_bound"), "wrong_flags"
    )


@query(
    "saved_model_equivalence",
    "SELECT count(*) AS events, 0::BIGINT AS different FROM orders",
)
def saved_model_equivalence(spark, folder):
    """A saved and loaded model against itself."""
    path = new_path(spark, "model")
    tables = domain_tables(spark, folder)
    model = training.train(tables, AS_OF, training.ridge(0.1)).model
    model.save(spark, path)
    return _different(model.predict(tables), training.ScoringModel.load(spark, path).predict(tables))


# ---------------------------------------------------------------------- sinks, limits, own stages


@query(
    "feature_table_by_month",
    """
    SELECT o_orderkey AS referral_referralinstanceid, strftime(o_orderdate, '%Y-%m') AS month,
           CAST(o_totalprice AS DOUBLE) AS price FROM orders""",
)
def feature_table_by_month(spark, folder):
    """Feature rows written by month and read back."""
    path = new_path(spark, "feature-table")
    rows = orders(spark, folder).select(
        F.col("o_orderkey").alias(MASTER.event_id), F.col("o_orderdate").alias(MASTER.ts),
    )
    price = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias(MASTER.event_id), F.col("o_totalprice").cast("double").alias("price")
    )
    write_features(rows.join(price, MASTER.event_id), path)
    back = spark.read.parquet(path)
    return back.select(MASTER.event_id, F.date_format("month", "yyyy-MM").alias("month"), "price")


@query(
    "feature_table_updates",
    """
    SELECT o_orderkey AS referral_referralinstanceid, strftime(o_orderdate, '%Y-%m') AS month,
           CAST(o_totalprice AS DOUBLE) AS price FROM orders""",
)
def feature_table_updates(spark, folder):
    """A feature table that is brought up to date: wrong prices, wrong months and missing events mended."""
    path = new_path(spark, "feature-table")
    rows = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias(MASTER.event_id), F.col("o_orderdate").cast("timestamp_ntz").alias(MASTER.ts),
        F.col("o_totalprice").cast("double").alias("price"),
    )
    late = F.col(MASTER.ts) >= F.lit("1997-06-01").cast("timestamp_ntz")
    moved = late & (F.col(MASTER.event_id) % 3 == 0)
    old = rows.withColumn(MASTER.ts, F.when(moved, F.expr(f"{MASTER.ts} + INTERVAL '400' DAY")).otherwise(F.col(MASTER.ts)))
    old = old.withColumn("price", F.when(late, F.col("price") + 1).otherwise(F.col("price")))
    write_features(old.where(~late | (F.col(MASTER.event_id) % 4 < 2)), path)
    update_features(rows.where(late), path)
    return read_features(spark, path).select(MASTER.event_id, "month", "price")


@query(
    "score_files",
    "SELECT o_orderkey AS referralinstanceid, CAST(o_totalprice AS DOUBLE) AS score, '7' AS model_version FROM orders",
)
def score_files(spark, folder):
    """Scores written as JSON lines and read back."""
    path = new_path(spark, "score-files")
    rows = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias(MASTER.event_id), F.col("o_totalprice").cast("double").alias("prediction")
    )
    write_scores(score_rows(rows, "7"), path, "json")
    return spark.read.schema("referralinstanceid BIGINT, score DOUBLE, model_version STRING").json(path)


@query(
    "tables_below_id",
    """
    SELECT o_orderkey AS referralinstanceid, count(l_orderkey) AS items
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey < 700 GROUP BY 1""",
)
def tables_below_id(spark, folder):
    """Tables stored as files, read with an id limit, with only the child rows of what is left."""
    path = new_path(spark, "tables")
    for name, df in domain_tables(spark, folder).items():
        df.write.parquet(f"{path}/{name}")
    kept = children_of_events(parquet_tables(spark, path, id_below=700))
    check_tables(kept, need_rows=True)
    counts = kept["referralissue"].groupBy("referralinstanceid").agg(F.count("*").alias("items"))
    joined = kept["referral"].join(counts, "referralinstanceid", "left")
    return joined.select("referralinstanceid", F.coalesce("items", F.lit(0)).alias("items"))


@query(
    "first_payloads",
    """
    SELECT o_custkey AS clientid, count(*) AS events FROM orders
    WHERE o_custkey IN (SELECT DISTINCT o_custkey FROM orders ORDER BY 1 LIMIT 10) GROUP BY 1""",
)
def first_payloads(spark, folder):
    """The payloads of the ten smallest client ids, one payload per client."""
    referral = domain_tables(spark, folder)["referral"]
    rows = F.struct("referralinstanceid", "clientid")
    payloads = referral.groupBy("clientid").agg(F.collect_list(rows).alias("referral"))
    client = F.array().cast("array<struct<clientid: bigint>>")
    payloads = payloads.select("referral", client.alias("client"))
    return payload_tables(payloads, limit=10)["referral"].groupBy("clientid").agg(F.count("*").alias("events"))


@query(
    "own_stage",
    """
    WITH doubled AS (SELECT o_orderkey, 2 * CAST(floor(o_totalprice / 50000) AS BIGINT) AS d FROM orders)
    SELECT o_orderkey AS referral_referralinstanceid, CAST(d AS DOUBLE) AS own_doubled FROM doubled""",
)
def own_stage(spark, folder):
    """A stage of the user's own inside the feature pipeline."""
    doubled = SQLTransformer(statement="SELECT *, referral_householdsize * 2 AS own_doubled FROM __THIS__")
    settings = FeatureSettings(extra_stages=[doubled])
    features, rows = FeaturePipeline.fit_transform(domain_tables(spark, folder), AS_OF, settings)
    own = [c for c in features.column_schema if c.startswith("own_")]
    return rows.select(MASTER.event_id, *[F.col(c).cast("double").alias(c) for c in own])


@query(
    "own_fitted_stage",
    """
    WITH s AS (SELECT o_orderkey, CAST(floor(o_totalprice / 50000) AS DOUBLE) AS size FROM orders),
    m AS (SELECT avg(size) AS mean FROM s WHERE size <> 2)
    SELECT o_orderkey AS referral_referralinstanceid, CASE WHEN size = 2 THEN mean ELSE size END AS own_filled,
           10 * CASE WHEN size = 2 THEN mean ELSE size END AS own_tenfold
    FROM s, m""",
)
def own_fitted_stage(spark, folder):
    """Own stages that are fitted in order, inside the feature pipeline and through storage."""
    path = new_path(spark, "features")
    tables = domain_tables(spark, folder)
    size = SQLTransformer(statement="SELECT *, CAST(referral_householdsize AS DOUBLE) AS own_size FROM __THIS__")
    filled = Imputer(inputCols=["own_size"], outputCols=["own_filled"], missingValue=2.0)
    tenfold = SQLTransformer(statement="SELECT *, 10 * own_filled AS own_tenfold FROM __THIS__")
    FeaturePipeline.fit(tables, AS_OF, FeatureSettings(extra_stages=[size, filled, tenfold])).save(spark, path)
    rows = FeaturePipeline.load(spark, path).transform(tables)
    return rows.select(MASTER.event_id, "own_filled", "own_tenfold")


@query(
    "items_seen",
    """
    WITH firsts AS (
      SELECT o_custkey, min((o_orderdate, o_orderkey)) AS m, l_suppkey
      FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey, l_suppkey)
    SELECT o_orderkey, o_custkey, o_orderdate,
           (SELECT count(*) FROM firsts f
            WHERE f.o_custkey = o.o_custkey AND f.m <= (o.o_orderdate, o.o_orderkey)) AS suppliers
    FROM orders o""",
)
def items_seen(spark, folder):
    """Distinct suppliers a customer has had so far, without a column per supplier."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey")
    return history.distinct_items_seen(orders(spark, folder), ORDERS, lines, "l_orderkey", "l_suppkey", "suppliers")


@query(
    "count_encode_join",
    """
    SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_suppkey) AS l_suppkey FROM lineitem""",
)
def count_encode_join(spark, folder):
    """Frequencies kept as a table, for vocabularies of any size."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    fitted = durable(encode.frequencies(lines, "l_suppkey"), "frequencies")
    return encode.count_encode(lines, "l_suppkey", fitted)
