"""Consolidation: pivots, encoders, client features, joins, flags and projections."""

from pyspark.sql import functions as F

from revisit.functions import time as clock
from revisit.functions.columns import columns_like, lower_names, with_prefix, with_suffix
from revisit.operators import encode, pivot
from revisit.operators.client import client_scalars
from revisit.operators.consolidate import Consolidation
from revisit.operators.history import distinct_items_seen, split_current_ever
from revisit.schema import CHILD_TABLES
from revisit.sources.tables import children_of_events, conform, read_tables
from workload.domain import (
    AS_OF,
    CLIENT_ISSUES,
    DOMAIN_SQL,
    child_counts_sql,
    client_sql,
    domain_tables,
    master_sql,
)
from workload.registry import query, table
from workload.timeline_queries import ORDERS, orders


@query(
    "count_pivot",
    """
    SELECT l_orderkey,
           nullif(count(*) FILTER (WHERE l_returnflag = 'A'), 0) AS flag_A,
           nullif(count(*) FILTER (WHERE l_returnflag = 'N'), 0) AS flag_N,
           nullif(count(*) FILTER (WHERE l_returnflag = 'R'), 0) AS flag_R
    FROM lineitem GROUP BY l_orderkey""",
)
def count_pivot(spark, folder):
    return pivot.count_pivot(table(spark, folder, "lineitem"), "l_orderkey", "l_returnflag", "flag")


@query(
    "count_pivot_join",
    """
    SELECT o_orderkey,
           nullif(count(*) FILTER (WHERE l_suppkey = s.k1), 0) AS n_suppliers_first,
           nullif(count(l_suppkey), 0) AS n_lines
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey
    CROSS JOIN (SELECT min(s_suppkey) AS k1 FROM supplier) s
    GROUP BY o_orderkey""",
)
def count_pivot_join(spark, folder):
    """A wide vocabulary stays a map; one item and the total are read from it."""
    lines = table(spark, folder, "lineitem")
    first = table(spark, folder, "supplier").agg(F.min("s_suppkey").alias("k1"))
    counts = pivot.item_counts({"suppliers": (lines, "l_orderkey", "l_suppkey")})
    joined = table(spark, folder, "orders").select("o_orderkey").join(
        counts.withColumnRenamed("key", "o_orderkey"), "o_orderkey", "left"
    )
    total = F.aggregate(F.map_values("suppliers"), F.lit(0).cast("bigint"), lambda a, n: a + n)
    return joined.select(
        "o_orderkey",
        F.try_element_at("suppliers", first.scalar()).alias("n_suppliers_first"),
        total.alias("n_lines"),
    )


@query(
    "category_vocabulary",
    """
    SELECT 'priority' AS name, o_orderpriority AS item, count(*) AS n FROM orders GROUP BY 2
    UNION ALL SELECT 'segment', c_mktsegment, count(*) FROM customer GROUP BY 2""",
)
def category_vocabulary(spark, folder):
    fitted = pivot.category_counts(
        {
            "priority": (table(spark, folder, "orders"), "o_orderpriority"),
            "segment": (table(spark, folder, "customer"), "c_mktsegment"),
        }
    )
    rows = [(name, item, n) for name, items in fitted.items() for item, n in items.items()]
    return spark.createDataFrame(rows, "name string, item string, n bigint")


@query(
    "category_frequencies",
    "SELECT l_suppkey, count(*) AS frequency FROM lineitem GROUP BY l_suppkey",
)
def category_frequencies(spark, folder):
    return encode.frequencies(table(spark, folder, "lineitem"), "l_suppkey")


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query(
    "one_hot",
    "SELECT c_custkey, "
    + ", ".join(
        f"CAST(c_mktsegment = '{s}' AS INT) AS c_mktsegment_{s}" for s in SEGMENTS
    )
    + " FROM customer",
)
def one_hot(spark, folder):
    customer = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    fitted = pivot.vocabulary({"c_mktsegment": (customer, "c_mktsegment")})
    return encode.one_hot(customer, fitted)


@query(
    "count_encode",
    """
    SELECT c_custkey, f.n AS c_mktsegment
    FROM customer JOIN (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1) f
      USING (c_mktsegment)""",
)
def count_encode(spark, folder):
    customer = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    fitted = encode.fit_frequencies(customer, "c_mktsegment")
    return encode.count_encode(customer, "c_mktsegment", fitted)


@query(
    "count_encoded_children",
    """
    WITH f AS (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1),
    e AS (SELECT l_orderkey, f.n, dense_rank() OVER (ORDER BY f.n) AS place
          FROM lineitem JOIN f USING (l_returnflag))
    SELECT l_orderkey, nullif(count(*) FILTER (WHERE place = 1), 0) AS rarest,
           nullif(count(*) FILTER (WHERE place = 2), 0) AS middle,
           nullif(count(*) FILTER (WHERE place = 3), 0) AS commonest
    FROM e GROUP BY l_orderkey""",
)
def count_encoded_children(spark, folder):
    """Items replaced by how often they occur, then pivoted."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_returnflag")
    fitted = encode.fit_frequencies(lines, "l_returnflag")
    encoded = encode.count_encode(lines, "l_returnflag", fitted)
    wide = pivot.count_pivot(encoded, "l_orderkey", "l_returnflag", "f", sorted(fitted.values()))
    return wide.toDF("l_orderkey", "rarest", "middle", "commonest")


@query(
    "client_scalars",
    f"WITH {DOMAIN_SQL}, c AS ({client_sql()}) SELECT client_clientid AS clientid,"
    " client_age AS age, client_addresslength AS addresslength,"
    " client_clientismale AS clientismale, client_knownpartner AS knownpartner FROM c",
)
def scalars(spark, folder):
    client = domain_tables(spark, folder)["client"]
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    return client_scalars(client, as_of).select(
        "clientid", "age", "addresslength", "clientismale", "knownpartner"
    )


@query(
    "floor_days",
    """
    SELECT event_id,
           CAST(floor((epoch_us(TIMESTAMP '2024-01-15 12:00:00') - epoch_us(ts)) / 86400000000)
                AS BIGINT) AS days_until,
           CAST(date_trunc('week', ts) AS DATE) + 6 AS week_end,
           ts - INTERVAL 365 DAY AS year_before
    FROM events""",
)
def floor_days(spark, folder):
    rows = table(spark, folder, "events")
    noon = F.expr("TIMESTAMP_NTZ'2024-01-15 12:00:00'")
    return rows.select(
        "event_id",
        clock.floor_days(noon, F.col("ts")).alias("days_until"),
        clock.week_end(clock.week_index(F.col("ts"))).alias("week_end"),
        (F.col("ts") - clock.days(365)).alias("year_before"),
    )


@query("master_table", f"WITH {DOMAIN_SQL} {master_sql()}")
def master_table(spark, folder):
    tables = domain_tables(spark, folder)
    return Consolidation.fit(tables, AS_OF).master(tables)


@query(
    "client_table",
    f"WITH {DOMAIN_SQL} {client_sql()}",
)
def client_table(spark, folder):
    tables = domain_tables(spark, folder)
    return Consolidation.fit(tables, AS_OF).clients(tables)


@query(
    "count_encoded_clients",
    f"""
    WITH {DOMAIN_SQL},
    f AS (SELECT clientaddresstypeid, count(*) AS n FROM client GROUP BY 1)
    SELECT clientid AS client_clientid,
           CAST(dense_rank() OVER (ORDER BY f.n) AS BIGINT) AS commonness
    FROM client JOIN f USING (clientaddresstypeid)""",
)
def count_encoded_clients(spark, folder):
    """The count-encoding mode; the one-hot columns of the counts are read back as a rank."""
    tables = domain_tables(spark, folder)
    clients = Consolidation.fit(tables, AS_OF, encode_counts=True).clients(tables)
    flags = sorted(
        (c for c in clients.columns if c.startswith("client_clientaddresstypeid_")),
        key=lambda c: int(c.rsplit("_", 1)[1]),
    )
    place = F.coalesce(*[F.when(F.col(c) == 1, F.lit(i + 1)) for i, c in enumerate(flags)])
    return clients.select("client_clientid", place.cast("bigint").alias("commonness"))


def _flag_rows(spark, folder):
    """Orders with the flag and status counts of their lines."""
    lines = table(spark, folder, "lineitem")
    items = pivot.vocabulary({"flag": (lines, "l_returnflag"), "status": (lines, "l_linestatus")})
    counts = pivot.counted_items(
        {"flag": (lines, "l_orderkey", "l_returnflag"), "status": (lines, "l_orderkey", "l_linestatus")},
        items,
    ).withColumnRenamed("key", "o_orderkey")
    joined = orders(spark, folder).join(counts, "o_orderkey", "left")
    return pivot.spread(joined, items)


_FLAG_SQL = """
    c AS (SELECT l_orderkey,
             nullif(count(*) FILTER (WHERE l_returnflag = 'A'), 0) AS flag_A,
             nullif(count(*) FILTER (WHERE l_returnflag = 'N'), 0) AS flag_N,
             nullif(count(*) FILTER (WHERE l_returnflag = 'R'), 0) AS flag_R,
             nullif(count(*) FILTER (WHERE l_linestatus = 'F'), 0) AS status_F,
             nullif(count(*) FILTER (WHERE l_linestatus = 'O'), 0) AS status_O
          FROM lineitem GROUP BY 1),
    m AS (SELECT o_orderkey, o_custkey, o_orderdate, c.* EXCLUDE (l_orderkey)
          FROM orders LEFT JOIN c ON l_orderkey = o_orderkey)"""


def _ever(column):
    return (
        f"coalesce(sum({column}) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) > 0,"
        f" FALSE) AS {column}_ever"
    )


@query(
    "current_and_ever_flags",
    f"""
    WITH {_FLAG_SQL}
    SELECT o_orderkey, o_custkey, o_orderdate, status_F, status_O,
           flag_A AS flag_A_current, flag_N AS flag_N_current, flag_R AS flag_R_current,
           {_ever('flag_A')}, {_ever('flag_N')}, {_ever('flag_R')}
    FROM m""",
)
def current_and_ever_flags(spark, folder):
    return split_current_ever(_flag_rows(spark, folder), ORDERS, ["flag_"])


@query(
    "ever_flags_many_categories",
    """
    WITH s AS (SELECT o_custkey, o_orderdate, o_orderkey, l_suppkey
               FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    f AS (SELECT DISTINCT ON (o_custkey, l_suppkey) o_custkey, o_orderkey
          FROM s ORDER BY o_custkey, l_suppkey, o_orderdate, o_orderkey)
    SELECT o.o_orderkey, count(f.o_orderkey) AS suppliers_so_far
    FROM orders o
    LEFT JOIN (SELECT f.o_custkey, f.o_orderkey, o_orderdate
               FROM f JOIN orders USING (o_orderkey)) f
      ON f.o_custkey = o.o_custkey
     AND (f.o_orderdate, f.o_orderkey) <= (o.o_orderdate, o.o_orderkey)
    GROUP BY o.o_orderkey""",
)
def ever_flags_many_categories(spark, folder):
    """Ever flags in their long form: how many suppliers each customer has had, at any vocabulary."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey")
    rows = orders(spark, folder)
    seen = distinct_items_seen(rows, ORDERS, lines, "l_orderkey", "l_suppkey", "suppliers_so_far")
    return seen.select("o_orderkey", "suppliers_so_far")


@query(
    "column_naming",
    f"""
    WITH {_FLAG_SQL}
    SELECT o_orderkey AS x_o_orderkey, flag_A AS x_flag_a_now, flag_N AS x_flag_n_now,
           flag_R AS x_flag_r_now
    FROM m""",
)
def column_naming(spark, folder):
    """Prefix, suffix, choice by substring, drop and lower-casing of columns."""
    rows = _flag_rows(spark, folder)
    picked = columns_like(rows.columns, ["flag_"])
    rows = rows.select("o_orderkey", *picked).drop("status_F", "not_there")
    return lower_names(with_prefix(with_suffix(rows, "_now", picked), "x_"))


@query(
    "children_of_events",
    """
    SELECT l_orderkey AS referralinstanceid, CAST(l_linenumber AS BIGINT) AS clientissueid
    FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)""",
)
def child_rows(spark, folder):
    tables = children_of_events(conform(domain_tables(spark, folder)))
    return tables["referralissue"]


@query(
    "tables_from_reader",
    """
    SELECT n_nationkey, n_name, n_regionkey, r_name
    FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
def tables_from_reader(spark, folder):
    """Tables with upper-case columns read through a reader function."""

    def read(name):
        raw = table(spark, folder, name)
        return raw.toDF(*[c.upper() for c in raw.columns])

    tables = read_tables(read, names=("nation", "region"))
    return tables["nation"].join(
        tables["region"], F.col("n_regionkey") == F.col("r_regionkey")
    ).drop("r_regionkey")


@query("child_count_columns", f"WITH {DOMAIN_SQL} {child_counts_sql()}")
def child_count_columns(spark, folder):
    """All six child tables counted together."""
    tables = conform(domain_tables(spark, folder))
    counts = pivot.item_counts({n: (tables[n], k, i) for n, (k, i) in CHILD_TABLES.items()})
    items = pivot.vocabulary({n: (tables[n], i) for n, (_, i) in CHILD_TABLES.items()})
    return pivot.spread(counts, items).withColumnRenamed("key", "id")


@query(
    "client_issue_pivot",
    f"WITH {DOMAIN_SQL} SELECT clientid, "
    + ", ".join(
        f"nullif(count(*) FILTER (WHERE item = {v}), 0) AS clientissue_{v}" for v in CLIENT_ISSUES
    )
    + " FROM clientissue GROUP BY 1",
)
def client_issue_pivot(spark, folder):
    tables = domain_tables(spark, folder)
    return pivot.count_pivot(tables["clientissue"], "clientid", "clientissueid", "clientissue")
