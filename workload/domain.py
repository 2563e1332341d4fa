"""The nine domain tables, derived from the test tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from revisit.schema import CHILD_TABLES
from workload.registry import table

AS_OF = "2001-08-02 00:00:00"


def domain_tables(spark, folder):
    orders = table(spark, folder, "orders")
    lines = table(spark, folder, "lineitem")
    customer = table(spark, folder, "customer")
    nation = table(spark, folder, "nation").select("n_nationkey", "n_regionkey")

    def child(name, expression):
        key, item = CHILD_TABLES[name]
        return lines.select(
            F.col("l_orderkey").alias(key), F.expr(expression).cast("bigint").alias(item)
        )

    return {
        "referral": orders.selectExpr(
            "o_orderkey AS referralinstanceid",
            "o_custkey AS clientid",
            "o_orderdate AS referraltakendate",
            "o_orderstatus AS referralnotes",
            "CAST(floor(o_totalprice / 50000) AS BIGINT) AS householdsize",
        ),
        "client": customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").selectExpr(
            "c_custkey AS clientid",
            "CAST(date_add(DATE'1940-01-01', CAST(c_custkey * 37 % 29000 AS INT)) AS TIMESTAMP_NTZ)"
            " AS clientdateofbirth",
            "CAST(date_add(DATE'1990-01-01', CAST(c_custkey * 53 % 4000 AS INT)) AS TIMESTAMP_NTZ)"
            " AS addresssincedate",
            "c_custkey % 2 = 0 AS clientismale",
            "CASE WHEN c_acctbal > 5000 THEN CAST(c_nationkey AS BIGINT) END AS partnerid",
            "CAST(c_nationkey AS BIGINT) AS clientcountryid",
            "CAST(ascii(c_mktsegment) AS BIGINT) AS clientaddresstypeid",
            "CAST(n_regionkey AS BIGINT) AS addresslocalityid",
            "CASE WHEN c_acctbal >= 0 THEN CAST(floor(c_acctbal / 2500) AS BIGINT) END"
            " AS clientresidencyid",
        ),
        "clientissue": orders.selectExpr(
            "o_custkey AS clientid", "CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS clientissueid"
        ),
        "referralissue": child("referralissue", "l_linenumber"),
        "referralbenefit": child("referralbenefit", "ascii(l_returnflag)"),
        "referralreason": child("referralreason", "ascii(l_linestatus)"),
        "referraldietaryrequirements": child("referraldietaryrequirements", "round(l_tax * 100)"),
        "referraldomesticcircumstances": child(
            "referraldomesticcircumstances", "floor(l_quantity / 10)"
        ),
        "referraldocument": child("referraldocument", "floor(round(l_discount * 100) / 5)"),
    }


DOMAIN_SQL = """
    referral AS (
      SELECT o_orderkey AS referralinstanceid, o_custkey AS clientid,
             o_orderdate AS referraltakendate, o_orderstatus AS referralnotes,
             CAST(floor(o_totalprice / 50000) AS BIGINT) AS householdsize FROM orders),
    client AS (
      SELECT c_custkey AS clientid,
             CAST(DATE '1940-01-01' + CAST(c_custkey * 37 % 29000 AS INT) AS TIMESTAMP)
               AS clientdateofbirth,
             CAST(DATE '1990-01-01' + CAST(c_custkey * 53 % 4000 AS INT) AS TIMESTAMP)
               AS addresssincedate,
             c_custkey % 2 = 0 AS clientismale,
             CASE WHEN c_acctbal > 5000 THEN CAST(c_nationkey AS BIGINT) END AS partnerid,
             CAST(c_nationkey AS BIGINT) AS clientcountryid,
             CAST(ascii(c_mktsegment) AS BIGINT) AS clientaddresstypeid,
             CAST(n_regionkey AS BIGINT) AS addresslocalityid,
             CASE WHEN c_acctbal >= 0 THEN CAST(floor(c_acctbal / 2500) AS BIGINT) END
               AS clientresidencyid
      FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey),
    clientissue AS (
      SELECT o_custkey AS clientid, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS item
      FROM orders),
    child AS (
      SELECT l_orderkey AS id, l_linenumber AS referralissue,
             ascii(l_returnflag) AS referralbenefit, ascii(l_linestatus) AS referralreason,
             CAST(round(l_tax * 100) AS BIGINT) AS referraldietaryrequirements,
             CAST(floor(l_quantity / 10) AS BIGINT) AS referraldomesticcircumstances,
             CAST(round(l_discount * 100) AS BIGINT) // 5 AS referraldocument
      FROM lineitem)"""

# Values that occur at every scale factor of the test tables.
CHILD_ITEMS = {
    "referralissue": list(range(1, 8)),
    "referralbenefit": [65, 78, 82],
    "referralreason": [70, 79],
    "referraldietaryrequirements": list(range(9)),
    "referraldomesticcircumstances": list(range(6)),
    "referraldocument": [0, 1, 2],
}
CLIENT_ITEMS = {
    "clientcountryid": list(range(25)),
    "clientaddresstypeid": [65, 66, 70, 72, 77],
    "addresslocalityid": list(range(5)),
    "clientresidencyid": list(range(4)),
}
CLIENT_ISSUES = list(range(1, 6))


def child_counts_sql() -> str:
    """Per event, rows per child item; null where there is none."""
    cells = [
        f"nullif(count(*) FILTER (WHERE {name} = {v}), 0) AS {name}_{v}"
        for name, values in CHILD_ITEMS.items()
        for v in values
    ]
    return f"SELECT id, {', '.join(cells)} FROM child GROUP BY id"


def client_sql(as_of: str = AS_OF) -> str:
    """Client features by client id."""
    micros = "86400000000"
    age = f"(epoch_us(TIMESTAMP '{as_of}') - epoch_us(clientdateofbirth))"
    age = f"(CAST(floor({age} / {micros}) AS BIGINT) / 365.0::DOUBLE)"
    there = f"(epoch_us(TIMESTAMP '{as_of}') - epoch_us(addresssincedate))"
    flags = [
        f"CAST(coalesce({c} = {v}, FALSE) AS INT) AS client_{c}_{v}"
        for c, values in CLIENT_ITEMS.items()
        for v in values
    ]
    issues = [
        f"nullif(count(*) FILTER (WHERE item = {v}), 0) AS clientissue_{v}" for v in CLIENT_ISSUES
    ]
    return f"""
      SELECT * FROM (
        SELECT clientid AS client_clientid,
               CASE WHEN {age} < 0 THEN {age} + 100 ELSE {age} END AS client_age,
               CAST(floor({there} / {micros}) AS BIGINT) / 365.0::DOUBLE AS client_addresslength,
               CAST(clientismale AS INT) AS client_clientismale,
               CAST(partnerid IS NOT NULL AS INT) AS client_knownpartner,
               {', '.join(flags)}
        FROM client)
      LEFT JOIN (SELECT clientid AS client_clientid, {', '.join(issues)}
                 FROM clientissue GROUP BY 1) USING (client_clientid)"""


def master_sql() -> str:
    return f"""
      SELECT r.referralinstanceid AS referral_referralinstanceid,
             r.clientid AS referral_clientid, r.referraltakendate AS referral_referraltakendate,
             r.referralnotes AS referral_referralnotes,
             r.householdsize AS referral_householdsize,
             k.* EXCLUDE (id), c.*
      FROM referral r
      LEFT JOIN ({child_counts_sql()}) k ON k.id = r.referralinstanceid
      LEFT JOIN ({client_sql()}) c ON c.client_clientid = r.clientid"""
