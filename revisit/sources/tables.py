"""Table sources: any reader that returns a DataFrame per table name."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revisit.functions.columns import lower_names, named, quoted
from revisit.schema import CHILD_TABLES, REQUIRED_TABLES, TABLE_SCHEMAS

TIMES = {"referral": ("referraltakendate",), "client": ("clientdateofbirth", "addresssincedate")}


def read_tables(
    read: Callable[[str], DataFrame],
    names: Iterable[str] = REQUIRED_TABLES,
    id_below: int | None = None,
) -> dict[str, DataFrame]:
    """Read every table through ``read(name)`` with lower-case columns.

    ``id_below`` keeps only referrals with a smaller instance id; the filter reaches the scan.
    """
    tables = {name: lower_names(read(name)) for name in names}
    if id_below is not None:
        tables["referral"] = tables["referral"].where(F.col("referralinstanceid") < id_below)
    return tables


def parquet_tables(spark: SparkSession, folder: str, id_below: int | None = None):
    return read_tables(lambda name: spark.read.parquet(f"{folder}/{name}"), id_below=id_below)


def jdbc_tables(
    spark: SparkSession,
    url: str,
    properties: Mapping[str, str],
    bounds: Mapping[str, tuple[str, int, int, int]] | None = None,
    id_below: int | None = None,
):
    """Tables of a database. ``bounds[table] = (column, low, high, partitions)`` reads in parallel."""

    def read(name: str) -> DataFrame:
        if bounds and name in bounds:
            column, low, high, partitions = bounds[name]
            return spark.read.jdbc(
                url, name, column=column, lowerBound=low, upperBound=high,
                numPartitions=partitions, properties=dict(properties),
            )
        return spark.read.jdbc(url, name, properties=dict(properties))

    return read_tables(read, id_below=id_below)


def check_tables(tables: Mapping[str, DataFrame], need_rows: bool = False) -> None:
    """Every table must be there (it may be empty); with ``need_rows`` events and clients not."""
    for name in REQUIRED_TABLES:
        if name not in tables:
            raise ValueError(
                f"table {name!r} is required; pass an empty DataFrame if there is no data"
            )
    if need_rows:
        for name in ("referral", "client"):
            if tables[name].isEmpty():
                raise ValueError(f"table {name!r} has no rows")


def conform(tables: Mapping[str, DataFrame], strict: bool = True) -> dict[str, DataFrame]:
    """Lower-case names, parsed times and declared types; columns without a declaration stay.

    Unreadable times fail, or become null if not ``strict``.
    """
    made = {}
    for name in REQUIRED_TABLES:
        df = lower_names(tables[name])
        declared = {f.name: f.dataType for f in TABLE_SCHEMAS[name]}
        times = TIMES.get(name, ())
        cast = "CAST" if strict else "TRY_CAST"
        made[name] = df.selectExpr(
            [
                named(f"{cast}({quoted(c)} AS TIMESTAMP_NTZ)", c)
                if c in times
                else named(f"CAST({quoted(c)} AS {declared[c].simpleString()})", c)
                if c in declared
                else quoted(c)
                for c in df.columns
            ]
        )
    return made


def children_of_events(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Child rows whose event is present (after ``id_below``, for example)."""
    events = tables["referral"].select("referralinstanceid")
    kept = {
        name: tables[name].join(events, key, "left_semi") for name, (key, _) in CHILD_TABLES.items()
    }
    return {**tables, **kept}


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLE_SCHEMAS[name])
