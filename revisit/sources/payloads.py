"""Nested JSON payloads: one object per client, an array of rows per table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revisit.functions.columns import ref
from revisit.schema import PAYLOAD_SCHEMA, REQUIRED_TABLES, TABLE_SCHEMAS, payload_schema


def read_payloads(
    spark: SparkSession,
    path: str,
    multi_line: bool = False,
    schema: T.StructType = PAYLOAD_SCHEMA,
) -> DataFrame:
    """One row per payload object.

    The default format is one object per line, which Spark splits freely. ``multi_line`` reads
    files that hold one object or one array over many lines; such a file is one task, so large
    exports should be many files or be rewritten as lines once (``write_payload_lines``).
    """
    reader = spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", multi_line)
    return reader.json(path)


def write_payload_lines(payloads: DataFrame, path: str) -> None:
    payloads.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def parse_payloads(
    rows: DataFrame, column: str, schema: T.StructType = PAYLOAD_SCHEMA
) -> DataFrame:
    """Payloads from JSON text in a column, also when the text was itself encoded as JSON."""
    body = _unwrapped(ref(column))
    parsed = F.from_json(body, schema, {"mode": "FAILFAST"})
    return rows.select(parsed.alias("_payload")).select("_payload.*")


def _unwrapped(text: Column) -> Column:
    inner = F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "v STRING")["v"]
    return F.when(F.ltrim(text).startswith('"'), inner).otherwise(text)


def inferred_schema(spark: SparkSession, path: str, multi_line: bool = False) -> T.StructType:
    """The declared columns with their types and all others that the files hold, by one pass."""
    found = spark.read.option("multiLine", multi_line).json(path).schema
    return with_undeclared(found)


def inferred_text_schema(rows: DataFrame, column: str) -> T.StructType:
    """The same for JSON text in a column."""
    whole = F.expr("schema_of_variant_agg(_body)")
    found = rows.select(F.parse_json(_unwrapped(ref(column))).alias("_body")).agg(whole).first()[0]
    kind = T.DataType.fromDDL((found or "STRUCT<>").replace("OBJECT<", "STRUCT<"))
    return with_undeclared(kind if isinstance(kind, T.StructType) else T.StructType())


def with_undeclared(found: T.StructType) -> T.StructType:
    more = {}
    for field in found:
        name, kind = field.name.lower(), field.dataType
        if name in TABLE_SCHEMAS and isinstance(kind, T.ArrayType):
            if isinstance(kind.elementType, T.StructType):
                declared = set(TABLE_SCHEMAS[name].names)
                own = [f for f in kind.elementType if f.name.lower() not in declared]
                more[name] = [(f.name, f.dataType.simpleString()) for f in own]
    return payload_schema(more)


def payload_tables(payloads: DataFrame, limit: int | None = None) -> dict[str, DataFrame]:
    """The tables inside the payloads; a missing or empty array gives no rows.

    ``limit`` keeps the payloads of the ``limit`` smallest client ids (files have no order).
    """
    if limit is not None:
        payloads = payloads.orderBy(payload_client()).limit(limit)
    have = set(payloads.columns)
    return {
        name: payloads.select(F.inline(ref(name))) for name in REQUIRED_TABLES if name in have
    }


def payload_client() -> Column:
    """Client id of a payload: from its client row, else from its first referral."""
    return F.coalesce(
        F.get(F.col("client"), F.lit(0))["clientid"], F.get(F.col("referral"), F.lit(0))["clientid"]
    )
