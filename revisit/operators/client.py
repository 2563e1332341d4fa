"""Client table to client features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revisit.functions import time as clock
from revisit.functions.columns import ref
from revisit.operators.encode import one_hot


def one_row_per_key(df: DataFrame, key: str) -> DataFrame:
    """Keep one row per key, always the same one: the largest in column order."""
    others = [c for c in df.columns if c != key]
    best = df.where(ref(key).isNotNull()).groupBy(ref(key)).agg(
        F.max(F.struct(*[ref(c) for c in others])).alias("_row")
    )
    return best.select(ref(key), "_row.*").select([ref(c) for c in df.columns])


def client_scalars(client: DataFrame, as_of: Column) -> DataFrame:
    """Add age, addresslength and knownpartner, and turn clientismale into 0/1."""
    known = ref("partnerid").isNotNull().cast("int") if "partnerid" in client.columns else F.lit(0)
    return client.select(
        *[ref(c) for c in client.columns if c != "clientismale"],
        ref("clientismale").cast("int").alias("clientismale"),
        clock.age_years(as_of, ref("clientdateofbirth")).alias("age"),
        clock.years_since(as_of, ref("addresssincedate")).alias("addresslength"),
        known.alias("knownpartner"),
    )


def client_features(
    client: DataFrame, as_of: Column, categories: Mapping[str, Sequence]
) -> DataFrame:
    """The scalar features and one 0/1 column per fitted category value."""
    kept = ["age", "addresslength", "clientismale", "knownpartner", "clientid"]
    scalars = client_scalars(client, as_of).select(*kept, *categories)
    return one_hot(scalars, categories)
