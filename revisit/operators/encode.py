"""Category encoders. ``fit`` functions return plain values, the others are projections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revisit.functions.columns import literal, named, quoted, quoted_all, ref
from revisit.operators.pivot import MAX_CATEGORIES, category_counts


def one_hot(df: DataFrame, columns: Mapping[str, Sequence]) -> DataFrame:
    """Replace each column by 0/1 columns ``<column>_<value>``; null and unseen values are all 0."""
    flags = [
        named(f"CAST(coalesce({quoted(c)} = {literal(v)}, FALSE) AS INT)", f"{c}_{v}")
        for c, values in columns.items()
        for v in values
    ]
    return df.selectExpr(*quoted_all(c for c in df.columns if c not in columns), *flags)


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """How often each non-null value occurs."""
    return (
        df.where(ref(column).isNotNull())
        .groupBy(ref(column))
        .agg(F.count(F.lit(1)).alias("frequency"))
    )


def fit_frequencies(
    df: DataFrame, column: str, max_categories: int = MAX_CATEGORIES
) -> dict[object, int]:
    return category_counts({column: (df, column)}, max_categories)[column]


def count_encode(
    df: DataFrame, column: str, fitted: Mapping[object, int] | DataFrame
) -> DataFrame:
    """Replace values by their fitted frequency; values not seen at fit become null.

    ``fitted`` is a small dictionary, or a table as ``frequencies`` gives it (saved as Parquet, for
    example), which may be of any size and never passes through the driver.
    """
    if isinstance(fitted, DataFrame):
        mapping = fitted.select(ref(column), F.col("frequency").alias("_frequency"))
    else:
        kind = df.schema[column].dataType
        schema = T.StructType(
            [T.StructField(column, kind), T.StructField("_frequency", T.LongType())]
        )
        # At most max_categories rows, so Spark broadcasts it.
        mapping = df.sparkSession.createDataFrame(sorted(fitted.items()), schema)
    joined = df.join(mapping, column, "left")
    return joined.select(
        *[F.col("_frequency").alias(c) if c == column else ref(c) for c in df.columns]
    )
