"""The fitted column schema: what training saw is what scoring gets."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revisit.functions.columns import named, quoted, quoted_all, ref
from revisit.schema import LABEL, NOT_FEATURES


def feature_columns(columns: Iterable[str], excluded: Iterable[str] = NOT_FEATURES) -> list[str]:
    """All columns that are not on the exclusion list, in order."""
    refused = {c.lower() for c in excluded}
    return [c for c in columns if c.lower() not in refused]


def align(df: DataFrame, schema: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` as is, then exactly the fitted columns as doubles; missing and null become 0."""
    present = set(df.columns)
    cells = [
        named(f"coalesce(CAST({quoted(c)} AS DOUBLE), 0D)" if c in present else "0D", c)
        for c in schema
    ]
    return df.selectExpr(*quoted_all(c for c in keep if c in present), *cells)


def leftover_columns(df: DataFrame, schema: Sequence[str]) -> list[str]:
    """Columns that are not features: ids, times, targets, notes."""
    fitted = set(schema)
    return [c for c in df.columns if c not in fitted]


def label(df: DataFrame, source: str = LABEL, name: str = "label") -> DataFrame:
    """Add the target, null as 0."""
    return df.withColumn(name, F.coalesce(ref(source), F.lit(0.0)))
