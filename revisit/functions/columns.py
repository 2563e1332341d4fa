"""Column naming helpers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    """``name`` as an identifier for SQL text."""
    return "`" + name.replace("`", "``") + "`"


def ref(name: str) -> Column:
    """Column by its exact name, dots and all."""
    return F.col(quoted(name))


def literal(value) -> str:
    """An integer, boolean or string as SQL text."""
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(value)


def named(expression: str, name: str) -> str:
    return f"{expression} AS {quoted(name)}"


def quoted_all(names: Iterable[str]) -> list[str]:
    """Identifiers for ``selectExpr``: wide projections are cheaper to build as SQL text."""
    return [quoted(n) for n in names]


def with_prefix(df: DataFrame, prefix: str) -> DataFrame:
    return df.toDF(*[prefix + c for c in df.columns])


def with_suffix(df: DataFrame, suffix: str, columns: Iterable[str]) -> DataFrame:
    """Add ``suffix`` to the named columns, leave the others."""
    chosen = set(columns)
    return df.toDF(*[c + suffix if c in chosen else c for c in df.columns])


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def columns_like(columns: Iterable[str], classes: Iterable[str]) -> list[str]:
    """Columns whose name contains one of the class names, each once, in class order."""
    columns = list(columns)
    picked = [c for part in classes for c in columns if part in c]
    return list(dict.fromkeys(picked))
