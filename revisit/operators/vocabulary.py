"""Vocabularies as tables: items, how often they occur, and their places in a feature vector.

Nothing here passes through the driver, and no item becomes a column, so a vocabulary may be of any
size. Places are dealt by counting: items are sorted by range, each partition counts its own, and
the counts before a partition are added (see ``scan``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revisit.functions.columns import ref
from revisit.operators.scan import Running, segmented_scan

KEYS = ["name", "item"]
_HEAVY_SHARE = 4096  # items with over 1 / 4096 of all rows are joined by broadcast: at most 4,096


def long_items(tables: Mapping[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """(name, key, item) rows of every ``name: (table, key, item)``, items as text; nulls are left out."""
    rows = None
    for name, (df, key, item) in tables.items():
        part = df.where(ref(key).isNotNull() & ref(item).isNotNull()).select(
            F.lit(name).alias("name"), ref(key).alias("key"), ref(item).cast("string").alias("item")
        )
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        raise ValueError("no table to take items from")
    return rows


def frequencies_of(items: DataFrame) -> DataFrame:
    """(name, item, frequency) of (name, item) rows."""
    return items.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("frequency"))


def with_places(frequencies: DataFrame, wide: Column | None = None) -> DataFrame:
    """Add ``place``, from 0 in the order of (name, item), and ``second``.

    Where ``wide`` is true an item takes two places, the later of which is ``second`` (else null).
    """
    double = F.coalesce(wide, F.lit(False)) if wide is not None else F.lit(False)
    rows = frequencies.withColumn("_width", F.when(double, 2).otherwise(1).cast("long"))
    ended = segmented_scan(rows, [], KEYS, {"_end": Running("sum", "_width")})
    return ended.select(
        *frequencies.columns,
        (F.col("_end") - F.col("_width")).alias("place"),
        F.when(F.col("_width") == 2, F.col("_end") - 1).alias("second"),
    )


def looked_up(rows: DataFrame, vocabulary: DataFrame, columns: Sequence[str], total: int | None = None) -> DataFrame:
    """(name, item, ..) rows with columns of the vocabulary; rows of unknown items go.

    The commonest items are taken out and joined by broadcast, as many rows of an item would else
    meet in one task. ``total`` is the sum of all frequencies, counted if not given.
    """
    if total is None:
        total = vocabulary.agg(F.sum("frequency")).first()[0] or 0
    picked = vocabulary.select(*KEYS, "frequency", *[c for c in columns if c != "frequency"])
    heavy = F.col("frequency") * _HEAVY_SHARE > total
    if "frequency" in columns:
        few, rest = F.broadcast(picked.where(heavy)), picked.where(~heavy)
    else:
        few, rest = F.broadcast(picked.where(heavy).drop("frequency")), picked.where(~heavy).drop("frequency")
    common = rows.join(few, KEYS)
    others = rows.join(F.broadcast(picked.where(heavy).select(*KEYS)), KEYS, "left_anti").join(rest, KEYS)
    return common.unionByName(others)


def encoded(rows: DataFrame, vocabulary: DataFrame, total: int | None = None) -> DataFrame:
    """(name, item, ..) rows with items replaced by how often they occurred at fit, as text."""
    found = looked_up(rows, vocabulary, ["frequency"], total)
    return found.withColumn("item", F.col("frequency").cast("string")).drop("frequency").select(rows.columns)
