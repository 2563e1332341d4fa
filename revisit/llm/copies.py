"""Written copies that are deleted once they have been read, and marks of the keys a join can meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revisit.plans.durable import durable_at, forget

MARKS = 1 << 26  # bits of a mark table: 8 MB at any size of the data
_BUCKET_BITS = 32768  # of Spark's bitmap functions


class Copies:
    """Copies in the shared folder that only intermediate steps need."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: list[str] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        copy, path = durable_at(df, name)
        self.paths.append(path)
        return copy

    def forget(self) -> None:
        """Delete all; what was computed from them must have been written by now."""
        for path in self.paths:
            forget(self.spark, path)
        self.paths.clear()


def _mark_of(*key: Column) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(MARKS)) + 1


def marks(keys: DataFrame, column: str) -> DataFrame:
    """(mark_bucket, mark_bits): a bit per hash of the values of ``column``, of bounded size."""
    mark = _mark_of(F.col(column))
    rows = keys.select(F.bitmap_bucket_number(mark).alias("mark_bucket"), F.bitmap_bit_position(mark).alias("bit"))
    return rows.groupBy("mark_bucket").agg(F.bitmap_construct_agg("bit").alias("mark_bits"))


def split_by_marks(df: DataFrame, column: str, marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` whose ``column`` may be among the marked values, and rows where it is not.

    A few rows are taken for marked that are not; none is missed. Rows do not move.
    """
    mark = _mark_of(F.col(column))
    bit = F.bitmap_bit_position(mark)
    met = df.join(F.broadcast(marked), F.bitmap_bucket_number(mark) == marked["mark_bucket"], "left")
    bits = marked["mark_bits"]
    byte = F.conv(F.hex(F.substring(bits, (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = bits.isNotNull() & (byte.bitwiseAND(F.pow(F.lit(2), bit % 8).cast("int")) > 0)
    # The columns of the join are named apart from those of ``df``.
    columns = [df[c] for c in df.columns]
    return met.where(held).select(*columns), met.where(~held).select(*columns)
