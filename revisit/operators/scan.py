"""Running totals along each key's rows, for any number of keys of any weight.

Rows are partitioned by range of (key, order), so a heavy key lies in several neighbouring
partitions and no task holds all of it. Totals run inside each partition; what a key has gathered
in earlier partitions is carried into the later ones. A border between two partitions cuts at most
one key, so there are fewer carried rows than partitions, whatever the data: they are broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revisit.functions.columns import quoted_all, ref
from revisit.plans.durable import durable

PART = "_scan_part"
ROWS, PEERS, BEFORE = "rows", "peers", "before"


@dataclass(frozen=True)
class Running:
    """One running value of the SQL expression ``value``.

    ``kind`` is sum, min, max, xor or last (the last one that is not null).

    ``frame`` is ``rows`` (up to this row), ``peers`` (also the rows of equal order behind it) or
    ``before`` (the rows in front of it only; with ``peers`` in mind use a distinct order).
    """

    kind: str
    value: str
    frame: str = ROWS


_AGGREGATES = {"sum": F.sum, "min": F.min, "max": F.max, "xor": F.bit_xor}


def _over(kind: str, value: Column, window) -> Column:
    if kind == "last":
        return F.last(value, ignorenulls=True).over(window)
    return _AGGREGATES[kind](value).over(window)


def _joined(kind: str, earlier: Column, here: Column) -> Column:
    """An earlier total and a later one together; null where both are."""
    if kind == "sum":
        return F.when(earlier.isNull(), here).when(here.isNull(), earlier).otherwise(earlier + here)
    if kind == "xor":
        whole = earlier.bitwiseXOR(here)
        return F.when(earlier.isNull(), here).when(here.isNull(), earlier).otherwise(whole)
    if kind == "last":
        return F.coalesce(here, earlier)
    return F.least(earlier, here) if kind == "min" else F.greatest(earlier, here)


@dataclass
class Placed:
    """Rows written in range partitions of (keys, order), with the number of their partition."""

    rows: DataFrame
    keys: Sequence[str]
    order: Sequence[str]

    def running(self, rows: DataFrame, values: Mapping[str, Running]) -> DataFrame:
        """``rows`` (those placed, with further columns perhaps) and one column per running value.

        Null keys are a key, null orders come first, rows of equal key and order lie together in
        an arbitrary order. Values are null until something that is not null has been met.
        """
        keys = [ref(k) for k in self.keys]
        window = Window.partitionBy(PART, *keys).orderBy(*[ref(c) for c in self.order])
        frames = {
            ROWS: window.rowsBetween(Window.unboundedPreceding, 0),
            PEERS: window.rangeBetween(Window.unboundedPreceding, 0),
            BEFORE: window.rowsBetween(Window.unboundedPreceding, -1),
        }
        local = rows.select(
            "*", *[_over(v.kind, F.expr(v.value), frames[v.frame]).alias(f"_here {name}") for name, v in values.items()]
        )
        carried = self._carried(rows, values)
        same = (F.col(PART) == F.col("_part")) & self._equal_keys()
        # Fewer rows than there are partitions.
        met = local.join(F.broadcast(carried), same, "left")
        made = [
            _joined(v.kind, F.col(f"_earlier {name}"), F.col(f"_here {name}")).alias(name)
            for name, v in values.items()
        ]
        return met.select(*quoted_all(rows.columns), *made)

    def _equal_keys(self) -> Column:
        same = F.lit(True)
        for i, key in enumerate(self.keys):
            same = same & ref(key).eqNullSafe(F.col(f"_key{i}"))
        return same

    def _carried(self, rows: DataFrame, values: Mapping[str, Running]) -> DataFrame:
        """(_part, _key0.., _earlier ..): what a key has gathered before each of its later partitions."""
        named = [ref(k).alias(f"_key{i}") for i, k in enumerate(self.keys)]
        totals = []
        last_place = F.struct(*[ref(c) for c in self.order])
        for i, v in enumerate(values.values()):
            if v.kind == "last":
                value = F.expr(v.value)
                held = F.max_by(value, F.when(value.isNotNull(), last_place))
            else:
                held = _AGGREGATES[v.kind](F.expr(v.value))
            totals.append(held.alias(f"_total{i}"))
        parts = rows.groupBy(F.col(PART).alias("_part"), *named).agg(*totals)
        own = [f"_key{i}" for i in range(len(self.keys))]
        by_part = Window.partitionBy(*own).orderBy("_part")
        before = by_part.rowsBetween(Window.unboundedPreceding, -1)
        earlier = [
            _over(v.kind, F.col(f"_total{i}"), before).alias(f"_earlier {name}")
            for i, (name, v) in enumerate(values.items())
        ]
        ranked = parts.select("_part", *own, *earlier, F.row_number().over(by_part).alias("_nth"))
        return ranked.where("_nth > 1").drop("_nth")


def place(rows: DataFrame, keys: Sequence[str], order: Sequence[str], partitions: int | None = None) -> Placed:
    """Write ``rows`` by range of (keys, order). Ordering columns must be comparable.

    ``partitions`` is by default the session's number of shuffle partitions. Rows of equal key and
    order are never parted.
    """
    spark = rows.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [ref(c) for c in (*keys, *order)]
    ranged = rows.repartitionByRange(n, *by).withColumn(PART, F.spark_partition_id())
    return Placed(durable(ranged, "placed"), list(keys), list(order))


def segmented_scan(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Mapping[str, Running],
    partitions: int | None = None,
) -> DataFrame:
    """``rows`` with running values along each key's rows (see ``Running``)."""
    placed = place(rows, keys, order, partitions)
    return placed.running(placed.rows, values).drop(PART)
