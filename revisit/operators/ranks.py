"""Average-tie ranks and exact order statistics, neither through a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revisit.functions.columns import quoted_all, ref
from revisit.functions.time import epoch_micros
from revisit.operators.hot import DEFAULT_POLICY, HotPolicy, by_heat, sums_before


def average_rank(
    rows: DataFrame,
    group: Sequence[str],
    value: str,
    name: str,
    descending: bool = False,
    policy: HotPolicy = DEFAULT_POLICY,
    size: str | None = None,
    ties: str = "mean",
) -> DataFrame:
    """Add the rank of ``value`` in its group; equal values share the mean of their places.

    With ``ties`` "first" they share the first of them. Null values have a null rank and take no
    place. ``size`` names a column for the number of rows of the group. A null group is a group
    like any other, also where it is hot.
    """
    group = list(group)
    if group and not policy.decided:
        # As one struct, a null key compares equal to itself and can be found, joined and split.
        keyed = rows.withColumn("_group", F.struct(*[ref(g) for g in group]))
        made = _ranked(keyed, ["_group"], value, name, descending, policy, size, ties)
        return made.select(*quoted_all(rows.columns), ref(name), *([ref(size)] if size else []))
    return _ranked(rows, group, value, name, descending, policy, size, ties)


def _ranked(rows, group, value, name, descending, policy, size, ties) -> DataFrame:
    mean = {"mean": 1, "first": 0}[ties]

    def ordinary(part: DataFrame) -> DataFrame:
        order = ref(value).desc_nulls_last() if descending else ref(value).asc_nulls_last()
        by_value = Window.partitionBy(*[ref(g) for g in group]).orderBy(order)
        equal = F.count(F.lit(1)).over(by_value.rangeBetween(0, 0))
        place = F.rank().over(by_value) + mean * (equal - 1) / F.lit(2.0)
        whole = by_value.rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        sizes = [F.count(F.lit(1)).over(whole).alias(size)] if size else []
        return part.select("*", _where_set(value, place).alias(name), *sizes)

    def heavy(part: DataFrame, policy: HotPolicy) -> DataFrame:
        points = (
            part.where(ref(value).isNotNull())
            .groupBy(*[ref(g) for g in group], ref(value))
            .agg(F.count(F.lit(1)).alias("_ties"))
        )
        placed = sums_before(points, group, value, ["_ties"], policy)
        if descending:
            totals = points.groupBy([ref(g) for g in group]).agg(F.sum("_ties").alias("_total"))
            placed = placed.join(F.broadcast(totals), group)  # one row per hot group
            first = F.col("_total") - F.col("before__ties") - F.col("_ties")
        else:
            first = F.col("before__ties")
        places = placed.select(
            *[ref(g) for g in group],
            ref(value),
            (first + 1 + mean * (F.col("_ties") - 1) / F.lit(2.0)).alias(name),
        )
        joined = part.join(places, [*group, value], "left")
        if not size:
            return joined.select(*quoted_all(part.columns), ref(name))
        sizes = part.groupBy([ref(g) for g in group]).agg(F.count(F.lit(1)).alias(size))
        joined = joined.join(F.broadcast(sizes), group)  # one row per hot group
        return joined.select(*quoted_all(part.columns), ref(name), ref(size))

    return by_heat(rows, group, ordinary, heavy, policy)


def _where_set(value: str, result: Column) -> Column:
    return F.when(ref(value).isNotNull(), result)


_BUCKETS = 4096
_FEW = 10_000
_EPOCH = datetime(1970, 1, 1)


def order_statistic(rows: DataFrame, value: str, place: int):
    """Exact ``place``-th smallest non-null value (from 0), and how many rows are below it.

    ``value`` is an integer, a double or a ``TIMESTAMP_NTZ``. Doubles are ordered as Spark sorts
    them: -infinity, finite values (with -0.0 equal to 0.0), infinity, NaN. Each pass is one
    aggregation into at most 4096 buckets between the current bounds and narrows the bounds to
    the bucket that holds the place; the bounds are a filter the scan can use. Rows are never
    sorted or moved, except for the last few thousand distinct values.
    """
    current = rows.where(ref(value).isNotNull()).select(ref(value).alias("v"))
    below = 0
    if current.schema["v"].dataType in (T.DoubleType(), T.FloatType()):
        current = current.select(F.col("v").cast("double").alias("v"))
        v, infinite = F.col("v"), F.lit(float("inf"))
        finite = ~F.isnan(v) & (F.abs(v) != infinite)
        lowest, usual, highest, count = current.agg(
            F.count_if(v == -infinite), F.count_if(finite), F.count_if(v == infinite), F.count("v")
        ).first()
        _check_place(place, count)
        if place < lowest:
            return float("-inf"), 0
        if place >= lowest + usual:
            top = place < lowest + usual + highest
            return (float("inf"), lowest + usual) if top else (float("nan"), lowest + usual + highest)
        current, below = current.where(finite), lowest
    low, high, count = current.agg(F.min("v"), F.max("v"), F.count("v")).first()
    _check_place(place - below, count)
    while low != high and count > _FEW:
        current = current.where(F.col("v").between(_literal(low), _literal(high)))
        parts = (
            current.groupBy(_bucket(low, high).alias("b"))
            .agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("n"))
            .orderBy("b")
            .collect()  # at most 4096 rows
        )
        if len(parts) < 2:
            raise RuntimeError("the rows changed between passes")
        for part in parts:
            if place < below + part.n:
                break
            below += part.n
        low, high, count = part.lo, part.hi, part.n
    if low == high:
        return low, below
    last = current.where(F.col("v").between(_literal(low), _literal(high)))
    for part in last.groupBy("v").count().orderBy("v").collect():  # at most _FEW rows
        if place < below + part["count"]:
            return part["v"], below
        below += part["count"]
    raise RuntimeError("the rows changed between passes")


def _check_place(place: int, count: int) -> None:
    if not 0 <= place < count:
        raise ValueError(f"place {place} is outside 0..{count - 1}")


def _bucket(low, high) -> Column:
    """Bucket number, never falling as the value grows; the first for ``low``, the last for ``high``."""
    v = F.col("v")
    if isinstance(low, float):
        # Halves, since the range of doubles may be too wide for one; whole where they vanish.
        half = 0.5 if high / 2 - low / 2 >= 1e-300 else 1.0
        share = (v * half - F.lit(low * half)) / F.lit(high * half - low * half)
        return F.floor(share * F.lit(_BUCKETS - 1))
    if isinstance(low, datetime):
        v, low, high = epoch_micros(v), _micros(low), _micros(high)
    step = (high - low) // _BUCKETS + 1
    wide = v.cast("decimal(20,0)") if high - low >= 2**63 else v
    return F.call_function("div", wide - F.lit(low), F.lit(step))


def _micros(moment: datetime) -> int:
    return (moment - _EPOCH) // timedelta(microseconds=1)


def _literal(value) -> Column:
    if isinstance(value, datetime):
        return F.expr(f"TIMESTAMP_NTZ'{value.isoformat(sep=' ')}'")
    return F.lit(value)


def exact_quantile(rows: DataFrame, value: str, share: float) -> float | None:
    """Exact quantile with linear interpolation between neighbours; null without rows."""
    count = rows.where(ref(value).isNotNull()).count()
    if not count:
        return None
    position = share * (count - 1)
    place = int(position)
    low, _ = order_statistic(rows, value, place)
    part = position - place
    if not part:
        return float(low)
    # The next place holds the same value, or the smallest one above it.
    upto, above = rows.agg(
        F.count_if(ref(value) <= F.lit(low)), F.min(F.when(ref(value) > F.lit(low), ref(value)))
    ).first()
    high = low if upto > place + 1 else above
    if high == low:
        return float(low)  # also where both are infinite
    return float(low) + (float(high) - float(low)) * part
