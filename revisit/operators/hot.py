"""Keys too heavy for one task.

A window partitioned by an entity puts the whole history of that entity into one task. That
is the cheapest plan for ordinary entities (one shuffle), but not for a key that holds a large
share of all rows. Operators therefore take two roads and union the results:

* ordinary keys go through plain windows;
* hot keys, found by an exact count, have their rows cut into balanced chunks. Windows run
  inside a chunk, and a small table with one row per (key, chunk) carries totals across.

Both roads are exact; the choice only moves work around.

Bounds. At most ``max_keys`` keys are hot: the heaviest ones above ``min_rows``. Any key left
out then has fewer than ``total / max_keys`` rows, because ``max_keys`` others are at least as
heavy. So the key list (driver, broadcast) and the chunk bounds (``max_keys * chunks`` values)
do not grow with the data.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revisit.functions.columns import quoted_all, ref


@dataclass(frozen=True)
class HotPolicy:
    """When a key is hot, and how finely its rows are cut. ``chunks`` is a power of two.

    The other fields are set inside a split. ``decided`` tells whether all rows are of ordinary
    keys or of hot ones, ``hot_keys`` which keys those are. ``source`` holds the hot rows as they
    were when the split began: operators in a chain compute from it and join to the rows they
    are given, so a chain of n operators reads the hot rows n times and not 2^n times.
    """

    min_rows: int = 4_000_000
    max_keys: int = 4096
    chunks: int = 1024
    decided: str | None = None
    hot_keys: DataFrame | None = field(default=None, compare=False, repr=False)
    source: DataFrame | None = field(default=None, compare=False, repr=False)

    def __post_init__(self) -> None:
        if self.chunks < 2 or self.chunks & (self.chunks - 1):
            raise ValueError("chunks must be a power of two, at least 2")

    def for_other_keys(self) -> HotPolicy:
        """The same policy for rows grouped by something else."""
        return replace(self, decided=None, hot_keys=None, source=None)

    def base(self, rows: DataFrame, columns: Sequence[str]) -> DataFrame:
        """The named columns of the split's source, or of ``rows`` outside a split."""
        return (rows if self.source is None else self.source).select(quoted_all(columns))


ORDINARY, HOT = "ordinary", "hot"
DEFAULT_POLICY = HotPolicy()
_BROADCAST_CELLS = 4_000_000


def find_hot(rows: DataFrame, keys: Sequence[str], policy: HotPolicy = DEFAULT_POLICY):
    """The hot keys of ``rows`` as a local DataFrame of at most ``max_keys`` rows, or None.

    One job: a count per key with map-side combine that reads only the key columns.
    """
    keys = list(keys)
    heavy = (
        rows.groupBy([ref(k) for k in keys])
        .agg(F.count(F.lit(1)).alias("_rows"))
        .where((F.col("_rows") > policy.min_rows) & _all_set(keys))
        .orderBy(F.col("_rows").desc())
        .limit(policy.max_keys)
        .select([ref(k) for k in keys])
    )
    found = heavy.collect()
    if not found:
        return None
    return rows.sparkSession.createDataFrame(found, schema=heavy.schema)


def by_heat(
    rows: DataFrame,
    keys: Sequence[str],
    ordinary: Callable[[DataFrame], DataFrame],
    heavy: Callable[[DataFrame, HotPolicy], DataFrame],
    policy: HotPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """``ordinary`` over the rows of ordinary keys, ``heavy`` over those of hot keys."""

    def work(part: DataFrame, known: HotPolicy) -> DataFrame:
        return heavy(part, known) if known.decided == HOT else ordinary(part)

    return split_by_heat(rows, keys, work, policy)


def split_by_heat(
    rows: DataFrame,
    keys: Sequence[str],
    work: Callable[[DataFrame, HotPolicy], DataFrame],
    policy: HotPolicy = DEFAULT_POLICY,
    narrow: DataFrame | None = None,
) -> DataFrame:
    """Split once, then run ``work(part, policy)`` on each part and union the results.

    Operators called with the policy they are given here do not look for hot keys again, so a
    chain of them shares one shuffle. ``narrow`` may give the same rows before costly joins;
    keys are counted there.
    """
    if policy.decided:
        return work(rows, policy)
    narrow = rows if narrow is None else narrow
    hot = find_hot(narrow, keys, policy)
    if hot is None:
        return work(rows, replace(policy, decided=ORDINARY))
    few = F.broadcast(hot)  # at most max_keys rows
    cold_rows = rows.join(few, list(keys), "left_anti").select(quoted_all(rows.columns))
    hot_rows = rows.join(few, list(keys), "left_semi").select(quoted_all(rows.columns))
    source = narrow.join(few, list(keys), "left_semi")
    return work(cold_rows, replace(policy, decided=ORDINARY)).unionByName(
        work(hot_rows, replace(policy, decided=HOT, hot_keys=hot, source=source))
    )


def join_per_key(
    rows: DataFrame,
    per_key: DataFrame,
    key: str,
    policy: HotPolicy = DEFAULT_POLICY,
    cells: int = 1,
) -> DataFrame:
    """Left join with a table that has one row per key.

    For hot keys only their few rows of ``per_key`` are needed: those are broadcast, so hot rows
    do not move. ``cells`` is the width of such a row; wide ones over the limit are left to a
    sort-merge join, whose skewed partitions adaptive execution splits.
    """

    def work(part: DataFrame, known: HotPolicy) -> DataFrame:
        other = per_key
        if known.decided == HOT and known.hot_keys is not None:
            other = per_key.join(F.broadcast(known.hot_keys), key, "left_semi")
            if known.max_keys * cells <= _BROADCAST_CELLS:
                other = F.broadcast(other)
        return part.join(other, key, "left")

    return split_by_heat(rows, [key], work, policy)


def into_chunks(
    rows: DataFrame,
    bounds: DataFrame,
    keys: Sequence[str],
    at: str,
    policy: HotPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Add ``_chunk``: how many bounds of the key are at or below ``at``.

    Equal values share a chunk, and chunks follow the order of ``at``.
    """
    steps = []
    step = policy.chunks // 2
    while step:
        steps.append(F.lit(step))
        step //= 2
    where = F.aggregate(
        F.array(*steps),
        F.lit(0),
        lambda seen, jump: F.when(
            F.get(F.col("_bounds"), seen + jump - 1) <= ref(at), seen + jump
        ).otherwise(seen),
    )
    placed = rows.join(F.broadcast(bounds), list(keys))  # max_keys * chunks values
    return placed.withColumn("_chunk", where).drop("_bounds")


def chunk_bounds(
    points: DataFrame, keys: Sequence[str], at: str, policy: HotPolicy = DEFAULT_POLICY
) -> DataFrame:
    """Quantiles of ``at`` per key. Approximate: they steer balance, never results."""
    grid = [i / policy.chunks for i in range(1, policy.chunks)]
    return points.groupBy([ref(k) for k in keys]).agg(
        F.percentile_approx(ref(at), grid, 10 * policy.chunks).alias("_bounds")
    )


def sums_before(
    points: DataFrame,
    keys: Sequence[str],
    at: str,
    sums: Sequence[str],
    policy: HotPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """For each point, the sum of each column over the key's points with a smaller ``at``.

    ``points`` has one row per (key, at). New columns are named ``before_<column>``.
    """
    bounds = chunk_bounds(points, keys, at, policy)
    placed = into_chunks(points, bounds, keys, at, policy)
    inside = _chunk_window(keys).orderBy(ref(at)).rowsBetween(Window.unboundedPreceding, -1)
    return _carried(placed, keys, sums, inside).drop("_chunk")


def sums_at(
    points: DataFrame,
    probes: DataFrame,
    keys: Sequence[str],
    at: str,
    probe_at: str,
    sums: Sequence[str],
    inclusive: bool,
    policy: HotPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """For each probe, the sum of each column over the key's points before ``probe_at``.

    With ``inclusive`` a point exactly at ``probe_at`` counts too. New columns are named
    ``until_<column>``. Points and probes meet in one shuffle by (key, chunk).
    """
    kept = probes.columns
    # Probes lie up to a whole window away from their points, so both are balanced together.
    places = points.select(*[ref(k) for k in keys], ref(at).alias("_at")).union(
        probes.select(*[ref(k) for k in keys], ref(probe_at).alias("_at"))
    )
    bounds = chunk_bounds(places, keys, "_at", policy)
    zero = [F.lit(0).cast("bigint").alias(s) for s in sums]
    point_rows = points.select(
        *[ref(k) for k in keys], ref(at).alias("_at"), F.lit(1).alias("_side"),
        *[ref(s).cast("bigint").alias(s) for s in sums],
    )
    probe_rows = probes.select(
        *[ref(k) for k in keys],
        ref(probe_at).alias("_at"),
        F.lit(2 if inclusive else 0).alias("_side"),
        *zero,
        F.struct(*[ref(c) for c in kept]).alias("_probe"),
    )
    both = point_rows.unionByName(probe_rows, allowMissingColumns=True)
    placed = into_chunks(both, bounds, keys, "_at", policy)
    inside = (
        _chunk_window(keys)
        .orderBy("_at", "_side")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = _carried(placed, keys, sums, inside)
    return carried.where(F.col("_probe").isNotNull()).select(
        F.col("_probe.*"), *[ref("before_" + s).alias("until_" + s) for s in sums]
    )


def _carried(placed: DataFrame, keys: Sequence[str], sums: Sequence[str], inside) -> DataFrame:
    local = placed.select(
        "*", *[F.coalesce(F.sum(ref(s)).over(inside), F.lit(0)).alias("_in_" + s) for s in sums]
    )
    totals = placed.groupBy(*[ref(k) for k in keys], "_chunk").agg(
        *[F.sum(ref(s)).alias("_sum_" + s) for s in sums]
    )
    earlier = carry_window(keys).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *[ref(k) for k in keys],
        "_chunk",
        *[
            F.coalesce(F.sum(ref("_sum_" + s)).over(earlier), F.lit(0)).alias("_to_" + s)
            for s in sums
        ],
    )
    joined = local.join(carry, [*keys, "_chunk"])
    return joined.select(
        *quoted_all(placed.columns),
        *[(ref("_in_" + s) + ref("_to_" + s)).cast("bigint").alias("before_" + s) for s in sums],
    )


def _chunk_window(keys: Sequence[str]):
    return Window.partitionBy(*[ref(k) for k in keys], F.col("_chunk"))


def carry_window(keys: Sequence[str]):
    """Over the table of chunk totals: at most ``chunks`` rows per key."""
    return Window.partitionBy(*[ref(k) for k in keys]).orderBy("_chunk")


def chunk_window(keys: Sequence[str], at: str):
    return _chunk_window(keys).orderBy(ref(at))


def _all_set(keys: Sequence[str]) -> Column:
    condition = F.lit(True)
    for k in keys:
        condition = condition & ref(k).isNotNull()
    return condition
