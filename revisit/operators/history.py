"""Current and ever-seen flags of category columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revisit.functions.columns import columns_like, named, quoted, quoted_all, ref
from revisit.operators.hot import DEFAULT_POLICY, ORDINARY, HotPolicy, by_heat, join_per_key
from revisit.operators.pivot import WIDE
from revisit.operators.scan import Running, segmented_scan
from revisit.operators.timeline import valid_events
from revisit.schema import EventColumns


def first_seen(events: DataFrame, cols: EventColumns, columns: Sequence[str]) -> DataFrame:
    """One row per entity: an array with, per column, the first (time, id) where it is positive.

    Only positive cells become rows, and they are reduced before the shuffle, so neither a wide
    vocabulary nor a long history is sorted or collected.
    """
    cells = ", ".join(f"IF({quoted(c)} > 0, {i}, NULL)" for i, c in enumerate(columns))
    places = F.expr(f"array_compact(array({cells}))")
    seen = events.where(ref(cols.entity).isNotNull()).select(
        ref(cols.entity),
        F.struct(ref(cols.ts).alias("ts"), ref(cols.event_id).alias("id")).alias("_moment"),
        F.explode(places).alias("_place"),
    )
    firsts = seen.groupBy(ref(cols.entity), "_place").agg(F.min("_moment").alias("_moment"))
    per_entity = firsts.groupBy(ref(cols.entity)).agg(
        F.map_from_entries(F.collect_list(F.struct("_place", "_moment"))).alias("_map")
    )
    slots = ", ".join(f"try_element_at(_map, {i})" for i in range(len(columns)))
    return per_entity.select(ref(cols.entity), F.expr(f"array({slots})").alias("_firsts"))


def split_current_ever(
    events: DataFrame,
    cols: EventColumns,
    classes: Sequence[str],
    policy: HotPolicy = DEFAULT_POLICY,
    seen: DataFrame | None = None,
) -> DataFrame:
    """Replace each count column of the classes by ``<column>_current`` and ``<column>_ever``.

    Current is the count on this event (null if absent). Ever is true from the entity's first
    event with a positive count on, in (time, id) order. A class picks columns by substring.
    ``seen`` may give the same count columns before later joins; first sightings are read there.
    Rows without entity or time have seen nothing.
    """
    picked = columns_like(events.columns, classes)
    if not picked:
        return events
    others = quoted_all(c for c in events.columns if c not in set(picked))
    current = [named(quoted(c), c + "_current") for c in picked]
    order = f"PARTITION BY {quoted(cols.entity)} ORDER BY {quoted(cols.ts)}, {quoted(cols.event_id)}"
    # Rows of equal time and id see each other, as in the comparison with the first sight.
    running = f"OVER ({order} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

    def by_windows(part: DataFrame) -> DataFrame:
        ever = [
            named(f"max(coalesce({quoted(c)} > 0, FALSE)) {running}", c + "_ever") for c in picked
        ]
        return part.selectExpr(*others, *current, *ever)

    def by_first_sight(part: DataFrame, known: HotPolicy) -> DataFrame:
        firsts = first_seen(part if seen is None else seen, cols, picked)
        joined = join_per_key(part, firsts, cols.entity, known, cells=len(picked))
        moment = f"struct({quoted(cols.ts)} AS ts, {quoted(cols.event_id)} AS id)"
        ever = [
            named(f"coalesce(get(_firsts, {i}) <= {moment}, FALSE)", c + "_ever")
            for i, c in enumerate(picked)
        ]
        return joined.selectExpr(*others, *current, *ever)

    def ordinary(part: DataFrame) -> DataFrame:
        # Few columns: running windows in the order the rows already have. Many: one pass over
        # the positive cells instead of a window per column.
        if len(picked) <= WIDE:
            return by_windows(part)
        return by_first_sight(part, replace(policy, decided=ORDINARY))

    if policy.decided:
        return by_heat(events, [cols.entity], ordinary, by_first_sight, policy)
    split = by_heat(valid_events(events, cols), [cols.entity], ordinary, by_first_sight, policy)
    rest = events.where(ref(cols.entity).isNull() | ref(cols.ts).isNull())
    never = [named("FALSE", c + "_ever") for c in picked]
    return split.unionByName(rest.selectExpr(*others, *current, *never))


def distinct_items_seen(
    events: DataFrame,
    cols: EventColumns,
    items: DataFrame,
    key: str,
    item: str,
    name: str = "items_seen",
) -> DataFrame:
    """Add how many distinct items the entity has had up to and including this event.

    The long form of ever-seen flags: ``items`` has rows (event id ``key``, ``item``), and no item
    becomes a column, so a vocabulary may be of any size. Each entity's items are reduced to their
    first sightings in (time, id) order; the sightings are added up along the history. Null items
    do not count; rows without entity or time have seen nothing.
    """
    valid = valid_events(events, cols)
    moment = F.struct(ref(cols.ts).alias("ts"), ref(cols.event_id).alias("id"))
    places = valid.select(ref(cols.entity).alias("_entity"), moment.alias("_moment"))
    held = items.where(ref(item).isNotNull()).select(ref(key).alias("_key"), ref(item).alias("_item"))
    sighted = places.join(held, F.col("_moment.id") == F.col("_key"))
    firsts = sighted.groupBy("_entity", "_item").agg(F.min("_moment").alias("_moment"))
    new = firsts.groupBy("_entity", "_moment").agg(F.count(F.lit(1)).alias("_new"))
    # One row per distinct event; rows of equal time and id share its sightings.
    apart = new.select(F.col("_entity").alias("_owner"), F.col("_moment").alias("_when"), "_new")
    met = (F.col("_entity") == F.col("_owner")) & F.col("_moment").eqNullSafe(F.col("_when"))
    distinct = places.distinct().join(apart, met, "left").select(
        "_entity", "_moment", F.coalesce("_new", F.lit(0)).alias("_new")
    )
    # Counted along the history in range partitions: one entity may hold any share of the rows.
    upto = segmented_scan(distinct, ["_entity"], ["_moment"], {"_seen": Running("sum", "_new")})
    same = (F.col("_entity") == ref(cols.entity)) & moment.eqNullSafe(F.col("_moment"))
    seen = valid.join(upto, same).select(*quoted_all(events.columns), F.col("_seen").alias(name))
    rest = events.where(ref(cols.entity).isNull() | ref(cols.ts).isNull())
    return seen.unionByName(rest.withColumn(name, F.lit(0).cast("bigint")))
