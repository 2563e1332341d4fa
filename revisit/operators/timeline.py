"""Per-entity event sequences: ordinals, gaps, bursts and windows in event time.

Ordinary entities: one shuffle by entity serves every column here. Hot entities
(see ``revisit.operators.hot``): events collapse to one *point* per (entity, time) with
map-side combine, points are cut into chunks, and results join back on (entity, time).

Events without an entity or a time belong to no history and are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revisit.functions import time as clock
from revisit.functions.columns import quoted_all, ref
from revisit.operators import hot
from revisit.operators.hot import DEFAULT_POLICY, HotPolicy, by_heat
from revisit.operators.ranks import average_rank
from revisit.schema import TARGET_PREFIX, TIME_PREFIX, EventColumns


def valid_events(events: DataFrame, cols: EventColumns) -> DataFrame:
    return events.where(ref(cols.entity).isNotNull() & ref(cols.ts).isNotNull())


# --------------------------------------------------------------------------- sequence features


def event_ordinal(
    events: DataFrame,
    cols: EventColumns,
    name: str = "ordinal",
    policy: HotPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Position of the event in its entity's history, ordered by time and then id.

    Rows of equal time and id share the first of their positions; null ids come last in their time.
    """

    def ordinary(part: DataFrame) -> DataFrame:
        return part.select("*", F.rank().over(_by_id(cols)).cast("bigint").alias(name))

    def heavy(part: DataFrame, policy: HotPolicy) -> DataFrame:
        places = _points(_base(part, cols, policy), cols, 1, policy)
        places = places.select(ref(cols.entity), ref(cols.ts), "_before", "_ids")
        ranked = average_rank(
            part, [cols.entity, cols.ts], cols.event_id, "_place", ties="first",
            policy=policy.for_other_keys(),
        )
        place = F.coalesce(F.col("_place"), F.col("_ids") + 1)
        return ranked.join(places, [cols.entity, cols.ts]).select(
            *quoted_all(part.columns), (F.col("_before") + place).cast("bigint").alias(name)
        )

    return by_heat(valid_events(events, cols), [cols.entity], ordinary, heavy, policy)


def burst_features(
    events: DataFrame,
    cols: EventColumns,
    break_days: int = 28,
    start: Column | None = None,
    prefix: str = TIME_PREFIX,
    policy: HotPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Add the six sequence features.

    A burst ends when more than ``break_days`` whole days pass without an event. With ``start``,
    the referral number counts only events from that moment on and is null before it. The gap
    before a moment is reported on its events with the smallest id, null where all are.
    """

    def ordinary(part: DataFrame) -> DataFrame:
        return _burst_windows(part, cols, break_days, start, prefix)

    def heavy(part: DataFrame, policy: HotPolicy) -> DataFrame:
        return _burst_points(part, cols, break_days, start, prefix, policy)

    return by_heat(valid_events(events, cols), [cols.entity], ordinary, heavy, policy)


def _burst_windows(part, cols, break_days, start, prefix):
    ts = ref(cols.ts)
    by_id, by_ts = _by_id(cols), _by_ts(cols)
    whole = by_ts.rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = by_ts.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    from_start = F.lit(1) if start is None else F.when(ts >= start, 1).otherwise(0)
    # First select: what needs only the raw rows. Second: what builds on the gap flag.
    gaps = part.select(
        "*",
        F.coalesce(clock.elapsed_days(ts, F.lag(ts).over(by_id)), F.lit(0)).alias("_gap"),
        F.count(F.lit(1)).over(by_ts.rangeBetween(0, 0)).alias("_n"),
        F.min(ref(cols.event_id)).over(by_ts.rangeBetween(0, 0)).alias("_first_id"),
        F.count(F.lit(1)).over(whole).alias("_total"),
        F.rank().over(by_ts).alias("_rank"),
        F.sum(from_start).over(upto).alias("_counted"),
    )
    # The first row of a moment has the gap before it, the moment's other rows have zero.
    here = F.max("_gap").over(by_ts.rangeBetween(0, 0))
    reported = F.when(ref(cols.event_id).eqNullSafe(F.col("_first_id")), here).otherwise(0)
    cut = F.col("_gap") > break_days
    running = by_id.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = F.coalesce(F.max(F.when(cut, F.col("_rank") - 1)).over(running), F.lit(0))
    tie_mean = (F.col("_n") + 1) / F.lit(2.0)
    number = F.col("_counted") - F.col("_n") + tie_mean
    return gaps.select(
        *quoted_all(part.columns),
        (number if start is None else F.when(ts >= start, number)).alias(prefix + "referralnumber"),
        reported.alias(prefix + "dayssincelastreferral"),
        (reported > break_days).alias(prefix + "startofburst"),
        (F.sum(cut.cast("bigint")).over(running) + 1).alias(prefix + "burstnumber"),
        (F.col("_rank") - 1 - base + tie_mean).alias(prefix + "indexinburst"),
        F.col("_total").alias(prefix + "totalreferralsforclient"),
    )


def _burst_points(part, cols, break_days, start, prefix, policy):
    places = _points(_base(part, cols, policy), cols, break_days, policy, start)
    first = ref(cols.event_id).eqNullSafe(F.col("_first_id"))
    tie_mean = (F.col("_n") + 1) / F.lit(2.0)
    number = F.col("_before") - F.col("_uncounted") + tie_mean
    gap = F.coalesce(clock.elapsed_days(ref(cols.ts), F.col("_prev")), F.lit(0))
    gap = F.when(first, gap).otherwise(0)
    return part.join(places, [cols.entity, cols.ts]).select(
        *quoted_all(part.columns),
        (number if start is None else F.when(ref(cols.ts) >= start, number)).alias(
            prefix + "referralnumber"
        ),
        gap.alias(prefix + "dayssincelastreferral"),
        (gap > break_days).alias(prefix + "startofburst"),
        (F.col("_cuts") + 1).alias(prefix + "burstnumber"),
        (F.col("_before") - F.col("_burst_base") + tie_mean).alias(prefix + "indexinburst"),
        F.col("_total").alias(prefix + "totalreferralsforclient"),
    )


# ------------------------------------------------------------------------- windows ahead and back


def look_ahead(
    events: DataFrame,
    cols: EventColumns,
    window: int = 365,
    break_days: int = 28,
    break_coefficient: float = 1.0,
    prefix: str = TARGET_PREFIX,
    policy: HotPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Add the label: later events within ``window`` whole days, gaps among them, and the score.

    score = (events - gaps * coefficient) / (window / 7). The event itself does not count; other
    events at the same moment do.
    """
    counted = _count_ahead(events, cols, window, break_days, policy)
    return counted.select(
        *quoted_all(events.columns),
        F.col("_events").alias(prefix + "futurereferralcount"),
        _score(F.col("_events"), F.col("_gaps"), window, break_coefficient).alias(
            prefix + "futurereferralscore"
        ),
        F.col("_gaps").alias(prefix + "futurereferralgaps"),
    )


def _count_ahead(events, cols, window, break_days, policy):
    def ordinary(part: DataFrame) -> DataFrame:
        ts = ref(cols.ts)
        flagged = part.select(
            "*",
            F.coalesce(
                (clock.elapsed_days(ts, F.lag(ts).over(_by_id(cols))) > break_days).cast("int"),
                F.lit(0),
            ).alias("_cut"),
        )
        placed = flagged.select(
            "*",
            F.rank().over(_by_ts(cols)).alias("_rank"),
            F.sum("_cut").over(_so_far(cols)).alias("_cuts"),
        )
        end = ts + clock.days(window + 1)
        return _until(placed, cols, end, {"_n": "1", "_cut": "_cut"}, False).select(
            *quoted_all(part.columns),
            (F.col("until__n") - F.col("_rank")).alias("_events"),
            (F.col("until__cut") - F.col("_cuts")).alias("_gaps"),
        )

    def heavy(part: DataFrame, policy: HotPolicy) -> DataFrame:
        places = _points(_base(part, cols, policy), cols, break_days, policy)
        probes = places.withColumn("_end", ref(cols.ts) + clock.days(window + 1))
        reached = hot.sums_at(
            places, probes, [cols.entity], cols.ts, "_end", ["_n", "_cut"], False, policy
        )
        result = reached.select(
            ref(cols.entity),
            ref(cols.ts),
            (F.col("until__n") - F.col("_before") - 1).alias("_events"),
            (F.col("until__cut") - F.col("_cuts")).alias("_gaps"),
        )
        return part.join(result, [cols.entity, cols.ts]).select(
            *quoted_all(part.columns), "_events", "_gaps"
        )

    return by_heat(valid_events(events, cols), [cols.entity], ordinary, heavy, policy)


def look_back(
    events: DataFrame,
    cols: EventColumns,
    window: int = 365,
    break_days: int = 28,
    break_coefficient: float = 1.0,
    prefix: str = "historical_",
    policy: HotPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Add the historical score: the same formula over the last ``window`` days, times 100.

    The event itself counts, so a first event has a positive score. Gaps lie between two events
    of the frame; silence before the frame's first event is not one.
    """

    def ordinary(part: DataFrame) -> DataFrame:
        ts = ref(cols.ts)
        before = clock.elapsed_days(ts, F.lag(ts).over(_by_id(cols))) > break_days
        after = clock.elapsed_days(F.lead(ts).over(_by_id(cols)), ts) > break_days
        flagged = part.select(
            "*",
            F.coalesce(before.cast("int"), F.lit(0)).alias("_cut"),
            F.coalesce(after.cast("int"), F.lit(0)).alias("_cut_next"),
        )
        placed = flagged.select(
            "*",
            F.count(F.lit(1)).over(_so_far(cols)).alias("_seen"),
            F.sum("_cut").over(_so_far(cols)).alias("_cuts"),
        )
        begin = ts - clock.days(window + 1)
        sums = {"_n": "1", "_cut_next": "_cut_next"}
        return _until(placed, cols, begin, sums, True).select(
            *quoted_all(part.columns),
            (F.col("_seen") - F.col("until__n")).alias("_events"),
            (F.col("_cuts") - F.col("until__cut_next")).alias("_gaps"),
        )

    def heavy(part: DataFrame, policy: HotPolicy) -> DataFrame:
        places = _points(_base(part, cols, policy), cols, break_days, policy)
        probes = places.withColumn("_begin", ref(cols.ts) - clock.days(window + 1))
        reached = hot.sums_at(
            places, probes, [cols.entity], cols.ts, "_begin", ["_n", "_cut_next"], True, policy
        )
        result = reached.select(
            ref(cols.entity),
            ref(cols.ts),
            (F.col("_before") + F.col("_n") - F.col("until__n")).alias("_events"),
            # Cuts up to here sit on the later event; moved to the earlier one they are the
            # cuts of all points before this one.
            (F.col("_cuts") - F.col("until__cut_next")).alias("_gaps"),
        )
        return part.join(result, [cols.entity, cols.ts]).select(
            *quoted_all(part.columns), "_events", "_gaps"
        )

    counted = by_heat(valid_events(events, cols), [cols.entity], ordinary, heavy, policy)
    score = _score(F.col("_events"), F.col("_gaps"), window, break_coefficient) * 100
    return counted.select(
        *quoted_all(events.columns),
        F.col("_events").alias(prefix + "count"),
        F.col("_gaps").alias(prefix + "gaps"),
        score.alias(prefix + "score"),
    )


def events_in_last_months(
    events: DataFrame,
    cols: EventColumns,
    months: int = 6,
    name: str = "recent_events",
    policy: HotPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Add the number of the entity's events in the last ``months`` months, this one included."""

    def ordinary(part: DataFrame) -> DataFrame:
        placed = part.select("*", F.count(F.lit(1)).over(_so_far(cols)).alias("_seen"))
        begin = ref(cols.ts) - F.expr(f"INTERVAL '{int(months)}' MONTH")
        return _until(placed, cols, begin, {"_n": "1"}, False).select(
            *quoted_all(part.columns), (F.col("_seen") - F.col("until__n")).alias(name)
        )

    def heavy(part: DataFrame, policy: HotPolicy) -> DataFrame:
        places = _points(_base(part, cols, policy), cols, 1, policy)
        begin = ref(cols.ts) - F.expr(f"INTERVAL '{int(months)}' MONTH")
        reached = hot.sums_at(
            places, places.withColumn("_begin", begin), [cols.entity], cols.ts, "_begin", ["_n"],
            False, policy,
        )
        result = reached.select(
            ref(cols.entity),
            ref(cols.ts),
            (F.col("_before") + F.col("_n") - F.col("until__n")).alias(name),
        )
        return part.join(result, [cols.entity, cols.ts]).select(
            *quoted_all(part.columns), ref(name)
        )

    return by_heat(valid_events(events, cols), [cols.entity], ordinary, heavy, policy)


def _score(count: Column, gaps: Column, window: int, coefficient: float) -> Column:
    return (count - gaps * F.lit(float(coefficient))) / F.lit(window / 7)


# ---------------------------------------------------------------------------------- weekly counts


def weekly_counts(
    events: DataFrame,
    cols: EventColumns,
    windows: Sequence[int] = (1, 4, 12),
    prefix: str = "window_count_",
    strict_past: bool = False,
    policy: HotPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Add, for each n, the entity's events in this Monday-to-Sunday week and the n-1 before it.

    The current week counts whole, so events later in the same week are included. With
    ``strict_past`` only events at or before this one count. Rows without an entity get 0.
    """
    names = [f"{prefix}{n}" for n in windows]
    week = clock.week_index(ref(cols.ts))

    def ordinary(part: DataFrame) -> DataFrame:
        placed = part.withColumn("_week", week)
        by_week = Window.partitionBy(ref(cols.entity)).orderBy("_week")
        counts = [F.count(F.lit(1)).over(by_week.rangeBetween(1 - n, 0)) for n in windows]
        if strict_past:
            in_week = Window.partitionBy(ref(cols.entity), F.col("_week")).orderBy(ref(cols.ts))
            whole = in_week.rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            upto = in_week.rangeBetween(Window.unboundedPreceding, Window.currentRow)
            later = F.count(F.lit(1)).over(whole) - F.count(F.lit(1)).over(upto)
            counts = [c - later for c in counts]
        return placed.select(
            *quoted_all(part.columns), *[c.alias(n) for c, n in zip(counts, names)]
        )

    def heavy(part: DataFrame, policy: HotPolicy) -> DataFrame:
        per_week = weekly_totals(_base(part, cols, policy), cols)
        by_week = Window.partitionBy(ref(cols.entity)).orderBy("week")
        sums = per_week.select(
            ref(cols.entity),
            F.col("week").alias("_week"),
            *[
                F.sum("events").over(by_week.rangeBetween(1 - n, 0)).alias(name)
                for n, name in zip(windows, names)
            ],
        )
        joined = part.withColumn("_week", week).join(sums, [cols.entity, "_week"])
        if strict_past:
            # Events after this one in its week: week total up to its end minus the prefix.
            places = _points(_base(part, cols, policy), cols, 1, policy).select(
                ref(cols.entity), ref(cols.ts), (F.col("_before") + F.col("_n")).alias("_upto")
            )
            ends = per_week.select(
                ref(cols.entity),
                F.col("week").alias("_week"),
                F.sum("events")
                .over(by_week.rowsBetween(Window.unboundedPreceding, Window.currentRow))
                .alias("_week_upto"),
            )
            joined = joined.join(ends, [cols.entity, "_week"]).join(places, [cols.entity, cols.ts])
            later = F.col("_week_upto") - F.col("_upto")
        else:
            later = F.lit(0)
        return joined.select(
            *quoted_all(part.columns), *[(ref(n) - later).alias(n) for n in names]
        )

    if policy.decided:  # inside a split there are only valid events
        return by_heat(events, [cols.entity], ordinary, heavy, policy)
    counted = by_heat(valid_events(events, cols), [cols.entity], ordinary, heavy, policy)
    without = events.where(ref(cols.entity).isNull() | ref(cols.ts).isNull())
    zeros = without.select("*", *[F.lit(0).cast("bigint").alias(n) for n in names])
    return counted.unionByName(zeros)


def weekly_totals(events: DataFrame, cols: EventColumns) -> DataFrame:
    """Events per entity and week; weeks without events are absent."""
    week = clock.week_index(ref(cols.ts)).alias("week")
    return (
        valid_events(events, cols)
        .groupBy(ref(cols.entity), week)
        .agg(F.count(F.lit(1)).alias("events"))
    )


def dense_weekly_totals(events: DataFrame, cols: EventColumns) -> DataFrame:
    """Events per entity and week, with zeros between the entity's first and last week.

    Zeros are filled between neighbouring weeks, so no grid is joined.
    """
    by_week = Window.partitionBy(ref(cols.entity)).orderBy("week")
    totals = weekly_totals(events, cols).withColumn("_next", F.lead("week").over(by_week))
    last = F.coalesce(F.col("_next") - 1, F.col("week"))
    filled = totals.select(
        ref(cols.entity),
        F.col("week").alias("_week"),
        "events",
        F.explode(F.sequence("week", last)).alias("week"),
    )
    return filled.select(
        ref(cols.entity),
        clock.week_end(F.col("week")).alias("week_end"),
        F.when(F.col("week") == F.col("_week"), F.col("events")).otherwise(0).alias("events"),
    )


# ------------------------------------------------------------------------------------- internals


def _by_id(cols: EventColumns):
    by_id = ref(cols.event_id).asc_nulls_last()
    return Window.partitionBy(ref(cols.entity)).orderBy(ref(cols.ts), by_id)


def _by_ts(cols: EventColumns):
    return Window.partitionBy(ref(cols.entity)).orderBy(ref(cols.ts))


def _base(part: DataFrame, cols: EventColumns, policy: HotPolicy) -> DataFrame:
    return policy.base(part, [cols.event_id, cols.entity, cols.ts])


def _so_far(cols: EventColumns):
    return _by_ts(cols).rangeBetween(Window.unboundedPreceding, Window.currentRow)


def _until(part, cols, at: Column, sums: dict[str, str], inclusive: bool) -> DataFrame:
    """Add ``until_<name>``: the sum over the entity's events before ``at`` (or not after it).

    A frame with two moving ends is summed anew for every row, which is quadratic in the history.
    Here each event is followed by a probe placed at ``at``; one running sum over both answers
    all probes in a single sorted pass. Both rows stay in the entity's partition.
    """
    rows = part.select(
        ref(cols.entity).alias("_entity"),
        ref(cols.ts).alias("_ts"),
        at.alias("_end"),
        *[F.expr(e).cast("bigint").alias("_w" + n) for n, e in sums.items()],
        F.struct(*quoted_all(part.columns)).alias("_row"),
    )
    weights = [f"_w{n}" for n in sums]
    point = ", ".join(["1 AS _side", "_ts AS _at", *weights, "IF(FALSE, _row, NULL) AS _row"])
    side = 2 if inclusive else 0
    ask = ", ".join([f"{side} AS _side", "_end AS _at", *[f"0L AS {w}" for w in weights], "_row"])
    both = rows.selectExpr("_entity", f"inline(array(struct({point}), struct({ask})))")
    running = (
        Window.partitionBy("_entity")
        .orderBy("_at", "_side")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    answered = both.select(
        "*", *[F.sum("_w" + n).over(running).alias("until_" + n) for n in sums]
    ).where(F.col("_side") == side)
    # The entity is not read from the struct: Spark then still knows how rows are partitioned.
    return answered.select(
        *[
            (F.col("_entity") if c == cols.entity else F.col("_row").getField(c)).alias(c)
            for c in part.columns
        ],
        *["until_" + n for n in sums],
    )


def _points(events, cols, break_days, policy, start: Column | None = None) -> DataFrame:
    """One row per (entity, time) with everything the sequence says about that moment.

    ``_n`` events here, ``_first_id`` smallest id, ``_ids`` events with an id, ``_before`` events
    earlier, ``_prev`` and ``_next`` neighbouring times, ``_cut`` / ``_cut_next`` gap over ``break_days`` before / after,
    ``_cuts`` gaps so far, ``_burst_base`` events before the current burst, ``_total`` events of
    the entity, ``_uncounted`` events of the entity before ``start``.
    """
    keys, at = [cols.entity], cols.ts
    early = F.lit(0) if start is None else F.when(ref(at) < start, F.lit(1)).otherwise(0)
    points = events.groupBy(ref(cols.entity), ref(at)).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min(ref(cols.event_id)).alias("_first_id"),
        F.count(ref(cols.event_id)).alias("_ids"),
        F.sum(early).alias("_early"),
    )
    bounds = hot.chunk_bounds(points, keys, at, policy)
    placed = hot.into_chunks(points, bounds, keys, at, policy)
    inside = hot.chunk_window(keys, at)
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = placed.select(
        "*",
        F.lag(ref(at)).over(inside).alias("_lag"),
        F.lead(ref(at)).over(inside).alias("_lead"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_in"),
    )
    inner_cut = _over(ref(at), F.col("_lag"), break_days)
    local = local.withColumn("_inner", inner_cut)
    cut_base = F.when(F.col("_inner") == 1, F.col("_in"))
    local = local.select(
        "*",
        F.sum("_inner").over(running).alias("_inner_cuts"),
        F.max(cut_base).over(running).alias("_inner_base"),
    )
    chunk = local.groupBy(*[ref(k) for k in keys], "_chunk").agg(
        F.min(ref(at)).alias("_first"),
        F.max(ref(at)).alias("_last"),
        F.sum("_n").alias("_size"),
        F.sum("_early").alias("_early_size"),
        F.sum("_inner").alias("_chunk_cuts"),
        F.max("_inner_base").alias("_chunk_base"),
    )
    order = hot.carry_window(keys)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    all_chunks = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    chunk = chunk.select(
        "*",
        F.lag("_last").over(order).alias("_prev_last"),
        F.lead("_first").over(order).alias("_next_first"),
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_base"),
        F.sum("_size").over(all_chunks).alias("_total"),
        F.sum("_early_size").over(all_chunks).alias("_uncounted"),
    ).withColumn("_first_cut", _over(F.col("_first"), F.col("_prev_last"), break_days))
    start_base = F.when(F.col("_first_cut") == 1, F.col("_base"))
    latest = F.coalesce(F.col("_base") + F.col("_chunk_base"), start_base)
    carry = chunk.select(
        *[ref(k) for k in keys],
        "_chunk",
        "_prev_last",
        "_next_first",
        "_base",
        "_total",
        "_uncounted",
        "_first_cut",
        start_base.alias("_start_base"),
        F.coalesce(
            F.sum(F.col("_chunk_cuts") + F.col("_first_cut")).over(earlier), F.lit(0)
        ).alias("_cuts_before"),
        F.max(latest).over(earlier).alias("_base_before"),
    )
    joined = local.join(carry, [*keys, "_chunk"])
    previous = F.coalesce(F.col("_lag"), F.col("_prev_last"))
    following = F.coalesce(F.col("_lead"), F.col("_next_first"))
    return joined.select(
        *[ref(k) for k in keys],
        ref(at),
        "_n",
        "_first_id",
        "_ids",
        "_total",
        "_uncounted",
        previous.alias("_prev"),
        following.alias("_next"),
        (F.col("_base") + F.col("_in")).alias("_before"),
        _over(ref(at), previous, break_days).alias("_cut"),
        _over(following, ref(at), break_days).alias("_cut_next"),
        (F.col("_cuts_before") + F.col("_first_cut") + F.col("_inner_cuts")).alias("_cuts"),
        F.coalesce(
            F.col("_base") + F.col("_inner_base"),
            F.col("_start_base"),
            F.col("_base_before"),
            F.lit(0),
        ).alias("_burst_base"),
    )


def _over(later: Column, earlier: Column, break_days: int) -> Column:
    gap = F.coalesce(clock.elapsed_days(later, earlier) > break_days, F.lit(False))
    return gap.cast("bigint")
