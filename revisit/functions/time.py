"""Time arithmetic that gives the same answer in every session time zone.

Event times are ``TIMESTAMP_NTZ``. Differences of two such values are plain day-time
intervals, so nothing here depends on daylight saving or ``spark.sql.session.timeZone``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY = "DAY"
_FIRST_MONDAY = "DATE'1970-01-05'"
_FIRST_SUNDAY = "DATE'1970-01-11'"


def floor_days(later: Column, earlier: Column) -> Column:
    """Whole 24-hour periods from ``earlier`` to ``later``, rounded down (also below zero)."""
    gap = later - earlier
    whole = F.extract(F.lit(_DAY), gap)
    return (
        F.when(F.make_dt_interval(whole) > gap, whole - 1).otherwise(whole).cast("bigint")
    )


def elapsed_days(later: Column, earlier: Column) -> Column:
    """``floor_days`` for pairs known to be in order: one expression, no branch."""
    return F.extract(F.lit(_DAY), later - earlier).cast("bigint")


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 00:00 on the clock of ``ts``."""
    seconds = (ts - F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")).cast("interval second")
    return (seconds.cast("decimal(20,6)") * 1000000).cast("bigint")


def week_index(ts: Column) -> Column:
    """Number of the Monday-to-Sunday week that holds ``ts``."""
    return F.floor(F.datediff(ts.cast("date"), F.expr(_FIRST_MONDAY)) / 7).cast("bigint")


def week_end(week: Column) -> Column:
    """Sunday that closes the week with this index."""
    return F.date_add(F.expr(_FIRST_SUNDAY), (week * 7).cast("int"))


def days(count: int) -> Column:
    return F.expr(f"INTERVAL '{int(count)}' DAY")


def years_since(as_of: Column, since: Column) -> Column:
    """Whole days over 365."""
    return floor_days(as_of, since) / F.lit(365.0)


def age_years(as_of: Column, birth: Column) -> Column:
    """Age; a birth date after ``as_of`` is a two-digit year read a century late."""
    age = years_since(as_of, birth)
    return F.when(age < 0, age + 100).otherwise(age)

