"""Time expressions. All interval logic runs on integer epoch microseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

US_PER_HOUR = 3_600_000_000
FAR_HOURS = 1e9  # a missing time counts as infinitely far away (R5)


def epoch_us(col: Column | str) -> Column:
    """Wall-clock epoch microseconds of a timestamp, independent of the session zone.

    ``timestamp_ntz`` input is read as-is; a zoned ``timestamp`` is first viewed as
    session-local wall clock. Differences of two such values are exact integers.
    """
    c = F.col(col) if isinstance(col, str) else col
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c.cast("timestamp_ntz"))


def normalize_time(text: Column | str) -> Column:
    """B12: 'yyyy-MM-dd HH:mm:ss' or a bare date (midnight) -> epoch micros; else NULL."""
    c = F.col(text) if isinstance(text, str) else text
    parsed = F.coalesce(
        F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss")),
        F.try_to_timestamp(c, F.lit("yyyy-MM-dd")),
    )
    ok = c.rlike(r"^\d{4}-\d{2}-\d{2}( \d{2}:\d{2}:\d{2})?$")
    return F.when(ok, epoch_us(parsed))


def normalize_visit(text: Column | str) -> Column:
    """B13: '22841357.0' -> 22841357 (bigint); 'nan'/'None'/'' / unparsable -> NULL."""
    c = F.col(text) if isinstance(text, str) else text
    d = c.try_cast("double")
    return F.when(d.isNotNull() & ~F.isnan(d), d.cast("bigint"))


def hours_between(a_us: Column | str, b_us: Column | str, far: float = FAR_HOURS) -> Column:
    """Signed hours from a to b; a missing side gives ``far`` (1e9)."""
    a = F.col(a_us) if isinstance(a_us, str) else a_us
    b = F.col(b_us) if isinstance(b_us, str) else b_us
    return F.coalesce((b - a) / F.lit(float(US_PER_HOUR)), F.lit(far))


def hours_lt(a_us: Column, b_us: Column, hours: float) -> Column:
    """(b - a) < hours, exactly, on integer micros; NULL side -> False."""
    return F.coalesce((b_us - a_us) < F.lit(int(hours * US_PER_HOUR)), F.lit(False))


def is_before(a_us: Column, b_us: Column) -> Column:
    """Strict a < b."""
    return a_us < b_us


def midnight_us(us: Column) -> Column:
    day = F.lit(86_400_000_000)
    return F.floor(us / day) * day
