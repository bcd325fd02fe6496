"""Synoptic hours, dates in odd layouts, and steps of ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from galerna.constants import SYNOPTIC_HOURS


MICROS = 1_000_000


def micros(t: Column) -> Column:
    """Microseconds since 1970, the precision of timestamps: nothing is cut off."""
    return F.unix_micros(t.cast("timestamp"))


def bucket(t: Column, seconds: int) -> Column:
    """Number of the bin of ``seconds`` in which a time falls, exactly."""
    at, width = micros(t), F.lit(seconds * MICROS)
    return ((at - F.pmod(at, width)) / width).cast("long")


def is_synoptic(t: Column, hours: tuple[int, ...] = SYNOPTIC_HOURS) -> Column:
    """On the hour (to the microsecond), at one of ``hours``."""
    return (t == F.date_trunc("hour", t)) & F.hour(t).isin(*hours)


def normalized_hour(value: Column) -> Column:
    """6 and 600 both mean 6; anything else is an error."""
    h = F.when(value < 100, value).when(value % 100 == 0, F.floor(value / 100))
    message = F.concat(F.lit("not an hour: "), value.cast("string"))
    return F.when(value.isNull(), F.lit(None)).when(h.between(0, 23), h.cast("int")).otherwise(F.raise_error(message).cast("int"))


def timestamp_of(year: Column, month: Column, day: Column, hour: Column) -> Column:
    """From parts; the hour may be H or HHMM with minutes of zero."""
    return F.make_timestamp(year, month, day, normalized_hour(hour), F.lit(0), F.lit(0))


def timestamp_of_compact(date: Column, hhmm: Column) -> Column:
    """From YYYYMMDD and H, HH or HHMM."""
    d = date.cast("string")
    hours = F.when(hhmm < 100, hhmm).otherwise(F.floor(hhmm / 100)).cast("int")
    minutes = F.when(hhmm < 100, 0).otherwise(hhmm % 100).cast("int")
    return F.make_timestamp(F.substring(d, 1, 4).cast("int"), F.substring(d, 5, 2).cast("int"), F.substring(d, 7, 2).cast("int"), hours, minutes, F.lit(0))


def to_utc(local: Column, offset_hours: float) -> Column:
    """Local time with a fixed offset (hours ahead of UTC) to UTC."""
    return F.timestamp_micros(micros(local) - F.lit(int(offset_hours * 3600 * MICROS)))


def nearest_hour(t: Column) -> Column:
    return F.date_trunc("hour", t + F.expr("interval 30 minutes"))


def window_end(label: Column, hours: int = 6, label_is: str = "start") -> Column:
    """End T of the window (T - hours, T] to which an hourly value belongs.

    ``start``: the label is the beginning of its hour; ``end``: the end of it.
    """
    if label_is not in ("start", "end"):
        raise ValueError(f"unknown label convention: {label_is}")
    at = micros(label) + F.lit((3600 if label_is == "start" else 0) * MICROS)
    # whole numbers of microseconds: a fraction of a second after a window's end belongs to the next window
    return F.timestamp_micros(at + F.pmod(-at, F.lit(hours * 3600 * MICROS)))


def season_window_ends(year: Column, hours: int = 6) -> Column:
    """All window ends of a season: 1 May 06 h to 1 December 00 h."""
    start = F.make_timestamp(year, F.lit(5), F.lit(1), F.lit(6), F.lit(0), F.lit(0))
    end = F.make_timestamp(year, F.lit(12), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return F.sequence(start, end, F.expr(f"interval {hours} hours"))


def ordered_dates(start: Column, end: Column) -> tuple[Column, Column, Column]:
    """(start, end, whether they were inverted): the end defaults to the start, and inverted dates are swapped."""
    end = F.coalesce(end, start)
    return F.least(start, end), F.greatest(start, end), F.coalesce(start > end, F.lit(False))


def six_hour_steps(start: Column, end: Column, days_before: int = 0, days_after: int = 0) -> Column:
    """Array of the 00, 06, 12 and 18 h steps of all days from ``start`` to ``end``."""
    first = F.date_trunc("day", start) - F.expr(f"interval {days_before} days")
    last = F.date_trunc("day", end) + F.expr(f"interval {days_after} days") + F.expr("interval 18 hours")
    return F.sequence(first, last, F.expr("interval 6 hours"))


def time_from_name(name: Column) -> Column:
    """Time in a file name: YYYYJJJ.HH or YYYYMMDD, an optional separator, HH; NULL if there is none."""
    julian, plain = r"(?:^|[^0-9])(\d{4})(\d{3})\.(\d{2})(?:[^0-9]|$)", r"(?:^|[^0-9])(\d{4})(\d{2})(\d{2})[._T-]?(\d{2})(?:[^0-9]|$)"
    part = lambda pattern, k: F.regexp_extract(name, pattern, k).cast("int")
    by_day = F.date_add(F.make_date(part(julian, 1), F.lit(1), F.lit(1)), part(julian, 2) - 1).cast("timestamp")
    by_day = F.timestamp_seconds(F.unix_timestamp(by_day) + part(julian, 3) * 3600)
    return F.when(F.rlike(name, F.lit(julian)), by_day).when(
        F.rlike(name, F.lit(plain)), F.make_timestamp(part(plain, 1), part(plain, 2), part(plain, 3), part(plain, 4), F.lit(0), F.lit(0))
    )

