"""Day-grain calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WEEKDAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")


def weekday(c: Column) -> Column:
    """Monday is 0."""
    return F.weekday(c).cast("int")


def calendar_parts(day: str) -> dict[str, Column]:
    """weekday, month and year of a date column."""
    c = F.col(day)
    return {"dia_semana": weekday(c), "mes": F.month(c), "ano": F.year(c)}


def calendar_features(day: str) -> dict[str, Column]:
    """The seven calendar features of the forecast models."""
    c = F.col(day)
    return {
        **calendar_parts(day),
        "semana_ano": F.weekofyear(c),
        "is_weekend": (F.weekday(c) >= 5).cast("int"),
        "is_month_start": (F.dayofmonth(c) == 1).cast("int"),
        "is_month_end": (F.last_day(c) == F.to_date(c)).cast("int"),
    }


def day_of(c: Column) -> Column:
    """the calendar day a moment falls on."""
    return F.to_date(c)


def next_midnight(c: Column, dtype: str) -> Column:
    """The first midnight at or after a moment, as a date.

    For a midnight ``s`` at or after ``t``, the whole elapsed days ``floor(s - t)`` (F9)
    are the calendar days from ``next_midnight(t)`` to ``s``; comparing days instead of
    moments is exact and does not depend on the session time zone.
    """
    day = F.to_date(c)
    if dtype == "date":
        return day
    return F.when(c > day.cast(dtype), F.date_add(day, 1)).otherwise(day)


def whole_days(start: Column, end: Column) -> Column:
    """elapsed 24-hour periods between two moments, rounded down (also below zero)."""
    elapsed = end - start
    days = F.extract(F.lit("DAY"), elapsed).cast("int")
    return F.when(elapsed < F.make_dt_interval(days), days - 1).otherwise(days).cast("long")


def first_weekday_from(day: Column, name: str) -> Column:
    """The first given weekday at or after a date."""
    return F.next_day(F.date_sub(day, 1), name)


def weekly_dates(lo: Column, hi: Column, name: str = "MON") -> Column:
    """array of weekly dates on one weekday within [lo, hi]; null when there is none."""
    return F.transform(week_numbers(lo, hi, name), lambda k: F.date_add(first_weekday_from(lo, name), k * 7))


def week_numbers(lo: Column, hi: Column, name: str = "MON") -> Column:
    """Array 0..n-1 for the n weekly dates within [lo, hi]; null when there is none.

    Exploding small numbers and adding weeks afterwards is several times cheaper than
    exploding a sequence of dates, which does calendar arithmetic per element.
    """
    first = first_weekday_from(lo, name)
    return F.when(first <= hi, F.sequence(F.lit(0), F.floor(F.date_diff(hi, first) / 7).cast("int")))
