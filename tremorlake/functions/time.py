"""Day numbers: days since 2000-01-01 UTC as double, the engine's only time scale.

Built arithmetically, so that a day past a month's end rolls over and second 60 is taken."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "2000-01-01"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def civil_day(year: Column, month: Column, day: Column) -> Column:
    """Integer day number; null for a month outside 1..12 or any null part. Day 31 of a shorter month rolls over."""
    first = F.make_date(year, F.when(month.between(1, 12), month), F.lit(1))
    return (F.datediff(first, F.lit(EPOCH).cast("date")) + day - 1).cast("double")


def checked_day(year: Column, month: Column, day: Column) -> Column:
    """Integer day number, null unless the date exists."""
    first = F.make_date(year, F.when(month.between(1, 12), month), F.lit(1))
    return F.when(day.between(1, F.dayofmonth(F.last_day(first))), civil_day(year, month, day))


def date_of(day: Column) -> Column:
    """The calendar date of a day number."""
    return F.date_add(F.lit(EPOCH).cast("date"), F.floor(day).cast("int"))


def year_of(day: Column) -> Column:
    return F.year(date_of(day))


def iso_day(text: Column) -> Column:
    """`1970-01-01T17:11:00.630Z` -> day number; null if malformed. Seconds may be absent, or 60."""
    t = F.trim(text)
    number = r"(\d+(?:\.\d*)?|\.\d+)"
    pattern = rf"^(-?\d+)-(\d+)-(\d+)[^T]*T{number}:{number}(?::{number})?Z*$"
    part = lambda i, kind: F.expr("NULL").cast(kind) if i is None else F.regexp_extract(t, pattern, i).try_cast(kind)
    year, month, day = (part(i, "int") for i in (1, 2, 3))
    hour, minute = part(4, "double"), part(5, "double")
    second = F.coalesce(part(6, "double"), F.lit(0.0))
    good = month.between(1, 12) & day.between(1, 31) & (hour < 24) & (minute < 60) & (second < 61)
    return F.when(good, civil_day(year, month, day) + (hour * 3600 + minute * 60 + second) / 86400)


def mail_day(text: Column) -> Column:
    """`Mon, 1 Jan 2018 00:00:00` (the weekday may be absent) -> day number; null if malformed."""
    pattern = r"^\s*(?:\w+,)?\s*(\d+)\s+(\w{3})\w*\s+(\d{4})\s+(\d+):(\d+):(\d+(?:\.\d*)?)"
    part = lambda i, kind: F.regexp_extract(text, pattern, i).try_cast(kind)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.regexp_extract(text, pattern, 2))).cast("int")
    return civil_day(part(3, "int"), F.when(month > 0, month), part(1, "int")) + (part(4, "double") * 3600 + part(5, "double") * 60 + part(6, "double")) / 86400
