"""Dates and times that arrive as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_date(c: Column) -> Column:
    """A date of yyyy-MM-dd, yyyyMMdd, or a week date yyyy-Www-d (dashes or none; day 1 where it is left out); null of anything else."""
    dashed = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))
    plain = F.when(c.rlike(r"^\d{8}$"), F.try_to_date(c, "yyyyMMdd"))
    return F.coalesce(dashed, plain, _week_date(c))


def _week_date(c: Column) -> Column:
    dashed, plain = r"^(\d{4})-W(\d{2})(?:-([1-7]))?$", r"^(\d{4})W(\d{2})([1-7])?$"
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(c, dashed, i), F.lit("")), F.nullif(F.regexp_extract(c, plain, i), F.lit(""))).try_cast("int")
    year, week, day = part(1), part(2), F.coalesce(part(3), F.lit(1))
    # The week of 4 January is the first; a year has 53 where 28 December is in one.
    first = F.try_to_date(F.format_string("%04d-01-04", year), "yyyy-MM-dd")
    last = F.weekofyear(F.try_to_date(F.format_string("%04d-12-28", year), "yyyy-MM-dd"))
    monday = F.date_sub(first, F.weekday(first))
    return F.when((year > 0) & week.between(1, last), F.date_add(monday, (week - 1) * 7 + day - 1))


def previous_day(c: Column) -> Column:
    """The text of the day before a text day. Days beyond a month's end count on into the next month."""
    first = F.to_date(F.concat(F.substring(c, 1, 8), F.lit("01")))
    return F.date_format(F.date_add(first, F.substring(c, 9, 2).cast("int") - 2), "yyyy-MM-dd")


def utc_text(c: Column, offset: str = "+08:00") -> Column:
    """ISO time in UTC of a wall-clock text `yyyy-MM-dd HH:mm:ss` at a fixed offset."""
    sign = -1 if offset[0] == "-" else 1
    seconds = sign * (int(offset[1:3]) * 3600 + int(offset[4:6]) * 60)
    at = F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz") - F.expr(f"INTERVAL '{seconds}' SECOND")
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def second_before(c: Column) -> Column:
    """The wall-clock text one second earlier."""
    return F.date_format(F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz") - F.expr("INTERVAL '1' SECOND"), "yyyy-MM-dd HH:mm:ss")
