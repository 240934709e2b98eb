"""Hijri dates and their civil equivalents.

Dates are (year, month?, day?) integers; days follow the tabular calendar and are
indicative, years are reliable. Zero counts as a missing part everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sijill.values import MONTHS

# --- Fixed values: day numbers the two calendars are anchored to ----------------
HIJRI_EPOCH = 1948439        # day number before 1 Muharram 1, counted at noon
JULIAN_YEAR_ZERO = 1721058   # 1 January of the Julian year 0
UNIX_EPOCH = 2440588         # 1 January 1970
GREGORIAN_START = 2299161    # 15 October 1582

_SAME_HUNDRED = r"^(\d*)(\d\d)-\1(\d\d)$"


def _int(value: Column | int) -> Column:
    return (F.lit(value) if isinstance(value, int) else value).cast("bigint")


def given(part: Column | None) -> Column:
    """The part of a date, or null when it is missing or zero."""
    return F.lit(None).cast("int") if part is None else F.nullif(part, F.lit(0))


def hijri_day_number(year: Column, month: Column | int = 1, day: Column | int = 1) -> Column:
    """Julian day number of a Hijri date.

    Months alternate 30 and 29 days, a common year has 354 and eleven years of
    every thirty get a day more.
    """
    months_before = _int(month) - 1
    years_before = _int(year) - 1
    leap_days = F.floor((_int(year) * 11 + 3) / 30).cast("bigint")
    return _int(day) + months_before * 29 + F.shiftright(months_before + 1, 1) + years_before * 354 + leap_days + HIJRI_EPOCH


def _julian_days(day_number: Column) -> Column:
    return day_number - JULIAN_YEAR_ZERO


def _julian_year(day_number: Column) -> Column:
    return F.floor(_julian_days(day_number) * 4 / 1461).cast("int")


def _gregorian_date(day_number: Column) -> Column:
    return F.date_from_unix_date((day_number - UNIX_EPOCH).cast("int"))


def civil_year(day_number: Column) -> Column:
    """Year in the calendar in force on that day: Julian up to 4 October 1582, then Gregorian."""
    return F.when(day_number < GREGORIAN_START, _julian_year(day_number)).otherwise(F.year(_gregorian_date(day_number)))


def civil_date(day_number: Column) -> Column:
    """Civil (year, month, day) of a day number.

    A Julian day is laid over a year of the same length (2000 or 2001), so month and
    day come from the built-in date functions in both calendars.
    """
    year = _julian_year(day_number)
    day_of_year = _julian_days(day_number) - F.ceil(year.cast("bigint") * 1461 / 4)
    like = F.date_add(F.when(year % 4 == 0, F.lit("2000-01-01").cast("date")).otherwise(F.lit("2001-01-01").cast("date")),
                      day_of_year.cast("int"))
    julian = day_number < GREGORIAN_START
    gregorian = _gregorian_date(day_number)
    return F.struct(
        F.when(julian, year).otherwise(F.year(gregorian)).alias("year"),
        F.when(julian, F.month(like)).otherwise(F.month(gregorian)).alias("month"),
        F.when(julian, F.dayofmonth(like)).otherwise(F.dayofmonth(gregorian)).alias("day"),
    )


def year_span(first_day: Column, last_day: Column) -> Column:
    """``1139``, ``1139-40`` within a hundred, ``1199-1200`` across one.

    Each day is named once: repeating such an expression would outgrow generated code.
    """
    years = F.array_distinct(F.transform(F.array(first_day, last_day), civil_year))
    return F.regexp_replace(F.array_join(years.cast("array<string>"), "-"), _SAME_HUNDRED, "$1$2-$3")


def miladi(year: Column, month: Column | None = None, day: Column | None = None) -> Column:
    """Civil year or years of a Hijri year, month or day; a day without a month is not used."""
    m, d = given(month), given(day)
    # The period from its first day to the day before the next period starts.
    first = hijri_day_number(year, F.coalesce(m, F.lit(1)), F.coalesce(F.when(m.isNotNull(), d), F.lit(1)))
    whole_year_or_last_month = m.isNull() | (m == 12)
    next_period = F.when(whole_year_or_last_month, hijri_day_number(year + 1)).otherwise(
        hijri_day_number(year, F.coalesce(m, F.lit(1)) + 1))
    last = F.when(m.isNotNull() & d.isNotNull(), first).otherwise(next_period - 1)
    return year_span(first, last)


def hm(year: Column, month: Column | None = None, day: Column | None = None) -> Column:
    """``534/1139-40``; null for a missing year."""
    return F.concat(year.cast("string"), F.lit("/"), miladi(year, month, day))


def month_name(lang: str, month: Column) -> Column:
    return F.try_element_at(F.array(*map(F.lit, MONTHS[lang])), given(month).cast("int"))


def hm_long(lang: str, year: Column, month: Column | None = None, day: Column | None = None) -> Column:
    """``3 Safer 702/1302``; here a day is shown even without a month."""
    name = F.lit(None).cast("string") if month is None else month_name(lang, month)
    return F.when(year.isNotNull(), F.concat_ws(" ", given(day).cast("string"), name, hm(year, month, day)))
