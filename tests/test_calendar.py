"""Hijri dates against golden values and against plain day counting."""

import datetime

import pytest
from pyspark.sql import functions as F

from sijill.functions.calendar import civil_date, hijri_day_number, hm, hm_long, miladi

GOLDEN = [
    ((534, None, None), "534/1139-40"), ((534, 3, 26), "534/1139"), ((183, None, None), "183/799-800"),
    ((972, None, None), "972/1564-65"), ((833, 3, None), "833/1429"), ((735, 7, 30), "735/1335"),
    ((699, 10, 2), "699/1300"), ((595, None, None), "595/1198-99"), ((596, None, None), "596/1199-1200"),
    ((493, None, None), "493/1099-1100"), ((393, None, None), "393/1002-03"), ((990, None, None), "990/1582-83"),
    ((1304, None, None), "1304/1886-87"), ((1324, None, None), "1324/1906-07"), ((1, None, None), "1/622-23"),
    ((735, 12, None), "735/1335"), ((534, None, 26), "534/1139-40"), ((534, 0, 0), "534/1139-40"),
    ((534, 3, 0), "534/1139"),
]
ONE_CIVIL_YEAR = [19, 52, 86, 119, 153, 186, 220, 253, 254]
ACROSS_A_HUNDRED = [390, 493, 596, 699, 802, 905, 1008, 1111, 1214, 1317, 1420]


def test_golden_dates(spark):
    rows = spark.createDataFrame([d for d, _ in GOLDEN], "y int, m int, d int")
    got = [r.t for r in rows.select(hm(F.col("y"), F.col("m"), F.col("d")).alias("t")).collect()]
    assert got == [t for _, t in GOLDEN]


def test_years_within_one_civil_year_and_across_hundreds(spark):
    years = spark.range(1, 1500).select(F.col("id").cast("int").alias("y"))
    text = {r.y: r.t for r in years.select("y", miladi(F.col("y")).alias("t")).collect()}
    single = [y for y, t in text.items() if "-" not in t]
    assert [y for y in single if y < 260] == ONE_CIVIL_YEAR
    crossing = [y for y, t in text.items() if "-" in t and len(t.split("-")[1]) == 4]
    assert [y for y in crossing if y >= 350] == ACROSS_A_HUNDRED


def _julian_calendar(first, last):
    """Civil dates counted day by day from a known Julian day."""
    y, m, d = 622, 1, 1
    days = [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
    number = 1721058 + 622 * 365 + (622 + 3) // 4
    table = {}
    while number <= last:
        if number >= first:
            table[number] = (y, m, d)
        d += 1
        if d > days[m - 1] + (m == 2 and y % 4 == 0):
            d, m = 1, m + 1
            if m > 12:
                m, y = 1, y + 1
        number += 1
    return table


def test_civil_dates_by_day_counting(spark):
    first, switch, last = 1948440, 2299161, 2299161 + 200_000
    julian = _julian_calendar(first, switch - 1)
    days = spark.range(first, last).select("id", civil_date(F.col("id")).alias("c")).select("id", "c.*")
    for r in days.toLocalIterator():
        if r.id < switch:
            assert (r.year, r.month, r.day) == julian[r.id]
        else:
            day = datetime.date.fromordinal(r.id - 1721425)
            assert (r.year, r.month, r.day) == (day.year, day.month, day.day)


def test_exact_day(spark):
    row = spark.range(1).select(civil_date(hijri_day_number(F.lit(534), F.lit(3), F.lit(26))).alias("c")).first()
    assert tuple(row.c) == (1139, 11, 20)


def test_day_numbers_advance_month_by_month(spark):
    rows = spark.sql("select y, m from (select explode(sequence(1, 1500)) y) lateral view explode(sequence(1, 12)) t as m")
    numbers = [r.n for r in rows.select("y", "m", hijri_day_number(F.col("y"), F.col("m")).alias("n")).orderBy("y", "m").collect()]
    steps = {b - a for a, b in zip(numbers, numbers[1:])}
    assert steps == {29, 30}
    # Thirty years hold eleven leap days.
    assert numbers[360] - numbers[0] == 30 * 354 + 11


@pytest.mark.parametrize("lang,expected", [("tr", "26 Rebîülevvel 534/1139"), ("en", "26 Rabi I 534/1139"),
                                           ("ar", "26 ربيع الأول 534/1139")])
def test_long_form(spark, lang, expected):
    row = spark.range(1).select(hm_long(lang, F.lit(534), F.lit(3), F.lit(26)).alias("t")).first()
    assert row.t == expected


def test_long_form_without_parts(spark):
    rows = spark.createDataFrame([(534, None, 26), (534, 3, None), (534, None, None), (534, 0, 0), (None, 3, 26)], "y int, m int, d int")
    got = [r.t for r in rows.select(hm_long("en", F.col("y"), F.col("m"), F.col("d")).alias("t")).collect()]
    assert got == ["26 534/1139-40", "Rabi I 534/1139", "534/1139-40", "534/1139-40", None]
