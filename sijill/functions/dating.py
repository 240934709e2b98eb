"""Centuries and date lines of a life."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from sijill.functions.calendar import given, hm, hm_long
from sijill.values import CENTURY_ORDINALS_AR, CENTURY_WORD_AR

# --- Fixed value: years from birth to the century a life is counted in ----------
YEARS_TO_FLORUIT = 60

# --- Fixed values: endings of English ordinals, and the numbers that keep "th" ---
ENGLISH_ENDINGS = ["st", "nd", "rd"]
ENGLISH_TEENS = [11, 12, 13]


@dataclass(frozen=True)
class Words:
    """Words of one language used in date lines, chosen by the caller."""

    died: str
    approx: str
    other_reports: str
    century_suffix: str = ""


def century(hijri: Column) -> Column:
    """Years 1 to 100 are the first century."""
    return F.ceil(hijri / 100).cast("int")


def life_century(death_year: Column, birth_year: Column) -> Column:
    """Century of death, or of birth plus sixty years; a death year of 0 still hides the birth."""
    year = F.coalesce(death_year, given(birth_year) + YEARS_TO_FLORUIT)
    return century(given(year))


def century_label(c: Column, lang: str, suffix: str = "") -> Column:
    if lang == "ar":
        names = F.array(*map(F.lit, CENTURY_ORDINALS_AR))
        return F.concat_ws(" ", F.lit(CENTURY_WORD_AR), F.coalesce(F.try_element_at(names, given(c)), c.cast("string")))
    if lang == "en":
        by_last_digit = F.try_element_at(F.array(*map(F.lit, ENGLISH_ENDINGS)), given(c % 10))
        ending = F.coalesce(F.when(~c.isin(ENGLISH_TEENS), by_last_digit), F.lit("th"))
        return F.concat(c.cast("string"), ending, F.lit(" c. AH"))
    return F.concat(c.cast("string"), F.lit(suffix))


def _approx(date: Column, words: Words) -> Column:
    return F.when(date["approx"], F.lit(words.approx))


def life_short(death: Column, words: Words) -> Column:
    """``d. 534/1139-40``, empty without a year of death."""
    text = F.concat_ws(" ", F.lit(words.died), _approx(death, words), hm(death["hijri"], death["month"], death["day"]))
    return F.when(given(death["hijri"]).isNotNull(), text).otherwise("")


def date_line(date: Column, lang: str, words: Words) -> Column:
    """Full date with the years other reports give; null without a year."""
    main = F.concat_ws(" ", _approx(date, words), hm_long(lang, date["hijri"], date["month"], date["day"]))
    others = F.array_join(F.transform(date["alt"], lambda y: hm(y)), ", ")
    alt = F.when(F.size(F.coalesce(date["alt"], F.array().cast("array<int>"))) > 0,
                 F.concat(F.lit(f" ({words.other_reports}: "), others, F.lit(")"))).otherwise("")
    return F.when(given(date["hijri"]).isNotNull(), F.concat(main, alt))
