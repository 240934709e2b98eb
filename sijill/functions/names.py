"""Names of people and institutions, and ids made from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed value: Turkish and accented letters in ids ---------------------------
_LETTERS = "çğıöşüâîûÇĞİIÖŞÜÂÎÛ"
_PLAIN = "cgiosuaiucgiiosuaiu"


def display_name(author: Column) -> Column:
    """``Surname, Given`` → ``Given Surname``; a name without a comma stays."""
    parts = F.split(author, ", ", 2)
    return F.when(F.size(parts) == 2, F.concat_ws(" ", parts[1], parts[0])).otherwise(author)


def display_names(authors: Column) -> Column:
    return F.array_join(F.transform(authors, display_name), ", ")


def university_name(university: Column) -> Column:
    """The university without its institute."""
    return F.split(university, ",", 2)[0]


def department_parts(department: Column) -> Column:
    """First and last level of ``A / B / C``."""
    parts = F.split(department, " / ")
    return F.struct(F.element_at(parts, 1).alias("first"), F.element_at(parts, -1).alias("last"))


def _plain(text: Column) -> Column:
    return F.lower(F.translate(text, _LETTERS, _PLAIN))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(_plain(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def work_slug(author: Column, title: Column, year: Column, title_words: int = 2) -> Column:
    """``surname-word-word-year`` with ``nodate`` for a missing year.

    Title words of up to three letters are passed over.
    """
    surname = slug(F.split(author, ",", 2)[0])
    picked = F.slice(F.regexp_extract_all(_plain(title), F.lit("[a-z0-9]{4,}"), F.lit(0)), 1, title_words)
    parts = F.concat(F.array(surname), picked, F.array(F.coalesce(year.cast("string"), F.lit("nodate"))))
    return F.array_join(F.filter(parts, lambda p: p != ""), "-")
