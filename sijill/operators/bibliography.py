"""Filters, references, labels and ids of the bibliography."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sijill.functions.citation import with_page
from sijill.functions.names import work_slug
from sijill.functions.text import fold
from sijill.operators.scale import HOT_ROWS, Lookup, numbered_within, spread_join
from sijill.values import SCHOOLS, WORK_TYPES


def matches_text(query: str, title: Column, translations: Column) -> Column:
    """The query occurs in the original title or in one of its translations."""
    wanted = fold(F.lit(query))
    translated = F.exists(F.map_values(translations), lambda t: F.contains(fold(t), wanted))
    return F.contains(fold(title), wanted) | F.coalesce(translated, F.lit(False))


def filter_works(works: DataFrame, types: list[str] | None = None, languages: list[str] | None = None,
                 years: tuple[int | None, int | None] = (None, None), school: str | None = None,
                 subject: str | None = None, search: str | None = None) -> DataFrame:
    """Works that meet every given facet; the plain comparisons reach the Parquet scan."""
    if types:
        works = works.where(F.col("type").isin(types))
    if languages:
        works = works.where(F.col("language").isin(languages))
    first, last = years
    if first is not None:
        works = works.where(F.col("year") >= first)
    if last is not None:
        works = works.where(F.col("year") <= last)
    for label in (school, subject):
        if label is not None:
            works = works.where(F.array_contains("topics", label))
    if search:
        works = works.where(matches_text(search, F.col("title"), F.col("titleTranslation")))
    return works


def citations(sources: DataFrame, forms: DataFrame, spread: list[str]) -> DataFrame:
    """Reference texts of rows with (book, lang, page): styles, first note, short note, bibliography.

    ``forms`` is the caller's table (book, lang, styles, note_tpl, short_tpl, bib); a book it lacks
    gives null texts.
    """
    joined = Lookup(forms).join(sources, ["book", "lang"], "left", spread=spread)
    return joined.select(
        *sources.columns, "styles",
        with_page(F.col("note_tpl"), F.col("page")).alias("note"),
        with_page(F.col("short_tpl"), F.col("page")).alias("short"), "bib")


def labels(spark: SparkSession, kind: str) -> DataFrame:
    """(key, lang, label) of the schools or work types."""
    rows = {"school": [r[:4] for r in SCHOOLS], "work_type": WORK_TYPES}[kind]
    wide = spark.createDataFrame(rows, "key string, tr string, en string, ar string")
    return wide.unpivot("key", ["tr", "en", "ar"], "lang", "label")


def with_label(df: DataFrame, kind: str, key: str, lang: str, name: str = "label") -> DataFrame:
    """Add the label of column ``key`` in the language of column ``lang``."""
    lookup = Lookup(labels(df.sparkSession, kind).toDF("_key", "_lang", name))
    return lookup.join(df.withColumns({"_key": F.col(key), "_lang": F.col(lang)}), ["_key", "_lang"]).drop("_key", "_lang")


def linked_scholars(works: DataFrame, link: DataFrame, scholars: DataFrame) -> DataFrame:
    """Works joined to the scholars they are about, through (work, scholar) links.

    One scholar may be the subject of a large share of the works, and one work may treat many scholars.
    """
    titles = works.select(F.col("id").alias("work"), "title")
    by_work = spread_join(link, titles, ["work"], "inner", spread=["work", "scholar"])
    people = scholars.select(F.col("id").alias("scholar"), F.col("name"))
    return spread_join(by_work, people, ["scholar"], "inner", spread=["work", "scholar"])


def with_slugs(works: DataFrame, order: list[str], name: str = "slug", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Ids ``surname-words-year``; the second and later works of one id get ``-1``, ``-2``, …"""
    base = works.withColumn("_base", work_slug(F.try_element_at("authors", F.lit(1)), F.col("title"), F.col("year")))
    ranked = numbered_within(base, ["_base"], order, "_n", hot_rows)
    suffix = F.when(F.col("_n") > 1, F.concat(F.lit("-"), (F.col("_n") - 1).cast("string"))).otherwise("")
    return ranked.withColumn(name, F.concat("_base", suffix)).drop("_base", "_n")
