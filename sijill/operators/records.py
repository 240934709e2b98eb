"""Flat open-data records of scholars and works."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sijill.functions.calendar import given, miladi
from sijill.functions.names import display_names, university_name
from sijill.functions.text import has_text, or_empty, page_path, snippet
from sijill.operators.places import PLACES_TYPE, gazetteer, place_lists, with_place
from sijill.operators.scale import HOT_ROWS, hot_keys, spread_join

WORK_COLUMNS = ["id", "type", "title", "titleTranslation", "authors", "language", "year", "university", "city",
                "department", "advisors", "topics", "pageCount", "url", "fullText", "abstract", "yokId", "origin", "addedAt"]


def _civil(date: str) -> Column:
    d = F.col(date)
    return F.when(given(d["hijri"]).isNotNull(), miladi(d["hijri"], d["month"], d["day"]))


def or_none(values: str) -> Column:
    """A list, empty when the file had none."""
    return F.coalesce(F.col(values), F.array().cast("array<string>"))


def scholar_records(scholars: DataFrame, places: DataFrame, people: DataFrame, base_url: str,
                    hot_rows: int = HOT_ROWS) -> DataFrame:
    """One flat record per scholar.

    ``people`` is the written table of ``neighbours``. The key of a record is (id, part): a scholar whose ids fill
    several parts of it has a record for each, alike but for the ids. Ids of people without a record are kept.
    """
    lookup = gazetteer(places)
    located = with_place(with_place(scholars, F.col("birth.place"), "birthPlace", lookup, ["id"]),
                         F.col("death.place"), "deathPlace", lookup, ["id"])
    source = F.try_element_at("sources", F.lit(1))
    flat = located.select(
        "id", "order",
        page_path("tr", "scholars", F.col("id"), base=base_url).alias("url"),
        F.col("name.ar").alias("nameAr"), F.col("name.tr").alias("nameTr"), F.col("name.en").alias("nameEn"),
        "madhhab",
        F.col("birth.hijri").alias("birthHijri"), _civil("birth").alias("birthGregorian"), "birthPlace",
        F.col("death.hijri").alias("deathHijri"), _civil("death").alias("deathGregorian"),
        F.col("death.approx").alias("deathApprox"), "deathPlace",
        or_none("teachers").alias("teachers"), or_none("students").alias("students"),
        F.transform(F.coalesce("works", F.array().cast("array<struct<ar:string>>")), lambda w: w["ar"]).alias("works"),
        F.struct(source["book"].alias("book"), source["page"].alias("page"), source["entry"].alias("entry")).alias("source"),
    )
    lists = place_lists(scholars, lookup)
    whole = flat.join(lists, "id", "left").withColumn("places", F.coalesce("places", F.array().cast(PLACES_TYPE)))
    none = F.array().cast("array<string>")
    columns = ["id", "part", "order", "url", "nameAr", "nameTr", "nameEn", "madhhab", "birthHijri", "birthGregorian",
               "birthPlace", "deathHijri", "deathGregorian", "deathApprox", "deathPlace", "places", "teachers", "students",
               "teacherIds", "studentIds", "works", "source"]

    def with_lists(parts: DataFrame) -> DataFrame:
        named = parts.select("id", "part", F.col("teacher_ids").alias("teacherIds"), F.col("student_ids").alias("studentIds"))
        return whole.join(named, "id", "left").withColumns({
            "part": F.coalesce("part", F.lit(0)),
            "teacherIds": F.coalesce("teacherIds", none), "studentIds": F.coalesce("studentIds", none),
        }).select(*columns)

    # One scholar may own most of the further parts. Where nobody does, all parts meet the records in one join.
    if hot_keys(people, ["id"], hot_rows) is None:
        return with_lists(people)
    more = spread_join(people.where(F.col("part") > 0), whole, ["id"], "inner", ["id", "part"], hot_rows).withColumnsRenamed(
        {"teacher_ids": "teacherIds", "student_ids": "studentIds"})
    return with_lists(people.where(F.col("part") == 0)).unionByName(more.select(*columns))


def in_order(records: DataFrame) -> DataFrame:
    """Scholars by their ``order``; parts of one record follow each other."""
    return records.orderBy("order", "part")


def work_records(works: DataFrame) -> DataFrame:
    """The record of a work that all bibliography exports share."""
    return works.select(*WORK_COLUMNS[:4], or_none("authors").alias("authors"), *WORK_COLUMNS[5:10],
                        or_none("advisors").alias("advisors"), or_none("topics").alias("topics"), *WORK_COLUMNS[12:])


def compact_rows(works: DataFrame) -> DataFrame:
    """The fifteen fields of a bibliography list row, without the full abstract."""
    return works.select(
        "id", "type", "language",
        university_name(F.col("university")).alias("university"),
        or_empty(F.col("university")).alias("universityFull"),
        or_none("advisors").alias("advisors"), or_none("topics").alias("topics"),
        "year", "pageCount",
        has_text(F.col("abstract")).alias("hasAbstract"),
        or_empty(F.col("fullText")).alias("fullText"),
        "title",
        display_names(F.col("authors")).alias("authors"),
        or_empty(F.col("city")).alias("city"),
        snippet(F.col("abstract")).alias("abstractSnippet"),
    )
