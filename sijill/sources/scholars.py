"""Scholars: Markdown with front matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sijill.functions.frontmatter import front_and_body, inline, inline_words, nested, scalar, string_list, top
from sijill.sources.files import stem, whole_files

DATE = "struct<hijri:int,month:int,day:int,approx:boolean,alt:array<int>,place:string>"
SOURCE_FIELDS = ["book", "bookTr", "author", "authorTr", "edition", "page", "entry"]


def _first(values: Column) -> Column:
    return F.try_element_at(values, F.lit(1))


def _date(block: Column) -> Column:
    alternatives = F.transform(
        F.regexp_extract_all(F.regexp_extract(block, r"(?m)^[ \t]+alt:[ \t]*\[(.*)\]", 1), F.lit(r"(\d+)"), F.lit(1)),
        lambda y: y.cast("int"))
    return F.struct(
        *[nested(block, part).try_cast("int").alias(part) for part in ("hijri", "month", "day")],
        nested(block, "approx").try_cast("boolean").alias("approx"), alternatives.alias("alt"),
        nested(block, "place").alias("place")).cast(DATE)


def _sources(block: Column) -> Column:
    # One element per "- " line; a source's own lines are indented below it.
    items = F.filter(F.split(block, r"(?m)^[ \t]+-(?= )"), lambda i: F.trim(F.regexp_replace(i, r"\s+", " ")) != "")
    return F.transform(items, lambda item: F.struct(*[
        nested(F.regexp_replace(item, r"\A ", "  "), f).alias(f) for f in SOURCE_FIELDS]))


def parse_scholars(files: DataFrame) -> DataFrame:
    """(path, value) → typed scholars; lists a file lacks are empty, a missing birth is null."""
    front, body = front_and_body(F.col("value"))
    rows = files.select(stem(F.col("path")).alias("id"), front.alias("front"), body.alias("body"))
    blocks = ["name", "fullNameAr", "madhhab", "birth", "death", "places", "teachers", "students", "works", "summary",
              "order", "featured", "addedAt", "sources"]
    rows = rows.select("id", "body", *[top(F.col("front"), k).alias(k) for k in blocks])
    birth, death = F.col("birth"), F.col("death")
    return rows.select(
        "id",
        F.struct(*[_first(inline(F.col("name"), x)).alias(x) for x in ("ar", "tr", "en")]).alias("name"),
        scalar(F.col("fullNameAr")).alias("fullNameAr"), scalar(F.col("madhhab")).alias("madhhab"),
        F.when(F.trim(birth) != "", _date(birth)).alias("birth"), _date(death).alias("death"),
        F.arrays_zip(inline_words(F.col("places"), "place").alias("place"), inline_words(F.col("places"), "role").alias("role"))
        .alias("places"),
        string_list(F.col("teachers")).alias("teachers"), string_list(F.col("students")).alias("students"),
        F.transform(inline(F.col("works"), "ar"), lambda t: F.struct(t.alias("ar"))).alias("works"),
        F.map_from_arrays(F.array(F.lit("tr"), F.lit("en")), F.array(
            _first(inline(F.col("summary"), "tr")), _first(inline(F.col("summary"), "en")))).alias("summary"),
        scalar(F.col("order")).try_cast("int").alias("order"), scalar(F.col("featured")).try_cast("boolean").alias("featured"),
        scalar(F.col("addedAt")).try_cast("date").alias("addedAt"), _sources(F.col("sources")).alias("sources"), "body")


def read_scholars(spark: SparkSession, folder: str) -> DataFrame:
    return parse_scholars(whole_files(spark, folder, "*.md"))
