"""Posts and fixed pages: Markdown in one folder per language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sijill.functions.frontmatter import front_and_body, scalar, string_list, top
from sijill.sources.files import whole_files

_PATH = r"/([a-z]{2})/([^/]+)\.md$"


def _parse(files: DataFrame, fields: dict[str, str]) -> DataFrame:
    front, body = front_and_body(F.col("value"))
    rows = files.select(F.regexp_extract("path", _PATH, 1).alias("lang"),
                        F.url_decode(F.regexp_extract("path", _PATH, 2)).alias("slug"), front.alias("front"), body.alias("body"))

    def field(name: str, kind: str) -> Column:
        raw = top(F.col("front"), name)
        return (string_list(raw) if kind == "list" else scalar(raw).try_cast(kind)).alias(name)

    return rows.select("lang", "slug", *[field(n, k) for n, k in fields.items()], "body")


def parse_posts(files: DataFrame) -> DataFrame:
    return _parse(files, {"photo": "string", "title": "string", "date": "date", "summary": "string", "tags": "list"})


def parse_pages(files: DataFrame) -> DataFrame:
    return _parse(files, {"title": "string", "lead": "string", "photo": "string"})


def read_posts(spark: SparkSession, folder: str) -> DataFrame:
    return parse_posts(whole_files(spark, folder, "*.md"))


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    return parse_pages(whole_files(spark, folder, "*.md"))
