"""Works: one YAML file each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sijill.functions.frontmatter import JSON_OPTIONS, json_object
from sijill.sources.files import stem, whole_files
from sijill.values import ORIGIN_HARVESTED

_FIELDS = ("type string, title string, titleTranslation map<string,string>, authors array<string>, language string, "
           "year string, university string, city string, department string, advisors array<string>, topics array<string>, "
           "pageCount string, url string, fullText string, abstract string, yokId string, origin string, addedAt string")
_TYPED = {"year": "int", "pageCount": "int", "yokId": "bigint", "addedAt": "date"}


def parse_works(files: DataFrame) -> DataFrame:
    """(path, value) → typed works; a file is read once into one JSON object."""
    rows = files.select(stem(F.col("path")).alias("id"), F.from_json(json_object(F.col("value")), _FIELDS, JSON_OPTIONS).alias("w"))
    none = F.array().cast("array<string>")
    columns = []
    for field in rows.schema["w"].dataType.names:
        value = F.col(f"w.{field}")
        if field in _TYPED:
            value = value.try_cast(_TYPED[field])
        elif field in ("authors", "advisors", "topics"):
            value = F.coalesce(value, none)
        columns.append(value.alias(field))
    return rows.select("id", *columns)


def unread_works(files: DataFrame) -> DataFrame:
    """(path, reason) of files that ``parse_works`` cannot read whole: no field is found, or a value is not of its type.

    One row per file and reason; empty files have no field. The records stay in ``parse_works`` with nulls in their place.
    """
    rows = files.select("path", F.from_json(json_object(F.col("value")), _FIELDS, JSON_OPTIONS).alias("w"))
    fields = rows.schema["w"].dataType.names
    nothing = F.when(F.coalesce(*[F.col(f"w.{f}").cast("string") for f in fields]).isNull(), F.lit("no field"))
    untyped = [F.when(F.col(f"w.{f}").isNotNull() & F.col(f"w.{f}").try_cast(kind).isNull(), F.lit(f"{f} is no {kind}")) for f, kind in _TYPED.items()]
    return rows.select("path", F.explode(F.array_compact(F.array(nothing, *untyped))).alias("reason"))


def read_works(spark: SparkSession, folder: str) -> DataFrame:
    return parse_works(whole_files(spark, folder, "*.yaml"))


def harvested_ids(files: DataFrame) -> DataFrame:
    """Ids of files that carry the harvest mark, without parsing them."""
    return files.where(F.col("value").rlike(rf"(?m)^origin: {ORIGIN_HARVESTED}$")).select(stem(F.col("path")).alias("id"))
