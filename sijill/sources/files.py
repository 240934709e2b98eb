"""Whole small files as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def whole_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, value): one row per file below ``folder`` whose name fits ``pattern``."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    return files.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def stem(path: Column) -> Column:
    """File name without its extension."""
    return F.url_decode(F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1))
