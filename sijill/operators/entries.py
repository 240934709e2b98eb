"""Slices of an ordered list of source entries."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sijill.operators.scale import HOT_ROWS, _slices
from sijill.session import shared_path

FRONT = 10_000  # a slice that ends by this position is the front of a sorted table, which needs no layout


def _identity(entries: DataFrame) -> list:
    """Two hashes that tell rows of equal keys apart; a hash skips nulls, so which columns are null goes in."""
    columns = sorted(entries.columns)
    parts = [F.col(f"`{c}`") for c in columns]
    plain = [F.to_json(F.struct(p)) if t.startswith("map") else p for p, (_, t) in zip(parts, sorted(entries.dtypes))]
    return [F.xxhash64(F.lit(seed), *[p.isNull() for p in parts], *plain).alias(n) for seed, n in ((1, "_same"), (7, "_same2"))]


_TIE = ["_same", "_same2"]


def write_ranked(entries: DataFrame, order: list[str], folder: str, slice_rows: int = HOT_ROWS) -> None:
    """Write entries as slices of ``order`` (``rows``) and, for each slice, its rows and the rows before it (``slices``).

    Equal keys are ordered by a hash of the whole row, so only equal rows are interchangeable. A missing key comes first.
    """
    spark, columns = entries.sparkSession, [*order, *_TIE]
    slices = _slices(entries.count(), slice_rows)
    placed = entries.select("*", *_identity(entries)).repartitionByRange(slices, *columns).withColumn("_slice", F.spark_partition_id())
    placed.sortWithinPartitions(*columns).write.partitionBy("_slice").parquet(os.path.join(folder, "rows"))
    placed.limit(0).coalesce(1).write.parquet(os.path.join(folder, "columns"))  # what an empty table leaves
    counts = spark.read.schema(placed.schema).parquet(os.path.join(folder, "rows")).groupBy("_slice").agg(F.count("*").alias("n"))
    # One row per slice, of which there is a fixed number at most.
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).coalesce(1).write.parquet(os.path.join(folder, "slices"))


def ranked_slice(spark: SparkSession, folder: str, order: list[str], first: int, last: int) -> DataFrame:
    """Entries number ``first`` to ``last`` of a table that ``write_ranked`` wrote; only the slices that hold them are read."""
    slices = spark.read.parquet(os.path.join(folder, "slices"))
    met = slices.where((F.col("before") < last) & (F.col("before") + F.col("n") >= first)).agg(
        F.min("_slice").alias("lo"), F.max("_slice").alias("hi")).first()
    rows = spark.read.schema(spark.read.parquet(os.path.join(folder, "columns")).schema).parquet(os.path.join(folder, "rows"))
    lo, hi = (0, -1) if met.lo is None else (met.lo, met.hi)
    local = F.row_number().over(Window.partitionBy("_slice").orderBy(*order, *_TIE))
    ranked = rows.where(F.col("_slice").between(lo, hi)).withColumn("_local", local)
    before = F.broadcast(slices.where(F.col("_slice").between(lo, hi)).select("_slice", "before"))
    found = ranked.join(before, "_slice").withColumn("position", F.col("_local") + F.col("before"))
    return found.where(F.col("position").between(first, last)).drop("_slice", "_local", "before", *_TIE)


def entry_slice(entries: DataFrame, first: int, last: int, order: list[str]) -> DataFrame:
    """Entries number ``first`` to ``last`` (from 1, both included) by position in ``order``, with their ``position``.

    A missing key comes first, equal keys follow each other in an order of their own, so a slice has ``last - first + 1`` rows wherever the
    table has as many. A slice near the front is cut from the first rows alone; any other is cut from a table laid out by rank.
    """
    if last <= FRONT:
        front = entries.select("*", *_identity(entries)).orderBy(*order, *_TIE).limit(max(last, 0))
        position = F.row_number().over(Window.orderBy(*order, *_TIE)).cast("bigint")
        return front.withColumn("position", position).where(F.col("position").between(first, last)).drop(*_TIE)
    folder = shared_path(entries.sparkSession, "ranked")
    write_ranked(entries, order, folder)
    return ranked_slice(entries.sparkSession, folder, order, first, last).select(*[f"`{c}`" for c in entries.columns], "position")


def entry_text(entries: DataFrame) -> DataFrame:
    """Reading copy of entries (n, pageStart, pageEnd, heading, text)."""
    head = F.concat(F.lit("## "), F.col("n").cast("string"), F.lit(" ["), F.col("pageStart").cast("string"), F.lit("-"),
                    F.col("pageEnd").cast("string"), F.lit("] "), "heading")
    return entries.select("n", F.concat(head, F.lit("\n"), "text", F.lit("\n")).alias("value"))
