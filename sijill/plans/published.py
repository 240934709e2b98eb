"""The published works in buckets of their registry id: a run reads and rewrites only the buckets that it meets.

A store is a folder with the tables ``works`` and ``names`` (the register of handed-out ids: base, last number), both in
partitions ``_bucket``, ``layout`` (how many buckets) and ``runs/<run>``, the outcome of each run.
"""

from __future__ import annotations

import json
import os
from datetime import date
from functools import reduce
from operator import or_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, IntegerType, MapType, StructField, StructType

from sijill.operators.harvest import handed_out, recent, with_new_ids
from sijill.operators.scale import HOT_ROWS, MAX_SLICES, key_or_own
from sijill.plans.harvest import merged_records, wanted_records
from sijill.session import materialise
from sijill.values import ORIGIN_HARVESTED, YEARS_BACK

BUCKET = "_bucket"


def _bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _work_bucket(buckets: int) -> Column:
    """Works without a registry id meet no feed; they are dealt by their own id."""
    return _bucket_of(key_or_own(F.col("yokId"), ["id"]), buckets)


def _dealt(df: DataFrame) -> DataFrame:
    """Rows by bucket; a large bucket goes to several tasks."""
    return df.hint("rebalance", BUCKET)


def _writer(df: DataFrame) -> DataFrameWriter:
    """Texts take about half the room as with Spark's default codec."""
    return df.write.mode("overwrite").option("compression", "zstd").partitionBy(BUCKET)


def _write_buckets(df: DataFrame, path: str) -> None:
    """Replace the buckets that ``df``, dealt or read by bucket, has rows of; the others keep their files."""
    _writer(df).option("partitionOverwriteMode", "dynamic").parquet(path)


NAMES = f"_base string, _last bigint, {BUCKET} int"


def _layout(spark: SparkSession, store: str) -> tuple[int, StructType]:
    """Number of buckets, and columns of the works: an empty table has no file that would tell them."""
    row = spark.read.parquet(os.path.join(store, "layout")).first()
    return row.buckets, StructType.fromJson(json.loads(row.columns))


def _works(spark: SparkSession, folder: str, columns: StructType, *more: StructField) -> DataFrame:
    return spark.read.schema(StructType([*columns, *more, StructField(BUCKET, IntegerType())])).parquet(os.path.join(folder, "works"))


def _names(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(NAMES).parquet(os.path.join(folder, "names"))


def create_store(works: DataFrame, store: str, buckets: int | None = None) -> None:
    """Lay out ``works`` and the register of their ids; by default a bucket has about ``HOT_ROWS`` works."""
    buckets = buckets or min(-(-works.count() // HOT_ROWS) or 1, MAX_SLICES)
    _write_buckets(_dealt(works.withColumn(BUCKET, _work_bucket(buckets))), os.path.join(store, "works"))
    names = handed_out(works)
    _write_buckets(_dealt(names.withColumn(BUCKET, _bucket_of(F.col("_base"), buckets))), os.path.join(store, "names"))
    layout = works.sparkSession.range(1).select(F.lit(buckets).alias("buckets"), F.lit(works.schema.json()).alias("columns"))
    layout.write.parquet(os.path.join(store, "layout"))


def published(spark: SparkSession, store: str) -> DataFrame:
    """All published works."""
    return _works(spark, store, _layout(spark, store)[1]).drop(BUCKET)


def _buckets_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of the buckets that ``wanted`` names; the list has at most as many entries as the store has buckets."""
    return rows.where(F.col(BUCKET).isin([r[0] for r in wanted.select(BUCKET).distinct().collect()]))


def _differs(a: Column, b: Column, kind: DataType) -> Column:
    if isinstance(kind, MapType):
        a, b = F.array_sort(F.map_entries(a)), F.array_sort(F.map_entries(b))
    return ~a.eqNullSafe(b)


def _mark(spark: SparkSession, folder: str, step: str) -> None:
    spark.range(1).write.mode("overwrite").parquet(os.path.join(folder, step))


def _reached(spark: SparkSession, folder: str, step: str) -> bool:
    try:
        return not spark.read.parquet(os.path.join(folder, step)).isEmpty()
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return False


def publish_run(spark: SparkSession, store: str, run: str, registry: DataFrame, wanted: DataFrame, run_date: date,
                years_back: int = YEARS_BACK, hot_rows: int = HOT_ROWS) -> None:
    """Bring a run's records into the store; the works are then those of ``correct_types`` and ``upsert`` over the whole archive.

    ``registry`` (yokId, type) corrects types, the last by name where an id repeats; ``wanted`` has one row per registry id and is merged
    within the window of years. Records without a registry id and empty feeds change nothing. The outcome is first written whole to
    ``runs/<run>`` and then put in place; a run lost on the way is called again under its name and goes on from its outcome instead of
    taking its own new records for known ones. A run that is in place does nothing more. Runs of one store follow each other.
    """
    folder = os.path.join(store, "runs", run)
    if _reached(spark, folder, "placed"):
        return
    if not _reached(spark, folder, "written"):
        _prepare(spark, store, folder, registry, wanted, run_date, years_back, hot_rows)
    outcome = _works(spark, folder, _layout(spark, store)[1], StructField("_changed", BooleanType()))
    _write_buckets(_buckets_of(outcome, outcome.where("_changed")).drop("_changed"), os.path.join(store, "works"))
    _write_buckets(_names(spark, folder), os.path.join(store, "names"))
    _mark(spark, folder, "placed")


def _prepare(spark: SparkSession, store: str, folder: str, registry: DataFrame, wanted: DataFrame, run_date: date,
             years_back: int, hot_rows: int) -> None:
    buckets, columns = _layout(spark, store)
    fields = [f.name for f in columns if f.name not in ("id", "yokId", "origin", "addedAt")]

    def from_feed(f) -> Column:
        known = F.col(f.name) if f.name in wanted.columns else F.lit(None)
        return known.cast(f.dataType).alias(f.name)

    window = wanted.where(F.col("yokId").isNotNull() & recent(F.col("year"), run_date, years_back))
    new = window.select(F.col("yokId").cast("string").alias("_key"), F.struct(*[from_feed(f) for f in columns if f.name in fields]).alias("_new"))
    types = registry.where(F.col("yokId").isNotNull()).groupBy(F.col("yokId").cast("string").alias("_key")).agg(F.max("type").alias("_type"))
    # The keys alone name the buckets; types and fields meet them by the same key, so each is moved once.
    keys = types.select("_key").unionByName(new.select("_key"))
    old = (_buckets_of(_works(spark, store, columns), keys.select(_bucket_of(F.col("_key"), buckets).alias(BUCKET)))
           .withColumn("_key", key_or_own(F.col("yokId"), ["id"])))
    harvested = F.col("origin").eqNullSafe(F.lit(ORIGIN_HARVESTED))

    def merged(c: str) -> Column:
        if c not in fields:
            return F.col(c)
        taken = F.when(harvested, F.col("_new")[c])
        return F.coalesce(F.col("_new")["type"], "_type", "type") if c == "type" else F.coalesce(taken, F.col(c))

    met = old.join(types, "_key", "left").join(new, "_key", "left")
    changed = reduce(or_, [_differs(merged(f.name), F.col(f.name), f.dataType) for f in columns if f.name in fields])
    names = [f.name for f in columns]
    present = met.select(*[merged(c).alias(c) for c in names], BUCKET, changed.alias("_changed"))

    unseen = new.join(old.select("_key"), "_key", "left_anti")
    key_type = next(f.dataType for f in columns if f.name == "yokId")
    given = {"id": F.lit(None).cast("string"), "yokId": F.col("_key").cast(key_type), "origin": F.lit(ORIGIN_HARVESTED), "addedAt": F.lit(run_date)}
    fresh = unseen.select(*[given.get(c, F.col("_new")[c] if c in fields else None).alias(c) for c in names])

    def register_of(bases: DataFrame) -> DataFrame:
        placed = bases.withColumn(BUCKET, _bucket_of(F.col("_base"), buckets))
        return _buckets_of(_names(spark, store), placed).select("_base", "_last")

    named = materialise(with_new_ids(fresh, register_of, hot_rows), "named")
    inserted = named.withColumns({BUCKET: _work_bucket(buckets), "_changed": F.lit(True)})
    _writer(_dealt(present.unionByName(inserted))).parquet(os.path.join(folder, "works"))

    more = handed_out(named)
    both = register_of(more).unionByName(more)
    register = both.groupBy("_base").agg(F.max("_last").alias("_last")).withColumn(BUCKET, _bucket_of(F.col("_base"), buckets))
    _writer(_dealt(register)).parquet(os.path.join(folder, "names"))
    _mark(spark, folder, "written")


def harvest_into(spark: SparkSession, store: str, run: str, feeds: list[DataFrame], patterns: list[str], terms: DataFrame, run_date: date,
                 accept: float, review: float, examine_all: bool = True, include_review: bool = False,
                 years_back: int = YEARS_BACK) -> None:
    """``harvest_run`` into a store: the feeds are merged, routed and tagged, then published by buckets."""
    merged = merged_records(feeds, patterns, accept, review, examine_all)
    wanted = wanted_records(merged, patterns, terms, run_date, accept, review, examine_all, include_review, years_back)
    publish_run(spark, store, run, merged.select("yokId", "type"), wanted, run_date, years_back)
