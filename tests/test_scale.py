"""Skew-safe operators against plain ones, with the hot path forced on small data."""

import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sijill.operators.scale import Lookup, first_per_group, hot_keys, numbered, numbered_within, paged_lists, spread_join


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows under one key, a tenth under a missing one."""
    k = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 10 == 1, None).otherwise((F.col("id") % 37).cast("string"))
    return spark.range(3000).select(k.alias("k"), "id", (F.col("id") * 7919 % 1009).alias("v")).cache()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_hot_keys_include_the_missing_key(skewed):
    assert hot_keys(skewed, ["k"], 5000) is None
    assert {r.k for r in hot_keys(skewed, ["k"], 150).collect()} == {"hot", None}


@pytest.mark.parametrize("hot_rows", [70, 150, 10**9])
def test_numbers_within_groups(skewed, hot_rows):
    expected = skewed.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("v", "id")).cast("bigint"))
    assert rows(numbered_within(skewed, ["k"], ["v", "id"], "n", hot_rows)) == rows(expected)


def test_numbers_over_the_whole_table(skewed):
    expected = skewed.withColumn("n", F.row_number().over(Window.orderBy("v", "id")).cast("bigint"))
    assert rows(numbered(skewed, ["v", "id"], slice_rows=500)) == rows(expected)
    assert rows(numbered(skewed.limit(0), ["v", "id"])) == []


@pytest.mark.parametrize("hot_rows", [100, 10**9])
def test_paged_lists_are_whole_and_ordered(skewed, hot_rows):
    parts = paged_lists(skewed, ["k"], ["v", "id"], "id", "ids", page=40, hot_rows=hot_rows).collect()
    assert max(len(r.ids) for r in parts) == 40
    got = {}
    for r in sorted(parts, key=lambda r: r.part):
        got.setdefault(r.k, []).extend(r.ids)
    expected = {}
    for r in skewed.orderBy("v", "id").collect():
        expected.setdefault(r.k, []).append(r.id)
    assert got == expected


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("hot_rows", [100, 10**9])
def test_spread_join_equals_the_plain_join(spark, skewed, how, hot_rows):
    names = spark.createDataFrame([("hot", "H"), ("1", "one"), ("2", "two"), (None, "none")], "k string, name string")
    assert rows(spread_join(skewed, names, ["k"], how, ["id"], hot_rows)) == rows(skewed.join(names, ["k"], how))


def test_lookup_is_broadcast_only_when_measured_small(spark, skewed):
    names = spark.createDataFrame([("hot", "H"), ("1", "one")], "k string, name string")
    small, many, wide = Lookup(names), Lookup(names, max_rows=1), Lookup(names, max_bytes=3)
    assert small.is_small and not many.is_small and not wide.is_small
    for lookup in (many, wide):
        assert rows(lookup.join(skewed, ["k"], spread=["id"])) == rows(small.join(skewed, ["k"]))


def test_first_per_group(skewed):
    order = Window.partitionBy("k").orderBy(F.col("v").desc(), "id")
    expected = skewed.withColumn("n", F.row_number().over(order)).where("n <= 5").drop("n")
    assert rows(first_per_group(skewed, ["k"], [F.col("v").desc(), "id"], 5, ["id"], salts=4)) == rows(expected)


def test_hot_and_missing_keys_stay_spread_in_the_plan(spark, skewed, capsys):
    from sijill.operators.scale import key_or_own
    names = spark.createDataFrame([("hot", "H"), ("1", "one")], "k string, name string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        spread_join(skewed, names, ["k"], "left", ["id"], 100).explain()
        salted = capsys.readouterr().out
        keyed = skewed.withColumn("key", key_or_own(F.col("k"), ["id"])).drop("k")
        keyed.join(names.withColumnRenamed("k", "key"), "key", "left_anti").explain()
        spread = capsys.readouterr().out
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # The optimizer must not fold the second key away.
    assert len(re.findall(r"hashpartitioning\(k#\d+, _salt#\d+", salted)) == 2
    assert "hashpartitioning(key#" in spread and "LeftAnti" in spread
    keys = keyed.groupBy("key").count().agg(F.max("count").alias("n")).first().n
    assert keys == 1000  # the hot key; no heap of missing ones


def test_slices_are_bounded_while_rows_grow():
    from sijill.operators import scale
    assert [scale._slices(n, 10) for n in (0, 10, 11, 10**12)] == [1, 1, 2, scale.MAX_SLICES]
