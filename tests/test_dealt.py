"""A table of one row group is dealt over tasks before the costly steps."""

from pyspark.sql import functions as F

from __spark_entry__ import SMOKE_DIR
from checks.data import places, scholars
from sijill.operators import scale
from sijill.operators.records import scholar_records


def test_scholars_are_dealt_over_tasks(spark):
    people = scholars(spark, SMOKE_DIR)
    tasks = people.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) >= 6 and max(r["count"] for r in tasks) < 80 and sum(r["count"] for r in tasks) == 160


def test_lists_are_numbered_without_a_second_count(spark, monkeypatch):
    rows = spark.range(400).select((F.col("id") % 3).alias("key"), (F.col("id") % 2).cast("int").alias("side"), F.col("id").alias("v"))

    def counted(*_):
        raise AssertionError("rows are counted again")

    monkeypatch.setattr(scale, "hot_keys", counted)
    for hot_rows in (1000, 20):
        got = {(r.key, r.part): (r.a, r.b) for r in scale.paged_sides(rows, ["key"], ["v"], "v", ["a", "b"], 10, hot_rows).collect()}
        lists = [[[v for v in range(400) if v % 3 == k and v % 2 == side] for side in (0, 1)] for k in range(3)]
        want = {(k, p): tuple(side[10 * p:10 * p + 10] for side in lists[k]) for k in range(3) for p in range(7)}
        assert got == want


def test_records_of_all_parts_come_from_one_join(spark):
    people = scholars(spark, SMOKE_DIR)
    parts = spark.createDataFrame([("c1", 0, ["a"], []), ("c1", 1, ["b"], ["x"]), ("c2", 0, [], ["y"]), ("none", 0, ["z"], [])],
                                  "id string, part int, teacher_ids array<string>, student_ids array<string>")
    whole = scholar_records(people, places(spark, SMOKE_DIR), parts, "b")
    split = scholar_records(people, places(spark, SMOKE_DIR), parts, "b", hot_rows=1)
    lists = lambda df: sorted(map(tuple, df.select("id", "part", "teacherIds", "studentIds", "nameTr").collect()))
    assert lists(whole) == lists(split) and len(lists(whole)) == 161
    scans = [df._jdf.queryExecution().optimizedPlan().toString().count("Relation [c_custkey") for df in (whole, split)]
    assert 0 < scans[0] < scans[1]  # names, dates and places are worked out once
