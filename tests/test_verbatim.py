"""Text exports hold exactly what a single hand-written file holds."""

import os

import pytest
from pyspark.sql import functions as F

from helpers import exported
from sijill.sinks.verbatim import write_verbatim


def test_parts_are_the_values_in_order(spark, out_dir):
    rows = spark.range(3000).repartition(7).orderBy("id").select(
        F.when(F.col("id") == 0, "﻿head").when(F.col("id") % 10 == 3, None).otherwise(F.concat(F.lit("\r\nsatır ğ "), F.col("id").cast("string"))).alias("value"))
    write_verbatim(rows, out_dir + "/out")
    expected = "﻿head" + "".join(f"\r\nsatır ğ {i}" for i in range(1, 3000) if i % 10 != 3)
    assert exported(out_dir + "/out") == expected.encode("utf-8")
    assert sorted(n for n in os.listdir(out_dir + "/out") if not n.startswith("part-")) == ["_SUCCESS"]
    with pytest.raises(FileExistsError):
        write_verbatim(rows, out_dir + "/out")


def test_nothing_is_written_of_no_rows(spark, out_dir):
    write_verbatim(spark.createDataFrame([], "value string"), out_dir + "/out")
    assert exported(out_dir + "/out") == b"" and "_SUCCESS" in os.listdir(out_dir + "/out")


def test_a_failed_write_leaves_no_parts(spark, out_dir):
    rows = spark.range(100).select(F.when(F.col("id") == 77, F.raise_error(F.lit("broken"))).otherwise(F.col("id").cast("string")).alias("value"))
    with pytest.raises(Exception, match="broken"):
        write_verbatim(rows, out_dir + "/out")
    assert os.listdir(out_dir + "/out") == []
