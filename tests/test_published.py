"""The store of published works: only met buckets change, ids stay apart, lost runs are repeated."""

import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from sijill.operators.harvest import correct_types, handed_out, upsert
from sijill.plans import published as store_module
from sijill.plans.published import create_store, publish_run, published

RUN = date(2026, 9, 24)
SCHEMA = ("id string, yokId bigint, origin string, addedAt date, title string, authors array<string>, year int, type string, city string, "
          "titleTranslation map<string,string>")
FEED = "yokId bigint, title string, authors array<string>, year int, type string, titleTranslation map<string,string>"


def _works(spark, n=400):
    rows = [(f"w{i}" if i % 5 else f"kaya-hukuk-2026-{i}", i if i % 7 else None, "otomatik" if i % 2 else None, RUN, f"T{i}", ["Kaya, Ali"], 2026,
             "tez-yl" if i % 3 else None, "Van" if i % 4 else None, {"en": f"t{i}", "ar": "x"}) for i in range(1, n)]
    return spark.createDataFrame(rows, SCHEMA)


def _files(store):
    return {os.path.join(f, n) for f, _, names in os.walk(os.path.join(store, "works")) for n in names if n.startswith("part-")}


def _rows(df):
    return sorted((tuple(sorted(v.items()) if isinstance(v, dict) else v for v in r) for r in df.collect()), key=str)


def test_a_run_equals_the_whole_merge_and_leaves_other_buckets(spark, out_dir):
    works = _works(spark)
    create_store(works, out_dir, buckets=32)
    before = _files(out_dir)
    assert len(before) >= 32 and _rows(published(spark, out_dir)) == _rows(works)
    # 1 changes, 2 is manual and takes only the type, 3 says nothing new, 4 is too old, three are new, one has no id.
    feed = spark.createDataFrame([(1, "Yeni", ["A"], 2026, "kitap", {"en": "n"}), (2, "Yeni", ["A"], 2026, "kitap", None),
                                  (3, "T3", ["Kaya, Ali"], 2026, None, {"ar": "x", "en": "t3"}), (4, "Eski", ["A"], 1999, None, None),
                                  (900, "Hukuk", ["Kaya, Ali"], 2026, "tez-yl", None), (901, "Hukuk", ["Kaya, Ali"], 2026, "tez-yl", None),
                                  (902, "Hukuk 2026", ["Kaya, Ali"], 395, "tez-yl", None), (None, "Z", ["Z"], 2026, "kitap", None)], FEED)
    expected = _rows(upsert(correct_types(works, feed), feed, RUN, 5000))
    publish_run(spark, out_dir, "1", feed, feed, RUN, 5000)
    assert _rows(published(spark, out_dir)) == expected
    kept = before & _files(out_dir)
    assert 32 - 6 <= len(kept) < 32
    known = _rows(spark.read.parquet(out_dir + "/names").select("_base", "_last"))
    assert known == _rows(handed_out(published(spark, out_dir)))
    # The same run again takes nothing as new; the next one goes on from the register.
    publish_run(spark, out_dir, "1", feed, feed, RUN, 5000)
    assert _rows(published(spark, out_dir)) == expected
    more = feed.where("yokId >= 900").withColumn("yokId", F.col("yokId") + 1000)
    publish_run(spark, out_dir, "2", more, more, RUN, 5000)
    ids = [r.id for r in published(spark, out_dir).collect()]
    assert len(ids) == len(set(ids)) == 399 + 6
    assert _rows(spark.read.parquet(out_dir + "/names").select("_base", "_last")) == _rows(handed_out(published(spark, out_dir)))


def test_a_run_lost_between_its_tables_is_repeated(spark, out_dir, monkeypatch):
    works = _works(spark, 60)
    create_store(works, out_dir, buckets=4)
    feed = spark.createDataFrame([(900, "Hukuk", ["Kaya, Ali"], 2026, "tez-yl", None), (1, "Yeni", ["A"], 2026, "kitap", None)], FEED)
    expected = _rows(upsert(correct_types(works, feed), feed, RUN))
    write, calls = store_module._write_buckets, []

    def lost(df, path):
        calls.append(path)
        write(df, path)
        raise OSError("driver lost")
    monkeypatch.setattr(store_module, "_write_buckets", lost)
    with pytest.raises(OSError):
        publish_run(spark, out_dir, "1", feed, feed, RUN)
    monkeypatch.setattr(store_module, "_write_buckets", write)
    publish_run(spark, out_dir, "1", feed, feed, RUN)
    assert len(calls) == 1 and _rows(published(spark, out_dir)) == expected
    assert _rows(spark.read.parquet(out_dir + "/names").select("_base", "_last")) == _rows(handed_out(published(spark, out_dir)))


def test_empty_stores_and_empty_feeds(spark, out_dir):
    none = spark.createDataFrame([], SCHEMA)
    create_store(none, out_dir)
    feed = spark.createDataFrame([], FEED)
    publish_run(spark, out_dir, "1", feed, feed, RUN)
    assert published(spark, out_dir).count() == 0 and published(spark, out_dir).columns == none.columns
    one = spark.createDataFrame([(1, "Hukuk", ["Kaya, Ali"], 2026, "tez-yl", None)], FEED)
    publish_run(spark, out_dir, "2", one, one, RUN)
    assert [(r.id, r.yokId, r.origin) for r in published(spark, out_dir).collect()] == [("kaya-hukuk-2026", 1, "otomatik")]
