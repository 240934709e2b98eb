"""The search index against a look into every title."""

import random

import pytest
from pyspark.sql import functions as F

from sijill.operators.bibliography import matches_text
from sijill.operators.search import _grams, _postings, search_titles, write_search_index

TITLES = ["İlmi Eserler", "ILMI eserler", "ılmı", "Üç Harf", "ab", "a", "", None, "Kitab %_ \\ 'x'", "😀😀😀 emoji", "aaaaaa", "x" * 50_000,
          "The Book of the Book", "كتاب العلم"]
QUERIES = ["ilm", "İLMİ", "eser", "üç", "ab", "a", "", "%_ \\", "😀😀😀", "aaaa", "xxxxxxx", "book of", "the book", "العلم", "zzz", "emoji\n"]


def archive(spark):
    rng = random.Random(4)
    rows = [(f"w{i}", t, {"en": rng.choice(TITLES) or "none"} if i % 3 else None) for i, t in enumerate(TITLES)]
    rows += [(f"r{i}", " ".join("".join(rng.choice("abcğı") for _ in range(rng.randrange(1, 6))) for _ in range(4)), {"en": None}) for i in range(300)]
    # One sequence stands in a third of all titles.
    rows += [(f"h{i}", f"common words {i}", {"en": f"common words {i}"}) for i in range(150)]
    return spark.createDataFrame(rows, "id string, title string, titleTranslation map<string, string>")


@pytest.mark.parametrize("buckets", [1, 8])
def test_search_finds_what_a_scan_finds(spark, out_dir, buckets):
    works = archive(spark).cache()
    write_search_index(works, out_dir + "/index", buckets)
    for q in [*QUERIES, "common", "words 7", "bc", "abc", "ğıa"]:
        want = sorted(r.id for r in works.where(matches_text(q, F.col("title"), F.col("titleTranslation"))).select("id").collect())
        assert sorted(r.id for r in search_titles(spark, out_dir + "/index", q).collect()) == want, q


def test_search_reads_the_buckets_of_its_query(spark, out_dir):
    write_search_index(archive(spark), out_dir + "/index", 32)
    found = search_titles(spark, out_dir + "/index", "common words 77")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(stretch" in plan or "dynamicpruning" in plan
    assert [r.id for r in found.collect()] == ["h77"]


def test_search_in_an_empty_archive(spark, out_dir):
    write_search_index(archive(spark).limit(0), out_dir + "/index", 4)
    assert search_titles(spark, out_dir + "/index", "book").count() == 0 == search_titles(spark, out_dir + "/index", "b").count()


def test_texts_are_taken_apart_once(spark):
    titles = spark.range(100).select(F.col("id").alias("no"), F.concat(F.lit("title number "), "id").alias("folded"))
    found = _postings(titles, 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "REBALANCE_PARTITIONS_BY_COL" in plan  # ranges would be sampled first
    assert found.groupBy("gram").count().where("gram = 'num'").first()["count"] == 100


def test_sequences_of_odd_texts(spark):
    texts = [t for t in TITLES if t is not None] + ["a\nb\u2028c\r\nd", "😀a😀b"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", _grams(F.col("t")).alias("g")).collect()
    assert all(sorted(r.g) == sorted({r.t[i:i + 3] for i in range(len(r.t) - 2)}) for r in rows)
