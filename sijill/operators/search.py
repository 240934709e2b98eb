"""Search in titles by postings of three-letter sequences.

An index is a folder of three tables. ``titles`` has every folded title and translation once per work, ``postings`` the sequences of
three letters in each, and ``counts`` how many titles have a sequence. All are laid out in buckets of their key, so a search reads the
buckets of its own sequences, then the titles that have its rarest ones, and looks into these alone.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sijill.functions.text import fold
from sijill.operators.scale import Lookup

GRAM = 3
RAREST = 4      # sequences of a query whose postings are read
BUCKETS = 256   # of postings and of titles; a large archive takes more


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


SCHEMAS = {"titles": "id string, folded string, no long, stretch int", "postings": "no long, gram string, bucket int",
           "counts": "gram string, n long, bucket int", "settings": "buckets int"}


def _table(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[kind]).parquet(os.path.join(folder, kind))


def _grams(text: Column) -> Column:
    """The distinct three-letter sequences of a text."""
    # Plain matches from the first, second and third letter on; an empty match before each letter would take longer.
    each = [F.regexp_extract_all(F.substring(text, start, 1 << 30) if start > 1 else text, F.lit(f"(?s).{{{GRAM}}}"), F.lit(0))
            for start in range(1, GRAM + 1)]
    return F.array_distinct(F.concat(*each))


def _postings(titles: DataFrame, buckets: int) -> DataFrame:
    """(no, gram, bucket) in order within tasks.

    Rows are dealt by bucket, and a large bucket goes to several tasks: unlike ranges of sequences this needs no
    sample, for which all texts would be taken apart a second time.
    """
    rows = titles.select("no", F.explode(_grams(F.col("folded"))).alias("gram")).withColumn("bucket", _bucket(F.col("gram"), buckets))
    return rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "gram", "no")


def write_search_index(works: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    """Write the index of ``works`` (id, title, titleTranslation). Missing titles and translations have no row.

    A sequence that a large share of the titles has is split over tasks and files by the title's number.
    """
    spark = works.sparkSession
    fields = F.array_distinct(F.concat(F.array("title"), F.coalesce(F.map_values("titleTranslation"), F.array().cast("array<string>"))))
    titles = (works.select("id", F.explode(fields).alias("field")).where("field is not null")
              .withColumn("no", F.monotonically_increasing_id()).withColumn("stretch", _bucket(F.col("no"), buckets)))
    # Texts are folded after they are dealt, as the works may come out of a few tasks.
    dealt = titles.hint("rebalance", "stretch").select("id", fold(F.col("field")).alias("folded"), "no", "stretch")
    dealt.write.partitionBy("stretch").parquet(os.path.join(folder, "titles"))
    # Numbers are read back as written, so that postings name the same titles however often a task runs.
    postings = _postings(_table(spark, folder, "titles"), buckets)
    postings.write.partitionBy("bucket").parquet(os.path.join(folder, "postings"))
    counts = _table(spark, folder, "postings").groupBy("bucket", "gram").agg(F.count("*").alias("n"))
    counts.repartition("bucket").sortWithinPartitions("gram").write.partitionBy("bucket").parquet(os.path.join(folder, "counts"))
    spark.range(1).select(F.lit(buckets).alias("buckets")).write.parquet(os.path.join(folder, "settings"))


def search_titles(spark: SparkSession, folder: str, query: str) -> DataFrame:
    """(id) of the works with ``query`` in a title or translation, each once; the same works as ``matches_text`` finds.

    A query of fewer than three letters has no sequence and looks into all titles.
    """
    read = lambda kind: _table(spark, folder, kind)
    wanted = spark.range(1).select(fold(F.lit(query)).alias("q")).first().q
    titles, grams = read("titles"), sorted({wanted[i:i + GRAM] for i in range(len(wanted) - GRAM + 1)})
    if grams:
        buckets = read("settings").first().buckets
        places = spark.range(1).select(F.array(*[_bucket(F.lit(g), buckets) for g in grams]).alias("b")).first().b
        at = dict(zip(grams, places))
        known = read("counts").where(F.col("bucket").isin(*set(places)) & F.col("gram").isin(*grams)).collect()  # at most one row per letter
        rarest = [r.gram for r in sorted(known, key=lambda r: (r.n, r.gram))[:RAREST]] if len(known) == len(grams) else []
        postings = read("postings").where(F.col("bucket").isin(*{at[g] for g in rarest}) & F.col("gram").isin(*rarest)) if rarest else read("postings").limit(0)
        hits = postings.groupBy("no").agg(F.count("*").alias("n")).where(F.col("n") == len(rarest))
        found = Lookup(hits.select("no", _bucket(F.col("no"), buckets).alias("stretch")))
        titles = found.join(titles, ["stretch", "no"], "inner", spread=["no"])
    return titles.where(F.contains("folded", F.lit(wanted))).select("id").distinct()
