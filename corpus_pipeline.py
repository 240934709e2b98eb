"""A training corpus from raw documents: language, quality, near-duplicates, mixing, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sijill.llm import bpe, language, mixing, near_dups, quality
from sijill.llm.queries import tokenizer_path
from sijill.llm.text import importable, row_name
from sijill.session import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The columns of documents, ready for Python workers; a stage may be called by itself."""
    importable(spark)
    return docs.select(*COLUMNS)


def clear_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear."""
    rows = _documents(spark, docs)
    return language.accepted(rows, language.learn(rows.where(language.teaches(F.col("doc_id")))))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and look like trusted ones."""
    rows = _documents(spark, docs)
    return quality.good(rows, quality.learn(rows, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def _first_rows(rows: DataFrame, key: str) -> DataFrame:
    """One row per key, the one with the smallest name, so that the same rows give the same one."""
    first = rows.withColumn("_row", row_name(rows.select(*COLUMNS))).groupBy(key).agg(F.min_by(F.struct(*COLUMNS), "_row").alias("d"))
    return first.select("d.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; rows that repeat an id are one document, rows without an id each their own."""
    rows = _documents(spark, docs)
    found = near_dups.named_near_duplicates(rows).where("kept")
    left = materialise(found.select("doc_id", "name", (F.col("n_shingles") == 0).alias("empty")).distinct(), "kept")
    known = _first_rows(rows.join(left.select("doc_id").where("doc_id is not null").distinct(), "doc_id", "left_semi"), "doc_id")
    nameless = rows.where("doc_id is null").withColumn("name", row_name(rows, "text")).join(
        left.where("doc_id is null").select("name", "empty"), "name")
    # A text without words is a duplicate of nothing; of other equal texts the operator keeps one at most.
    return known.unionByName(_first_rows(nameless.where("not empty"), "name")).unionByName(nameless.where("empty").select(*COLUMNS))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    rows = _documents(spark, docs)
    taken = mixing.copies(rows).where("copies > 0").groupBy("row").agg(F.sum("copies").cast("int").alias("_copies"))
    # Rows that agree in every column are one text; the first of them carries all their copies.
    met = rows.withColumn("row", row_name(rows)).dropDuplicates(["row"]).join(taken, "row")
    return met.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and the text they decode to."""
    importable(spark)
    return bpe.coded(docs, tokenizer_path()).withColumn("n_tokens", F.size("ids"))


STAGES = [("language", clear_language), ("quality", good_quality), ("near_duplicates", one_of_each), ("mixing", mixed), ("tokens", tokens)]

ORACLE_SQL = None  # compression, draws and merges have no SQL; tests hold each stage against plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
