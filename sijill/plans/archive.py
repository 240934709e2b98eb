"""From record files to Parquet tables, and from those to the open-data exports."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sijill.functions.text import page_path
from sijill.operators.bibliography import filter_works
from sijill.operators.graph import edges_of, neighbours, pairs, update_pairs
from sijill.operators.pages import catalogue, posts_with_fallback
from sijill.operators.records import scholar_records
from sijill.operators.scale import Lookup
from sijill.session import materialise
from sijill.sinks import exports
from sijill.sources.files import whole_files
from sijill.sources.posts import read_pages, read_posts
from sijill.sources.scholars import read_scholars
from sijill.sources.tables import read_links, read_places
from sijill.sources.works import read_works, unread_works
from sijill.values import LANGUAGES, ORIGIN_HARVESTED

# Facets that filters compare; ordered files let Parquet skip row groups by them.
WORK_LAYOUT = ["language", "type", "year", "id"]


def table(spark: SparkSession, archive: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(archive, name))


def _write_new(df: DataFrame, archive: str, name: str) -> None:
    df.write.mode("errorifexists").parquet(os.path.join(archive, name))


def _write_graph(spark: SparkSession, archive: str, pair_rows: DataFrame) -> None:
    _write_new(pair_rows, archive, "pairs")
    _write_new(edges_of(table(spark, archive, "pairs")), archive, "edges")
    _write_new(neighbours(table(spark, archive, "edges")), archive, "neighbours")


def build_archive(spark: SparkSession, content: str, links: str, gazetteer: str, archive: str, links_per_line: bool = False) -> None:
    """Read every record file once and write the tables all other jobs start from.

    ``content`` holds the folders scholars, works, posts and pages. Links are read by many tasks in any layout; with
    ``links_per_line`` a line is an object of its own, which costs less. The table unread names works files with fields that do not parse.
    """
    def write(df: DataFrame, name: str) -> None:
        _write_new(df, archive, name)

    write(read_scholars(spark, os.path.join(content, "scholars")), "scholars")
    # Written as parsed, since a layout by range first samples its input; the id ends
    # the order, so one large language or year is split over many files.
    works = materialise(read_works(spark, os.path.join(content, "works")), "parsed-works")
    write(unread_works(whole_files(spark, os.path.join(content, "works"), "*.yaml")), "unread")
    write(works.repartitionByRange(*WORK_LAYOUT).sortWithinPartitions(*WORK_LAYOUT), "works")
    write(read_posts(spark, os.path.join(content, "posts")), "posts")
    write(read_pages(spark, os.path.join(content, "pages")), "pages")
    write(read_places(spark, gazetteer), "places")
    write(read_links(spark, links, links_per_line), "mentions")
    _write_graph(spark, archive, pairs(table(spark, archive, "mentions")))


def update_graph(spark: SparkSession, archive: str, target: str, changed: DataFrame, mentions: DataFrame) -> None:
    """The link tables of ``archive`` after the entries ``changed`` (id) have the ``mentions`` (id, role, idx, other), written to ``target``."""
    entries = Lookup(changed.select("id").where(F.col("id").isNotNull()).distinct())
    kept = entries.join(table(spark, archive, "mentions"), ["id"], "left_anti", spread=["other", "idx"])
    new = entries.join(mentions, ["id"], "left_semi", spread=["other", "idx"]).select(*kept.columns)
    _write_new(kept.unionByName(new), target, "mentions")
    _write_graph(spark, target, update_pairs(table(spark, archive, "pairs"), changed, mentions))


def export_scholars(spark: SparkSession, archive: str, out: str, base_url: str) -> None:
    records = scholar_records(table(spark, archive, "scholars"), table(spark, archive, "places"),
                              table(spark, archive, "neighbours"), base_url)
    # Both exports read one written copy of the records.
    records.write.parquet(os.path.join(out, "scholars.parquet"))
    written = spark.read.schema(records.schema).parquet(os.path.join(out, "scholars.parquet"))
    exports.write_scholars_csv(written, os.path.join(out, "scholars.csv"))
    exports.write_scholars_json(written, os.path.join(out, "scholars.json"))


WORK_EXPORTS = {
    "csv": (exports.write_works_csv, "bibliography.csv"),
    "json": (exports.write_works_json, "bibliography.json"),
    "bib": (exports.write_works_bibtex, "bibliography.bib"),
    "ris": (exports.write_works_ris, "bibliography.ris"),
    "list": (exports.write_compact_list, "bibliography-list.json"),
}


def export_bibliography(spark: SparkSession, archive: str, out: str, formats: list[str] | None = None, **facets) -> None:
    """Write the works that meet the facets (see ``filter_works``) in the given formats, by default all."""
    works = filter_works(table(spark, archive, "works"), **facets)
    for name in formats or WORK_EXPORTS:
        write, file = WORK_EXPORTS[name]
        write(works, os.path.join(out, file))


# --- Fixed values: sections of the site that exist in every language ------------
SECTIONS = ["", "scholars/", "bibliography/", "posts/", "about/", "contribute/", "license/", "credits/", "search/"]


def site_catalogue(spark: SparkSession, archive: str, base: str = "") -> DataFrame:
    """Addresses (path) for search engines: sections, scholars, works and posts in every language."""
    langs = F.explode(F.array(*map(F.lit, LANGUAGES))).alias("lang")
    works = table(spark, archive, "works")
    sections = spark.range(1).select(langs).select("lang", F.explode(F.array(*map(F.lit, SECTIONS))).alias("s")).select(
        F.concat(F.lit(base.rstrip("/") + "/"), "lang", F.lit("/"), "s").alias("path"))
    scholars = table(spark, archive, "scholars").select("id", langs).select(
        page_path(F.col("lang"), "scholars", F.col("id"), base=base).alias("path"))
    bibliography = works.select("id", langs).select(page_path(F.col("lang"), "bibliography", F.col("id"), base=base).alias("path"))
    posts = posts_with_fallback(table(spark, archive, "posts")).select(
        page_path(F.col("lang"), "posts", F.col("slug"), base=base).alias("path"))
    pages = sections.unionByName(scholars).unionByName(bibliography).unionByName(posts)
    return catalogue(pages, works.where(F.col("origin") == ORIGIN_HARVESTED).select("id"))
