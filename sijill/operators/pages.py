"""Multilingual posts and pages, and the catalogue of addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sijill.functions.text import in_language, iso_day
from sijill.operators.scale import key_or_own
from sijill.values import DEFAULT_LANGUAGE, LANGUAGES

# --- Fixed values: addresses that stay out of the catalogue ---------------------
HIDDEN = "/(search|404)/"
TRANSLATED_WORK = "/(en|ar)/bibliography/([^/]+)/$"


def _content(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("lang", "slug")]


def posts_with_fallback(posts: DataFrame, order: list[str] = LANGUAGES) -> DataFrame:
    """Every slug in every language; a missing translation shows the first one of ``order`` there is.

    ``lang`` is the page's language, ``shown`` the language of the text, ``fallback`` whether they differ.
    One row per (lang, slug) comes in, so a slug's aggregate holds as many texts as there are languages.
    """
    content = F.struct(*_content(posts))
    known = posts.where(F.col("lang").isin(order))
    versions = known.groupBy("slug").agg(*[
        F.max(F.when(F.col("lang") == x, F.struct(F.lit(x).alias("shown"), content.alias("content")))).alias(x) for x in order])
    paths = versions.select("slug", F.explode(F.array(*[
        F.struct(F.lit(x).alias("lang"), F.coalesce(F.col(x), *[F.col(y) for y in order if y != x]).alias("post"))
        for x in order])).alias("path"))
    return paths.select("path.lang", "slug", F.col("path.post.shown").alias("shown"),
                        (F.col("path.post.shown") != F.col("path.lang")).alias("fallback"), "path.post.content.*")


def fixed_pages(wanted: DataFrame, pages: DataFrame, default: str = DEFAULT_LANGUAGE) -> DataFrame:
    """Content for each wanted (lang, slug): the page itself, else the page in the default language."""
    content = _content(pages)
    own = pages.select("lang", "slug", F.struct(*content).alias("_own"))
    other = pages.where(F.col("lang") == default).select("slug", F.struct(*content).alias("_default"))
    chosen = wanted.join(own, ["lang", "slug"], "left").join(other, "slug", "left")
    return chosen.select("lang", "slug", F.col("_own").isNull().alias("fallback"),
                         F.coalesce("_own", "_default").alias("_c")).select("lang", "slug", "fallback", "_c.*")


def visible(path: Column) -> Column:
    return ~path.rlike(HIDDEN)


def drop_redirects(pages: DataFrame, harvested: DataFrame, path: str = "path") -> DataFrame:
    """Pages without the English and Arabic addresses of harvested works, which only redirect.

    Most addresses name no work; they are spread so that they do not meet in one task.
    """
    work = F.nullif(F.regexp_extract(path, TRANSLATED_WORK, 2), F.lit(""))
    keyed = pages.withColumn("_work", key_or_own(work, [path]))
    return keyed.join(harvested.select(F.col("id").alias("_work")), "_work", "left_anti").drop("_work")


def catalogue(pages: DataFrame, harvested: DataFrame, path: str = "path") -> DataFrame:
    """Addresses for search engines: no search or error pages, no redirects."""
    return drop_redirects(pages.where(visible(F.col(path))), harvested, path)


def with_alternates(pages: DataFrame, path: str = "path", base: str = "") -> DataFrame:
    """One row per page and language with the page's address there."""
    langs = F.explode(F.array(*map(F.lit, LANGUAGES))).alias("alternate_lang")
    return pages.select("*", langs).withColumn("alternate", in_language(F.col(path), F.col("alternate_lang"), base))


def article_metadata(posts: DataFrame) -> DataFrame:
    """JSON description of each post for search engines, and its tags on one line."""
    meta = F.to_json(F.struct(
        F.lit("Article").alias("@type"), F.col("title").alias("headline"), F.col("summary").alias("description"),
        iso_day("date").alias("datePublished"), F.col("lang").alias("inLanguage")))
    return posts.select("lang", "slug", meta.alias("jsonld"), F.array_join("tags", ", ").alias("tag_line"))
