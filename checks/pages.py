"""Posts, fixed pages and the catalogue of addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.data import WORKS, table, works
from sijill.functions.text import known_language, page_path
from sijill.operators.entries import entry_slice, entry_text
from sijill.operators.pages import article_metadata, catalogue, fixed_pages, posts_with_fallback, with_alternates
from sijill.values import ORIGIN_HARVESTED

QUERIES, ORACLE = {}, {}


# --- catalogue ------------------------------------------------------------------

def _addresses(spark, sf_dir):
    """Addresses of pages: their own path, a work's page in their language, or the search page."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://[^/]+([^?#]*)", 1).alias("own"))
    k = F.col("page_id")
    lang = F.regexp_extract("own", "^/([a-z]{2})/", 1)
    work = F.concat(F.lit("/"), F.when(k % 2 == 0, "en").when(k % 4 == 1, "ar").otherwise(lang), F.lit("/bibliography/w"), k.cast("string"), F.lit("/"))
    path = F.when(k % 11 == 0, F.concat(F.lit("/"), lang, F.lit("/search/"))).when(k % 3 == 0, work).otherwise(F.col("own"))
    return p.select("page_id", path.alias("path"))


_ADDRESSES = r"""own AS (SELECT page_id AS k, regexp_extract(url, '^https?://[^/]+([^?#]*)', 1) AS own FROM pages),
langs AS (SELECT k, own, regexp_extract(own, '^/([a-z]{2})/', 1) AS lang FROM own),
addresses AS (
  SELECT k AS page_id, CASE WHEN k % 11 = 0 THEN '/' || lang || '/search/'
    WHEN k % 3 = 0 THEN '/' || CASE WHEN k % 2 = 0 THEN 'en' WHEN k % 4 = 1 THEN 'ar' ELSE lang END || '/bibliography/w' || k || '/'
    ELSE own END AS path FROM langs)"""


def page_catalogue_anti(spark, sf_dir):
    harvested = works(spark, sf_dir).where(F.col("origin") == ORIGIN_HARVESTED).select("id")
    return catalogue(_addresses(spark, sf_dir), harvested)


QUERIES["page_catalogue_anti"] = page_catalogue_anti
ORACLE["page_catalogue_anti"] = rf"""
WITH {_ADDRESSES}, {WORKS}
SELECT page_id, path FROM addresses a
WHERE NOT regexp_matches(path, '/(search|404)/') AND NOT EXISTS (
  SELECT 1 FROM works w WHERE w.origin = 'otomatik'
    AND (a.path = '/en/bibliography/' || w.id || '/' OR a.path = '/ar/bibliography/' || w.id || '/'))"""

QUERIES["page_lang_switch"] = lambda spark, sf_dir: with_alternates(_addresses(spark, sf_dir), base="/site/")
# The base is cut off by length, as it would be from a full path.
ORACLE["page_lang_switch"] = f"""
WITH {_ADDRESSES}, cut AS (SELECT page_id, path, substr(path, 6) AS rest FROM addresses),
bare AS (SELECT page_id, path, CASE WHEN rest IN ('/tr', '/en', '/ar') OR left(rest, 4) IN ('/tr/', '/en/', '/ar/') THEN substr(rest, 4) ELSE rest END AS rest FROM cut)
SELECT page_id, path, l AS alternate_lang, '/site/' || l || CASE WHEN rest = '' THEN '/' ELSE rest END AS alternate
FROM bare, (SELECT unnest(['tr', 'en', 'ar']) AS l)"""


def page_lang_root(spark, sf_dir):
    return with_alternates(_addresses(spark, sf_dir))


QUERIES["page_lang_root"] = page_lang_root
ORACLE["page_lang_root"] = f"""
WITH {_ADDRESSES},
bare AS (SELECT page_id, path, CASE WHEN path IN ('/tr', '/en', '/ar') OR left(path, 4) IN ('/tr/', '/en/', '/ar/') THEN substr(path, 4) ELSE path END AS rest FROM addresses)
SELECT page_id, path, l AS alternate_lang, '/' || l || CASE WHEN rest = '' THEN '/' ELSE rest END AS alternate
FROM bare, (SELECT unnest(['tr', 'en', 'ar']) AS l)"""

QUERIES["page_lang_default"] = lambda spark, sf_dir: table(spark, sf_dir, "documents").select(
    "doc_id", known_language(F.col("lang")).alias("page_lang"), page_path(known_language(F.col("lang")), "posts", F.col("source"), base="/b/").alias("href"))
ORACLE["page_lang_default"] = """
SELECT doc_id, CASE WHEN lang IN ('tr', 'en', 'ar') THEN lang ELSE 'tr' END AS page_lang,
  '/b/' || CASE WHEN lang IN ('tr', 'en', 'ar') THEN lang ELSE 'tr' END || '/posts/' || source || '/' AS href FROM documents"""


# --- posts and fixed pages ------------------------------------------------------

def _posts(spark, sf_dir):
    # Every document is a post: three ids in a row are one slug in three languages, and each seventh has a slug of its own.
    k = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        F.when(k % 3 == 0, "tr").when(k % 3 == 1, "en").otherwise("ar").alias("lang"),
        F.when(k % 7 == 0, F.concat(F.lit("q"), k.cast("string"))).otherwise(F.concat(F.lit("p"), F.floor(k / 3).cast("string"))).alias("slug"),
        F.col("source").alias("title"), F.col("text").alias("summary"),
        F.date_add(F.lit("2026-01-01").cast("date"), (k % 300).cast("int")).alias("date"),
        F.array("source", F.when(k % 3 == 0, "tr").when(k % 3 == 1, "en").otherwise("ar")).alias("tags"), F.col("text").alias("body"))


_POSTS = """posts AS (
  SELECT CASE doc_id % 3 WHEN 0 THEN 'tr' WHEN 1 THEN 'en' ELSE 'ar' END AS lang,
    CASE WHEN doc_id % 7 = 0 THEN 'q' || doc_id ELSE 'p' || doc_id // 3 END AS slug, source AS title, text AS body,
    CAST(DATE '2026-01-01' + CAST(doc_id % 300 AS INTEGER) AS DATE) AS date FROM documents)"""

QUERIES["post_fallback"] = lambda spark, sf_dir: posts_with_fallback(_posts(spark, sf_dir)).select(
    "lang", "slug", "shown", "fallback", "title", "body", F.array_join("tags", ", ").alias("tags"))
ORACLE["post_fallback"] = f"""
WITH {_POSTS}, versions AS (
  SELECT l.lang, s.slug, p.lang AS shown, p.title, p.body,
    row_number() OVER (PARTITION BY l.lang, s.slug ORDER BY CASE WHEN p.lang = l.lang THEN 0 WHEN p.lang = 'tr' THEN 1 WHEN p.lang = 'en' THEN 2 ELSE 3 END) AS rn
  FROM (SELECT unnest(['tr', 'en', 'ar']) AS lang) l, (SELECT DISTINCT slug FROM posts) s JOIN posts p ON p.slug = s.slug)
SELECT lang, slug, shown, shown <> lang AS fallback, title, body, title || ', ' || shown AS tags FROM versions WHERE rn = 1"""


def page_fallback(spark, sf_dir):
    pages = _posts(spark, sf_dir).select("lang", "slug", "title", "body")
    wanted = table(spark, sf_dir, "documents").select(
        F.when(F.col("doc_id") % 3 == 0, "en").when(F.col("doc_id") % 3 == 1, "ar").otherwise("tr").alias("lang"),
        F.concat(F.lit("p"), F.floor(F.col("doc_id") / 3).cast("string")).alias("slug")).distinct()
    return fixed_pages(wanted, pages)


QUERIES["page_fallback"] = page_fallback
ORACLE["page_fallback"] = f"""
WITH {_POSTS}, wanted AS (
  SELECT DISTINCT CASE doc_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'ar' ELSE 'tr' END AS lang, 'p' || doc_id // 3 AS slug FROM documents)
SELECT w.lang, w.slug, o.slug IS NULL AS fallback, CASE WHEN o.slug IS NULL THEN d.title ELSE o.title END AS title,
  CASE WHEN o.slug IS NULL THEN d.body ELSE o.body END AS body
FROM wanted w LEFT JOIN posts o ON o.lang = w.lang AND o.slug = w.slug LEFT JOIN posts d ON d.lang = 'tr' AND d.slug = w.slug"""

QUERIES["jsonld_rows"] = lambda spark, sf_dir: article_metadata(_posts(spark, sf_dir))
ORACLE["jsonld_rows"] = f"""
WITH {_POSTS}
SELECT lang, slug, '{{"@type":"Article","headline":' || to_json(title) || ',"description":' || to_json(body) || ',"datePublished":"'
  || strftime(date, '%Y-%m-%d') || '","inLanguage":"' || lang || '"}}' AS jsonld, title || ', ' || lang AS tag_line FROM posts"""


# --- entries --------------------------------------------------------------------

def _entries(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        (k * 7 % 15013).cast("int").alias("n"), (k % 300).cast("int").alias("pageStart"), (k % 300 + 1).cast("int").alias("pageEnd"),
        F.col("o_orderpriority").alias("heading"), F.col("o_orderstatus").alias("text"), "o_orderkey")


_ENTRIES = """entries AS (
  SELECT o_orderkey * 7 % 15013 AS n, o_orderkey % 300 AS p, o_orderpriority AS heading, o_orderstatus AS text, o_orderkey FROM orders),
placed AS (SELECT *, row_number() OVER (ORDER BY n, o_orderkey) AS position FROM entries)"""
_ENTRY_TEXT = "'## ' || n || ' [' || p || '-' || p + 1 || '] ' || heading || chr(10) || text || chr(10)"

QUERIES["ordinal_slice"] = lambda spark, sf_dir: entry_text(entry_slice(_entries(spark, sf_dir), 31, 160, ["n", "o_orderkey"]))
ORACLE["ordinal_slice"] = f"WITH {_ENTRIES} SELECT CAST(n AS INTEGER) AS n, {_ENTRY_TEXT} AS value FROM placed WHERE position BETWEEN 31 AND 160"

QUERIES["ordinal_slice_deep"] = lambda spark, sf_dir: entry_slice(
    _entries(spark, sf_dir), 5001, 9000, ["n", "o_orderkey"]).select("position", "n", "o_orderkey", "heading")
ORACLE["ordinal_slice_deep"] = f"""
WITH {_ENTRIES} SELECT position, CAST(n AS INTEGER) AS n, o_orderkey, heading FROM placed WHERE position BETWEEN 5001 AND 9000"""

QUERIES["ordinal_slice_ties"] = lambda spark, sf_dir: entry_slice(
    table(spark, sf_dir, "orders").select(F.expr("nullif(o_custkey % 40, 7)").alias("n"), "o_orderstatus"), 201, 900, ["n"]).select("position", "n")
ORACLE["ordinal_slice_ties"] = """
WITH placed AS (SELECT nullif(o_custkey % 40, 7) AS n, row_number() OVER (ORDER BY nullif(o_custkey % 40, 7) NULLS FIRST) AS position FROM orders)
SELECT position, n FROM placed WHERE position BETWEEN 201 AND 900"""
