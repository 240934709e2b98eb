"""Harvest jobs over feed-shaped tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from checks.data import WORKS, sql_fold, table, works
from sijill.operators.harvest import (cap_results, classify, correct_types, merge_feeds, publishable, recent, recheck_queue,
                                      since_oldest, unit_due, upsert, with_subjects)
from sijill.plans.published import create_store, harvest_into, published
from sijill.session import shared_path

QUERIES, ORACLE = {}, {}


# --- filters --------------------------------------------------------------------

QUERIES["recent_window"] = lambda spark, sf_dir: works(spark, sf_dir).where(recent(F.col("year"), date(2026, 9, 24))).select("id", "year")
ORACLE["recent_window"] = f"WITH {WORKS} SELECT id, year FROM works WHERE year >= 2025"

QUERIES["year_floor"] = lambda spark, sf_dir: works(spark, sf_dir).where(since_oldest(F.col("year"))).select("id", "year")
ORACLE["year_floor"] = f"WITH {WORKS} SELECT id, year FROM works WHERE year >= 1950"


def review_gate(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").withColumn(
        "status", F.when(F.col("quality") == 0, "inceleme").when(F.col("toxic") == 1, None).otherwise("kabul"))
    return lab.where(publishable(F.col("status"))).select("doc_id", "status")


QUERIES["review_gate"] = review_gate
ORACLE["review_gate"] = """
SELECT doc_id, CASE WHEN toxic = 1 THEN NULL ELSE 'kabul' END AS status FROM labels WHERE quality <> 0"""


def recheck_due(spark, sf_dir):
    units = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last_checked"))
    return units.where(unit_due(F.col("last_checked"), date(2024, 2, 27))).select("user_id", F.date_format("last_checked", "yyyy-MM-dd").alias("day"))


QUERIES["recheck_due"] = recheck_due
ORACLE["recheck_due"] = """
SELECT user_id, strftime(max(ts), '%Y-%m-%d') AS day FROM events GROUP BY user_id
HAVING datediff('day', CAST(max(ts) AS DATE), DATE '2024-02-27') >= 30"""


def recheck_reasons(spark, sf_dir):
    feed = works(spark, sf_dir).withColumn("last_checked", F.when(F.col("year") != 2000, F.col("addedAt")))
    return recheck_queue(feed, date(2026, 4, 15)).select("id", "reason")


QUERIES["recheck_queue"] = recheck_reasons
ORACLE["recheck_queue"] = f"""
WITH {WORKS}, c AS (SELECT id, fullText, CASE WHEN year <> 2000 THEN addedAt END AS d FROM works),
r AS (SELECT id, CASE WHEN fullText IS NULL AND (d IS NULL OR datediff('day', d, DATE '2026-04-15') >= 90) THEN 'full_text'
  WHEN d IS NULL OR datediff('day', d, DATE '2026-04-15') >= 30 THEN 'unit' END AS reason FROM c)
SELECT id, reason FROM r WHERE reason IS NOT NULL"""


# --- feeds ----------------------------------------------------------------------

def feed_union_precedence(spark, sf_dir):
    """The cleaned copy holds every document, the registry the newer ones and several copies of some."""
    w = works(spark, sf_dir).select("id", "yokId", "title", "year", "type")
    cleaned = w.withColumn("feed", F.lit("copy"))
    registry = w.where(recent(F.col("year"), date(2026, 1, 1), 20)).withColumns({
        "feed": F.lit("registry"), "id": F.concat(F.lit("r"), F.col("id")),
        "yokId": F.when(F.col("yokId") % 5 == 0, F.lit(500001)).otherwise(F.col("yokId"))})
    return merge_feeds([cleaned, registry])


QUERIES["feed_union_precedence"] = feed_union_precedence
ORACLE["feed_union_precedence"] = f"""
WITH {WORKS}, f AS (
  SELECT id, yokId, title, year, type, 'copy' AS feed, 0 AS rnk FROM works
  UNION ALL SELECT 'r' || id, CASE WHEN yokId % 5 = 0 THEN 500001 ELSE yokId END, title, year, type, 'registry', 1 FROM works WHERE year >= 2006)
SELECT id, yokId, title, year, type, feed FROM (
  SELECT *, row_number() OVER (PARTITION BY yokId, CASE WHEN yokId IS NULL THEN id END ORDER BY rnk DESC, id DESC) AS rn FROM f) WHERE rn = 1"""


def capped_query(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("query"), "o_orderkey", "o_totalprice")
    return cap_results(rows, "query", [F.col("o_totalprice").desc(), "o_orderkey"], ["o_orderkey"])


QUERIES["capped_query"] = capped_query
ORACLE["capped_query"] = """
SELECT query, o_orderkey, o_totalprice FROM (
  SELECT o_orderpriority AS query, o_orderkey, o_totalprice,
    row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3000"""


# --- classification -------------------------------------------------------------

_PATTERNS = ["HUKUK", "Din src1"]
_TERMS = [("fikih_usulu", "title", "the", 2.0), ("fikih_usulu", "abstract", "of the", 1.5), ("fikih_tarihi", "abstract", "und", 2.0),
          ("fikih_tarihi", "keywords", "hanefî", 1.25), ("fukaha", "title", "el", 1.0), ("fukaha", "abstract", "de la", 2.5),
          ("mukayeseli", "keywords", "topic 7", 3.0), ("iktisat", "abstract", "with", 0.5), ("fikih", "title", "that", 4.0),
          ("fikih", "abstract", "absent words here", 9.0)]


def _classified(spark, sf_dir, examine_all=True):
    terms = spark.createDataFrame(_TERMS, "category string, field string, term string, weight double")
    feed = works(spark, sf_dir).select("id", "title", "topics", "abstract", "department")
    return classify(feed, _PATTERNS, terms, accept=3.0, review=1.5, examine_all=examine_all)


def _routes(df):
    return df.select("id", "in_department", "status", F.col("score").cast("double").alias("score"), F.array_join("categories", ";").alias("categories"))


_TERM_ROWS = ", ".join(f"('{c}', '{f}', '{t}', {w})" for c, f, t, w in _TERMS)
# A term occurs when its words stand next to each other, whatever stands between words.
_CLASSIFIED = rf"""{WORKS}, terms(category, field, term, weight) AS (VALUES {_TERM_ROWS}),
texts AS (
  SELECT id, 'title' AS field, title AS t FROM works UNION ALL SELECT id, 'abstract', abstract FROM works
  UNION ALL SELECT id, 'keywords', array_to_string(topics, ' ') FROM works),
padded AS (SELECT id, field, ' ' || regexp_replace({sql_fold("coalesce(t, '')")}, '[^\p{{L}}\p{{M}}\p{{N}}]+', ' ', 'g') || ' ' AS t FROM texts),
scored AS (
  SELECT p.id, category, sum(weight) AS score FROM padded p JOIN terms USING (field) WHERE contains(p.t, ' ' || {sql_fold('term')} || ' ') GROUP BY 1, 2),
best AS (SELECT id, max(score) AS score, string_agg(category, ';' ORDER BY category) AS categories FROM scored GROUP BY id),
staged AS (
  SELECT id, coalesce(contains({sql_fold('department')}, 'hukuk') OR contains({sql_fold('department')}, 'din src1'), false) AS in_department FROM works)"""


def _routed_sql(candidates: str) -> str:
    return f"""
WITH {_CLASSIFIED}
SELECT s.id, in_department, CASE WHEN b.score >= 3 THEN 'kabul' WHEN b.score >= 1.5 THEN 'inceleme' ELSE 'red' END AS status,
  CAST(coalesce(b.score, 0) AS DOUBLE) AS score, coalesce(b.categories, '') AS categories
FROM staged s LEFT JOIN best b ON b.id = s.id AND {candidates}"""


QUERIES["classify_route"] = lambda spark, sf_dir: _routes(_classified(spark, sf_dir))
ORACLE["classify_route"] = _routed_sql("true")
QUERIES["classify_prefiltered"] = lambda spark, sf_dir: _routes(_classified(spark, sf_dir, examine_all=False))
ORACLE["classify_prefiltered"] = _routed_sql("in_department")

QUERIES["category_labels"] = lambda spark, sf_dir: with_subjects(_classified(spark, sf_dir), name="subjects").select(
    "id", F.array_join("subjects", ";").alias("subjects"))
ORACLE["category_labels"] = f"""
WITH {_CLASSIFIED}, subjects(category, subject) AS (VALUES ('fikih_usulu', 'Fıkıh usulü'), ('fikih_tarihi', 'Fıkıh tarihi'),
  ('fukaha', 'Şahıs çalışmaları'), ('mukayeseli', 'Mukayeseli hukuk'), ('iktisat', 'İslam iktisadı'))
SELECT w.id, coalesce(string_agg(subject, ';' ORDER BY subject), '') AS subjects
FROM works w LEFT JOIN (SELECT s.id, subject FROM scored s JOIN best b ON b.id = s.id AND b.score >= 3 JOIN subjects USING (category)) x ON x.id = w.id
GROUP BY w.id"""


# --- publishing -----------------------------------------------------------------

def type_correction(spark, sf_dir):
    registry = table(spark, sf_dir, "labels").select(
        (F.col("doc_id") + 500000).alias("yokId"), F.when(F.col("quality") == 1, "tez-doktora").otherwise("kitap").alias("type"))
    return correct_types(works(spark, sf_dir).select("id", "yokId", "type"), registry)


QUERIES["type_correction"] = type_correction
ORACLE["type_correction"] = f"""
WITH {WORKS}
SELECT id, yokId, CASE WHEN l.doc_id IS NULL THEN type WHEN quality = 1 THEN 'tez-doktora' ELSE 'kitap' END AS type
FROM works w LEFT JOIN labels l ON l.doc_id + 500000 = w.yokId"""


def upsert_query(spark, sf_dir):
    """Published works against a feed that renames some, retypes all and brings as many new ones."""
    w = works(spark, sf_dir)
    known = w.where(F.col("yokId").isNotNull()).select(
        "yokId", F.lit("kitap").alias("type"), F.concat(F.lit("Yeni Başlık "), "language").alias("title"), "authors", "language", "year")
    new = w.where(F.col("yokId").isNotNull()).select(
        (F.col("yokId") + 1000000).alias("yokId"), "type", F.concat(F.lit("Taze Kitap "), "language").alias("title"),
        F.array(F.lit("Kaya, Ali")).alias("authors"), "language", "year")
    published = w.withColumn("id", F.when(F.col("yokId") % 50 == 0, F.concat(F.lit("kaya-taze-kitap-"), F.col("year").cast("string"), F.lit("-"), (F.col("yokId") % 9 + 1).cast("string"))).otherwise(F.col("id")))
    out = upsert(published, known.unionByName(new), date(2026, 9, 24), years_back=30)
    return out.select("id", "type", "title", "language", "year", "city", "yokId", "origin", F.date_format("addedAt", "yyyy-MM-dd").alias("added"))


QUERIES["upsert"] = upsert_query
ORACLE["upsert"] = f"""
WITH {WORKS}, pub AS (
  SELECT CASE WHEN yokId % 50 = 0 THEN 'kaya-taze-kitap-' || year || '-' || yokId % 9 + 1 ELSE id END AS id, type, title, language, year, city, yokId, origin, addedAt FROM works),
taken AS (
  SELECT 'kaya-taze-kitap-' || year AS base, max(yokId % 9 + 1) AS last FROM works WHERE yokId % 50 = 0 GROUP BY 1),
fresh AS (
  SELECT type, 'Taze Kitap ' || language AS title, language, year, yokId + 1000000 AS yokId, 'kaya-taze-kitap-' || year AS base FROM works
  WHERE yokId IS NOT NULL AND year >= 1996),
numbered AS (
  SELECT f.*, row_number() OVER (PARTITION BY f.base ORDER BY yokId) + coalesce(last, -1) AS n FROM fresh f LEFT JOIN taken t ON t.base = f.base)
SELECT id, CASE WHEN hit THEN 'kitap' ELSE type END AS type, CASE WHEN hit AND origin = 'otomatik' THEN 'Yeni Başlık ' || language ELSE title END AS title,
  language, year, city, yokId, origin, strftime(addedAt, '%Y-%m-%d') AS added
FROM (SELECT *, yokId IS NOT NULL AND coalesce(year >= 1996, false) AS hit FROM pub)
UNION ALL
SELECT base || CASE WHEN n > 0 THEN '-' || n ELSE '' END, type, title, language, year, NULL, yokId, 'otomatik', '2026-09-24' FROM numbered"""


def harvest_run(spark, sf_dir):
    """Two runs into a store of the labelled works: a feed of all works, then as many records that are all new."""
    w = works(spark, sf_dir)
    store = shared_path(spark, "store")
    create_store(w.where(F.col("origin").isNotNull()), store, buckets=8)
    terms = spark.createDataFrame(_TERMS, "category string, field string, term string, weight double")
    feed = w.select("id", "yokId", F.lit("kitap").alias("type"), F.concat(F.lit("Taze Kitap "), "language").alias("title"),
                    F.array(F.lit("Kaya, Ali")).alias("authors"), "language", "year", "topics", "abstract", "department")
    for run, shift in (("1", 0), ("2", 1000000)):
        records = feed.withColumn("yokId", F.col("yokId") + shift)
        harvest_into(spark, store, run, [records], _PATTERNS, terms, date(2026, 9, 24), accept=3.0, review=1.5, examine_all=False, years_back=30)
    return published(spark, store).select("id", "type", "title", "year", "city", F.array_join("topics", ";").alias("topics"), "yokId", "origin")


_FEED_TITLES = _CLASSIFIED.replace("title AS t FROM works", "'Taze Kitap ' || language AS t FROM works")
QUERIES["harvest_run"] = harvest_run
ORACLE["harvest_run"] = f"""
WITH {_FEED_TITLES}, subjects(category, subject) AS (VALUES ('fikih_usulu', 'Fıkıh usulü'), ('fikih_tarihi', 'Fıkıh tarihi'),
  ('fukaha', 'Şahıs çalışmaları'), ('mukayeseli', 'Mukayeseli hukuk'), ('iktisat', 'İslam iktisadı')),
wanted AS (
  SELECT w.*, coalesce((SELECT string_agg(subject, ';' ORDER BY subject) FROM scored x JOIN subjects USING (category) WHERE x.id = w.id),
    array_to_string(w.topics, ';')) AS new_topics
  FROM works w JOIN staged s ON s.id = w.id AND s.in_department JOIN best b ON b.id = w.id AND b.score >= 3
  WHERE w.yokId IS NOT NULL AND w.year >= 1996),
fresh AS (
  SELECT w.*, w.yokId AS reg, 1 AS run FROM wanted w WHERE w.origin IS NULL UNION ALL SELECT w.*, w.yokId + 1000000, 2 FROM wanted w),
numbered AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY run, reg) - 1 AS n FROM fresh)
SELECT p.id, CASE WHEN p.yokId IS NOT NULL THEN 'kitap' ELSE p.type END AS type,
  CASE WHEN w.id IS NOT NULL THEN 'Taze Kitap ' || p.language ELSE p.title END AS title, p.year, p.city,
  CASE WHEN w.id IS NOT NULL THEN w.new_topics ELSE array_to_string(p.topics, ';') END AS topics, p.yokId, p.origin
FROM works p LEFT JOIN wanted w ON w.id = p.id WHERE p.origin IS NOT NULL
UNION ALL
SELECT 'kaya-taze-kitap-' || year || CASE WHEN n > 0 THEN '-' || n ELSE '' END, 'kitap', 'Taze Kitap ' || language, year, NULL, new_topics, reg, 'otomatik'
FROM numbered"""
