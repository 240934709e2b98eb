"""Calendar and dating."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.data import (EN, PEOPLE, scholars, sql_civil, sql_day_number, sql_hm, sql_hm_long, sql_miladi, table)
from sijill.functions.calendar import civil_date, hijri_day_number, hm, hm_long, miladi
from sijill.functions.dating import century, century_label, date_line, life_century, life_short
from sijill.values import CENTURY_ORDINALS_AR, CENTURY_WORD_AR, MONTHS

QUERIES, ORACLE = {}, {}

H, M, D = "1 + o_orderkey % 1450", "1 + o_orderkey % 12", "1 + o_orderkey % 29"


def _orders(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", (1 + k % 1450).cast("int").alias("h"), (1 + k % 12).cast("int").alias("m"), (1 + k % 29).cast("int").alias("d"))


_SQL_ORDERS = f"(SELECT o_orderkey, {H} AS h, {M} AS m, {D} AS d FROM orders)"


def _dates(*parts):
    def query(spark, sf_dir):
        cols = [F.col(p) for p in parts]
        return _orders(spark, sf_dir).select("o_orderkey", miladi(*cols).alias("civil"), hm(*cols).alias("hm"))
    return query


for _name, _parts in {"calendar_year": ["h"], "calendar_month": ["h", "m"], "calendar_day": ["h", "m", "d"]}.items():
    QUERIES[_name] = _dates(*_parts)
    ORACLE[_name] = f"SELECT o_orderkey, {sql_miladi(*_parts)} AS civil, {sql_hm(*_parts)} AS hm FROM {_SQL_ORDERS}"


def civil_parts(spark, sf_dir):
    z = hijri_day_number(F.col("h"), F.col("m"), F.col("d"))
    return _orders(spark, sf_dir).select("o_orderkey", z.alias("day_number"), civil_date(z).alias("c")).select(
        "o_orderkey", "day_number", F.col("c.year").cast("bigint").alias("civil_year"),
        F.col("c.month").cast("bigint").alias("civil_month"), F.col("c.day").cast("bigint").alias("civil_day"))


QUERIES["civil_parts"] = civil_parts
ORACLE["civil_parts"] = f"""
SELECT o_orderkey, z AS day_number, CAST({sql_civil('z', 'year')} AS BIGINT) AS civil_year,
  CAST({sql_civil('z', 'month')} AS BIGINT) AS civil_month, CAST({sql_civil('z', 'day')} AS BIGINT) AS civil_day
FROM (SELECT o_orderkey, {sql_day_number('h', 'm', 'd')} AS z FROM {_SQL_ORDERS})"""


def calendar_long(spark, sf_dir):
    # Months 0 and days 0 occur, so that missing parts do.
    parts = F.col("h"), F.col("m") - 1, F.col("d") % 5
    return _orders(spark, sf_dir).select("o_orderkey", *[hm_long(x, *parts).alias(f"long_{x}") for x in ("tr", "en", "ar")])


QUERIES["calendar_long"] = calendar_long
ORACLE["calendar_long"] = f"""
SELECT o_orderkey, {', '.join(f"{sql_hm_long(MONTHS[x], 'h', 'm', 'd')} AS long_{x}" for x in ('tr', 'en', 'ar'))}
FROM (SELECT o_orderkey, h, m - 1 AS m, d % 5 AS d FROM {_SQL_ORDERS})"""


def century_bucket(spark, sf_dir):
    return (_orders(spark, sf_dir).groupBy(century(F.col("h")).alias("century"))
            .agg(F.count("*").alias("orders"), F.min("h").alias("first_year"), F.max("h").alias("last_year")))


QUERIES["century_bucket"] = century_bucket
ORACLE["century_bucket"] = f"""
SELECT CAST((h + 99) // 100 AS INTEGER) AS century, count(*) AS orders, CAST(min(h) AS INTEGER) AS first_year, CAST(max(h) AS INTEGER) AS last_year
FROM {_SQL_ORDERS} GROUP BY 1"""


def century_estimate(spark, sf_dir):
    k = F.col("o_orderkey")
    death = F.when(k % 3 == 0, F.when(k % 12 == 0, 0).otherwise(F.col("h")))
    birth = F.when(k % 5 != 0, F.when(k % 7 == 0, 0).otherwise(F.col("h")))
    return _orders(spark, sf_dir).select("o_orderkey", life_century(death, birth).alias("century"))


QUERIES["century_estimate"] = century_estimate
ORACLE["century_estimate"] = f"""
SELECT o_orderkey, CAST(CASE WHEN y <> 0 THEN (y + 99) // 100 END AS INTEGER) AS century FROM (
  SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 12 = 0 THEN 0 ELSE h END
    WHEN o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 THEN h + 60 END AS y FROM {_SQL_ORDERS})"""


def century_labels(spark, sf_dir):
    c = (F.col("o_orderkey") % 131 + 1).cast("int")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", century_label(c, "en").alias("label_en"), century_label(c, "ar").alias("label_ar"),
        century_label(c, "tr", ". yy").alias("label_tr"))


_ORDINALS = "[" + ", ".join(f"'{w}'" for w in CENTURY_ORDINALS_AR) + "]"
QUERIES["century_label_en"] = century_labels
ORACLE["century_label_en"] = f"""
SELECT o_orderkey,
  c || CASE WHEN c IN (11, 12, 13) THEN 'th' ELSE coalesce(['st', 'nd', 'rd'][c % 10], 'th') END || ' c. AH' AS label_en,
  '{CENTURY_WORD_AR} ' || coalesce({_ORDINALS}[c], CAST(c AS VARCHAR)) AS label_ar, c || '. yy' AS label_tr
FROM (SELECT o_orderkey, o_orderkey % 131 + 1 AS c FROM orders)"""


def date_lines(spark, sf_dir):
    s = scholars(spark, sf_dir)
    return s.select("id", life_short(F.col("death"), EN).alias("life_short"), date_line(F.col("death"), "en", EN).alias("death_line"),
                    date_line(F.col("birth"), "tr", EN).alias("birth_line"))


QUERIES["date_line_alt"] = date_lines
ORACLE["date_line_alt"] = f"""
WITH {PEOPLE}
SELECT id,
  CASE WHEN dh IS NULL THEN '' ELSE 'd. ' || CASE WHEN dapprox THEN 'c. ' ELSE '' END || {sql_hm('dh', 'dm', 'dd')} END AS life_short,
  CASE WHEN dh IS NOT NULL THEN CASE WHEN dapprox THEN 'c. ' ELSE '' END || {sql_hm_long(MONTHS['en'], 'dh', 'dm', 'dd')}
    || CASE WHEN alt1 IS NOT NULL THEN ' (other reports: ' || {sql_hm('alt1')} || ', ' || {sql_hm('alt2')} || ')' ELSE '' END END AS death_line,
  CASE WHEN bh IS NOT NULL THEN {sql_hm_long(MONTHS['tr'], 'bh', 'bm', 'bd')} END AS birth_line
FROM scholars"""
