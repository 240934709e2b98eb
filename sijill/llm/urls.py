"""Rules for URLs, found by their rarest token.

A rule is a host and a path start (``example.com/en/``). It is filed under the one of its tokens (host labels, path
segments) that fewest URLs have. A URL's tokens fetch the rules filed under them, and only these run their regular expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sijill.operators.scale import Lookup, spread_join
from sijill.session import materialise

ALLOW, BLOCK = "allow", "block"
HOT_ROWS = 100_000  # rows of one address that one task takes

RULES = (("com/", ALLOW), ("example.com/en/", BLOCK), ("www.example.com/en/", ALLOW), ("net/es/", BLOCK), ("net/fr/", BLOCK))


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.coalesce(_lower(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(host: Column, path: Column) -> Column:
    """Distinct literal tokens: labels of the host as ``h:…``, whole segments of the path as ``p:…``."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.filter(F.concat(labels, segments), lambda t: F.length(t) > 2))


def rule_table(spark: SparkSession, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "rule string, verdict string")


def indexed(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """(token, rule, verdict, pattern): every rule under its token that fewest of ``urls`` (host, path) have.

    The last segment of a rule's path is no token unless the rule ends it with a slash, as a URL may go on there.
    A rule without any token is filed under the empty one. Of two verdicts for one rule block holds.
    """
    one = rules.where(F.col("rule").isNotNull()).groupBy("rule").agg(F.max("verdict").alias("verdict"))
    host = _lower(F.regexp_extract("rule", r"^([^/]*)", 1))
    path = F.regexp_extract("rule", r"^[^/]*(.*)$", 1)
    whole = F.regexp_replace(path, r"[^/]*$", "")
    quoted = lambda c: F.regexp_replace(c, r"([^A-Za-z0-9_/])", r"\\$1")
    pattern = F.concat(F.lit(r"^([^/]*\.)?"), quoted(host), F.when(path == "", F.lit("(/|$)")).otherwise(quoted(path)))
    parts = one.select("rule", "verdict", pattern.alias("pattern"), F.explode_outer(tokens(host, whole)).alias("token"))
    vocabulary = parts.select("token").where(F.col("token").isNotNull()).distinct()
    seen = urls.select(F.explode(tokens(F.col("host"), F.col("path"))).alias("token"))
    frequency = Lookup(vocabulary).join(seen, ["token"], "inner").groupBy("token").agg(F.count("*").alias("n"))
    rarest = (parts.join(frequency, "token", "left").groupBy("rule", "verdict", "pattern")
              .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("token", F.lit("")).alias("token"))).alias("_best")))
    return rarest.select(F.col("_best.token").alias("token"), "rule", "verdict", "pattern")


def judged(pages: DataFrame, rules: DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = ALLOW) -> DataFrame:
    """``keep`` with host, path, rule and verdict of every row.

    The longest fitting rule decides (of equally long ones the first by name); without one the verdict is ``default`` and
    the rule null. A rule without a path fits every path. Null URLs and such without ``://`` have empty parts and fit nothing.
    Rows that repeat stay as they are; each distinct host and path is judged once.
    """
    rows = pages.select(*keep, url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    distinct = rows.where(F.col("host") != "").select("host", "path").distinct()
    index = Lookup(materialise(indexed(rules, distinct), "url-rules"))
    asked = distinct.withColumn("token", F.explode(F.concat(tokens(F.col("host"), F.col("path")), F.array(F.lit("")))))
    candidates = index.join(asked, ["token"], "inner", spread=["host", "path"])
    best = _longest(candidates.where(F.regexp_like(F.concat("host", "path"), F.col("pattern"))))
    # Rows without a host fit nothing and meet nobody; a popular page is split over tasks.
    known = spread_join(rows.where(F.col("host") != ""), best, ["host", "path"], "left", [*keep], HOT_ROWS)
    nowhere = rows.where(F.coalesce(F.col("host") == "", F.lit(True))).withColumn("_rule", F.lit(None).cast(best.schema["_rule"].dataType))
    return known.unionByName(nowhere).select(
        *keep, "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", F.lit(default)).alias("verdict"))


def _longest(fits: DataFrame) -> DataFrame:
    """(host, path, _rule): the longest rule of each, the first by name among equals."""
    ranked = F.struct((-F.length("rule")).alias("size"), F.col("rule"), F.col("verdict"))
    return fits.groupBy("host", "path").agg(F.min(ranked).alias("_rule"))
