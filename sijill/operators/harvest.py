"""Jobs over a landed catalogue feed: classify, route, tag, merge, recheck."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sijill.functions.names import work_slug
from sijill.functions.text import fold, words
from sijill.operators.scale import HOT_ROWS, Lookup, first_per_group, key_or_own, numbered_within, spread_join
from sijill.session import materialise
from sijill.values import (OLDEST_YEAR, ORIGIN_HARVESTED, RESULTS_PER_QUERY, RESTRICTED_RECHECK_DAYS, STATUS_ACCEPTED,
                           STATUS_REJECTED, STATUS_REVIEW, SUBJECT_OF_CATEGORY, UNIT_RECHECK_DAYS, YEARS_BACK)


# --- filters --------------------------------------------------------------------

def since_oldest(year: Column, oldest: int = OLDEST_YEAR) -> Column:
    return year >= oldest


def recent(year: Column, run_date: date, back: int = YEARS_BACK) -> Column:
    """This year and the ``back`` years before it."""
    return year >= run_date.year - back


def publishable(status: Column, include_review: bool = False) -> Column:
    """Rows under review stay out unless asked for; a row without a status is published."""
    return F.lit(True) if include_review else ~status.eqNullSafe(F.lit(STATUS_REVIEW))


def unit_due(last_checked: Column, run_date: date, days: int = UNIT_RECHECK_DAYS) -> Column:
    """Never checked, or checked at least ``days`` days before the run."""
    return last_checked.isNull() | (F.datediff(F.lit(run_date), last_checked) >= days)


def restricted_due(full_text: Column, last_checked: Column, run_date: date, days: int = RESTRICTED_RECHECK_DAYS) -> Column:
    return full_text.isNull() & unit_due(last_checked, run_date, days)


def recheck_queue(feed: DataFrame, run_date: date) -> DataFrame:
    """Records to look at again, with the reason."""
    unit = unit_due(F.col("last_checked"), run_date)
    restricted = restricted_due(F.col("fullText"), F.col("last_checked"), run_date)
    return (feed.withColumn("reason", F.when(restricted, "full_text").when(unit, "unit"))
            .where(F.col("reason").isNotNull()))


# --- feeds ----------------------------------------------------------------------

def merge_feeds(feeds: list[DataFrame], key: str = "yokId", spread: str = "id") -> DataFrame:
    """Union of feeds, the last one winning where they hold the same registry id.

    Copies of one record combine map-side. Without a registry id the record's own id tells copies; records with neither are all kept.
    """
    ranked = [f.withColumn("_rank", F.lit(rank)) for rank, f in enumerate(feeds)]
    rows = ranked[0]
    for more in ranked[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    columns = [c for c in rows.columns if c != "_rank"]
    alone = F.when(F.col(key).isNull(), F.col(spread).cast("string"))
    named = F.col(key).isNotNull() | F.col(spread).isNotNull()
    # The id settles ties within one feed. Rows with neither are nobody's copies and stay out of the grouping.
    best = rows.where(named).groupBy(F.col(key).alias("_key"), alone.alias("_alone")).agg(
        F.max_by(F.struct(*columns), F.struct("_rank", spread)).alias("_best"))
    return best.select("_best.*").unionByName(rows.where(~named).select(*columns))


def cap_results(results: DataFrame, query: str, order: list[str], spread: list[str], cap: int = RESULTS_PER_QUERY) -> DataFrame:
    """At most ``cap`` results of each keyword query.

    Spark cuts before its shuffle only up to a limit that is a session setting; it is raised to the cap where it is lower.
    """
    conf = results.sparkSession.conf
    if int(conf.get("spark.sql.optimizer.windowGroupLimitThreshold")) < cap:
        conf.set("spark.sql.optimizer.windowGroupLimitThreshold", str(cap))
    return first_per_group(results, [query], order, cap, spread)


# --- classification -------------------------------------------------------------

def in_department(department: Column, patterns: list[str]) -> Column:
    """A department or branch of the field: it contains one of the patterns."""
    if not patterns:
        return F.lit(False)
    text = fold(department)
    found = F.exists(F.array(*[fold(F.lit(p)) for p in patterns]), lambda p: F.contains(text, p))
    return F.coalesce(found, F.lit(False))


def term_scores(feed: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, category, score): weights of the terms found, each term once per field.

    ``terms`` is the rule table (category, field, term, weight) over the fields title, keywords and abstract; a
    term is one or more words. Of the feed's words only those of some term are kept, with their place. Each term is
    filed under its word that occurs least in this feed; where that word stands, the term's other words are looked up at their places.
    Null and empty texts have no words, terms without words find nothing, and rows that share an id add up their terms.
    """
    spelled = terms.select("category", "field", words(F.col("term")).alias("words"),
                           F.col("weight").cast("decimal(18,3)").alias("weight")).where(F.size("words") > 0)
    # Spellings that fold to the same words are one term.
    weighted = spelled.groupBy("category", "field", "words").agg(F.max("weight").alias("weight"))
    known = weighted.select("field", "words").distinct()
    vocabulary = Lookup(known.select("field", F.explode("words").alias("word")).distinct())

    fields = {"title": F.col("title"), "keywords": F.array_join("topics", " \n "), "abstract": F.col("abstract")}
    texts = F.explode(F.array(*[F.struct(F.lit(name).alias("field"), text.alias("text")) for name, text in fields.items()]))
    # A number of its own keeps places of rows apart that share an id. An inner explode would have Spark test the words for
    # emptiness first, splitting the text again for that.
    tokens = feed.select("id", texts.alias("t")).select("id", "t.field", F.monotonically_increasing_id().alias("source"), words(F.col("t.text")).alias("tokens"))
    rows = tokens.select("id", "field", "source", F.posexplode_outer("tokens").alias("pos", "word"))
    marks = materialise(vocabulary.join(rows, ["field", "word"], "left_semi", spread=["id", "pos"]), "term-words")

    often = marks.groupBy("field", "word").agg(F.count("*").alias("n"))
    parts = known.select("*", F.posexplode("words").alias("at", "word"))
    rarity = F.struct(F.coalesce("n", F.lit(0)), "at")
    filed = parts.join(often, ["field", "word"], "left").groupBy("field", "words").agg(
        F.min_by(F.struct("at", "word"), rarity).alias("anchor")).select("field", "words", "anchor.at", "anchor.word")
    hits = Lookup(filed).join(marks, ["field", "word"], "inner", spread=["id", "pos"]).withColumn("start", F.col("pos") - F.col("at"))
    alone = hits.where(F.size("words") == 1).select("id", "field", "words")
    others = (hits.where(F.size("words") > 1).select("id", "field", "source", "start", "words", "at", F.posexplode("words").alias("k", "word"))
              .where(F.col("k") != F.col("at")).withColumn("pos", F.col("start") + F.col("k")))
    whole = (others.join(marks.select("source", "pos", "word"), ["source", "pos", "word"]).groupBy("id", "field", "source", "start", "words")
             .agg(F.count("*").alias("n")).where(F.col("n") == F.size("words") - 1).select("id", "field", "words"))
    once = alone.unionByName(whole).distinct()
    return (Lookup(weighted).join(once, ["field", "words"], "inner", spread=["id"])
            .groupBy("id", "category").agg(F.sum("weight").alias("score")))


def readable(patterns: list[str], accept: float, review: float, examine_all: bool = True) -> Column:
    """Records whose texts can decide: of the oldest year or later and, without ``examine_all``, of a matching department.

    Others are rejected, unless a score of 0 is enough.
    """
    if min(accept, review) <= 0:
        return F.lit(True)
    return since_oldest(F.col("year")) & (F.lit(True) if examine_all else in_department(F.col("department"), patterns))


def classify(feed: DataFrame, patterns: list[str], terms: DataFrame, accept: float, review: float,
             examine_all: bool = True, only: Column | None = None) -> DataFrame:
    """Route each record: accepted, to manual review, or rejected, with its categories.

    Without ``examine_all`` only records of a matching department are read for terms, and the others are
    rejected. The best category's score decides. Of ``only`` some records are asked for, the others still count where they share an id.
    """
    staged = feed.withColumn("_department", in_department(F.col("department"), patterns))
    candidates = staged if examine_all else staged.where("_department")
    scores = term_scores(candidates, terms)
    # Categories are as few as the term table has.
    best = scores.groupBy("id").agg(F.max("score").alias("score"), F.array_sort(F.collect_set("category")).alias("categories"))
    status = (F.when(F.col("score") >= accept, STATUS_ACCEPTED).when(F.col("score") >= review, STATUS_REVIEW)
              .otherwise(STATUS_REJECTED))
    none = F.array().cast("array<string>")
    return ((staged if only is None else staged.where(only)).join(best, "id", "left")
            .withColumns({"score": F.coalesce("score", F.lit(0).cast("decimal(28,3)")),
                          "categories": F.coalesce("categories", none)})
            .withColumn("status", status).withColumnRenamed("_department", "in_department"))


def with_subjects(classified: DataFrame, mapping: dict[str, str] | None = None, name: str = "topics") -> DataFrame:
    """Subject labels of accepted records; a category without a label adds none.

    The mapping is a setting of a few entries, so it is part of the plan and nothing is shuffled.
    """
    pairs = (mapping or dict(SUBJECT_OF_CATEGORY)).items()
    subject_of = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    found = F.filter(F.transform("categories", lambda c: F.try_element_at(subject_of, c)), lambda x: x.isNotNull())
    subjects = F.when(F.col("status") == STATUS_ACCEPTED, F.array_sort(F.array_distinct(found)))
    return classified.withColumn(name, F.coalesce(subjects, F.array().cast("array<string>")))


# --- publishing -----------------------------------------------------------------

def correct_types(works: DataFrame, registry: DataFrame) -> DataFrame:
    """Degree type from the registry where the registry id agrees; works without an id keep theirs.

    Of several types for one id the last by name holds.
    """
    known = (registry.where(F.col("yokId").isNotNull()).groupBy(F.col("yokId").cast("string").alias("_key"))
             .agg(F.max("type").alias("_type")))
    keyed = works.withColumn("_key", key_or_own(F.col("yokId"), ["id"]))
    return keyed.join(known, "_key", "left").withColumn("type", F.coalesce("_type", "type")).select(*works.columns)


_NUMBERED = r"^(.*)-(\d{1,18})$"


def handed_out(works: DataFrame, bases: DataFrame | None = None) -> DataFrame:
    """(_base, _last): the largest number taken of each base of an id, or of each of ``bases``.

    A published id may be a base itself or a base with a number; which, the new bases say. So each id is read both ways.
    """
    number = F.regexp_extract("id", _NUMBERED, 2)
    readings = F.array(F.struct(F.col("id").alias("_base"), F.lit(0).cast("bigint").alias("_no")),
                       F.struct(F.regexp_extract("id", _NUMBERED, 1).alias("_base"), F.when(number != "", number.cast("bigint")).alias("_no")))
    read = works.select(F.explode(readings).alias("_r")).select("_r.*").where(F.col("_no").isNotNull())
    if bases is not None:
        read = read.join(bases, "_base", "left_semi")
    return read.groupBy("_base").agg(F.max("_no").alias("_last"))


def with_new_ids(fresh: DataFrame, register: Callable[[DataFrame], DataFrame], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Ids for inserted records that avoid those already published.

    ``register`` gives what is taken (see ``handed_out``) of the bases it is called with.
    """
    based = materialise(fresh.withColumn(
        "_base", work_slug(F.try_element_at("authors", F.lit(1)), F.col("title"), F.col("year"))), "new-works")
    taken = register(based.select("_base").distinct())
    ranked = numbered_within(based, ["_base"], ["yokId"], "_n", hot_rows)
    numbered = spread_join(ranked, taken, ["_base"], "left", spread=["yokId"], hot_rows=hot_rows)
    number = F.col("_n") + F.coalesce("_last", F.lit(-1))
    suffix = F.when(number > 0, F.concat(F.lit("-"), number.cast("string"))).otherwise("")
    return numbered.withColumn("id", F.concat("_base", suffix)).select(*fresh.columns)


def upsert(works: DataFrame, feed: DataFrame, run_date: date, years_back: int = YEARS_BACK, correct_type: bool = True,
           hot_rows: int = HOT_ROWS) -> DataFrame:
    """Next snapshot of the published works.

    Of the feed, this year and the ``years_back`` before count. A manual work keeps all its fields but the
    type; a harvested one takes what the feed has, keeping id, date and every field that the feed lacks or has as null; a
    new record gets an id and the harvest mark. ``feed`` has one row per registry id (see ``merge_feeds``).
    """
    fields = [c for c in works.columns if c not in ("id", "yokId", "origin", "addedAt")]
    window = feed.where(F.col("yokId").isNotNull() & recent(F.col("year"), run_date, years_back))
    new = window.select("yokId", F.struct(*[
        (F.col(c) if c in feed.columns else F.lit(None).cast(works.schema[c].dataType)).alias(c) for c in fields]).alias("_new"))
    old = works.withColumn("_key", key_or_own(F.col("yokId"), ["id"]))
    harvested = F.col("origin").eqNullSafe(F.lit(ORIGIN_HARVESTED))
    met = F.col("_new").isNotNull()

    def merged(c: str) -> Column:
        if c not in fields:
            return F.col(c)
        value = F.when(met & harvested, F.coalesce(F.col("_new")[c], F.col(c))).otherwise(F.col(c))
        return F.coalesce(F.col("_new")["type"], value) if c == "type" and correct_type else value

    update = new.select(F.col("yokId").cast("string").alias("_key"), "_new")
    present = old.join(update, "_key", "left").select(*[merged(c).alias(c) for c in works.columns])
    unseen = new.join(works.where(F.col("yokId").isNotNull()).select("yokId"), "yokId", "left_anti")
    given_by = {"id": F.lit(None).cast("string"), "yokId": F.col("yokId"), "origin": F.lit(ORIGIN_HARVESTED),
                "addedAt": F.lit(run_date)}
    fresh = unseen.select(*[given_by.get(c, F.col("_new")[c] if c in fields else None).alias(c) for c in works.columns])
    return present.unionByName(with_new_ids(fresh, lambda bases: handed_out(works, bases), hot_rows))
