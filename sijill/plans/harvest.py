"""One harvest run: feeds in, next snapshot of the works out."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sijill.operators.harvest import classify, correct_types, merge_feeds, publishable, readable, recent, since_oldest, upsert, with_subjects
from sijill.session import materialise
from sijill.values import STATUS_REJECTED, YEARS_BACK


def classified_feed(feeds: list[DataFrame], patterns: list[str], terms: DataFrame, accept: float, review: float,
                    examine_all: bool = True) -> DataFrame:
    """Feeds in order of precedence → one routed and tagged row per record, written once."""
    return classified_records(merge_feeds(feeds), patterns, terms, accept, review, examine_all)


def classified_records(merged: DataFrame, patterns: list[str], terms: DataFrame, accept: float, review: float,
                       examine_all: bool = True, keep: Column | None = None, only: Column | None = None) -> DataFrame:
    """``classified_feed`` of records that are merged already; of those of ``only`` the routed ones of ``keep`` are written."""
    routed = classify(merged.where(since_oldest(F.col("year"))), patterns, terms, accept, review, examine_all, only)
    if keep is not None:
        routed = routed.where(keep)
    tagged = with_subjects(routed, name="subjects")
    return materialise(tagged.withColumn("topics", F.when(F.size("subjects") > 0, F.col("subjects")).otherwise(F.col("topics"))),
                       "classified")


def wanted_status(include_review: bool) -> Column:
    """Routed records that are merged: rejected ones stay out, those under review unless asked for."""
    return (F.col("status") != STATUS_REJECTED) & publishable(F.col("status"), include_review)


def merged_records(feeds: list[DataFrame], patterns: list[str], accept: float, review: float, examine_all: bool = True) -> DataFrame:
    """``merge_feeds``, written once; a record that is rejected unread leaves all behind but what decides that, and its type.

    It still takes the place of older copies, so it is not left out before.
    """
    kept = {"id", "yokId", "year", "department", "type"}
    read = readable(patterns, accept, review, examine_all)
    lean = [f.select(*[F.col(c) if c in kept else F.when(read, F.col(c)).alias(c) for c in f.columns])
            if {"year", "department"} <= set(f.columns) else f for f in feeds]
    return materialise(merge_feeds(lean), "feeds", "zstd")


def wanted_records(merged: DataFrame, patterns: list[str], terms: DataFrame, run_date: date, accept: float, review: float,
                   examine_all: bool, include_review: bool, years_back: int) -> DataFrame:
    """The routed records that a run merges: with a registry id, within its years and not rejected. Only such are joined with their scores."""
    only = F.col("yokId").isNotNull() & recent(F.col("year"), run_date, years_back) & readable(patterns, accept, review, examine_all)
    return classified_records(merged, patterns, terms, accept, review, examine_all, wanted_status(include_review), only)


def harvest_run(works: DataFrame, feeds: list[DataFrame], patterns: list[str], terms: DataFrame, run_date: date,
                accept: float, review: float, examine_all: bool = True, include_review: bool = False,
                years_back: int = YEARS_BACK) -> DataFrame:
    """The works after the run; rejected records stay out, those under review unless asked for.

    Types follow the registry for all works it knows, also by records that are too old or rejected.
    """
    merged = merged_records(feeds, patterns, accept, review, examine_all)
    works = correct_types(works, merged)
    wanted = wanted_records(merged, patterns, terms, run_date, accept, review, examine_all, include_review, years_back)
    return upsert(works, wanted, run_date, years_back)
