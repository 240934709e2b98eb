"""Harvest jobs on a small feed."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from sijill.operators import entries as entries_module
from sijill.operators.entries import entry_slice, entry_text
from sijill.operators.harvest import (cap_results, classify, correct_types, in_department, merge_feeds, publishable, recent,
                                      restricted_due, term_scores, unit_due, upsert, with_subjects)
from sijill.plans.harvest import harvest_run, merged_records
from sijill.streaming.landing import snapshot_path, take_new_files

RUN = date(2026, 9, 24)
WORK = ("id string, type string, title string, authors array<string>, language string, year int, city string, topics array<string>, "
        "abstract string, department string, yokId bigint, origin string, addedAt date")
FEED = "id string, type string, title string, authors array<string>, language string, year int, city string, topics array<string>, abstract string, department string, yokId bigint"
TERMS = [("fikih_usulu", "title", "fıkıh usulü", 3.0), ("iktisat", "abstract", "faiz", 1.0), ("iktisat", "abstract", "banka", 0.5), ("fikih", "title", "fıkıh", 1.0)]


def work(id, yok=None, origin=None, type="tez-yl", title="T", year=2026, author="Kaya, Ali", abstract=None, department=None):
    return (id, type, title, [author], "tr", year, "X", [], abstract, department, yok, origin, date(2026, 1, 1))


def feed(id, yok, type="tez-yl", title="T", year=2026, author="Kaya, Ali", abstract=None, department=None):
    return work(id, yok, None, type, title, year, author, abstract, department)[:11]


@pytest.fixture
def terms(spark):
    return spark.createDataFrame(TERMS, "category string, field string, term string, weight double")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_filters(spark):
    rows = spark.createDataFrame([("a", "inceleme", 2026, date(2026, 8, 25), None), ("b", "kabul", 2025, date(2026, 8, 26), "u"),
                                  ("c", None, 2024, None, None), ("d", "kabul", None, date(2026, 6, 26), None)],
                                 "id string, status string, year int, last_checked date, fullText string")
    assert ids(rows.where(publishable(F.col("status")))) == ["b", "c", "d"]
    assert ids(rows.where(publishable(F.col("status"), include_review=True))) == ["a", "b", "c", "d"]
    assert ids(rows.where(recent(F.col("year"), RUN))) == ["a", "b"]
    assert ids(rows.where(unit_due(F.col("last_checked"), RUN))) == ["a", "c", "d"]
    assert ids(rows.where(restricted_due(F.col("fullText"), F.col("last_checked"), RUN))) == ["c", "d"]


def test_the_later_feed_wins_and_records_without_a_number_stay(spark):
    first = spark.createDataFrame([("a", 1, "old"), ("b", 2, "only"), ("x", None, "n1"), ("y", None, "n2")], "id string, yokId bigint, title string")
    second = spark.createDataFrame([("z", 1, "new"), ("x", None, "n3")], "id string, yokId bigint, title string")
    merged = sorted((r.yokId or 0, r.title) for r in merge_feeds([first, second]).collect())
    assert merged == [(0, "n2"), (0, "n3"), (1, "new"), (2, "only")]


def test_cap(spark):
    rows = spark.range(100).select(F.lit("q").alias("q"), "id")
    assert [r.id for r in cap_results(rows, "q", ["id"], ["id"], cap=3).orderBy("id").collect()] == [0, 1, 2]


def test_departments(spark):
    rows = spark.createDataFrame([("a", "Temel / İSLAM HUKUKU Bilim Dalı"), ("b", "Tarih"), ("c", None)], "id string, d string")
    assert ids(rows.where(in_department(F.col("d"), ["İslam Hukuku"]))) == ["a"]


def test_terms_count_once_per_field_and_match_whole_words(spark, terms):
    rows = spark.createDataFrame([feed("a", 1, title="FIKIH Usulü: fıkıh usulü", abstract="faiz faiz bankacılık"), feed("b", 2, title="fıkıh tarihi usulü")], FEED)
    got = {(r.id, r.category): float(r.score) for r in term_scores(rows, terms).collect()}
    assert got == {("a", "fikih_usulu"): 3.0, ("a", "fikih"): 1.0, ("a", "iktisat"): 1.0, ("b", "fikih"): 1.0}


def test_terms_agree_when_the_rule_table_is_too_large_to_broadcast(spark, terms, monkeypatch):
    from sijill.operators.scale import Lookup
    rows = spark.createDataFrame([feed("a", 1, title="fıkıh usulü", abstract="banka, faiz")], FEED)
    expected = sorted(map(tuple, term_scores(rows, terms).collect()))
    monkeypatch.setattr(Lookup, "is_small", False)
    assert sorted(map(tuple, term_scores(rows, terms).collect())) == expected


def test_routes_and_subjects(spark, terms):
    rows = spark.createDataFrame([feed("a", 1, title="Fıkıh usulü", department="Hukuk"), feed("b", 2, abstract="faiz ve banka", department="Tarih"),
                                  feed("c", 3, department="Hukuk")], FEED)
    routed = classify(rows, ["hukuk"], terms, accept=2.0, review=1.0)
    assert {r.id: r.status for r in routed.collect()} == {"a": "kabul", "b": "inceleme", "c": "red"}
    only = classify(rows, ["hukuk"], terms, accept=2.0, review=1.0, examine_all=False)
    assert {r.id: r.status for r in only.collect()} == {"a": "kabul", "b": "red", "c": "red"}
    # The general category carries no label.
    assert {r.id: r.subjects for r in with_subjects(routed, name="subjects").collect()} == {"a": ["Fıkıh usulü"], "b": [], "c": []}


def test_types_follow_the_registry(spark):
    works = spark.createDataFrame([("a", 1, "tez-yl"), ("b", 2, "tez-yl"), ("c", None, "tez-yl")], "id string, yokId bigint, type string")
    registry = spark.createDataFrame([(1, "tez-doktora"), (None, "kitap")], "yokId bigint, type string")
    assert {r.id: r.type for r in correct_types(works, registry).collect()} == {"a": "tez-doktora", "b": "tez-yl", "c": "tez-yl"}


def _upserted(spark, hot_rows=10**9, **options):
    works = spark.createDataFrame([
        work("manual", 1, title="Old"), work("auto", 2, "otomatik", title="Old"), work("old-year", 3, "otomatik", title="Old"),
        work("nameless", None), work("kaya-yeni-2026"), work("kaya-yeni-2026-3")], WORK)
    new = spark.createDataFrame([
        feed("f1", 1, "tez-doktora", "New"), feed("f2", 2, "tez-doktora", "New"), feed("f3", 3, "tez-doktora", "New", year=2020),
        feed("f4", 4, title="Yeni"), feed("f5", 5, title="Yeni"), feed("f6", 6, title="Başka", year=2025)], FEED)
    return {r.id: r for r in upsert(works, new, RUN, hot_rows=hot_rows, **options).collect()}


@pytest.mark.parametrize("hot_rows", [1, 10**9])
def test_upsert(spark, hot_rows):
    got = _upserted(spark, hot_rows)
    assert (got["manual"].title, got["manual"].type, got["manual"].origin) == ("Old", "tez-doktora", None)
    assert (got["auto"].title, got["auto"].type, got["auto"].origin) == ("New", "tez-doktora", "otomatik")
    assert got["old-year"].title == "Old" and "nameless" in got
    # New ids go on after those already taken.
    assert {i: got[i].yokId for i in got if i.startswith("kaya-yeni")} == {
        "kaya-yeni-2026": None, "kaya-yeni-2026-3": None, "kaya-yeni-2026-4": 4, "kaya-yeni-2026-5": 5}
    fresh = got["kaya-baska-2025"]
    assert (fresh.yokId, fresh.origin, fresh.addedAt) == (6, "otomatik", RUN) and len(got) == 9


def test_types_stay_when_asked(spark):
    assert _upserted(spark, correct_type=False)["manual"].type == "tez-yl"


def test_a_run(spark, terms):
    works = spark.createDataFrame([work("manual", 1)], WORK)
    copy = spark.createDataFrame([feed("a", 10, title="Fıkıh usulü eski", year=1949), feed("b", 11, title="Fıkıh usulü bir")], FEED)
    registry = spark.createDataFrame([feed("b2", 11, title="Fıkıh usulü iki"), feed("c", 12, abstract="faiz"), feed("d", 13)], FEED)
    def run(**k):
        return {r.yokId: r for r in harvest_run(works, [copy, registry], ["hukuk"], terms, RUN, 2.0, 1.0, **k).collect()}
    got = run()
    assert set(got) == {1, 11} and got[11].title == "Fıkıh usulü iki" and got[11].topics == ["Fıkıh usulü"]
    assert set(run(include_review=True)) == {1, 11, 12}


def test_new_files_are_taken_once(spark, out_dir, tmp_path):
    landing, seen = tmp_path / "landing", []
    landing.mkdir()
    def job(df, number):
        df.write.mode("overwrite").json(snapshot_path(out_dir, number))
        seen.append((number, sorted(r.id for r in spark.read.json(snapshot_path(out_dir, number)).collect())))
    def land(name, *records):
        (landing / name).write_text("\n".join(json.dumps(r) for r in records), encoding="utf-8")
    land("1.json", {"id": "a"}, {"id": "b"})
    for _ in range(2):
        take_new_files(spark, str(landing), "id string", str(tmp_path / "progress"), job)
    land("2.json", {"id": "c"})
    take_new_files(spark, str(landing), "id string", str(tmp_path / "progress"), job)
    assert seen == [(0, ["a", "b"]), (1, ["c"])]


def test_entry_slices(spark):
    entries = spark.range(50).select((F.col("id") * 3).cast("int").alias("n"), F.lit(1).alias("pageStart"), F.lit(2).alias("pageEnd"),
                                     F.lit("H").alias("heading"), F.lit("t").alias("text"))
    part = entry_slice(entries, 3, 5, ["n"])
    assert sorted((r.position, r.n) for r in part.collect()) == [(3, 6), (4, 9), (5, 12)]
    assert entry_text(part).orderBy("n").first().value == "## 6 [1-2] H\nt\n"


def test_records_without_any_id_are_all_kept(spark):
    feed = spark.createDataFrame([(None, None, "a"), (None, None, "b"), ("x", 1, "c")], "id string, yokId bigint, title string")
    assert sorted(r.title for r in merge_feeds([feed]).collect()) == ["a", "b", "c"]


def test_a_registry_id_that_repeats_does_not_multiply_works(spark):
    works = spark.createDataFrame([("a", 1, "kitap")], "id string, yokId bigint, type string")
    registry = spark.createDataFrame([(1, "tez-yl"), (1, "tez-doktora")], "yokId bigint, type string")
    assert [tuple(r) for r in correct_types(works, registry).collect()] == [("a", 1, "tez-yl")]


def test_new_ids_avoid_published_ones_and_fields_the_feed_lacks_stay(spark):
    from datetime import date

    from sijill.operators.harvest import upsert

    schema = "id string, yokId bigint, origin string, addedAt date, title string, authors array<string>, year int, type string, city string"
    day = date(2026, 1, 2)
    old = [("abdulrazaq-1149-2026", 1, "otomatik", day, "1149", ["Abdulrazaq"], 2026, "tez-yl", "Van"),
           ("2026", 2, "otomatik", day, "", ["李"], 2026, "tez-yl", "Muş"), ("2026-1", 3, "otomatik", day, "", ["王"], 2026, "tez-yl", None)]
    feed = spark.createDataFrame([(1, "1149", ["Abdulrazaq"], 2026, "tez-yl"), (9, "1149", ["Abdulrazaq"], 2026, "tez-yl"), (8, "", ["張"], 2026, "tez-yl")],
                                 "yokId bigint, title string, authors array<string>, year int, type string")
    out = upsert(spark.createDataFrame(old, schema), feed, day).collect()
    ids = {r.yokId: r.id for r in out}
    assert len(set(ids.values())) == len(out) == 5
    assert ids[9] == "abdulrazaq-1149-2026-1" and {r.yokId: r.city for r in out}[1] == "Van"


@pytest.mark.parametrize("front", [10_000, 0])
def test_a_slice_of_equal_keys_has_its_number_of_rows(spark, monkeypatch, front):
    monkeypatch.setattr(entries_module, "FRONT", front)
    rows = [(k, f"h{k}{c}", {"a": "b"}) for k in (3, 1, 2, None) for c in "abc"] + [(2, "same", None)] * 3
    entries = spark.createDataFrame(rows, "n int, heading string, `odd.name` map<string, string>")
    whole = sorted((r.position, r.n, r.heading) for r in entry_slice(entries, 1, 15, ["n"]).collect())
    assert [p for p, _, _ in whole] == list(range(1, 16)) and [n for _, n, _ in whole] == [None] * 3 + [1] * 3 + [2] * 6 + [3] * 3
    assert sorted(h for _, _, h in whole) == sorted(h for _, h, _ in rows)
    for first, last in ((1, 3), (1, 2), (5, 5), (6, 13), (14, 40), (16, 20), (3, 2)):
        part = sorted((r.position, r.n, r.heading) for r in entry_slice(entries, first, last, ["n"]).collect())
        assert part == whole[first - 1:last]


def test_a_ranked_table_reads_the_slices_it_needs(spark, out_dir):
    entries = spark.range(5000).select((F.col("id") * 7 % 5000).cast("int").alias("n"), F.col("id").cast("string").alias("text"))
    entries_module.write_ranked(entries, ["n"], out_dir + "/ranked", slice_rows=500)
    part = entries_module.ranked_slice(spark, out_dir + "/ranked", ["n"], 1201, 1204)
    assert sorted((r.position, r.n) for r in part.collect()) == [(1201 + k, 1200 + k) for k in range(4)]
    files = {f for f in part.inputFiles() if "/rows/" in f}
    slices = spark.read.parquet(out_dir + "/ranked/slices").count()
    assert slices == 10 and "PartitionFilters" in part._jdf.queryExecution().toString() and len(files) >= 1
    assert spark.read.parquet(out_dir + "/ranked/rows").where("_slice = 2").count() <= 1000


def test_an_entry_slice_keeps_a_missing_key(spark):
    entries = spark.createDataFrame([(None, "a"), (2, "b"), (1, "c")], "n int, heading string")
    rows = entry_slice(entries, 1, 2, ["n"]).collect()
    assert sorted((r.position, r.heading) for r in rows) == [(1, "a"), (2, "c")]


def test_records_that_are_rejected_unread_leave_their_texts_behind(spark):
    schema = "id string, yokId long, year int, type string, department string, abstract string"
    copy = spark.createDataFrame([("a1", 1, 2020, "x", "Hukuk", "old"), ("a2", 2, 2020, "x", "Hukuk", "read"), ("a3", 3, 1900, "x", "Hukuk", "early"),
                                  ("a4", 4, None, "x", "Hukuk", "no year"), ("a5", None, 2020, "x", "Tarih", "no id")], schema)
    registry = spark.createDataFrame([("b1", 1, 2020, "y", "Tarih", "new")], schema)

    def merged(*limits, **k):
        return {r.id: (r.type, r.abstract) for r in merged_records([copy, registry], ["hukuk"], *limits, **k).collect()}

    # A newer copy of another department still takes the older one's place, and gives its type.
    assert merged(2.0, 1.0, examine_all=False) == {"b1": ("y", None), "a2": ("x", "read"), "a3": ("x", None), "a4": ("x", None), "a5": ("x", None)}
    assert merged(2.0, 1.0) == {"b1": ("y", "new"), "a2": ("x", "read"), "a3": ("x", None), "a4": ("x", None), "a5": ("x", "no id")}
    # Where a score of 0 is enough, unread records are merged and stay whole.
    assert {a for _, a in merged(2.0, 0.0, examine_all=False).values()} == {"new", "read", "early", "no year", "no id"}
