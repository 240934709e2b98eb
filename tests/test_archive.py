"""Files → tables → exports on a small fixture."""

import json

import pytest
from pyspark.sql import functions as F

from helpers import exported, write_content
from sijill.operators.bibliography import filter_works
from sijill.operators.graph import edges, matched_names, neighbours, neighbours_of
from sijill.operators.pages import fixed_pages, posts_with_fallback, with_alternates
from sijill.plans.archive import build_archive, export_bibliography, export_scholars, site_catalogue, table, update_graph
from sijill.sources.files import whole_files
from sijill.sources.tables import checked_feed, read_links
from sijill.sources.works import harvested_ids, unread_works


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("archive")
    paths = write_content(str(root))
    build_archive(spark, paths["content"], paths["links"], paths["places"], str(root / "tables"))
    return root


@pytest.fixture
def read(spark, archive):
    return lambda name: table(spark, str(archive / "tables"), name)


def test_links_per_line_are_those_of_whole_files(spark, tmp_path):
    links = {"a": {"teachers": {"0": "b", "1": "c"}}, "b": {"students": {"0": "a"}}, "d": {}}
    (tmp_path / "whole").mkdir()
    (tmp_path / "whole" / "links.json").write_text(json.dumps(links, indent=1))
    (tmp_path / "lines.json").write_text("\n".join(json.dumps({k: v}) for k, v in links.items()))
    whole = sorted(read_links(spark, str(tmp_path / "whole")).collect())
    assert whole == sorted(read_links(spark, str(tmp_path / "lines.json"), per_line=True).collect())
    assert len(whole) == 3


def by_id(df):
    return {r.id: r for r in df.collect()}


def test_works(read):
    works = by_id(read("works"))
    full, least, arabic = works["kaya-hukuk-2020"], works["az-nodate"], works["demir-arapca-2021"]
    assert full.title == 'Hukuk "Usulü" Üzerine' and full.titleTranslation == {"en": "On Legal Theory"}
    assert full.abstract == "Özet; \n ikinci satır." and full.yokId == 101 and full.origin == "otomatik"
    assert full.advisors == ["A Bir", "B İki"] and str(full.addedAt) == "2026-01-05"
    assert least.year is None and least.topics == [] and least.type == "tez-doktora" and least.titleTranslation is None
    assert arabic.title == "فقه الحديث" and arabic.pageCount == 311


def test_harvest_mark(spark, archive):
    files = whole_files(spark, str(archive / "content" / "works"), "*.yaml")
    assert [r.id for r in harvested_ids(files).collect()] == ["kaya-hukuk-2020"]


def test_scholars(read):
    scholars = by_id(read("scholars"))
    ali, empty, omer = scholars["ali"], scholars["bos"], scholars["omer"]
    assert ali.name.en == 'Ali b. Wali, tr: "x"' and ali.name.tr == "Ali b. Veli" and ali.featured
    assert ali.death.alt == [535, 540] and ali.death.month == 3 and ali.death.day is None and ali.birth.hijri == 500
    assert [(p.place, p.role) for p in ali.places] == [("sam", "nisbe"), ("bagdat", "ders")]
    assert ali.teachers == ["Hoca Bir", "Hoca İki"] and ali.students == [] and [w.ar for w in ali.works] == ["كتاب"]
    assert len(ali.sources) == 1 and (ali.sources[0].page, ali.sources[0].entry) == ("12-13", "46a")
    assert ali.sources[0].author == "Yazar (v. 1)" and ali.body.startswith("**علي") and ali.body.endswith("نص.")
    assert empty.birth is None and empty.death.hijri is None and empty.places == [] and empty.summary["tr"] == ""
    assert (omer.birth.hijri, omer.birth.month, omer.birth.day) == (493, 12, 10)


def test_posts_and_pages(read):
    posts = {(r.lang, r.slug): r for r in read("posts").collect()}
    assert posts["tr", "ilk"].title == "Başlık: bir" and posts["tr", "ilk"].tags == ["duyuru", "haber"]
    assert posts["tr", "ilk"].body == "Gövde --- metin" and posts["tr", "ilk"].summary == "Özet, iki: üç."
    assert posts["en", "ilk"].title == 'Title "one"' and posts["en", "ilk"].tags == ["news"]
    assert posts["ar", "tek"].tags == ["a", "b"] and str(posts["ar", "tek"].date) == "2026-09-23"
    assert {(r.lang, r.slug) for r in read("pages").collect()} == {("tr", "lisans"), ("en", "lisans")}


def test_edges_and_neighbours(read):
    pairs = [(r.teacher, r.student) for r in read("edges").collect()]
    # One pair is mentioned from both sides; one teacher has no record.
    assert sorted(pairs) == [("kayip-hoca", "ali"), ("kayip-hoca", "omer"), ("omer", "ali")]
    people = by_id(read("neighbours"))
    assert people["ali"].teacher_ids == ["omer", "kayip-hoca"] and people["ali"].student_ids == []
    assert people["kayip-hoca"].student_ids == ["ali", "omer"]
    (one,) = neighbours_of(read("edges"), "omer").collect()
    assert (one.teacher_ids, one.student_ids) == (["kayip-hoca"], ["ali"])


def test_edge_counts_agree(spark):
    mentions = spark.range(500).select(
        F.concat(F.lit("n"), (F.col("id") % 23).cast("string")).alias("id"), F.when(F.col("id") % 2 == 0, "teachers").otherwise("students").alias("role"),
        (F.col("id") % 5).cast("int").alias("idx"), F.concat(F.lit("n"), (F.col("id") % 17).cast("string")).alias("other"))
    pairs = edges(mentions).cache()
    assert pairs.select("teacher", "student").distinct().count() == pairs.count()
    sizes = neighbours(pairs, page=3, hot_rows=5).agg(F.sum(F.size("teacher_ids")), F.sum(F.size("student_ids"))).first()
    assert tuple(sizes) == (pairs.count(), pairs.count())


def test_matched_names(read):
    got = {(r.id, r.idx): (r.listed, r.ref) for r in matched_names(read("scholars"), read("mentions"), "teachers").collect()}
    assert got == {("ali", 0): ("Hoca Bir", "omer"), ("ali", 1): ("Hoca İki", "kayip-hoca")}


def test_scholar_exports(spark, archive, out_dir):
    export_scholars(spark, str(archive / "tables"), out_dir, "https://x.org/b/")
    text = exported(f"{out_dir}/scholars.csv").decode("utf-8")
    lines = text.split("\r\n")
    assert lines[0].startswith("﻿id,nameAr,nameTr") and lines[-1].startswith("yakub,") and len(lines) == 5
    # By order; lists of two are quoted, an unknown place stands for itself.
    assert lines[1] == "bos,ب,Boş,Empty,hanefi,,,,,,,,,9,9,https://x.org/b/tr/scholars/bos/,0"
    assert lines[2] == ('ali,علي,Ali b. Veli,"Ali b. Wali, tr: ""x""",hanefi,500,1106-07,Şam,534,1139,kayip,"omer; kayip-hoca",,12-13,46a,'
                        "https://x.org/b/tr/scholars/ali/,0")
    records = [json.loads(x) for x in exported(f"{out_dir}/scholars.json").decode("utf-8").splitlines()]
    assert [r["id"] for r in records] == ["bos", "ali", "omer", "yakub"]
    ali = records[1]
    assert ali["deathPlace"] == {"id": "kayip", "name": "kayip"} and ali["birthPlace"]["lat"] == 33.5
    assert ali["places"] == [{"id": "sam", "name": "Şam", "lat": 33.5, "lng": 36.3, "role": "nisbe"},
                             {"id": "bagdat", "name": "Bağdat", "lat": 33.3, "lng": 44.4, "role": "ders"}]
    assert ali["teacherIds"] == ["omer", "kayip-hoca"] and ali["source"] == {"book": "Kitap", "page": "12-13", "entry": "46a"}
    assert set(records[0]) == {"id", "url", "nameAr", "nameTr", "nameEn", "madhhab", "places", "teachers", "students", "teacherIds",
                               "studentIds", "works", "source", "part"}
    assert records[3]["deathGregorian"] == "1335" and records[3]["deathApprox"] is True


def test_bibliography_exports(spark, archive, out_dir):
    export_bibliography(spark, str(archive / "tables"), out_dir)
    csv = exported(f"{out_dir}/bibliography.csv").decode("utf-8")
    assert csv.startswith("﻿id,type,title,") and '"Hukuk ""Usulü"" Üzerine"' in csv and '"A Bir; B İki"' in csv
    bib = exported(f"{out_dir}/bibliography.bib").decode("utf-8")
    blocks = bib.split("\n\n")
    assert len(blocks) == 3 and bib.endswith("\n}\n") and not csv.endswith("\n") and csv.count("\r\n") == 3
    assert blocks[0] == (
        "@phdthesis{az-nodate,\n  author = {Az},\n  title = {Az Kayıt},\n  school = {Tek},\n  address = {Konya},\n  language = {tr}\n}")
    ris = exported(f"{out_dir}/bibliography.ris").decode("utf-8")
    assert ris.count("TY  - THES\r\n") == 3 and ris.count("ER  - \r\n") == 3 and "KW  - Fıkıh usulü\r\nKW  - Şahıs" in ris
    assert "AB  - Özet;   ikinci satır.\r\n" in ris
    rows = [json.loads(x) for x in exported(f"{out_dir}/bibliography-list.json").decode("utf-8").splitlines()]
    assert rows[0]["authors"] == "Az" and rows[2]["authors"] == "Ali Kaya" and rows[2]["university"] == "Örnek Üniversitesi"
    assert rows[0]["city"] == "Konya" and rows[0]["hasAbstract"] == 0 and "year" not in rows[0]
    assert len(exported(f"{out_dir}/bibliography.json").splitlines()) == 3


def test_only_matching_works_are_exported(spark, archive, out_dir):
    export_bibliography(spark, str(archive / "tables"), out_dir, ["json"], languages=["ar"], search="hadis ILMI")
    (row,) = exported(f"{out_dir}/bibliography.json").splitlines()
    assert json.loads(row)["id"] == "demir-arapca-2021"


def test_facets_reach_the_scan(read, capsys):
    filter_works(read("works"), types=["tez-yl"], languages=["tr", "en"], years=(2000, 2022)).select("id").explain()
    plan = capsys.readouterr().out
    assert "In(language, [en,tr])" in plan or "In(language, [tr,en])" in plan
    assert "EqualTo(type,tez-yl)" in plan or "In(type, [tez-yl])" in plan
    # The printed list of pushed filters is cut short.
    assert "GreaterThanOrEqua" in plan and "ReadSchema: struct<id:string,type:string,language:string,year:int>" in plan


def test_filters(read):
    ids = lambda **k: sorted(r.id for r in filter_works(read("works"), **k).collect())
    assert ids() == ["az-nodate", "demir-arapca-2021", "kaya-hukuk-2020"]
    assert ids(search="legal theory") == ids(subject="Fıkıh usulü") == ids(years=(None, 2020)) == ["kaya-hukuk-2020"]
    assert ids(types=["tez-doktora"], languages=["tr"]) == ["az-nodate"]
    assert ids(school="Hanefî") == []


def test_post_fallback(read):
    shown = {(r.lang, r.slug): (r.shown, r.fallback) for r in posts_with_fallback(read("posts")).collect()}
    assert shown == {("tr", "ilk"): ("tr", False), ("en", "ilk"): ("en", False), ("ar", "ilk"): ("tr", True),
                     ("tr", "tek"): ("ar", True), ("en", "tek"): ("ar", True), ("ar", "tek"): ("ar", False)}


def test_fixed_pages(spark, read):
    wanted = spark.createDataFrame([("ar", "lisans"), ("en", "lisans"), ("tr", "yok")], "lang string, slug string")
    got = {(r.lang, r.slug): (r.fallback, r.title) for r in fixed_pages(wanted, read("pages")).collect()}
    assert got == {("ar", "lisans"): (True, "Lisans"), ("en", "lisans"): (False, "Licence"), ("tr", "yok"): (True, None)}


def test_catalogue(spark, archive):
    paths = {r.path for r in site_catalogue(spark, str(archive / "tables"), base="/s").collect()}
    assert "/s/tr/bibliography/kaya-hukuk-2020/" in paths and "/s/en/bibliography/kaya-hukuk-2020/" not in paths
    assert {"/s/ar/bibliography/az-nodate/", "/s/en/scholars/ali/", "/s/ar/posts/ilk/", "/s/tr/"} <= paths
    assert not any("/search/" in p for p in paths) and len(paths) == 8 * 3 + 4 * 3 + 3 * 3 - 2 + 2 * 3


def test_alternates(spark):
    pages = spark.createDataFrame([("/s/en/about/",)], "path string")
    assert {r.alternate for r in with_alternates(pages, base="/s").collect()} == {"/s/tr/about/", "/s/en/about/", "/s/ar/about/"}


def test_no_python_workers_in_plans(spark, archive, capsys):
    site_catalogue(spark, str(archive / "tables")).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "ArrowEval" not in plan and "Cartesian" not in plan


def test_long_lists_go_on_in_further_records(spark, read):
    from sijill.operators.records import scholar_records
    many = spark.range(25).select(F.lit("ali").alias("teacher"), F.format_string("s%02d", "id").alias("student"),
                                  F.lit("ali").alias("source"), F.lit(1).alias("role_rank"), F.col("id").cast("int").alias("idx"))
    people = neighbours(many, page=10, hot_rows=8)
    rows = scholar_records(read("scholars"), read("places"), people, "https://x.org", hot_rows=1).where("id = 'ali'").collect()
    assert [r.part for r in rows] == [0, 1, 2] and [len(r.studentIds) for r in rows] == [10, 10, 5]
    assert sum((r.studentIds for r in rows), []) == [f"s{i:02d}" for i in range(25)]
    assert {r.nameTr for r in rows} == {"Ali b. Veli"} and len({r.url for r in rows}) == 1


def test_the_graph_follows_a_changed_entry(spark, archive, read, tmp_path):
    changed = spark.createDataFrame([("omer",), ("yeni",)], "id string")
    mentions = spark.createDataFrame([("omer", "students", 0, "bos"), ("yeni", "teachers", 0, "ali")], "id string, role string, idx int, other string")
    update_graph(spark, str(archive / "tables"), str(tmp_path), changed, mentions)
    known = table(spark, str(tmp_path), "mentions")
    assert known.where("id = 'omer'").count() == 1 and known.where("id = 'ali'").count() == read("mentions").where("id = 'ali'").count()
    assert sorted(table(spark, str(tmp_path), "edges").collect()) == sorted(edges(known).collect())
    got = {r.id: (r.teacher_ids, r.student_ids) for r in table(spark, str(tmp_path), "neighbours").collect()}
    assert got["ali"] == (["omer", "kayip-hoca"], ["yeni"]) and got["omer"] == ([], ["ali", "bos"])


def test_what_does_not_parse_is_named(spark, read, tmp_path):
    assert read("unread").count() == 0
    files = spark.createDataFrame([("f:/a.yaml", "title: A\nyear: 20x0\npageCount: 1\nyokId: 7b\n"), ("f:/b.yaml", ""), ("f:/c.yaml", "[[["),
                                   ("f:/d.yaml", "title: D\nyear: 2020\n"), ("f:/e.yaml", None)], "path string, value string")
    got = sorted((r.path, r.reason) for r in unread_works(files).collect())
    assert got == [("f:/a.yaml", "year is no int"), ("f:/a.yaml", "yokId is no bigint"), ("f:/b.yaml", "no field"), ("f:/c.yaml", "no field"),
                   ("f:/e.yaml", "no field")]
    (tmp_path / "f.json").write_text('{"id": "a", "n": 1}\n{"id": "b", "n"\n\n{"id": "c", "n": "x"}\n{"id": "d"}\n')
    good, bad = checked_feed(spark, str(tmp_path), "id string, n int")
    assert sorted(tuple(r) for r in good.collect()) == [("a", 1), ("d", None)] and good.columns == ["id", "n"]
    assert sorted(r.line for r in bad.collect()) == ['{"id": "b", "n"', '{"id": "c", "n": "x"}'] and bad.first().path.endswith("f.json")
