"""Record files: their text is composed from the tables and must parse back to the same values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from checks.data import EDGES, PEOPLE, PLACES, WORKS, mentions, places, scholars, table, works
from sijill.operators.graph import flatten_links
from sijill.session import shared_path
from sijill.sources.posts import parse_pages, parse_posts
from sijill.sources.scholars import parse_scholars
from sijill.sources.tables import LINKS, parse_places, read_links
from sijill.sources.works import harvested_ids, parse_works

QUERIES, ORACLE = {}, {}


def _quoted(text: Column) -> Column:
    """A double-quoted value."""
    return F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", "")


def _lines(*lines: Column) -> Column:
    return F.concat_ws("\n", *lines)


def _field(key: str, value: Column) -> Column:
    return F.concat(F.lit(f"{key}: "), value)


# --- works ----------------------------------------------------------------------

def _work_files(spark, sf_dir):
    w = works(spark, sf_dir)
    some = lambda c: F.when(F.size(c) > 0, F.to_json(c))
    text = _lines(
        _field("type", F.when(F.col("year") % 2 == 0, F.col("type")).otherwise(_quoted(F.col("type")))),
        # A control character, as some files have.
        F.concat(F.lit("title: \u0007"), _quoted(F.col("title"))), _field("titleTranslation", F.to_json("titleTranslation")),
        _field("authors", F.to_json("authors")), _field("language", F.col("language")), _field("year", F.col("year").cast("string")),
        _field("university", _quoted(F.col("university"))), _field("city", F.when(F.col("city").isNotNull(), _quoted(F.col("city")))),
        _field("department", F.col("department")), _field("advisors", some("advisors")), _field("topics", some("topics")),
        _field("pageCount", F.col("pageCount").cast("string")), _field("url", _quoted(F.col("url"))),
        _field("fullText", F.when(F.col("fullText").isNotNull(), _quoted(F.col("fullText")))),
        _field("abstract", F.when(F.col("abstract").isNotNull(), _quoted(F.col("abstract")))),
        _field("yokId", F.col("yokId").cast("string")), _field("origin", F.col("origin")),
        _field("addedAt", F.date_format("addedAt", "yyyy-MM-dd")))
    return w.select(F.concat(F.lit("file:/archive/works/"), "id", F.lit(".yaml")).alias("path"), F.concat(text, F.lit("\n")).alias("value"))


def ingest_works(spark, sf_dir):
    return parse_works(_work_files(spark, sf_dir)).withColumns({
        "titleTranslation": F.col("titleTranslation")["en"], "authors": F.array_join("authors", "|"),
        "advisors": F.array_join("advisors", "|"), "topics": F.array_join("topics", "|")})


QUERIES["ingest_works"] = ingest_works
ORACLE["ingest_works"] = f"""
WITH {WORKS}
SELECT id, type, title, translation AS titleTranslation, author AS authors, language, year, university, city, department,
  array_to_string(advisors, '|') AS advisors, array_to_string(topics, '|') AS topics, pageCount, url, fullText, abstract, yokId, origin, addedAt
FROM works"""

QUERIES["harvested_flag"] = lambda spark, sf_dir: harvested_ids(_work_files(spark, sf_dir))
ORACLE["harvested_flag"] = f"WITH {WORKS} SELECT id FROM works WHERE origin = 'otomatik'"


# --- scholars -------------------------------------------------------------------

def _scholar_files(spark, sf_dir):
    s = scholars(spark, sf_dir)

    def date(key: str) -> Column:
        d = F.col(key)
        part = lambda name: F.concat(F.lit(f"  {name}: "), d[name].cast("string"))
        alt = F.when(F.size(d["alt"]) > 0, F.concat(F.lit("  alt: ["), F.array_join(d["alt"].cast("array<string>"), ", "), F.lit("]")))
        lines = _lines(part("hijri"), part("month"), part("day"), F.when(d["approx"], F.lit("  approx: true")), alt, part("place"))
        return F.when(d.isNull(), None).when(lines == "", F.lit(f"{key}: {{}}")).otherwise(F.concat(F.lit(f"{key}:\n"), lines))

    def inline(key: str, fields: dict[str, Column]) -> Column:
        inner = F.concat_ws(", ", *[F.concat(F.lit(f"{k}: "), _quoted(v)) for k, v in fields.items()])
        return F.concat(F.lit(f"{key}: {{ "), inner, F.lit(" }"))

    place_lines = F.transform("places", lambda p: F.concat(F.lit("  - { place: "), p["place"], F.lit(", role: "), p["role"], F.lit(" }")))
    work_lines = F.transform("works", lambda w: F.concat(F.lit("  - { ar: "), _quoted(w["ar"]), F.lit(" }")))
    block = lambda key, lines: F.concat(F.lit(f"{key}:\n"), F.array_join(lines, "\n"))
    src = F.col("sources")[0]
    text = _lines(
        F.lit("---"), inline("name", {x: F.concat(F.col("name")[x], F.lit(' "q", tr: x')) for x in ("ar", "tr", "en")}),
        F.concat(F.lit("fullNameAr: "), _quoted(F.col("name.ar"))), F.concat(F.lit("madhhab: "), "madhhab"), date("birth"), date("death"),
        block("places", place_lines), F.concat(F.lit("teachers: "), F.to_json("teachers")), F.concat(F.lit("students: "), F.to_json("students")),
        block("works", work_lines), inline("summary", {x: F.coalesce(F.col("summary")[x], F.lit("-")) for x in ("tr", "en")}),
        F.lit("addedAt: 2026-09-23"), F.concat(F.lit("order: "), F.col("order").cast("string")), F.lit("featured: false"),
        F.concat(F.lit("sources:\n  - book: "), _quoted(src["book"])), F.lit('    bookTr: "t"'), F.lit('    author: "a (b: c)"'),
        F.lit('    authorTr: "x"'), F.lit('    edition: "e: f"'), F.concat(F.lit("    page: "), _quoted(src["page"])),
        F.concat(F.lit("    entry: "), _quoted(src["entry"])), F.lit("---"),
        F.concat(F.lit("**"), F.col("name.ar"), F.lit("**\n\n"), F.col("name.en"), F.lit(".\n---\nend\n")))
    return s.select(F.concat(F.lit("file:/archive/scholars/"), "id", F.lit(".md")).alias("path"), text.alias("value"))


def ingest_scholars(spark, sf_dir):
    s = parse_scholars(_scholar_files(spark, sf_dir))
    date = lambda c: F.concat_ws("|", *[F.coalesce(F.col(c)[p].cast("string"), F.lit("-")) for p in ("hijri", "month", "day", "approx", "place")],
                                 F.array_join(F.col(c)["alt"].cast("array<string>"), ","))
    return s.select(
        "id", F.concat_ws("|", "name.ar", "name.tr", "name.en").alias("names"), "fullNameAr", "madhhab",
        F.col("birth").isNull().alias("no_birth"), F.col("birth.hijri").alias("birthHijri"), date("death").alias("death"),
        F.array_join(F.transform("places", lambda p: F.concat_ws(":", p["place"], p["role"])), "|").alias("places"),
        F.array_join("teachers", "|").alias("teachers"), F.array_join("students", "|").alias("students"),
        F.array_join("works.ar", "|").alias("works"), F.col("summary")["tr"].alias("tr"), F.col("summary")["en"].alias("en"), "order", "featured",
        "addedAt", F.array_join(F.transform("sources", lambda x: F.concat_ws("|", *[x[f] for f in ("book", "bookTr", "author", "authorTr", "edition", "page", "entry")])), ";").alias("sources"),
        "body")


_QUIRK = """ "q", tr: x"""
QUERIES["ingest_scholars"] = ingest_scholars
ORACLE["ingest_scholars"] = f"""
WITH {PEOPLE}
SELECT id, concat_ws('|', 'ar-' || nm || '{_QUIRK}', nm || '{_QUIRK}', nm || ' b. ' || nat || '{_QUIRK}') AS names, 'ar-' || nm AS fullNameAr, seg AS madhhab,
  bh IS NULL AS no_birth, CAST(bh AS INTEGER) AS birthHijri,
  concat_ws('|', coalesce(CAST(dh AS VARCHAR), '-'), coalesce(CAST(dm AS VARCHAR), '-'), coalesce(CAST(dd AS VARCHAR), '-'),
    CASE WHEN dapprox THEN 'true' ELSE '-' END, coalesce(dplace, '-'), concat_ws(',', alt1, alt2)) AS death,
  CASE WHEN p0 IS NULL THEN '' ELSE p0 || ':nisbe|' || p1 || ':ders' END AS places,
  'T' || k % 10 || '|T' || k % 11 || '|T' || k % 12 AS teachers, CASE WHEN k % 2 = 0 THEN 'S' || k % 10 ELSE '' END AS students,
  CASE WHEN k % 5 <> 0 THEN 'W' || k || '|V' || k ELSE '' END AS works, 'tr ' || nm AS tr, CASE WHEN k % 2 = 0 THEN 'en ' || nm ELSE '-' END AS en,
  CAST(ord AS INTEGER) AS "order", false AS featured, DATE '2026-09-23' AS addedAt,
  concat_ws('|', 'B' || k % 3, 't', 'a (b: c)', 'x', 'e: f', k % 300 || '-' || k % 300 + 1, k % 500 || 'a') AS sources,
  '**ar-' || nm || '**' || chr(10) || chr(10) || nm || ' b. ' || nat || '.' || chr(10) || '---' || chr(10) || 'end' AS body
FROM scholars"""


# --- posts and pages ------------------------------------------------------------

def _post_files(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    title = F.when(k % 3 == 0, F.concat(F.lit("'it''s: "), "source", F.lit("'"))).when(k % 3 == 1, F.concat("source", F.lit(" plain"))).otherwise(
        F.concat(F.lit('"quoted \\"'), "source", F.lit('\\""')))
    tags = F.when(k % 2 == 0, F.concat(F.lit("["), "lang", F.lit(", "), "source", F.lit("]"))).otherwise(F.to_json(F.array("lang", "source")))
    text = F.concat(F.lit("---\nphoto: p\ntitle: "), title, F.lit("\ndate: 2026-09-2"), (k % 10).cast("string"), F.lit("\nsummary: A, b: c\nlead: L\ntags: "),
                    tags, F.lit("\n---\n\n"), "text", F.lit("\n"))
    return d.select(F.concat(F.lit("file:/archive/posts/"), "lang", F.lit("/d"), k.cast("string"), F.lit(".md")).alias("path"), text.alias("value"))


_TITLE_SQL = "CASE doc_id % 3 WHEN 0 THEN 'it''s: ' || source WHEN 1 THEN source || ' plain' ELSE 'quoted \"' || source || '\"' END"
_BODY_SQL = r"regexp_replace(text, '^[ \t\n\v\f\r]+|[ \t\n\v\f\r]+$', '', 'g')"

QUERIES["ingest_posts"] = lambda spark, sf_dir: parse_posts(_post_files(spark, sf_dir)).withColumn("tags", F.array_join("tags", "|"))
ORACLE["ingest_posts"] = f"""
SELECT lang, 'd' || doc_id AS slug, 'p' AS photo, {_TITLE_SQL} AS title, CAST('2026-09-2' || doc_id % 10 AS DATE) AS date, 'A, b: c' AS summary,
  lang || '|' || source AS tags, {_BODY_SQL} AS body FROM documents"""

QUERIES["ingest_pages"] = lambda spark, sf_dir: parse_pages(_post_files(spark, sf_dir))
ORACLE["ingest_pages"] = f"""
SELECT lang, 'd' || doc_id AS slug, {_TITLE_SQL} AS title, 'L' AS lead, 'p' AS photo, {_BODY_SQL} AS body FROM documents"""


# --- links and gazetteer --------------------------------------------------------

def link_map(spark, sf_dir):
    """One JSON object per mention, as a split link file has it."""
    m = mentions(spark, sf_dir).distinct()
    doc = F.concat(F.lit('{"'), "id", F.lit('":{"'), "role", F.lit('":{"'), F.col("idx").cast("string"), F.lit('":"'), "other", F.lit('"}}}'))
    return flatten_links(m.select(F.from_json(doc, LINKS).alias("links")))


QUERIES["link_map"] = link_map
ORACLE["link_map"] = f"WITH {EDGES} SELECT DISTINCT id, role, idx, other FROM mentions"


def links_file(spark, sf_dir):
    """The same mentions through files, read from any place of them on."""
    m = mentions(spark, sf_dir).distinct()
    doc = F.concat(F.lit('{"'), "id", F.lit('": {"'), "role", F.lit('": {"'), F.col("idx").cast("string"), F.lit('": "'), "other", F.lit('"}}}'))
    folder = shared_path(spark, "links")
    m.select(doc.alias("value")).write.text(folder)
    return read_links(spark, folder, pattern="part-*")


QUERIES["links_file"] = links_file
ORACLE["links_file"] = ORACLE["link_map"]


def gazetteer_json(spark, sf_dir):
    p = places(spark, sf_dir)
    doc = F.concat(F.lit('{"'), "id", F.lit('":'), F.to_json(F.struct("name", "lat", "lng")), F.lit("}"))
    return parse_places(p.select(doc.alias("value"))).select("id", F.col("name.tr").alias("name"), "lat", "lng")


QUERIES["gazetteer_scan"] = gazetteer_json
ORACLE["gazetteer_scan"] = f"WITH {PLACES} SELECT id, name, lat, lng FROM places"
