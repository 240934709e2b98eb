"""Places, links and flat records."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from checks.data import BASE, EDGES, LIST_PAGE, PEOPLE, PLACES, mentions, places, scholars, sql_cell, sql_excerpt, sql_miladi, table
from sijill.functions.text import summary_text
from sijill.operators.graph import (edges, edges_of, flatten_links, matched_names, neighbours, pairs, student_ids, teacher_ids,
                                    update_pairs)
from sijill.operators.places import (bounding_boxes, century_places, gazetteer, itineraries, listed_places, map_points, place_lists,
                                     with_place)
from sijill.operators.records import in_order, scholar_records
from sijill.session import materialise
from sijill.sinks import exports
from sijill.sinks.exports import scholar_csv
from sijill.values import SCHOLAR_CSV_COLUMNS

QUERIES, ORACLE = {}, {}


def _edges(spark, sf_dir):
    """The edge table, written once: several lists are read from it."""
    return materialise(edges(mentions(spark, sf_dir)), "edges")


# --- places ---------------------------------------------------------------------

def place_lookup_fallback(spark, sf_dir):
    found = with_place(scholars(spark, sf_dir), F.col("death.place"), "deathPlace", gazetteer(places(spark, sf_dir)), ["id"])
    return found.select("id", F.col("deathPlace.id").alias("place"), F.col("deathPlace.name").alias("place_name"),
                        F.col("deathPlace.lat").alias("lat"), F.col("deathPlace.lng").alias("lng"))


QUERIES["place_lookup_fallback"] = place_lookup_fallback
ORACLE["place_lookup_fallback"] = f"""
WITH {PEOPLE}, {PLACES}
SELECT s.id, dplace AS place, coalesce(p.name, dplace) AS place_name, lat, lng FROM scholars s LEFT JOIN places p ON p.id = dplace"""


def place_array_lookup(spark, sf_dir):
    lists = place_lists(scholars(spark, sf_dir), gazetteer(places(spark, sf_dir)))
    line = F.transform("places", lambda p: F.concat_ws("|", p["id"], p["name"], p["role"], F.round(p["lng"], 2).cast("string")))
    return lists.select("id", F.array_join(line, ";").alias("places"))


QUERIES["place_array_lookup"] = place_array_lookup
ORACLE["place_array_lookup"] = f"""
WITH {PEOPLE}, {PLACES}, listed AS (
  SELECT id, 0 AS pos, p0 AS place, 'nisbe' AS role FROM scholars WHERE p0 IS NOT NULL
  UNION ALL SELECT id, 1, p1, 'ders' FROM scholars WHERE p1 IS NOT NULL)
SELECT l.id, string_agg(concat_ws('|', l.place, coalesce(p.name, l.place), l.role, CAST(p.lng AS VARCHAR)), ';' ORDER BY pos) AS places
FROM listed l LEFT JOIN places p ON p.id = l.place GROUP BY l.id"""


def century_place_counts(spark, sf_dir):
    return century_places(scholars(spark, sf_dir), gazetteer(places(spark, sf_dir)))


QUERIES["century_place_counts"] = century_place_counts
ORACLE["century_place_counts"] = f"""
WITH {PEOPLE}, {PLACES}, dated AS (
  SELECT id, p0, p1, CAST((coalesce(dh, bh + 60) + 99) // 100 AS INTEGER) AS century FROM scholars),
listed AS (SELECT id, century, p0 AS place FROM dated UNION SELECT id, century, p1 FROM dated)
SELECT century, place, coalesce(name, place) AS place_name, count(*) AS scholars
FROM listed LEFT JOIN places p ON p.id = place WHERE century IS NOT NULL AND place IS NOT NULL GROUP BY ALL"""


def bbox(spark, sf_dir):
    points = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("key"), (F.col("c_acctbal") / 100).alias("lat"), F.col("c_custkey").cast("double").alias("lng"))
    return bounding_boxes(points, "key")


QUERIES["bbox"] = bbox
ORACLE["bbox"] = """
SELECT key, n AS points, s - (e - s) * 0.5 AS south, e + (e - s) * 0.5 AS north, w - (o - w) * 0.5 AS west, o + (o - w) * 0.5 AS east
FROM (SELECT c_nationkey AS key, count(*) AS n, min(c_acctbal / 100) AS s, max(c_acctbal / 100) AS e,
        CAST(min(c_custkey) AS DOUBLE) AS w, CAST(max(c_custkey) AS DOUBLE) AS o FROM customer GROUP BY 1)"""


def itinerary(spark, sf_dir):
    rows = itineraries(map_points(scholars(spark, sf_dir), gazetteer(places(spark, sf_dir))))
    return rows.select("id", F.array_join("points.name", ";").alias("names"), F.array_join("points.role", ";").alias("roles"),
                       F.array_join("points.nameAr", ";").alias("names_ar"), F.array_join(F.transform("points.approx", lambda a: a.cast("string")), ";").alias("approx"),
                       F.size("points").alias("points"),
                       F.col("path").isNotNull().alias("has_path"), "labelled",
                       F.aggregate(F.coalesce("path", F.array().cast("array<array<double>>")), F.lit(0.0),
                                   lambda a, p: a + p[1]).alias("lng_sum"))


QUERIES["itinerary"] = itinerary
ORACLE["itinerary"] = f"""
WITH {PEOPLE}, {PLACES}, listed AS (
  SELECT id, 0 AS pos, p0 AS place, 'nisbe' AS role FROM scholars WHERE p0 IS NOT NULL
  UNION ALL SELECT id, 1, p1, 'ders' FROM scholars WHERE p1 IS NOT NULL)
SELECT l.id, string_agg(p.name, ';' ORDER BY pos) AS names, string_agg(CASE WHEN p.id IS NOT NULL THEN l.role END, ';' ORDER BY pos) AS roles,
  string_agg(p.ar, ';' ORDER BY pos) AS names_ar, string_agg(CAST(p.approx AS VARCHAR), ';' ORDER BY pos) AS approx, CAST(count(p.id) AS INTEGER) AS points, count(p.id) > 1 AS has_path,
  true AS labelled, CASE WHEN count(p.id) > 1 THEN sum(p.lng) ELSE 0.0 END AS lng_sum
FROM listed l LEFT JOIN places p ON p.id = l.place GROUP BY l.id"""


# --- links ----------------------------------------------------------------------

def edges_distinct(spark, sf_dir):
    return edges(mentions(spark, sf_dir))


QUERIES["edges_distinct"] = edges_distinct
ORACLE["edges_distinct"] = f"WITH {EDGES} SELECT * FROM edges"


def edges_updated(spark, sf_dir):
    """All suppliers mention anew, without their second lines; what customers mention stays."""
    known = materialise(mentions(spark, sf_dir), "mentions")
    changed = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"))
    return edges_of(update_pairs(materialise(pairs(known), "pairs"), changed, known.where(F.col("idx") != 2)))


QUERIES["edges_updated"] = edges_updated
ORACLE["edges_updated"] = f"""
WITH {EDGES.replace("FROM lineitem JOIN orders ON l_orderkey = o_orderkey)", "FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber <> 2)")} SELECT * FROM edges"""


def link_flatten(spark, sf_dir):
    # Nested maps per order: its lines are two lists, numbered from 0, so a map is as small as its domain.
    role = F.when(F.col("l_linenumber") % 2 == 1, "teachers").otherwise("students").alias("role")
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", role).agg(F.array_sort(F.collect_list("l_suppkey")).alias("ids"))
    numbered = F.map_from_entries(F.transform("ids", lambda s, i: F.struct(i.cast("string"), F.concat(F.lit("s"), s.cast("string")))))
    roles = lists.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("role", numbered))).alias("m"))
    return flatten_links(roles.select(F.create_map(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")), "m").alias("links")))


QUERIES["link_flatten"] = link_flatten
ORACLE["link_flatten"] = """
WITH lines AS (SELECT l_orderkey, l_suppkey, CASE WHEN l_linenumber % 2 = 1 THEN 'teachers' ELSE 'students' END AS role FROM lineitem)
SELECT 'o' || l_orderkey AS id, role, CAST(row_number() OVER (PARTITION BY l_orderkey, role ORDER BY l_suppkey) - 1 AS INTEGER) AS idx,
  's' || l_suppkey AS other FROM lines"""


def _joined(df, *lists):
    return df.select("id", "part", *[F.array_join(c, ";").alias(c) for c in lists])


QUERIES["teacher_ids"] = lambda spark, sf_dir: _joined(teacher_ids(_edges(spark, sf_dir), LIST_PAGE), "teacher_ids")
ORACLE["teacher_ids"] = f"WITH {EDGES} SELECT id, CAST(part AS INTEGER) AS part, ids AS teacher_ids FROM teacher_lists"

QUERIES["student_ids"] = lambda spark, sf_dir: _joined(student_ids(_edges(spark, sf_dir), LIST_PAGE), "student_ids")
ORACLE["student_ids"] = f"WITH {EDGES} SELECT id, CAST(part AS INTEGER) AS part, ids AS student_ids FROM student_lists"

QUERIES["neighbours"] = lambda spark, sf_dir: _joined(neighbours(_edges(spark, sf_dir), LIST_PAGE), "teacher_ids", "student_ids")
ORACLE["neighbours"] = f"""
WITH {EDGES}
SELECT id, CAST(part AS INTEGER) AS part, coalesce(t.ids, '') AS teacher_ids, coalesce(s.ids, '') AS student_ids
FROM teacher_lists t FULL JOIN student_lists s USING (id, part)"""


def positional_ref(spark, sf_dir):
    # The mentions of an entry under a role are numbered from 0, so that each has a position of its own.
    at = Window.partitionBy("id", "role").orderBy("idx", "other")
    numbered = mentions(spark, sf_dir).withColumn("idx", F.row_number().over(at) - 1)
    people = scholars(spark, sf_dir)
    return (matched_names(people, numbered, "teachers").withColumn("role", F.lit("teachers"))
            .unionByName(matched_names(people, numbered, "students").withColumn("role", F.lit("students"))))


QUERIES["positional_ref"] = positional_ref
ORACLE["positional_ref"] = f"""
WITH {PEOPLE}, {EDGES}, names AS (
  SELECT id, 'teachers' AS role, 0 AS idx, 'T' || k % 10 AS listed FROM scholars UNION ALL SELECT id, 'teachers', 1, 'T' || k % 11 FROM scholars
  UNION ALL SELECT id, 'teachers', 2, 'T' || k % 12 FROM scholars UNION ALL SELECT id, 'students', 0, 'S' || k % 10 FROM scholars WHERE k % 2 = 0),
known AS (SELECT id, role, row_number() OVER (PARTITION BY id, role ORDER BY idx, other) - 1 AS idx, other AS ref FROM mentions)
SELECT n.id, n.role, n.idx, n.listed, k.ref FROM names n LEFT JOIN known k ON k.id = n.id AND k.role = n.role AND k.idx = n.idx"""


# --- records --------------------------------------------------------------------

def records(spark, sf_dir):
    people = materialise(neighbours(_edges(spark, sf_dir), LIST_PAGE), "neighbours")
    return scholar_records(scholars(spark, sf_dir), places(spark, sf_dir), people, BASE)


def flat_record(spark, sf_dir):
    """The flagship: one flat record per scholar, nested fields as text."""
    place = lambda c: F.concat_ws("|", F.col(c)["id"], F.col(c)["name"], F.round(F.col(c)["lng"], 2).cast("string"))
    listed = F.transform("places", lambda p: F.concat_ws("|", p["id"], p["name"], p["role"]))
    joined = {c: F.array_join(c, ";").alias(c) for c in ("teachers", "students", "teacherIds", "studentIds", "works")}
    return in_order(records(spark, sf_dir)).select(
        "id", "part", "order", "url", "nameAr", "nameTr", "nameEn", "madhhab", "birthHijri", "birthGregorian",
        place("birthPlace").alias("birthPlace"), "deathHijri", "deathGregorian", "deathApprox", place("deathPlace").alias("deathPlace"),
        F.array_join(listed, ";").alias("places"), *joined.values(),
        F.concat_ws("|", "source.book", "source.page", "source.entry").alias("source"))


_RECORDS = f"""{PEOPLE}, {PLACES}, {EDGES},
listed AS (
  SELECT id, 0 AS pos, p0 AS place, 'nisbe' AS role FROM scholars WHERE p0 IS NOT NULL
  UNION ALL SELECT id, 1, p1, 'ders' FROM scholars WHERE p1 IS NOT NULL),
place_lists AS (
  SELECT l.id, string_agg(concat_ws('|', l.place, coalesce(p.name, l.place), l.role), ';' ORDER BY pos) AS places
  FROM listed l LEFT JOIN places p ON p.id = l.place GROUP BY l.id),
pages AS (
  SELECT id, 0 AS part FROM scholars UNION SELECT id, part FROM teacher_lists UNION SELECT id, part FROM student_lists),
records AS (
  SELECT s.id, CAST(g.part AS INTEGER) AS part, CAST(ord AS INTEGER) AS "order",
    '{BASE}/tr/scholars/' || s.id || '/' AS url, 'ar-' || nm AS nameAr, nm AS nameTr, nm || ' b. ' || nat AS nameEn, seg AS madhhab,
    CAST(bh AS INTEGER) AS birthHijri, CASE WHEN bh IS NOT NULL THEN {sql_miladi('bh', 'bm', 'bd')} END AS birthGregorian,
    bplace, bp.name AS bname, bp.lng AS blng, CAST(dh AS INTEGER) AS deathHijri,
    CASE WHEN dh IS NOT NULL THEN {sql_miladi('dh', 'dm', 'dd')} END AS deathGregorian, dapprox AS deathApprox,
    dplace, coalesce(dp.name, dplace) AS dname, dp.lng AS dlng, coalesce(pl.places, '') AS places,
    'T' || k % 10 || ';T' || k % 11 || ';T' || k % 12 AS teachers, CASE WHEN k % 2 = 0 THEN 'S' || k % 10 ELSE '' END AS students,
    coalesce(t.ids, '') AS teacherIds, coalesce(st.ids, '') AS studentIds,
    CASE WHEN k % 5 <> 0 THEN 'W' || k || ';V' || k ELSE '' END AS works,
    'B' || k % 3 AS book, k % 300 || '-' || k % 300 + 1 AS page, k % 500 || 'a' AS entry
  FROM scholars s JOIN pages g ON g.id = s.id LEFT JOIN places bp ON bp.id = bplace LEFT JOIN places dp ON dp.id = dplace
  LEFT JOIN place_lists pl ON pl.id = s.id
  LEFT JOIN teacher_lists t ON t.id = s.id AND t.part = g.part LEFT JOIN student_lists st ON st.id = s.id AND st.part = g.part)"""

_PLAIN = ["url", "nameAr", "nameTr", "nameEn", "madhhab", "birthHijri", "birthGregorian", "deathHijri", "deathGregorian", "deathApprox"]


QUERIES["flat_record"] = flat_record
ORACLE["flat_record"] = f"""
WITH {_RECORDS}
SELECT id, part, "order", {', '.join(_PLAIN)}, concat_ws('|', bplace, bname, CAST(blng AS VARCHAR)) AS birthPlace,
  concat_ws('|', dplace, dname, CAST(dlng AS VARCHAR)) AS deathPlace, places, teachers, students, works, teacherIds, studentIds,
  concat_ws('|', book, page, entry) AS source
FROM records"""


def csv_lines(spark, sf_dir):
    return scholar_csv(records(spark, sf_dir)).select(F.coalesce("order", F.lit(-1)).alias("ord"), F.coalesce("part", F.lit(0)).alias("part"), "value")


def _csv_cells() -> str:
    cells = {"birthPlace": "bname", "deathPlace": "dname", "teacherIds": "replace(teacherIds, ';', '; ')",
             "studentIds": "replace(studentIds, ';', '; ')", "sourcePage": "page", "sourceEntry": "entry"}
    return " || ',' || ".join(sql_cell(f"CAST({cells.get(c, c)} AS VARCHAR)") for c in [*SCHOLAR_CSV_COLUMNS, "part"])


QUERIES["csv_lines"] = csv_lines
ORACLE["csv_lines"] = f"""
WITH {_RECORDS}
SELECT -1 AS ord, 0 AS part, chr(65279) || '{','.join([*SCHOLAR_CSV_COLUMNS, 'part'])}' AS value
UNION ALL SELECT "order", part, {_csv_cells()} FROM records"""


def scholar_json(spark, sf_dir):
    """The records as JSON, absent fields left out."""
    return exports.scholar_json(records(spark, sf_dir))


def _json_strings(column: str, separator: str = ";") -> str:
    return f"""CASE WHEN {column} = '' THEN '[]' ELSE '["' || replace({column}, '{separator}', '","') || '"]' END"""


def _json_place(key: str, name: str, prefix: str) -> str:
    """Members of a place; coordinates only where the gazetteer has them."""
    return f"""'{{"id":"' || {key} || '","name":"' || {name} || '"' || coalesce(',"lat":' || {prefix}.lat || ',"lng":' || {prefix}.lng, '')"""


QUERIES["scholar_json"] = scholar_json
ORACLE["scholar_json"] = f"""
WITH {_RECORDS},
json_places AS (
  SELECT l.id, string_agg({_json_place('l.place', 'coalesce(p.name, l.place)', 'p')} || ',"role":"' || l.role || '"}}', ',' ORDER BY pos) AS places
  FROM listed l LEFT JOIN places p ON p.id = l.place GROUP BY l.id)
SELECT "order", part, '{{"id":"' || r.id || '","url":"' || url || '","nameAr":"' || nameAr || '","nameTr":"' || nameTr || '","nameEn":"' || nameEn || '","madhhab":"' || madhhab || '"'
  || coalesce(',"birthHijri":' || birthHijri || ',"birthGregorian":"' || birthGregorian || '","birthPlace":' || {_json_place('bplace', 'bp.name', 'bp')} || '}}', '')
  || coalesce(',"deathHijri":' || deathHijri || ',"deathGregorian":"' || deathGregorian || '","deathApprox":' || deathApprox
       || ',"deathPlace":' || {_json_place('dplace', 'dname', 'dp')} || '}}', '')
  || ',"places":[' || coalesce(jp.places, '') || '],"teachers":' || {_json_strings('teachers')} || ',"students":' || {_json_strings('students')}
  || ',"teacherIds":' || {_json_strings('teacherIds')} || ',"studentIds":' || {_json_strings('studentIds')} || ',"works":' || {_json_strings('r.works')}
  || ',"source":{{"book":"' || book || '","page":"' || page || '","entry":"' || entry || '"}},"part":' || part || '}}' AS value
FROM records r LEFT JOIN json_places jp ON jp.id = r.id LEFT JOIN places bp ON bp.id = bplace LEFT JOIN places dp ON dp.id = dplace"""


def summary_lang(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.create_map(F.lit("tr"), F.when(F.col("doc_id") % 2 == 0, F.col("source")), F.lit("en"), F.col("lang")).alias("summary"))
    return d.select("doc_id", *[summary_text(F.col("summary"), F.col("text"), x).alias(f"summary_{x}") for x in ("tr", "en", "ar")])


QUERIES["summary_lang"] = summary_lang
ORACLE["summary_lang"] = f"""
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE lang END AS summary_tr, lang AS summary_en, {sql_excerpt('text')} AS summary_ar
FROM documents"""
