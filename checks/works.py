"""Bibliography: list rows, filters, references, ids and exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.data import (PEOPLE, WORKS, scholars, sql_cell, sql_excerpt, sql_fold, sql_list, sql_snippet, table, works)
from sijill.functions.names import department_parts, display_name, display_names, university_name
from sijill.functions.text import excerpt, has_text, snippet
from sijill.operators.bibliography import citations, filter_works, linked_scholars, with_label, with_slugs
from sijill.operators.records import WORK_COLUMNS, compact_rows
from sijill.operators.search import search_titles, write_search_index
from sijill.session import shared_path
from sijill.sinks.exports import BOM, work_bibtex, work_csv, work_json, work_ris
from sijill.values import SCHOOLS, WORK_TYPES

QUERIES, ORACLE = {}, {}


# --- texts ----------------------------------------------------------------------

QUERIES["excerpt_220"] = lambda spark, sf_dir: table(spark, sf_dir, "documents").select(
    "doc_id", excerpt(F.concat(F.lit("\n**"), "source", F.lit("**\n\n"), "text", F.lit(" **kept**"))).alias("excerpt"),
    excerpt(F.col("text"), 60).alias("short"))
ORACLE["excerpt_220"] = f"""
SELECT doc_id, {sql_excerpt("(chr(10) || '**' || source || '**' || chr(10) || chr(10) || text || ' **kept**')")} AS excerpt,
  {sql_excerpt('text', 60)} AS short FROM documents"""

QUERIES["snippet_260"] = lambda spark, sf_dir: works(spark, sf_dir).select(
    "id", snippet(F.col("abstract")).alias("snippet"), has_text(F.col("abstract")).alias("has_abstract"))
ORACLE["snippet_260"] = f"""
WITH {WORKS} SELECT id, {sql_snippet('abstract')} AS snippet, CASE WHEN length(abstract) > 0 THEN 1 ELSE 0 END AS has_abstract FROM works"""


def compact(spark, sf_dir):
    return compact_rows(works(spark, sf_dir)).withColumns({
        "advisors": F.array_join("advisors", ";"), "topics": F.array_join("topics", ";")})


_DISPLAY = """CASE WHEN contains(author, ', ') THEN split_part(author, ', ', 2) || ' ' || split_part(author, ', ', 1) ELSE author END"""
QUERIES["compact_rows"] = compact
ORACLE["compact_rows"] = f"""
WITH {WORKS}
SELECT id, type, language, split_part(university, ',', 1) AS university, university AS universityFull,
  array_to_string(advisors, ';') AS advisors, array_to_string(topics, ';') AS topics, year, pageCount,
  CASE WHEN length(abstract) > 0 THEN 1 ELSE 0 END AS hasAbstract, coalesce(fullText, '') AS fullText, title,
  {_DISPLAY} AS authors, coalesce(city, '') AS city, {sql_snippet('abstract')} AS abstractSnippet
FROM works"""

QUERIES["author_display"] = lambda spark, sf_dir: works(spark, sf_dir).select("id", display_names(F.col("authors")).alias("authors"))
ORACLE["author_display"] = f"WITH {WORKS} SELECT id, {_DISPLAY} AS authors FROM works"

QUERIES["university_short"] = lambda spark, sf_dir: works(spark, sf_dir).groupBy(
    university_name(F.col("university")).alias("university")).agg(F.count("*").alias("works"))
ORACLE["university_short"] = f"WITH {WORKS} SELECT split_part(university, ',', 1) AS university, count(*) AS works FROM works GROUP BY 1"


def department_split(spark, sf_dir):
    return works(spark, sf_dir).select("id", department_parts(F.col("department")).alias("p")).select("id", "p.first", "p.last")


QUERIES["department_split"] = department_split
ORACLE["department_split"] = f"""
WITH {WORKS} SELECT id, split_part(department, ' / ', 1) AS first, split_part(department, ' / ', -1) AS last FROM works"""


# --- filters --------------------------------------------------------------------

def _facets(spark, sf_dir):
    return filter_works(works(spark, sf_dir), types=["tez-yl", "kitap"], languages=["en", "fr"], years=(1950, 2020),
                        school="Mâlikî", subject="Topic 7")


QUERIES["facet_filter"] = lambda spark, sf_dir: _facets(spark, sf_dir).select("id", "type", "language", "year")
ORACLE["facet_filter"] = f"""
WITH {WORKS} SELECT id, type, language, year FROM works
WHERE type IN ('tez-yl', 'kitap') AND language IN ('en', 'fr') AND year BETWEEN 1950 AND 2020
  AND list_contains(topics, 'Mâlikî') AND list_contains(topics, 'Topic 7')"""

QUERIES["facet_export"] = lambda spark, sf_dir: work_csv(_facets(spark, sf_dir).select(*WORK_COLUMNS)).select(
    F.coalesce("id", F.lit("")).alias("id"), "value")

QUERIES["title_search"] = lambda spark, sf_dir: filter_works(works(spark, sf_dir), search="İLMİ SRC1").select("id", "title").unionByName(
    filter_works(works(spark, sf_dir), search="the THAT").select("id", "title"))
ORACLE["title_search"] = f"""
WITH {WORKS}, queries AS (SELECT unnest(['İLMİ SRC1', 'the THAT']) AS q)
SELECT id, title FROM works, queries
WHERE contains({sql_fold('title')}, {sql_fold('q')}) OR contains({sql_fold('translation')}, {sql_fold('q')})"""


def title_search_index(spark, sf_dir):
    """Four searches of one index: several words, a rare sequence, two letters, and letters that no title has in a row."""
    folder = shared_path(spark, "search-index")
    write_search_index(works(spark, sf_dir), folder, buckets=16)
    return reduce(DataFrame.unionByName, [search_titles(spark, folder, q).select("id", F.lit(q).alias("query")) for q in _SEARCHES])


_SEARCHES = ["İLMİ SRC1", "the THAT", "th", "zzqzz"]
QUERIES["title_search_index"] = title_search_index
ORACLE["title_search_index"] = f"""
WITH {WORKS}, queries AS (SELECT unnest({_SEARCHES}) AS q)
SELECT DISTINCT id, q AS query FROM works, queries
WHERE contains({sql_fold('title')}, {sql_fold('q')}) OR contains({sql_fold('translation')}, {sql_fold('q')})"""


# --- references and labels ------------------------------------------------------

_FORMS = [("B0", "en", "First {page}.", "Short {page}.", "Book zero."), ("B0", "fr", "Premier {page}.", "Court {page}.", "Livre zéro."),
          ("B1", "en", "One, p. {page}; see {page}.", "One {page}", "Book one."), ("B1", "de", "Eins {page}", "E {page}", "Buch eins.")]


def citation_forms(spark, sf_dir):
    forms = spark.createDataFrame([(b, x, ["first", "short", "list"], n, s, bib) for b, x, n, s, bib in _FORMS],
                                  "book string, lang string, styles array<string>, note_tpl string, short_tpl string, bib string")
    d = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("B"), (F.col("doc_id") % 3).cast("string")).alias("book"), "lang",
        F.concat(F.col("n_chars").cast("string"), F.lit("-"), (F.col("n_chars") + 1).cast("string")).alias("page"))
    return citations(d, forms, ["doc_id"]).withColumn("styles", F.array_join("styles", ";"))


_FORM_ROWS = ", ".join("(" + ", ".join("'" + v + "'" for v in row) + ")" for row in _FORMS)
QUERIES["citation_forms"] = citation_forms
ORACLE["citation_forms"] = f"""
WITH forms(book, lang, n, s, bib) AS (VALUES {_FORM_ROWS}),
src AS (SELECT doc_id, 'B' || doc_id % 3 AS book, lang, n_chars || '-' || n_chars + 1 AS page FROM documents)
SELECT doc_id, book, lang, page, CASE WHEN f.n IS NOT NULL THEN 'first;short;list' END AS styles,
  replace(n, '{{page}}', page) AS note, replace(s, '{{page}}', page) AS short, bib
FROM src LEFT JOIN forms f USING (book, lang)"""


def label_lookup(spark, sf_dir):
    d = works(spark, sf_dir).select("id", "type", "language", F.when(F.col("language") == "en", "hanefi").otherwise("zahiri").alias("school"))
    return with_label(with_label(d, "work_type", "type", "language", "type_label"), "school", "school", "language", "school_label")


_LABEL_SQL = lambda rows: ", ".join(f"('{r[0]}', '{x}', '{r[i]}')" for r in rows for i, x in enumerate(("tr", "en", "ar"), 1))
QUERIES["label_lookup"] = label_lookup
ORACLE["label_lookup"] = f"""
WITH {WORKS}, t(k, l, type_label) AS (VALUES {_LABEL_SQL(WORK_TYPES)}), s(k, l, school_label) AS (VALUES {_LABEL_SQL(SCHOOLS)}),
d AS (SELECT id, type, language, CASE WHEN language = 'en' THEN 'hanefi' ELSE 'zahiri' END AS school FROM works)
SELECT id, type, language, school, type_label, school_label
FROM d LEFT JOIN t ON t.k = type AND t.l = language LEFT JOIN s ON s.k = school AND s.l = language"""


def work_scholar_link(spark, sf_dir):
    # Parts give two links to every work; a third of them lead to one scholar.
    k = F.col("p_partkey")
    half = F.floor(k / 2)
    link = table(spark, sf_dir, "part").select(
        F.concat(F.lit("w"), half.cast("string")).alias("work"),
        F.concat(F.lit("c"), F.when(k % 3 == 0, 1).otherwise(half + 1).cast("string")).alias("scholar"))
    return linked_scholars(works(spark, sf_dir), link, scholars(spark, sf_dir)).select("work", "scholar", "title", F.col("name.tr").alias("name"))


QUERIES["work_scholar_link"] = work_scholar_link
ORACLE["work_scholar_link"] = f"""
WITH {WORKS}, {PEOPLE}, link AS (
  SELECT 'w' || p_partkey // 2 AS work, 'c' || CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE p_partkey // 2 + 1 END AS scholar FROM part)
SELECT work, scholar, title, nm AS name FROM link JOIN works w ON w.id = work JOIN scholars s ON s.id = scholar"""

QUERIES["slug_ids"] = lambda spark, sf_dir: with_slugs(works(spark, sf_dir), ["yokId", "id"]).select("id", "slug")
_PLAIN_SQL = lambda t: f"regexp_replace(regexp_replace(lower(translate({t}, 'çğıöşüâîûÇĞİIÖŞÜÂÎÛ', 'cgiosuaiucgiiosuaiu')), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"
ORACLE["slug_ids"] = f"""
WITH {WORKS}, parts AS (
  SELECT id, yokId, {_PLAIN_SQL("split_part(author, ',', 1)")} AS surname,
    list_filter(string_split({_PLAIN_SQL('title')}, '-'), lambda w: length(w) > 3)[1:2] AS ws, coalesce(CAST(year AS VARCHAR), 'nodate') AS y FROM works),
based AS (SELECT id, yokId, array_to_string(list_filter([surname] || ws || [y], lambda p: p <> ''), '-') AS base FROM parts),
ranked AS (SELECT id, base, row_number() OVER (PARTITION BY base ORDER BY yokId NULLS FIRST, id) AS n FROM based)
SELECT id, base || CASE WHEN n > 1 THEN '-' || n - 1 ELSE '' END AS slug FROM ranked"""


# --- exports --------------------------------------------------------------------

QUERIES["bibtex_blocks"] = lambda spark, sf_dir: work_bibtex(works(spark, sf_dir))
_bib = lambda name, value: (
    f"CASE WHEN length(CAST({value} AS VARCHAR)) > 0 THEN '  {name} = {{' || "
    rf"regexp_replace(CAST({value} AS VARCHAR), '([{{}}\\])', '\\\1', 'g') || '}}' END")
ORACLE["bibtex_blocks"] = f"""
WITH {WORKS}
SELECT id, '@' || CASE type WHEN 'tez-doktora' THEN 'phdthesis' ELSE 'mastersthesis' END || '{{' || id || ',' || chr(10) ||
  concat_ws(',' || chr(10), {', '.join(_bib(n, v) for n, v in [
      ('author', 'author'), ('title', 'title'), ('school', 'university'), ('address', 'city'), ('year', 'year'),
      ('language', 'language'), ('keywords', "array_to_string(topics, ', ')"), ('url', 'url'), ('abstract', 'abstract')])})
  || chr(10) || '}}' AS value
FROM works"""

QUERIES["ris_blocks"] = lambda spark, sf_dir: work_ris(works(spark, sf_dir))
_ris = lambda tag, value: f"CASE WHEN length(CAST({value} AS VARCHAR)) > 0 THEN '{tag}  - ' || regexp_replace(CAST({value} AS VARCHAR), '[\\r\\n]+', ' ', 'g') END"
ORACLE["ris_blocks"] = f"""
WITH {WORKS}
SELECT id, concat_ws(chr(13) || chr(10), 'TY  - THES', {', '.join(
    f"CASE WHEN len(topics) > 0 THEN array_to_string(list_transform(topics, lambda t: 'KW  - ' || t), chr(13) || chr(10)) END" if tag == 'KW'
    else _ris(tag, v) for tag, v in [('ID', 'id'), ('TI', 'title'), ('AU', 'author'), ('PB', 'university'), ('CY', 'city'), ('PY', 'year'),
                                     ('LA', 'language'), ('KW', ''), ('UR', 'url'), ('AB', 'abstract')])}, 'ER  - ') AS value
FROM works"""

_CSV = {"titleTranslation": "translation", "authors": "author", "advisors": "array_to_string(advisors, '; ')",
        "topics": "array_to_string(topics, '; ')"}


def _csv_sql(condition: str = "true") -> str:
    cells = " || ',' || ".join(sql_cell(_CSV.get(c, c)) for c in WORK_COLUMNS)
    return f"""
WITH {WORKS}
SELECT '' AS id, chr(65279) || '{','.join(WORK_COLUMNS)}' AS value
UNION ALL SELECT id, {cells} FROM works WHERE {condition}"""


QUERIES["work_csv_lines"] = lambda spark, sf_dir: work_csv(works(spark, sf_dir)).select(F.coalesce("id", F.lit("")).alias("id"), "value")
ORACLE["work_csv_lines"] = _csv_sql()
ORACLE["facet_export"] = _csv_sql("""type IN ('tez-yl', 'kitap') AND language IN ('en', 'fr') AND year BETWEEN 1950 AND 2020
  AND list_contains(topics, 'Mâlikî') AND list_contains(topics, 'Topic 7')""")


QUERIES["json_rows"] = lambda spark, sf_dir: work_json(works(spark, sf_dir))
_JSON = {"titleTranslation": "{'en': translation}", "authors": "[author]"}


def _member(c: str) -> str:
    """A member of a work's JSON, null where the work lacks it."""
    value = _JSON.get(c, c)
    return f"""CASE WHEN {value} IS NOT NULL THEN '"{c}":' || to_json({value}) END"""


ORACLE["json_rows"] = f"""
WITH {WORKS}
SELECT id, '{{' || concat_ws(',', {', '.join(map(_member, WORK_COLUMNS))}) || '}}' AS value FROM works"""
