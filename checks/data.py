"""Archive-shaped tables derived from the test tables, in Spark and as SQL.

Customers and suppliers stand for scholars, nations for places, order lines for links and
documents for works. Derivations are plain column expressions over whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sijill.functions.dating import Words

EN = Words(died="d.", approx="c.", other_reports="other reports")
BASE = "https://archive.example/site"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- places ---------------------------------------------------------------------

def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"),
        F.struct(F.col("n_name").alias("tr"), F.when(F.col("n_nationkey") % 4 != 0, _text("ar-", F.col("n_name"))).alias("ar")).alias("name"),
        (F.col("n_regionkey") * F.lit(10.5)).alias("lat"), (F.col("n_nationkey") * F.lit(1.25)).alias("lng"),
        F.when(F.col("n_nationkey") % 3 != 0, F.col("n_nationkey") % 2 == 0).alias("approx"))


PLACES = """places AS (
  SELECT 'n' || n_nationkey AS id, n_name AS name, n_regionkey * 10.5::DOUBLE AS lat, n_nationkey * 1.25::DOUBLE AS lng,
    CASE WHEN n_nationkey % 4 <> 0 THEN 'ar-' || n_name ELSE n_name END AS ar, n_nationkey % 3 <> 0 AND n_nationkey % 2 = 0 AS approx
  FROM nation)"""


# --- scholars -------------------------------------------------------------------

def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_custkey").alias("k"),
        F.col("c_name").alias("nm"), F.col("c_nationkey").alias("nat"), F.lower("c_mktsegment").alias("seg"),
        (F.col("c_custkey") * 2).alias("ord"))
    s = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_suppkey").alias("k"),
        F.col("s_name").alias("nm"), F.col("s_nationkey").alias("nat"), F.lit("hanefi").alias("seg"),
        (F.col("s_suppkey") * 2 + 1).alias("ord"))
    # A table may be one row group, and so one task; what follows costs far more than moving these few columns. The number
    # is given, as Spark would put so few bytes back into one task.
    return c.unionByName(s).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")


PEOPLE = """people AS (
  SELECT 'c' || c_custkey AS id, c_custkey AS k, c_name AS nm, c_nationkey AS nat, lower(c_mktsegment) AS seg, c_custkey * 2 AS ord
  FROM customer
  UNION ALL
  SELECT 's' || s_suppkey, s_suppkey, s_name, s_nationkey, 'hanefi', s_suppkey * 2 + 1 FROM supplier),
scholars AS (
  SELECT id, k, nm, nat, seg, ord,
    CASE WHEN k % 4 <> 0 THEN 1 + k % 1400 END AS bh, CASE WHEN k % 4 <> 0 THEN k % 13 END AS bm, CASE WHEN k % 4 <> 0 THEN k % 30 END AS bd,
    CASE WHEN k % 4 <> 0 THEN 'n' || nat END AS bplace,
    CASE WHEN k % 3 <> 0 THEN 1 + (k * 7) % 1450 END AS dh, CASE WHEN k % 3 <> 0 THEN (k * 5) % 13 END AS dm,
    CASE WHEN k % 3 <> 0 THEN (k * 11) % 30 END AS dd, CASE WHEN k % 3 <> 0 THEN k % 5 = 0 END AS dapprox,
    CASE WHEN k % 6 = 1 THEN 1 + k % 1400 END AS alt1, CASE WHEN k % 6 = 1 THEN 2 + k % 1300 END AS alt2,
    CASE WHEN k % 3 <> 0 THEN 'n' || (nat + k % 3 * 10) END AS dplace,
    CASE WHEN k % 7 <> 0 THEN 'n' || nat END AS p0, CASE WHEN k % 7 <> 0 THEN 'n' || (nat + k) % 30 END AS p1
  FROM people)"""


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def scholars(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, nat = F.col("k"), F.col("nat")

    def date(h: Column, m: Column, d: Column, approx: Column, alt: Column, place: Column) -> Column:
        return F.struct(h.cast("int").alias("hijri"), m.cast("int").alias("month"), d.cast("int").alias("day"),
                        approx.alias("approx"), alt.alias("alt"), place.alias("place"))

    no_years = F.array().cast("array<int>")
    dead = k % 3 != 0
    alt = F.when(k % 6 == 1, F.array((1 + k % 1400).cast("int"), (2 + k % 1300).cast("int"))).otherwise(no_years)
    entry = lambda place, role: F.struct(place.alias("place"), F.lit(role).alias("role"))
    return _people(spark, sf_dir).select(
        "id", F.struct(_text("ar-", F.col("nm")).alias("ar"), F.col("nm").alias("tr"), _text(F.col("nm"), " b. ", nat).alias("en")).alias("name"),
        F.col("seg").alias("madhhab"),
        F.when(k % 4 != 0, date(1 + k % 1400, k % 13, k % 30, F.lit(False), no_years, _text("n", nat))).alias("birth"),
        date(F.when(dead, 1 + (k * 7) % 1450), F.when(dead, (k * 5) % 13), F.when(dead, (k * 11) % 30), F.when(dead, k % 5 == 0),
             alt, F.when(dead, _text("n", nat + k % 3 * 10))).alias("death"),
        F.when(k % 7 != 0, F.array(entry(_text("n", nat), "nisbe"), entry(_text("n", (nat + k) % 30), "ders"))).alias("places"),
        F.array(_text("T", k % 10), _text("T", k % 11), _text("T", k % 12)).alias("teachers"),
        F.when(k % 2 == 0, F.array(_text("S", k % 10))).alias("students"),
        F.when(k % 5 != 0, F.array(F.struct(_text("W", k).alias("ar")), F.struct(_text("V", k).alias("ar")))).alias("works"),
        F.create_map(F.lit("tr"), _text("tr ", F.col("nm")), F.lit("en"), F.when(k % 2 == 0, _text("en ", F.col("nm")))).alias("summary"),
        F.col("ord").cast("int").alias("order"),
        F.array(F.struct(_text("B", k % 3).alias("book"), _text(k % 300, "-", k % 300 + 1).alias("page"), _text(k % 500, "a").alias("entry"))).alias("sources"),
    )


# --- links ----------------------------------------------------------------------

def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier teaches the customers of its order lines; odd lines are the customer's mention."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    s, c = _text("s", F.col("l_suppkey")), _text("c", F.col("o_custkey"))
    odd = F.col("l_linenumber") % 2 == 1
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.when(odd, c).otherwise(s).alias("id"), F.when(odd, "teachers").otherwise("students").alias("role"),
        F.col("l_linenumber").alias("idx"), F.when(odd, s).otherwise(c).alias("other"))


LIST_PAGE = 50  # ids of a part in the checks, so that lists go on in several; as in the SQL below
EDGES = """mentions AS (
  SELECT CASE WHEN l_linenumber % 2 = 1 THEN 'c' || o_custkey ELSE 's' || l_suppkey END AS id,
         CASE WHEN l_linenumber % 2 = 1 THEN 'teachers' ELSE 'students' END AS role, l_linenumber AS idx,
         CASE WHEN l_linenumber % 2 = 1 THEN 's' || l_suppkey ELSE 'c' || o_custkey END AS other
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
ranked_mentions AS (
  SELECT CASE WHEN role = 'teachers' THEN other ELSE id END AS teacher, CASE WHEN role = 'teachers' THEN id ELSE other END AS student,
         id AS source, CASE WHEN role = 'teachers' THEN 0 ELSE 1 END AS role_rank, idx FROM mentions),
edges AS (
  SELECT teacher, student, source, role_rank, idx FROM (
    SELECT *, row_number() OVER (PARTITION BY teacher, student ORDER BY source, role_rank, idx) AS rn FROM ranked_mentions)
  WHERE rn = 1),
teacher_lists AS (
  SELECT id, part, string_agg(teacher, ';' ORDER BY rn) AS ids FROM (
    SELECT student AS id, teacher, rn, (rn - 1) // 50 AS part FROM (
      SELECT *, row_number() OVER (PARTITION BY student ORDER BY source, role_rank, idx, teacher) AS rn FROM edges))
  GROUP BY id, part),
student_lists AS (
  SELECT id, part, string_agg(student, ';' ORDER BY rn) AS ids FROM (
    SELECT teacher AS id, student, rn, (rn - 1) // 50 AS part FROM (
      SELECT *, row_number() OVER (PARTITION BY teacher ORDER BY source, role_rank, idx, student) AS rn FROM edges))
  GROUP BY id, part)"""


# --- works ----------------------------------------------------------------------

def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l_doc_id"), "quality")
    k = F.col("doc_id")
    none = F.array().cast("array<string>")
    return d.join(lab, k == F.col("l_doc_id"), "left").select(
        _text("w", k).alias("id"),
        F.when(k % 3 == 0, "tez-doktora").otherwise("tez-yl").alias("type"),
        F.replace("text", F.lit("\n"), F.lit(" ")).alias("title"),
        F.create_map(F.lit("en"), _text("İlmi ", F.col("source"), " Ölçü ", k % 50)).alias("titleTranslation"),
        F.array(F.when(k % 10 == 0, _text("Ünal", k % 97)).otherwise(_text("Çelik", k % 97, ", Ayşe ", F.col("lang")))).alias("authors"),
        F.col("lang").alias("language"),
        F.when(k % 20 != 0, 1940 + k % 87).cast("int").alias("year"),
        F.when(k % 9 == 0, F.col("source")).otherwise(_text("Univ ", F.col("source"), ", Inst; ", F.col("lang"))).alias("university"),
        F.when(k % 8 != 0, F.upper("lang")).alias("city"),
        F.when(k % 6 != 0, _text("Temel ", F.col("lang"), F.when(k % 2 == 0, " / Hukuk ").otherwise(" / Orta / Din "), F.col("source"))).alias("department"),
        F.when(k % 5 != 0, F.array(_text("A ", k % 7), _text("B, ", k % 3))).otherwise(none).alias("advisors"),
        F.when(k % 4 != 0, F.array(_text("Topic ", k % 35), F.when(k % 3 == 0, "Hanefî").otherwise("Mâlikî"))).otherwise(none).alias("topics"),
        F.when(k % 13 == 0, 100 + k % 500).cast("int").alias("pageCount"),
        _text("http://x.example/", k).alias("url"),
        F.when(k % 7 != 0, _text("http://y.example/", k)).alias("fullText"),
        F.when(k % 11 != 0, F.col("text")).alias("abstract"),
        F.when(k % 30 != 0, 500000 + k).alias("yokId"),
        F.when(F.col("quality").isNotNull(), "otomatik").alias("origin"),
        F.date_add(F.lit("2026-01-01").cast("date"), (k % 200).cast("int")).alias("addedAt"),
    )


# The same columns; arrays are kept as lists.
WORKS = """works AS (
  SELECT 'w' || k AS id, k, CASE WHEN k % 3 = 0 THEN 'tez-doktora' ELSE 'tez-yl' END AS type,
    replace(text, chr(10), ' ') AS title, 'İlmi ' || source || ' Ölçü ' || k % 50 AS translation,
    CASE WHEN k % 10 = 0 THEN 'Ünal' || k % 97 ELSE 'Çelik' || k % 97 || ', Ayşe ' || lang END AS author,
    lang AS language, CASE WHEN k % 20 <> 0 THEN CAST(1940 + k % 87 AS INTEGER) END AS year,
    CASE WHEN k % 9 = 0 THEN source ELSE 'Univ ' || source || ', Inst; ' || lang END AS university,
    CASE WHEN k % 8 <> 0 THEN upper(lang) END AS city,
    CASE WHEN k % 6 <> 0 THEN 'Temel ' || lang || CASE WHEN k % 2 = 0 THEN ' / Hukuk ' ELSE ' / Orta / Din ' END || source END AS department,
    CASE WHEN k % 5 <> 0 THEN ['A ' || k % 7, 'B, ' || k % 3] ELSE [] END AS advisors,
    CASE WHEN k % 4 <> 0 THEN ['Topic ' || k % 35, CASE WHEN k % 3 = 0 THEN 'Hanefî' ELSE 'Mâlikî' END] ELSE [] END AS topics,
    CASE WHEN k % 13 = 0 THEN CAST(100 + k % 500 AS INTEGER) END AS pageCount,
    'http://x.example/' || k AS url, CASE WHEN k % 7 <> 0 THEN 'http://y.example/' || k END AS fullText,
    CASE WHEN k % 11 <> 0 THEN text END AS abstract, CASE WHEN k % 30 <> 0 THEN 500000 + k END AS yokId,
    CASE WHEN quality IS NOT NULL THEN 'otomatik' END AS origin,
    CAST(DATE '2026-01-01' + CAST(k % 200 AS INTEGER) AS DATE) AS addedAt
  FROM (SELECT d.doc_id AS k, text, lang, source, quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id))"""


# --- SQL expressions ------------------------------------------------------------

def sql_day_number(y: str, m: str = "1", d: str = "1") -> str:
    return f"(({d}) + 29 * (({m}) - 1) + ({m}) // 2 + 354 * (({y}) - 1) + (3 + 11 * ({y})) // 30 + 1948439)"


def _sql_month_step(z: str) -> str:
    return f"(5 * (((4 * ({z} + 1401) + 3) % 1461) // 4) + 2)"


def sql_julian_month(z: str) -> str:
    return f"(({_sql_month_step(z)} // 153 + 2) % 12 + 1)"


def sql_civil(z: str, part: str) -> str:
    """Year, month or day: integer arithmetic in the Julian calendar, date functions in the Gregorian."""
    julian = {
        "year": f"((4 * ({z} + 1401) + 3) // 1461 - 4716 + (14 - {sql_julian_month(z)}) // 12)",
        "month": sql_julian_month(z),
        "day": f"({_sql_month_step(z)} % 153 // 5 + 1)",
    }[part]
    return f"(CASE WHEN {z} < 2299161 THEN {julian} ELSE {part}(DATE '1970-01-01' + CAST({z} - 2440588 AS INTEGER)) END)"


def sql_span(first: str, last: str) -> str:
    a, b = sql_civil(first, "year"), sql_civil(last, "year")
    return (f"(CASE WHEN {a} = {b} THEN CAST({a} AS VARCHAR) WHEN {a} // 100 = {b} // 100 "
            f"THEN {a} || '-' || right(CAST({b} AS VARCHAR), 2) ELSE {a} || '-' || {b} END)")


def sql_miladi(y: str, m: str | None = None, d: str | None = None) -> str:
    year = sql_span(sql_day_number(y), f"({sql_day_number(f'{y} + 1')} - 1)")
    if m is None:
        return year
    last = f"(CASE WHEN {m} = 12 THEN {sql_day_number(f'{y} + 1')} ELSE {sql_day_number(y, f'{m} + 1')} END - 1)"
    month = sql_span(sql_day_number(y, m), last)
    if d is None:
        return f"(CASE WHEN coalesce({m}, 0) = 0 THEN {year} ELSE {month} END)"
    day = f"CAST({sql_civil(sql_day_number(y, m, d), 'year')} AS VARCHAR)"
    return f"(CASE WHEN coalesce({m}, 0) = 0 THEN {year} WHEN coalesce({d}, 0) = 0 THEN {month} ELSE {day} END)"


def sql_hm(y: str, m: str | None = None, d: str | None = None) -> str:
    return f"({y} || '/' || {sql_miladi(y, m, d)})"


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_hm_long(lang_months: list[str], y: str, m: str, d: str) -> str:
    return (f"(CASE WHEN coalesce({d}, 0) <> 0 THEN {d} || ' ' ELSE '' END || "
            f"CASE WHEN coalesce({m}, 0) <> 0 THEN {sql_list(lang_months)}[{m}] || ' ' ELSE '' END || {sql_hm(y, m, d)})")


# Browser white space, for the regular expressions of DuckDB.
SQL_SPACE = r"\t\n\v\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def sql_cut(text: str, n: int) -> str:
    return f"regexp_replace(substr({text}, 1, {n}), '[{SQL_SPACE}]+[^{SQL_SPACE}]*$', '') || '…'"


def sql_snippet(text: str) -> str:
    return f"(CASE WHEN length({text}) > 260 THEN {sql_cut(text, 257)} ELSE coalesce({text}, '') END)"


def sql_excerpt(text: str, n: int = 220) -> str:
    line = rf"trim(regexp_replace(regexp_replace(coalesce({text}, ''), '\*\*[^*]+\*\*', ''), '[{SQL_SPACE}]+', ' ', 'g'))"
    return f"(CASE WHEN length({line}) > {n} THEN {sql_cut(line, n)} ELSE {line} END)"


def sql_cell(text: str) -> str:
    t = f"coalesce(CAST({text} AS VARCHAR), '')"
    return f"(CASE WHEN regexp_matches({t}, '[\",\\n;]') THEN '\"' || replace({t}, '\"', '\"\"') || '\"' ELSE {t} END)"


def sql_fold(text: str) -> str:
    return f"lower(translate({text}, 'İı', 'ii'))"
