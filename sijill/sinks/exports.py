"""Scholars and bibliography as JSON, CSV, BibTeX and RIS.

Every writer makes a folder of part files; read in name order they are the export. Nothing is
gathered into one task, so the header is the first row of the first part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sijill.functions.citation import bibtex, ris
from sijill.functions.text import csv_cell, list_cell
from sijill.operators.records import WORK_COLUMNS, compact_rows, work_records
from sijill.sinks.verbatim import write_verbatim
from sijill.values import SCHOLAR_CSV_COLUMNS

# --- Fixed values: byte-order mark and separators of the exports ----------------
BOM = "\ufeff"
CSV_LINE_END = "\r\n"
JSON_LINE_END = "\n"
BIBTEX_LINE_END = "\n"
RIS_LINE_END = "\r\n"


def _with_header(lines: DataFrame, names: list[str], order: list[str]) -> DataFrame:
    """``lines`` (order columns, value) under one header row that sorts first (``_body``)."""
    spark = lines.sparkSession
    head = spark.range(1).select(*[F.lit(None).cast(lines.schema[c].dataType).alias(c) for c in order],
                                 F.lit(0).alias("_body"), F.lit(BOM + ",".join(names)).alias("value"))
    return head.unionByName(lines.withColumn("_body", F.lit(1)))


def _line(cells: list[Column]) -> Column:
    return F.concat_ws(",", *cells)


def scholar_csv(records: DataFrame) -> DataFrame:
    """(order, part, value): CSV lines of scholar records with their header; the part comes last."""
    names = [*SCHOLAR_CSV_COLUMNS, "part"]
    special = {
        "birthPlace": csv_cell(F.col("birthPlace.name")), "deathPlace": csv_cell(F.col("deathPlace.name")),
        "teacherIds": list_cell(F.col("teacherIds")), "studentIds": list_cell(F.col("studentIds")),
        "sourcePage": csv_cell(F.col("source.page")), "sourceEntry": csv_cell(F.col("source.entry")),
    }
    line = _line([special[c] if c in special else csv_cell(F.col(c)) for c in names])
    return _with_header(records.select("order", "part", line.alias("value")), names, ["order", "part"])


def scholar_json(records: DataFrame) -> DataFrame:
    """(order, part, value): scholar records as JSON, absent fields left out."""
    fields = [c for c in records.columns if c not in ("order", "part")]
    return records.select("order", "part", F.to_json(F.struct(*fields, "part")).alias("value"))


def work_csv(works: DataFrame) -> DataFrame:
    """(id, value): CSV lines of works with their header; a translation is its text."""
    cells = []
    for c in WORK_COLUMNS:
        if c == "titleTranslation":
            cells.append(list_cell(F.map_values(c)))
        elif c in ("authors", "advisors", "topics"):
            cells.append(list_cell(F.col(c)))
        else:
            cells.append(csv_cell(F.col(c)))
    return _with_header(work_records(works).select("id", _line(cells).alias("value")), WORK_COLUMNS, ["id"])


def work_json(works: DataFrame) -> DataFrame:
    """(id, value): works as JSON, absent fields left out."""
    return work_records(works).select("id", F.to_json(F.struct(*WORK_COLUMNS)).alias("value"))


def _columns(works: DataFrame) -> dict[str, Column]:
    return {c: F.col(c) for c in works.columns}


def work_bibtex(works: DataFrame) -> DataFrame:
    records = work_records(works)
    return records.select("id", bibtex(_columns(records)).alias("value"))


def work_ris(works: DataFrame) -> DataFrame:
    records = work_records(works)
    return records.select("id", ris(_columns(records)).alias("value"))


def _write_text(lines: DataFrame, path: str, separator: str, order: list[str]) -> None:
    lines.orderBy(*order).select("value").write.option("lineSep", separator).text(path)


def _write_csv(lines: DataFrame, path: str, order: list[str]) -> None:
    """Lines with separators between them and none after the last: each but the header brings its own."""
    value = F.when(F.col("_body") == 0, F.col("value")).otherwise(F.concat(F.lit(CSV_LINE_END), "value"))
    write_verbatim(lines.orderBy("_body", *order).select(value.alias("value")), path)


def write_scholars_csv(records: DataFrame, path: str) -> None:
    _write_csv(scholar_csv(records), path, ["order", "part"])


def write_scholars_json(records: DataFrame, path: str) -> None:
    """One record per line."""
    _write_text(scholar_json(records), path, JSON_LINE_END, ["order", "part"])


def write_works_csv(works: DataFrame, path: str) -> None:
    _write_csv(work_csv(works), path, ["id"])


def write_works_json(works: DataFrame, path: str) -> None:
    _write_text(work_json(works), path, JSON_LINE_END, ["id"])


def write_works_bibtex(works: DataFrame, path: str) -> None:
    """An empty line between entries; the last one ends with its line."""
    entries = work_bibtex(works)
    first = entries.agg(F.min("id")).first()[0]
    spaced = F.when(F.col("id") == first, F.col("value")).otherwise(F.concat(F.lit(BIBTEX_LINE_END), "value"))
    _write_text(entries.select("id", spaced.alias("value")), path, BIBTEX_LINE_END, ["id"])


def write_works_ris(works: DataFrame, path: str) -> None:
    _write_text(work_ris(works), path, RIS_LINE_END, ["id"])


def write_compact_list(works: DataFrame, path: str) -> None:
    compact_rows(works).orderBy("id").write.json(path)
