"""Reference texts and citation-file records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAGE_MARK = "{page}"


def with_page(template: Column, page: Column) -> Column:
    """A reference template with the page filled in."""
    return F.replace(template, F.lit(PAGE_MARK), F.coalesce(page, F.lit("")))


def _bib_escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([{}\\])", r"\\$1")


def _bib_field(name: str, value: Column) -> Column:
    text = value.cast("string")
    return F.when(F.coalesce(F.length(text), F.lit(0)) > 0, F.concat(F.lit(f"  {name} = {{"), _bib_escape(text), F.lit("}")))


def _present(values: list[Column]) -> Column:
    return F.filter(F.array(*values), lambda v: v.isNotNull())


def bibtex(work: dict[str, Column]) -> Column:
    """One BibTeX entry; doctoral theses are @phdthesis, master's @mastersthesis, the rest @misc."""
    kind = (F.when(work["type"] == "tez-doktora", "phdthesis").when(work["type"] == "tez-yl", "mastersthesis")
            .otherwise("misc"))
    fields = _present([
        _bib_field("author", F.array_join(work["authors"], " and ")),
        _bib_field("title", work["title"]),
        _bib_field("school", work["university"]),
        _bib_field("address", work["city"]),
        _bib_field("year", work["year"]),
        _bib_field("language", work["language"]),
        _bib_field("keywords", F.array_join(work["topics"], ", ")),
        _bib_field("url", work["url"]),
        _bib_field("abstract", work["abstract"]),
    ])
    return F.concat(F.lit("@"), kind, F.lit("{"), work["id"], F.lit(",\n"), F.array_join(fields, ",\n"), F.lit("\n}"))


def _ris_line(tag: str, value: Column) -> Column:
    # A RIS value ends at the line's end, so line breaks inside become spaces.
    text = F.regexp_replace(value.cast("string"), r"[\r\n]+", " ")
    return F.when(F.coalesce(F.length(text), F.lit(0)) > 0, F.concat(F.lit(f"{tag}  - "), text))


def ris(work: dict[str, Column]) -> Column:
    """One RIS record, lines joined by CRLF."""
    def repeated(tag: str, values: Column) -> Column:
        return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: _ris_line(tag, v))

    kind = F.when(work["type"].startswith("tez-"), "THES").otherwise("GEN")
    lines = F.concat(
        F.array(F.concat(F.lit("TY  - "), kind)),
        F.array(_ris_line("ID", work["id"]), _ris_line("TI", work["title"])),
        repeated("AU", work["authors"]),
        F.array(_ris_line("PB", work["university"]), _ris_line("CY", work["city"]), _ris_line("PY", work["year"]),
                _ris_line("LA", work["language"])),
        repeated("KW", work["topics"]),
        F.array(_ris_line("UR", work["url"]), _ris_line("AB", work["abstract"]), F.lit("ER  - ")),
    )
    return F.array_join(F.filter(lines, lambda v: v.isNotNull()), "\r\n")
