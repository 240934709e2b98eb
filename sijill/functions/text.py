"""Excerpts, cells, paths and other text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sijill.values import DEFAULT_LANGUAGE, EXCERPT_LENGTH, LANGUAGES, SNIPPET_CUT, SNIPPET_LENGTH

# --- Fixed values: white space as browsers see it -------------------------------
# Java's \s lacks the no-break, typographic and byte-order-mark spaces.
SPACE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
# The same set for whole texts: letters outside U+1680 to U+FEFF are told apart by one comparison.
SPACES = r"[\t\n\x0B\f\r \u00A0[\u1680-\uFEFF&&[\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]]]+"

# --- Fixed value: the language at the start of an address -----------------------
_PATH_LANGUAGE = "^/(tr|en|ar)(?=/|$)"


def _cut_at_word(text: Column, length: int) -> Column:
    """The first ``length`` characters without the last, possibly broken, word."""
    head = F.substring(text, 1, length)
    return F.concat(F.regexp_replace(head, rf"[{SPACE}]+[^{SPACE}]*\z", ""), F.lit("…"))


def _shortened(text: Column, longest: int, cut: int) -> Column:
    # The one-element array names a costly text once for its three uses.
    return F.transform(F.array(text), lambda t: F.when(F.length(t) > longest, _cut_at_word(t, cut)).otherwise(t))[0]


def excerpt(body: Column, length: int = EXCERPT_LENGTH) -> Column:
    """Opening of a text without its bold heading, on one line."""
    # Anchored, so that only the first heading goes.
    plain = F.regexp_replace(F.coalesce(body, F.lit("")), r"(?s)^(.*?)\*\*[^*]+\*\*", "$1")
    return _shortened(F.trim(F.regexp_replace(plain, SPACES, " ")), length, length)


def snippet(text: Column) -> Column:
    """Abstract for a list row: at most 260 characters, empty when absent."""
    return _shortened(F.coalesce(text, F.lit("")), SNIPPET_LENGTH, SNIPPET_CUT)


def summary_text(summary: Column, body: Column, lang: str) -> Column:
    """Summary in one language; in Arabic the opening of the source text.

    A missing language falls back to the others in fallback order, then to ''.
    """
    if lang == "ar":
        return excerpt(body)
    order = [lang] + [x for x in LANGUAGES if x != lang]
    return F.coalesce(*[summary[x] for x in order], F.lit(""))


def has_text(text: Column) -> Column:
    """1 for a non-empty text, else 0."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) > 0, 1).otherwise(0)


def or_empty(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def list_cell(values: Column) -> Column:
    return csv_cell(F.array_join(values, "; "))


def csv_cell(value: Column) -> Column:
    """One CSV cell; ';' also asks for quotes, so lists of two or more are always quoted."""
    text = or_empty(value)
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\n;]'), quoted).otherwise(text)


def page_path(*parts: Column | str, base: str = "") -> Column:
    """Address ``base/part/part/`` of a page."""
    columns = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return F.concat(F.lit(base.rstrip("/") + "/"), F.concat_ws("/", *columns), F.lit("/"))


def in_language(path: Column, lang: Column | str, base: str = "") -> Column:
    """Address of the same page in another language."""
    base = base.rstrip("/")
    lang = F.lit(lang) if isinstance(lang, str) else lang
    inner = F.substring(path, len(base) + 1, 1 << 30) if base else path
    rest = F.regexp_replace(inner, _PATH_LANGUAGE, "")
    return F.concat(F.lit(base + "/"), lang, F.when(rest == "", F.lit("/")).otherwise(rest))


def known_language(param: Column) -> Column:
    """The language itself when supported, else the default."""
    return F.when(param.isin(LANGUAGES), param).otherwise(DEFAULT_LANGUAGE)


def iso_day(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd")


def fold(text: Column) -> Column:
    """Lower case for search; dotted and dotless Turkish i become plain i."""
    return F.replace(F.lower(F.replace(text, F.lit("İ"), F.lit("i"))), F.lit("ı"), F.lit("i"))


def words(text: Column) -> Column:
    """Folded words of a text, in order."""
    # Letters, marks and digits make words in any script; plain ones are tested first.
    return F.array_remove(F.split(fold(F.coalesce(text, F.lit(""))), r"[^a-z0-9\p{L}\p{M}\p{N}]+"), "")
