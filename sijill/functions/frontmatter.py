"""Record files as columns: YAML of the archive's fixed layout, front matter and body."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed value: characters no record may hold ---------------------------------
CONTROL = r"[\x00-\x08\x0b-\x1f\x7f-\x9f]"

_JSON = {"allowUnquotedControlChars": "true", "allowBackslashEscapingAnyCharacter": "true"}
_QUOTED = r'"((?:[^"\\]|\\.)*)"'


def clean(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, "")


def front_and_body(text: Column) -> tuple[Column, Column]:
    """The cleaned part between the two ``---`` lines as ``blocks``, and the trimmed rest.

    A block is a top-level key with the indented lines below it.
    """
    parts = F.split(text, r"(?m)^---[ \t\r]*$", 3)
    body = F.regexp_replace(F.coalesce(F.try_element_at(parts, F.lit(3)), F.lit("")), r"\A\s+|\s+\z", "")
    return F.split(clean(F.try_element_at(parts, F.lit(2))), r"\n(?=\w+:)"), body


def _once(value: Column, use) -> Column:
    """``use(value)`` with a costly value computed once however often it is named."""
    return F.transform(F.array(value), use)[0]


def _unescape(inner: Column) -> Column:
    """Inside of a double-quoted value."""
    decoded = F.from_json(F.concat(F.lit('["'), inner, F.lit('"]')), "array<string>", _JSON)[0]
    return F.when(F.contains(inner, F.lit("\\")), decoded).otherwise(inner)


def scalar(text: Column) -> Column:
    """A double-quoted, single-quoted or plain value; null when there is none."""
    def decoded(value: Column) -> Column:
        single = F.replace(F.regexp_replace(value, r"^'|'$", ""), F.lit("''"), F.lit("'"))
        return (F.when(value == "", None).when(value.startswith('"'), _once(F.regexp_extract(value, f"^{_QUOTED}", 1), _unescape))
                .when(value.startswith("'"), single).otherwise(value))
    return _once(F.btrim(text, F.lit(" \t\n")), decoded)


def top(blocks: Column, key: str) -> Column:
    """Raw text of a top-level key: the rest of its line and the indented lines below it; '' when absent."""
    found = F.filter(blocks, lambda b: b.startswith(f"{key}:"))
    return F.coalesce(F.substring(F.try_element_at(found, F.lit(1)), len(key) + 2, 1 << 30), F.lit(""))


def nested(block: Column, key: str) -> Column:
    """A ``key: value`` line inside an indented block."""
    return scalar(F.regexp_extract(block, rf"(?m)^[ \t]+(?:- )?{key}:[ \t]*(.*)$", 1))


def inline(block: Column, key: str) -> Column:
    """A quoted value of an inline map ``{{ key: "…" }}``."""
    # An unescaped quote cannot occur inside another quoted value, so this meets only keys.
    found = F.regexp_extract_all(block, F.lit(rf"[{{,]\s*{key}:\s*{_QUOTED}"), F.lit(1))
    return F.transform(found, _unescape)


def inline_words(block: Column, key: str) -> Column:
    """Values of a bare-word key over a list of inline maps."""
    return F.transform(F.regexp_extract_all(block, F.lit(rf"[{{,]\s*{key}:\s*([^,}}\s]+)"), F.lit(1)),
                       lambda v: F.regexp_replace(v, r"^[\"']|[\"']$", ""))


def string_list(text: Column) -> Column:
    """``["a", "b"]``, ``[a, b]`` or a block of ``- a`` lines; empty when absent."""
    value = F.trim(text)
    quoted = F.from_json(value, "array<string>", _JSON)
    bare = F.transform(F.split(F.regexp_replace(value, r"^\[|\]$", ""), ","), scalar)
    lines = F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]+- (.*)$"), F.lit(1)), scalar)
    return (F.when(value.rlike(r'^\[\s*"'), quoted).when(value.startswith("["), F.filter(bare, lambda v: v.isNotNull()))
            .otherwise(lines))


def json_object(text: Column) -> Column:
    """A file of ``key: value`` lines with JSON-like values as the text of one JSON object."""
    lines = F.filter(F.split(clean(text), "\n"), lambda l: l.rlike(r"^\w+:"))
    # Key and value are named often below, so each line is split once.
    pairs = F.transform(F.transform(lines, lambda l: F.split(l, ":", 2)),
                        lambda p: F.struct(p[0].alias("key"), F.btrim(p[1], F.lit(" \t")).alias("value")))

    def member(pair: Column) -> Column:
        value = pair["value"]
        plain = F.replace(F.regexp_replace(value, r"^'|'\z", ""), F.lit("''"), F.lit("'"))
        text = F.concat(F.lit('"'), F.regexp_replace(plain, r'(["\\])', r"\\$1"), F.lit('"'))
        as_json = F.when(value == "", "null").when(F.substring(value, 1, 1).isin('"', "[", "{"), value).otherwise(text)
        return F.concat(F.lit('"'), pair["key"], F.lit('":'), as_json)

    return F.concat(F.lit("{"), F.array_join(F.transform(pairs, member), ","), F.lit("}"))


JSON_OPTIONS = _JSON
