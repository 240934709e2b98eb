"""Language of texts by compression: the language whose dictionary packs a text smallest.

Each language has a zstandard dictionary of raw content, taken from a bounded sample of its texts: pieces that are drawn by their
hash from all positions of a text, a first one of every text before any second. A text is
cut into blocks, so that the dictionary stays the reference of every part of it, and all blocks are compressed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sijill.llm.text import releasing

SAMPLES = 512            # texts a language is learned from, at most
DICTIONARY = 200 << 10   # bytes of a dictionary; a model has one per language
PIECE = 256              # characters of a piece of a sampled text
BLOCK = 512              # bytes that are compressed at once
LEVEL = 3
MARGIN = 0.004           # smaller relative leads over the second language are rejected
UNKNOWN = "und"

Model = tuple[tuple[str, bytes], ...]


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """A dictionary per language, the commonest first, from texts chosen by their hash alone.

    Rows without text, letters or language teach nothing. Of each language at most ``SAMPLES`` texts are read, whole, and pieces of
    about four dictionaries reach the driver.
    """
    count, pieces = sampled(labelled, text, lang)
    content: dict[str, list[bytes]] = {}
    for r in pieces:
        content.setdefault(r.lang, []).append(letters(r.piece) + b" ")
    return tuple((k, _filled(content[k])) for k in sorted(content, key=lambda k: (-count[k], k)))


def _filled(pieces: list[bytes]) -> bytes:
    """The first of the pieces that a dictionary has room for, each once."""
    return b"".join(dict.fromkeys(pieces))[:DICTIONARY]


def sampled(labelled: DataFrame, text: str = "text", lang: str = "lang") -> tuple[dict[str, int], list]:
    """Texts of each language, and drawn pieces (lang, h, draw, piece) of a sample of them, in the order they are taken."""
    h = F.xxhash64(F.col(text))
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), h.alias("h"))
    chosen = (rows.groupBy("lang", F.pmod("h", F.lit(SAMPLES)).alias("slot"))
              .agg(F.min("h").alias("h"), F.count("*").alias("n")).collect())
    if not chosen:
        return {}, []
    count: dict[str, int] = {}
    texts: dict[str, int] = {}
    for r in chosen:
        count[r.lang] = count.get(r.lang, 0) + r.n
        texts[r.lang] = texts.get(r.lang, 0) + 1
    # As many pieces of a text as fill four dictionaries with those of the others.
    most = F.create_map(*[F.lit(x) for k, n in texts.items() for x in (k, -(-4 * DICTIONARY // (n * PIECE)))])
    worded = F.regexp_replace("text", r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", " ")
    cut = F.filter(F.regexp_extract_all(worded, F.lit(rf"(?s)(.{{1,{PIECE}}})"), F.lit(1)), lambda p: p.rlike(r"\p{L}"))
    drawn = F.array_sort(F.transform(F.array_distinct(cut), lambda p: F.struct(F.xxhash64(p).alias("at"), p.alias("piece"))))
    some = (rows.where(F.col("h").isin([r.h for r in chosen])).dropDuplicates(["lang", "h"])
            .select("lang", "h", F.posexplode(F.slice(drawn, F.lit(1), most[F.col("lang")])).alias("draw", "p"))
            .select("lang", "h", "draw", "p.piece").collect())
    return count, sorted(some, key=lambda r: (r.lang, r.draw, r.h))


# Digits, marks and blanks of ASCII tell nothing of a language; letters and all other bytes stay.
_LETTERS = bytes(c if chr(c).isalpha() or c > 127 else 0x20 for c in range(256))


def letters(text: str) -> bytes:
    """The text's words in lower case, a blank between two."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).split())


@lru_cache(maxsize=2)
def _compressors(model: Model) -> list[tuple[str, zstandard.ZstdCompressor]]:
    made = []
    for lang, content in model:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        made.append((lang, zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_dict_id=False)))
    return made


def judge(text: str | None, model: Model) -> tuple[str, float, bool]:
    """(language, score, accepted) of one text; a text without a letter is ``und``, accepted like any clear case."""
    if text is None or not model or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0, text is not None and bool(text.strip())
    data = letters(text)
    blocks = [data[i:i + BLOCK] for i in range(0, len(data), BLOCK)]
    sizes = sorted(((sum(len(c.compress(b)) for b in blocks), lang) for lang, c in _compressors(model)), key=lambda x: x[0])
    if len(sizes) == 1:
        return sizes[0][1], 1.0, True
    lead = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
    return sizes[0][1], min(1.0, lead / (lead + MARGIN)) if lead else 0.0, lead >= MARGIN


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` with lang_pred, score and accepted for every row; nothing but the text is read for it.

    The score grows with the lead, 0.5 at the margin of rejection; equal sizes go to the commoner language with score 0.
    Null texts and texts without letters are ``und`` with score 0; of these only texts that have something are accepted.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [judge(t, shared.value) for t in b.column("_text").to_pylist()]
            out = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*out, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()),
                 pa.array([f[2] for f in found], pa.bool_())], [*keep, "lang_pred", "score", "accepted"])

    rows = docs.select(*keep, F.col(text).alias("_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return rows.mapInArrow(releasing(run), f"{kept}, lang_pred string, score double, accepted boolean")


def accepted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows whose language is clear, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mask = pa.array([judge(t, shared.value)[2] for t in b.column(at).to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([pc.filter(c, mask) for c in b.columns], names=by_place)

    # Columns go by place, as names with dots cannot be asked for inside.
    at, by_place = docs.columns.index(text), [f"c{i}" for i in range(len(docs.columns))]
    placed = docs.toDF(*by_place)
    return placed.mapInArrow(releasing(run), placed.schema).toDF(*docs.columns)


def teaches(doc_id: Column, parts: int = 4, held_out: int = 2) -> Column:
    """Rows a model may learn from: the id's remainder is known and not the held-out one."""
    from sijill.llm.text import remainder
    return F.coalesce(remainder(doc_id, parts) != held_out, F.lit(False))
