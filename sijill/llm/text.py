"""Words, splits and hashes that the operators of this folder share."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
BATCH_ROWS = 1 << 11
BATCH_BYTES = 4 << 20
SMALL = 1 << 18  # characters of a chunk whose arrays take several times 8 bytes each
#: Large arrays and Arrow's buffers go back to the system when they are freed. A worker lives as long as its executor, and by default keeps them.
WORKER_MEMORY = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_MMAP_THRESHOLD_": str(1 << 20), "MALLOC_TRIM_THRESHOLD_": str(1 << 20),
                 "MALLOC_ARENA_MAX": "2"}


def importable(spark: SparkSession) -> None:
    """Have Python workers find this library where the driver does, and get texts in batches of a few megabytes.

    On a cluster the library is installed or shipped. A batch has ``BATCH_ROWS`` rows or, with long texts, ``BATCH_BYTES``.
    What workers free they give back (``WORKER_MEMORY``), unless the session says otherwise.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
    for name, value in WORKER_MEMORY.items():
        environment.setdefault(name, value)


def word_count(text: Column) -> Column:
    """Words of a text, 0 for a null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def row_name(df: DataFrame, *columns: str) -> Column:
    """Two hashes over the columns, or all of them in the order of their names; only rows that agree in them share it.

    A hash skips nulls, so which columns are null goes in as well.
    """
    parts = [F.col("`" + c.replace("`", "``") + "`").cast("string") for c in columns or sorted(df.columns)]
    missing = [p.isNull() for p in parts]
    return F.struct(F.xxhash64(*missing, *parts).alias("hi"), F.xxhash64(F.lit(7), *missing, *parts).alias("lo"))


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))


def chunks(texts: list[str | None], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` characters, so that arrays over their bytes stay small."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def released() -> None:
    """Hand freed memory back: a worker goes on with other tasks, and what each step held would add up."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow; what its task held is handed back at the end."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        released()

    return whole


def joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, a blank after each, and the text number of each byte's run as offsets."""
    parts = [(t or "").encode("utf-8", "replace") for t in texts]
    ends = np.cumsum([len(p) + 1 for p in parts], dtype=np.int64)
    data = np.frombuffer(b" ".join(parts) + b" ", dtype=np.uint8)
    return data, np.concatenate([[0], ends])


_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_BASE = 0x9E3779B97F4A7C55
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def hashed_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word, A-Z lower-cased, and where each text's words start (one more offset at the end)."""
    data, offsets = joined(texts)
    data = _LOWER[data]
    blank = _BLANK[data]
    before = np.concatenate([[True], blank[:-1]])
    starts = np.flatnonzero(~blank & before)
    ends = np.flatnonzero(blank & ~before)  # every text is followed by a blank
    power = lambda base: np.cumprod(np.full(len(data), base, dtype=np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power(_BASE))])
    # Dividing by the power at its start makes a word's sum the same wherever it stands.
    hashes = mix((sums[ends] - sums[starts]) * power(_INVERSE)[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets)


_PLACES = np.array([0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x2127599BF4325C37],
                   dtype=np.uint64)


def shingles(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Distinct hashes, sorted, of ``size`` words in a row; fewer words are one shingle, none give none."""
    if not len(words):
        return words
    if len(words) < size:
        h = np.array([len(words)], dtype=np.uint64)
        for k in range(len(words)):
            h = mix(h + words[k:k + 1] * _PLACES[k:k + 1])
        return h
    n = len(words) - size + 1
    total = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        total += words[k:k + n] * _PLACES[k % len(_PLACES)]
    return np.unique(mix(total))
