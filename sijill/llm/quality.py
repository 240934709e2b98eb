"""Quality rules, and a log-likelihood ratio of hashed n-grams.

The ratio compares two multinomials over hashed byte n-grams: trusted documents against the whole raw corpus. A document's
mean log ratio per n-gram is compared with one fixed threshold, so the verdict depends on nothing but the text and the model.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sijill.llm.text import SMALL, chunks, joined, mix, releasing

GRAM = 4
BUCKETS = 1 << 16
TRUSTED_ROWS = 100_000   # labelled documents the trusted side is learned from, at most (on average)
SMOOTHING = 0.5
THRESHOLD = -0.35        # mean log ratio below which a document is rejected
MIN_WORDS = 50

_SYMBOLS = re.compile(r"[#*$%&|<>]")

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def base_rules(text: str | None) -> tuple[int, int, int, int, int]:
    """The values named in ``BASE`` for one text; all 0 for a null."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # blanks of bytes are exactly \x20 and \x09 to \x0D
    n = len(words)
    chars = len(b"".join(words).decode("utf-8", "surrogatepass"))
    lines = [line for line in raw.split(b"\n") if line.split(None, 1)]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    seen = Counter(windows)
    if len(seen) < len(windows):
        end = 0  # words before this one are counted
        for i, w in enumerate(windows):
            if seen[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return n, chars, len(_SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeated


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > 50 * n_words


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram, and where each text's n-grams start (one more offset at the end).

    A text's n-grams are those of its bytes and one blank; fewer bytes have none.
    """
    data, offsets = joined(texts)
    wide = np.concatenate([data, np.full(GRAM, 0x20, np.uint8)]).astype(np.uint64)
    h = np.zeros(len(data), np.uint64)
    for k in range(GRAM):
        h = (h << np.uint64(8)) | wide[k:k + len(data)]
    inside = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data)) >= GRAM  # none reaches into the next text
    sizes = np.maximum(np.diff(offsets) - (GRAM - 1), 0)
    return (mix(h[inside] + np.uint64(1)) >> np.uint64(48)).astype(np.int64) % BUCKETS, np.concatenate([[0], np.cumsum(sizes)])


def bounded_labels(labels: DataFrame, label: str, limit: int) -> DataFrame:
    """(doc_id, label) of labelled rows, one per id, thinned by a hash of the id to ``limit`` rows on average.

    An id with several labels has the largest. Rows without id or label are left out.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    total = rows.count()
    share = min(1.0, limit / max(total, 1))
    part = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))
    return rows.where(part).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias(label))


def learn(docs: DataFrame, labels: DataFrame, text: str = "text") -> np.ndarray:
    """Log ratio per bucket: trusted documents (quality 1) against all documents.

    Every document is counted; each task sums its own n-grams first, so what is shuffled is tasks times buckets at most and
    the driver gets one row per bucket. Without trusted documents all ratios are 0.
    """
    # The labels are bounded, so they go to every task.
    trusted = F.broadcast(bounded_labels(labels, "quality", TRUSTED_ROWS).where("quality = 1"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("_text")).join(trusted, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in batches:
            texts, marks = b.column(0).to_pylist(), b.column(1).to_pylist()
            for start, end in chunks(texts, SMALL):
                found, at = grams(texts[start:end])
                raw += np.bincount(found, minlength=BUCKETS)
                mine = np.repeat(np.array([m == 1 for m in marks[start:end]]), np.diff(at))
                good += np.bincount(found[mine], minlength=BUCKETS)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(good[used])], ["bucket", "raw", "good"])

    counts = (rows.select("_text", "quality").mapInArrow(releasing(run), "bucket long, raw long, good long")
              .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toPandas())
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[counts["bucket"]], good[counts["bucket"]] = counts["raw"], counts["good"]
    if not good.sum():
        return np.zeros(BUCKETS)
    share = lambda n: (n + SMOOTHING) / (n.sum() + SMOOTHING * BUCKETS)
    return np.log(share(good)) - np.log(share(raw))


def mean_ratios(texts: list[str | None], ratios: np.ndarray) -> np.ndarray:
    """Mean log ratio of each text; 0 for a text without n-grams."""
    out = np.zeros(len(texts))
    for start, end in chunks(texts, SMALL):
        found, at = grams(texts[start:end])
        sums = np.concatenate([[0.0], np.cumsum(ratios[found])])
        sizes, total = np.diff(at), sums[at[1:]] - sums[at[:-1]]
        out[start:end] = np.where(sizes > 0, total / np.maximum(sizes, 1), 0.0)
    return out


def judged(docs: DataFrame, ratios: np.ndarray, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id with the base values, base_failed, the mean log ratio ``llr`` and kept, for every row.

    Null and empty texts have zeros everywhere and fail. Rows that repeat are judged each for itself.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            base = [base_rules(t) for t in texts]
            llr = mean_ratios(texts, shared.value)
            failed = [base_failed(x[0], x[4]) for x in base]
            kept = [not f and r >= threshold for f, r in zip(failed, llr)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array([x[k] for x in base], pa.int64()) for k in range(len(BASE))], pa.array(failed, pa.bool_()),
                 pa.array(llr, pa.float64()), pa.array(kept, pa.bool_())], ["doc_id", *BASE, "base_failed", "llr", "kept"])

    schema = f"doc_id long, {', '.join(f'{c} long' for c in BASE)}, base_failed boolean, llr double, kept boolean"
    return docs.select(F.col("doc_id").cast("long"), F.col(text).alias("_text")).mapInArrow(releasing(run), schema)


def good(docs: DataFrame, ratios: np.ndarray, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that pass, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            llr = mean_ratios(texts, shared.value)
            kept = [r >= threshold and not base_failed(x[0], x[4]) for r, x in zip(llr, map(base_rules, texts))]
            mask = pa.array(kept, pa.bool_())
            yield pa.RecordBatch.from_arrays([pc.filter(c, mask) for c in b.columns], names=by_place)

    # Columns go by place, as names with dots cannot be asked for inside.
    at, by_place = docs.columns.index(text), [f"c{i}" for i in range(len(docs.columns))]
    placed = docs.toDF(*by_place)
    return placed.mapInArrow(releasing(run), placed.schema).toDF(*docs.columns)
