"""Phrases whose words belong together, by best-first growth of word sequences under score bounds.

A phrase of two to four words scores by how often it stands against its two parts, at its weakest cut. Counts of a prefix bound the
score of all that grows from it: with a = f(phrase) and l = f(first part) no longer phrase scores above 2000000 a / (l + a) at that
cut, and the same holds for suffixes from the right. So words and pairs are counted whole, a threshold is set by the best pairs of each
language, and only prefixes and suffixes whose bound reaches it grow, word by word. What reaches the threshold and may yet be dropped
grows too, as a longer phrase may hold it. A language is settled when enough phrases at or above its threshold survive; the others go
on with a lower one, and last with none.

A task knows what may grow from bitmaps over hashes of phrases. Their size is bounded (``MAX_BITS``), a chance hit only brings in a
row that exact counting removes, and no phrase is missed. Counts are sums of exact counts of strings; inside one chunk of texts words
are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sijill.llm.text import chunks, mix
from sijill.operators.scale import Lookup, first_per_group, spread_join
from sijill.session import materialise

LONGEST = 4            # words of a phrase
LEAST = 30             # occurrences of a candidate
FIRST = 2_000          # phrases of a language
SCALE = 2_000_000      # score of a phrase whose parts stand nowhere else, twice
INSIDE = 80            # per cent of a phrase's occurrences inside a longer one that drop it
ROUNDS = (2, 16)       # thresholds: the score of a language's pair of rank FIRST times this; after them none
MAX_BITS = 27          # a bitmap has at most 2^27 bits, 16 MB
HELD = 200_000         # phrases that a task counts before it hands them on
PACKED = 4 << 20       # hashes of pairs that a task gathers before it hands them on

_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_BASE = 0x9E3779B97F4A7C55
_PLACES = [np.uint64(p) for p in (0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165)]

_COUNTED = "lang string, phrase string, h long, a long"
_COUNTED_ARROW = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("h", pa.int64()), ("a", pa.int64())])


class Words:
    """Words of some texts of one language: where they stand, the piece that holds each, and their hashes."""

    def __init__(self, texts: list[str | None], lang: str):
        raw = ("\n".join([t or "" for t in texts]) + "\n").encode("utf-8", "replace")
        self.data = _LOWER[np.frombuffer(raw, dtype=np.uint8)]
        kind = _KIND[self.data]
        inside = kind == 0
        before = np.concatenate([[False], inside[:-1]])
        self.starts, self.ends = np.flatnonzero(inside & ~before), np.flatnonzero(~inside & before)
        self.piece = np.cumsum(kind == 2)[self.starts]
        power = np.cumprod(np.full(len(self.data), _BASE, dtype=np.uint64))
        inverse = np.cumprod(np.full(len(self.data), pow(_BASE, -1, 1 << 64), dtype=np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power)])
        salt = np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * inverse[self.starts] + (self.ends - self.starts).astype(np.uint64) + salt)
        self._grown: dict[int, np.ndarray] = {1: self.hashes}

    def __len__(self) -> int:
        return len(self.starts)

    def grown(self, m: int) -> np.ndarray:
        """Hash of the ``m`` words from each word on that has so many after it, piece or not."""
        if m not in self._grown:
            n = max(len(self) - m + 1, 0)
            total = np.full(n, m, dtype=np.uint64)
            for k in range(m):
                total += self.hashes[k:k + n] * _PLACES[k]
            self._grown[m] = mix(total)
        return self._grown[m]

    def within(self, m: int) -> np.ndarray:
        """Whether the ``m`` words from each word on stand in one piece."""
        n = max(len(self) - m + 1, 0)
        return self.piece[:n] == self.piece[m - 1:m - 1 + n]

    def phrase(self, i: int, m: int) -> str:
        found = self.data[self.starts[i]:self.ends[i + m - 1]].tobytes()
        return (b" ".join(found.split()) if m > 1 else found).decode("utf-8", "replace")


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Words]]:
    for b in batches:
        groups: dict[str, list] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if text:
                groups.setdefault(lang, []).append(text)
        for lang, texts in groups.items():
            for start, end in chunks(texts):
                yield lang, Words(texts[start:end], lang)


class Bitmaps:
    """Named sets of phrase hashes, as bits at the hash's upper bits; members are always found."""

    def __init__(self, bits: int):
        self.bits, self.sets = bits, {}

    def has(self, name: str, hashes: np.ndarray) -> np.ndarray:
        place = hashes >> np.uint64(64 - self.bits)
        return (self.sets[name][place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

    def add(self, name: str, places: DataFrame) -> None:
        """A set from rows with a ``place``. The driver gets 4 KB for each of at most 2^(MAX_BITS - 15) stretches that have one."""
        number = F.col("place") + 1
        rows = (places.select(F.bitmap_bucket_number(number).alias("b"), F.bitmap_bit_position(number).alias("p"))
                .groupBy("b").agg(F.bitmap_construct_agg("p").alias("bitmap")))
        found = np.zeros(max((1 << self.bits) // 8, 4096), dtype=np.uint8)
        for r in rows.toLocalIterator():
            found[(r.b - 1) * 4096:r.b * 4096] = np.frombuffer(r.bitmap, dtype=np.uint8)
        self.sets[name] = found

    def places(self, phrases: DataFrame) -> DataFrame:
        return phrases.select(F.shiftrightunsigned("h", 64 - self.bits).alias("place"))


def _texts(docs: DataFrame) -> DataFrame:
    """Null languages are ``und``, null texts have no word."""
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))


def counted(texts: DataFrame, m: int, keep: Callable[[Words], np.ndarray] | None = None) -> DataFrame:
    """(lang, phrase, h, a) of the phrases of ``m`` words: all of them, or those from words that ``keep`` marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, int] = {}

        def handed() -> pa.RecordBatch:
            rows = [pa.array(c) if held else pa.array([], f.type) for c, f in zip([*zip(*held)] or [()] * 3, _COUNTED_ARROW)]
            return pa.RecordBatch.from_arrays([*rows, pa.array(list(held.values()), pa.int64())], schema=_COUNTED_ARROW)

        for lang, words in _by_language(batches):
            hashes, good = words.grown(m), words.within(m)
            if keep:
                good = good & keep(words)
            at = np.flatnonzero(good)
            distinct, first, n = np.unique(hashes[at], return_index=True, return_counts=True)
            for h, i, a in zip(distinct.view(np.int64).tolist(), at[first].tolist(), n.tolist()):
                key = (lang, words.phrase(i, m), h)
                held[key] = held.get(key, 0) + a
            if len(held) >= HELD:
                yield handed()
                held.clear()
        yield handed()

    return texts.mapInArrow(run, _COUNTED).groupBy("lang", "phrase", "h").agg(F.sum("a").alias("a"))


def _common_pairs(texts: DataFrame, keep: Callable[[Words], np.ndarray], least: int, bits: int, words: int) -> DataFrame:
    """(place) of the pairs of words whose hash stands ``least`` times or more.

    Tasks hand on sorted hashes with counts up to ``least``, packed by bucket, five bytes a pair. There are as many buckets as
    keep one small, so hashes that share what is left of 64 bits (32 and the bucket's) count together, which only adds pairs.
    """
    upper = int(np.clip(np.log2(max(words, 1)) - 16, 4, 24))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def packed() -> pa.RecordBatch:
            distinct, n = np.unique(np.concatenate(held) >> np.uint64(32 - upper), return_counts=True)
            bucket, low, n = (distinct >> np.uint64(32)).astype(np.int32), distinct.astype(np.uint32), np.minimum(n, least).astype(np.uint8)
            cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            ends = [*cuts[1:].tolist(), len(bucket)]
            return pa.RecordBatch.from_arrays([
                pa.array(bucket[cuts]), pa.array([low[i:j].tobytes() for i, j in zip(cuts, ends)], pa.binary()),
                pa.array([n[i:j].tobytes() for i, j in zip(cuts, ends)], pa.binary())], ["bucket", "low", "n"])

        for _, w in _by_language(batches):
            held.append(w.grown(2)[w.within(2) & keep(w)])
            size += len(held[-1])
            if size >= PACKED:
                yield packed()
                held, size = [], 0
        if size:
            yield packed()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, lows, counts = None, [], []

        def common() -> pa.RecordBatch:
            low, back = np.unique(np.concatenate(lows), return_inverse=True)
            n = np.bincount(back, weights=np.concatenate(counts))
            full = np.uint64(current) << np.uint64(32) | low[n >= least].astype(np.uint64)
            return pa.RecordBatch.from_arrays([pa.array((full >> np.uint64(32 + upper - bits)).astype(np.int64))], ["place"])

        for b in batches:
            for bucket, low, n in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                if bucket != current:
                    if lows:
                        yield common()
                    current, lows, counts = bucket, [], []
                lows.append(np.frombuffer(low.as_buffer(), np.uint32))
                counts.append(np.frombuffer(n.as_buffer(), np.uint8))
        if lows:
            yield common()

    rows = texts.mapInArrow(gather, "bucket int, low binary, n binary").repartition("bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(merge, "place long")


def _parts(m: int, k: int) -> tuple[Column, Column]:
    """The first ``k`` words of a phrase of ``m``, and the others."""
    return F.substring_index("phrase", " ", k), F.substring_index("phrase", " ", k - m)


def _floored(df: DataFrame, name: str, total: Column) -> DataFrame:
    """``name`` = floor(SCALE * a / total), exact beyond 64 bits."""
    return (df.withColumn("_a", F.col("a").cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(8,0)"))
            .withColumn("_t", total.cast("decimal(20,0)")).withColumn(name, F.expr("_a div _t").cast("long")).drop("_a", "_t"))


def _scored(phrases: DataFrame, m: int, known: DataFrame) -> DataFrame:
    """With ``l``, ``r`` and ``score`` of the weakest cut (null if a part was not counted), and the bounds of what grows right or left."""
    sides = [(f"{side}{k}", part) for k in range(1, m) for side, part in zip("lr", _parts(m, k))]
    asked = phrases.select("lang", "phrase", "h", "a", F.explode(F.array(*[F.struct(F.lit(n).alias("side"), p.alias("part")) for n, p in sides]))
                           .alias("p")).select("lang", "phrase", "h", "a", "p.side", "p.part")
    counts = known.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    met = spread_join(asked, counts, ["lang", "part"], "left", ["phrase"])
    rows = met.groupBy("lang", "phrase", "h", "a").agg(*[F.max(F.when(F.col("side") == n, F.col("f"))).alias(n) for n, _ in sides])
    whole = F.lit(True)
    for k in range(1, m):
        first, rest = F.col(f"l{k}"), F.col(f"r{k}")
        whole = whole & first.isNotNull() & rest.isNotNull()
        for name, total in ((f"score{k}", first + rest), (f"right{k}", first + F.col("a")), (f"left{k}", F.col("a") + rest)):
            rows = _floored(rows, name, total)
    weakest = F.array_min(F.array(*[F.struct(F.col(f"score{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"),
                                             F.col(f"r{k}").alias("r")) for k in range(1, m)]))
    least = lambda side: F.array_min(F.array(*[F.col(f"{side}{k}") for k in range(1, m)]))
    return rows.withColumn("w", F.when(whole, weakest)).select(
        "lang", "phrase", "h", "a", F.col("w.l").alias("l"), F.col("w.r").alias("r"), F.col("w.score").alias("score"),
        least("right").alias("right"), least("left").alias("left"))


def _above(phrases: DataFrame, thresholds: Lookup, column: str) -> DataFrame:
    """Phrases of languages that have a threshold, where ``column`` reaches it."""
    return thresholds.join(phrases, ["lang"], "inner", spread=["phrase"]).where(F.col(column) >= F.col("threshold")).drop("threshold")


def _thresholds(pairs: DataFrame, rank: int | None, open_: DataFrame) -> DataFrame:
    """(lang, threshold) of open languages: the score of the pair of that rank, 0 where there is none."""
    if rank is None:
        return open_.select("lang", F.lit(0).cast("long").alias("threshold"))
    best = first_per_group(pairs.where("score is not null").select("lang", "phrase", "score"), ["lang"], [F.desc("score"), F.asc("phrase")],
                           rank, ["phrase"])
    found = best.groupBy("lang").agg(F.count("*").alias("n"), F.min("score").alias("score")).where(F.col("n") >= rank)
    return open_.join(found, "lang", "left").select("lang", F.coalesce("score", F.lit(0)).cast("long").alias("threshold"))


def _free(phrases: DataFrame, longer: DataFrame, m: int, inside: int) -> DataFrame:
    """Phrases of ``m`` words that no phrase of one word more holds in ``inside`` per cent of their occurrences.

    A phrase of two words more would have one of one word more between them that stands at least as often.
    """
    holds = longer.select("lang", F.explode(F.array(_parts(m + 1, m)[0], _parts(m + 1, 1)[1])).alias("phrase"), F.col("a").alias("held"))
    most = holds.groupBy("lang", "phrase").agg(F.max("held").alias("held"))
    rows = phrases.join(most, ["lang", "phrase"], "left")
    return rows.where("held is null or cast(held as decimal(20,0)) * 100 < cast(a as decimal(20,0)) * "
                      f"{inside}").drop("held")


def phrases(docs: DataFrame, first: int = FIRST, least: int = LEAST, inside: int = INSIDE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``first`` surviving phrases.

    ``a``, ``l`` and ``r`` count the phrase and the parts of its weakest cut, ``n`` the language's words. A null language is ``und``, a
    null or empty text has no words, repeated rows count each for themselves, ties go to the larger ``a`` and then the phrase of
    smaller bytes. An empty table has no rows. Every occurrence of every text is counted.
    """
    texts = _texts(docs)
    every = materialise(counted(texts, 1), "words")
    totals = materialise(every.groupBy("lang").agg(F.sum("a").alias("n")), "totals")
    n = totals.agg(F.sum("n")).first()[0] or 0
    maps = Bitmaps(int(np.clip(np.ceil(np.log2(max(n, 1))), 15, MAX_BITS)))
    words = materialise(every.where(F.col("a") >= least), "words")
    share = texts.sparkSession.sparkContext.broadcast

    maps.add("words", maps.places(words))
    one = share(maps)
    both = lambda w: (lambda f: f[:-1] & f[1:])(one.value.has("words", w.hashes))
    maps = Bitmaps(maps.bits)
    maps.add("pairs", _common_pairs(texts, both, least, maps.bits, n))
    two = share(maps)
    pairs = counted(texts, 2, lambda w: two.value.has("pairs", w.grown(2))).where(F.col("a") >= least)
    pairs = materialise(_scored(materialise(pairs, "pairs"), 2, words), "pairs")

    settled, open_ = None, totals.select("lang")
    for step in (*ROUNDS, None):
        limits = materialise(_thresholds(pairs, step and step * first, open_), "thresholds")
        survivors = _round(Lookup(open_).join(texts, ["lang"], "inner", spread=["text"]) if settled else texts,
                           words, pairs, Lookup(limits), maps.bits, least, inside)
        reached = survivors.groupBy("lang").agg(F.count("*").alias("found"))
        done = limits.join(reached, "lang", "left").where((F.col("threshold") <= 0) | (F.col("found") >= first)).select("lang")
        done = materialise(done, "settled")
        found = Lookup(done).join(survivors, ["lang"], "inner", spread=["phrase"])
        settled = found if settled is None else settled.unionByName(found)
        open_ = materialise(open_.join(done, "lang", "left_anti"), "open")
        if step is None or open_.isEmpty():
            break
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    top = first_per_group(settled, ["lang"], order, first, ["phrase"])
    ranked = top.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return Lookup(totals).join(ranked, ["lang"], "inner", spread=["phrase"]).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _round(texts: DataFrame, words: DataFrame, pairs: DataFrame, limits: Lookup, bits: int, least: int, inside: int) -> DataFrame:
    """(lang, phrase, a, l, r, score): all surviving phrases at or above the thresholds of the languages that have one."""
    share = texts.sparkSession.sparkContext.broadcast
    known = words.select("lang", "phrase", "a").unionByName(pairs.select("lang", "phrase", "a"))
    maps = Bitmaps(bits)
    maps.add("pairs", maps.places(pairs))
    maps.add("right", maps.places(_above(pairs, limits, "right")))
    maps.add("left", maps.places(_above(pairs, limits, "left")))
    two = share(maps)

    def third(w: Words) -> np.ndarray:
        h, has = w.grown(2), two.value.has
        return has("pairs", h[:-1]) & has("pairs", h[1:]) & (has("right", h[:-1]) | has("left", h[1:]))

    threes = materialise(counted(texts, 3, third).where(F.col("a") >= least), "threes")
    threes = materialise(_scored(threes, 3, known), "threes")
    maps = Bitmaps(bits)
    for side in ("right", "left", "score"):
        maps.add(side, maps.places(_above(threes, limits, side)))
    three = share(maps)

    def fourth(w: Words) -> np.ndarray:
        h, has = w.grown(3), three.value.has
        return has("right", h[:-1]) & has("left", h[1:]) | has("score", h[:-1]) | has("score", h[1:])

    fours = materialise(counted(texts, 4, fourth).where(F.col("a") >= least), "fours")
    fours = _scored(fours, 4, known.unionByName(threes.select("lang", "phrase", "a")))
    good = [_above(rows, limits, "score") for rows in (pairs, threes, fours)]
    left = _free(good[0], threes, 2, inside).unionByName(_free(good[1], fours, 3, inside)).unionByName(good[2])
    return materialise(left.select("lang", "phrase", "a", "l", "r", "score"), "survivors")
