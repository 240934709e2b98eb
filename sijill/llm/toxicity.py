"""Toxic passages by maximum-scoring segments of token log-odds.

A token's score is the log-odds of its documents being toxic, with priors from the tokens that begin alike; tokens that tell
nothing cost a little. One scan over a text finds all its maximal segments (each as heavy as it can be made, disjoint).
By the theory of extreme values a clean text of n tokens has about K n exp(-lambda s) segments of score s or more by chance;
that expected number of its segments together is what a document is judged by.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sijill.llm.quality import bounded_labels
from sijill.operators.scale import Lookup
from sijill.session import materialise

TRAINING_ROWS = 100_000   # labelled documents to learn from, at most (on average)
PREFIX = 4                # characters of a token's beginning
PRIOR = 4.0               # documents that the prior of a token's log-odds stands for
LEAST_SCORE = 2.0         # smaller log-odds count as telling nothing
COST = 0.05               # of every other token
CALIBRATION = 4           # one in so many labelled documents is kept for the constants of chance
EXPECTED = 0.005          # expected number of chance segments at which the score is 0.5
_TOKEN = re.compile(r"[^\W\d_]+")

Model = tuple[dict[str, float], dict[str, float], float, float]


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def maximal_segments(hits: list[tuple[int, float]], cost: float) -> list[tuple[int, int, float]]:
    """(first, last, score) of all maximal segments; ``hits`` are the positions with a positive score, in order.

    Between two hits every token costs ``cost``. Linear: a candidate is looked at again only when it is swallowed.
    """
    found: list[tuple[int, int, float, float, int]] = []  # first, last, total before, total after, the candidate below it
    total, previous = 0.0, -1
    for at, score in hits:
        total -= cost * (at - previous - 1)
        previous = at
        first, before, after = at, total, total + score
        total = after
        j = len(found) - 1
        while True:
            # The last candidate that began lower; those between two links began higher than the upper one.
            while j >= 0 and found[j][2] >= before:
                j = found[j][4]
            if j < 0 or found[j][3] >= after:
                found.append((first, at, before, after, j))
                break
            first, before, below = found[j][0], found[j][2], found[j][4]
            del found[j:]
            j = below
    return [(first, last, after - before) for first, last, before, after, _ in found]


def _scan(text: str, model: Model) -> tuple[int, list[tuple[int, int, float]]]:
    """Number of tokens, and the maximal segments of one text."""
    words, begins, _, _ = model
    found = tokens(text)
    hits = []
    for i, w in enumerate(found):
        s = words.get(w)
        if s is None:
            s = begins.get(w[:PREFIX])
        if s:
            hits.append((i, s))
    return len(found), maximal_segments(hits, COST)


def expected(n: int, segments: list[tuple[int, int, float]], lam: float, k: float) -> float:
    """Expected number of chance finds like the text's segments together.

    The sum of r segments is the statistic: each adds its normalised score, and r! and their order is counted out.
    """
    if not n or not segments:
        return math.inf
    best, total = math.inf, 0.0
    for r, s in enumerate(sorted((x[2] for x in segments), reverse=True), 1):
        total += lam * s - math.log(max(k * n, 1e-9))
        # exp(-T) T^(r-1) / (r! (r-1)!) for the sum T of the r best, halved for each further r tried.
        if total > 0:
            log_e = -total + (r - 1) * math.log(total) - math.lgamma(r + 1) - math.lgamma(r) + r * math.log(2)
            best = min(best, math.exp(min(log_e, 700)))
    return best


def score_of(text: str | None, model: Model) -> tuple[float, list[tuple[int, int, float]]]:
    """(score, segments): 0.5 where the expected number of chance finds is ``EXPECTED``, near 0 without segments."""
    if not text:
        return 0.0, []
    n, segments = _scan(text, model)
    e = expected(n, segments, model[2], model[3])
    return (1.0 / (1.0 + e / EXPECTED) if e < math.inf else 0.0), segments


def learn(docs: DataFrame, labels: DataFrame, text: str = "text") -> Model:
    """Token scores and the two constants of chance, from labelled rows (doc_id, toxic).

    What reaches the driver is the lexicon, whole, and single values; the training rows bound it. Without toxic or
    without clean documents nothing is toxic.
    """
    bounded = F.broadcast(bounded_labels(labels, "toxic", TRAINING_ROWS))  # bounded, so it goes to every task
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col(text)).alias("_text")).where(F.col("_text").isNotNull())
            .join(bounded, "doc_id").withColumn("_kept", F.pmod(F.xxhash64("_text"), F.lit(CALIBRATION)) == 0))
    rows, others = rows.where("not _kept"), rows.where("_kept")
    bad = F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0))
    tokenised = rows.select("toxic", F.array_distinct(F.regexp_extract_all("_text", F.lit(r"(\p{L}+)"), F.lit(1))).alias("w"))
    counts = (tokenised.select("toxic", F.explode("w").alias("word")).groupBy("word")
              .agg(bad.alias("bad"), F.count("*").alias("n")))
    counts = materialise(counts, "token-counts")
    n_docs, n_bad = rows.agg(F.count("*"), bad).first()
    if not n_bad or n_bad == n_docs:
        return {}, {}, 1.0, 1.0
    base = n_bad / n_docs
    odds = lambda share: F.log(share / (1 - share)) - math.log(base / (1 - base))
    # A beginning is judged by its different words, each as one: common words must not speak for the rare ones.
    kind = F.when(F.col("bad") / F.col("n") > 0.5, 1.0).otherwise(0.0)
    beginnings = (counts.where(F.length("word") > PREFIX).groupBy(F.substring("word", 1, PREFIX).alias("begin"))
                  .agg(F.sum(kind).alias("bad"), F.count("*").alias("n")))
    by_begin = beginnings.select("begin", ((F.col("bad") + PRIOR * base) / (F.col("n") + PRIOR)).alias("share"))
    strong = materialise(by_begin.where(F.col("share") > 0.6), "beginnings")
    prior = F.coalesce("share", F.lit(base))
    known = Lookup(strong)
    begun = counts.withColumn("begin", F.substring("word", 1, PREFIX))
    judged = (known.join(begun.where("bad > 0"), ["begin"], "left", spread=["word"])
              .select("word", odds((F.col("bad") + PRIOR * prior) / (F.col("n") + PRIOR)).alias("score")))
    clean = known.join(begun.where("bad = 0"), ["begin"], "left_semi", spread=["word"])
    words = judged.where(F.col("score") >= LEAST_SCORE).select("word", "score").collect()
    # Words that were seen in clean texts alone don't get the score of their beginning.
    quiet = clean.select("word").collect()
    lexicon = {r.word: 0.0 for r in quiet} | {r.word: float(r.score) for r in words}
    begins = {r.begin: float(math.log(r.share / (1 - r.share)) - math.log(base / (1 - base))) for r in strong.collect()}
    lam, k = chance(others.where("toxic = 0"), lexicon, begins)
    return lexicon, begins, lam, k


def chance(clean: DataFrame, lexicon: dict[str, float], begins: dict[str, float]) -> tuple[float, float]:
    """(lambda, K) of clean texts that the lexicon wasn't learned from: lambda balances rare hits against the cost, K is fitted to their best segments."""
    shared = clean.sparkSession.sparkContext.broadcast((lexicon, begins, 1.0, 1.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[float, list[int]] = {}
        n_all, docs = 0, 0
        for b in batches:
            for t in b.column(0).to_pylist():
                n, segments = _scan(t, shared.value)
                n_all, docs = n_all + n, docs + 1
                for s in segments:
                    found.setdefault(round(s[2], 1), [0])[0] += 1
        yield pa.RecordBatch.from_arrays([pa.array([-1.0, *found]), pa.array([n_all, *[v[0] for v in found.values()]], pa.int64())],
                                         ["score", "n"])

    seen = clean.select("_text").mapInArrow(run, "score double, n long").groupBy("score").agg(F.sum("n").alias("n")).toPandas()
    tokens_seen = max(1, int(seen[seen["score"] < 0]["n"].sum()))
    hits = seen[seen["score"] >= 0].sort_values("score")
    n = np.append(hits["n"].to_numpy(float), 1.0)  # one more than was seen, just above all scores
    s = np.append(hits["score"].to_numpy(float), (hits["score"].max() if len(hits) else 0.0) + LEAST_SCORE)
    # Segments of score s or more per token fall off as K exp(-lambda s): the mean excess over the least score gives lambda.
    lam = 1.0 / max(float((n * (s - LEAST_SCORE)).sum() / n.sum()), 0.25)
    return lam, float(n.sum() / tokens_seen * math.exp(lam * LEAST_SCORE))


def scored(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` with score, predicted, and the passages found (first and last token, score), for every row.

    Null and empty texts have score 0 and no passages; rows that repeat are scored each for itself.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    passage = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [score_of(t, shared.value) for t in b.column("_text").to_pylist()]
            passages = [[{"first": x[0], "last": x[1], "score": x[2]} for x in f[1]] for f in found]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(i) for i in range(len(keep))], pa.array([f[0] for f in found], pa.float64()),
                 pa.array([int(f[0] >= 0.5) for f in found], pa.int32()), pa.array(passages, passage)],
                [*keep, "score", "predicted", "passages"])

    rows = docs.select(*keep, F.col(text).alias("_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return rows.mapInArrow(run, f"{kept}, score double, predicted int, passages array<struct<first:int,last:int,score:double>>")
