"""Quality of documents by hierarchical empirical Bayes: the text's evidence, its site's and its section's.

A classifier on counted properties of a text gives each document a probability. Sites, and sections of a site, have
the mean of their documents' probabilities as their rate, shrunk towards the level above: few documents move little. How strong the
shrinking is, the spread of the rates says. A document's odds are its own times those of its section against the whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sijill.llm.quality import base_rules, bounded_labels
from sijill.llm.text import joined
from sijill.operators.scale import Lookup
from sijill.session import materialise

TRAINING_ROWS = 100_000  # labelled documents the classifier is fitted to, at most (on average)
BINS = 12
SMOOTHING = 1.0          # documents added to every cell
TEMPER = 0.5             # weight of the evidence, as properties of one text depend on each other

PROPERTIES = ["words", "word_chars", "upper", "digits", "marks", "symbols", "dup_lines", "repeats"]


def _bin(share: float) -> int:
    """Shares in bins that double: 0 for none, 1 below 1/1024, up to 11 for a half and more."""
    return 0 if share <= 0 else int(min(BINS - 1, max(1, np.floor(np.log2(share)) + BINS)))


def properties(text: str | None) -> list[int]:
    """Bin of each property of one text."""
    n, chars, symbols, dup, repeats = base_rules(text)
    size = max(chars, 1)
    upper = sum(map(str.isupper, text)) if text else 0
    data = joined([text])[0]
    digits = int(((data >= 48) & (data <= 57)).sum())
    marks = int((data == 33).sum() + (data == 63).sum())
    lines = max((text or "").count("\n") + 1, 1)
    return [min(BINS - 1, n.bit_length()), min(BINS - 1, chars // max(n, 1)), _bin(upper / size), _bin(digits / size),
            _bin(marks / size), _bin(symbols / size), _bin(dup / lines), _bin(repeats / max(n, 1))]


def measured(docs: DataFrame, text: str = "text", site: str = "source", section: str = "lang") -> DataFrame:
    """(doc_id, site, section, bins) of every row; site and section are columns, such as a host and a path where a table has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins = [properties(t) for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(bins, pa.list_(pa.int32()))],
                                             ["doc_id", "site", "section", "bins"])

    return docs.select(F.col("doc_id").cast("long"), F.col(site).cast("string").alias("site"),
                       F.col(section).cast("string").alias("section"), F.col(text).alias("_text")).mapInArrow(
        run, "doc_id long, site string, section string, bins array<int>")


def evidence(rows: DataFrame, labels: DataFrame) -> tuple[list[list[float]], float]:
    """Log-odds of good against bad per property and bin, and those of a document before it is read."""
    marked = F.broadcast(bounded_labels(labels, "quality", TRAINING_ROWS))  # bounded, so it goes to every task
    cells = (rows.join(marked, "doc_id").select("quality", F.posexplode("bins").alias("property", "bin"))
             .groupBy("property", "bin").agg(F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
                                             F.sum(F.when(F.col("quality") == 1, 0).otherwise(1)).alias("bad")).collect())
    good, bad = np.full((len(PROPERTIES), BINS), SMOOTHING), np.full((len(PROPERTIES), BINS), SMOOTHING)
    for c in cells:
        good[c.property, c.bin] += c.good
        bad[c.property, c.bin] += c.bad
    share = lambda x: x / x.sum(axis=1, keepdims=True)
    prior = float(np.log(good[0].sum()) - np.log(bad[0].sum()))
    return (np.log(share(good)) - np.log(share(bad))).tolist(), prior


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def _strength(groups: DataFrame, mean: float) -> float:
    """How many documents the level above counts for: small when rates differ much, by the moments of a beta."""
    spread = groups.where("n > 1").agg(F.sum(F.col("n") * F.pow(F.col("total") / F.col("n") - mean, 2)) / F.sum("n")).first()[0]
    most = mean * (1 - mean)
    return 1000.0 if not spread else float(min(1000.0, max(1.0, most / spread - 1)))


def judged(docs: DataFrame, labels: DataFrame, text: str = "text", site: str = "source", section: str = "lang") -> DataFrame:
    """(doc_id, text_score, site_rate, section_rate, score, kept) of every row.

    A missing source or language is a site or section of its own. A document's own probability is left out of
    the rates it is judged by. Without labels of both kinds all evidence is 0. Null and empty texts are judged as texts
    without words, rows that repeat each for itself.
    """
    rows = materialise(measured(docs, text, site, section), "properties")
    weights, prior = evidence(rows, labels)
    table = F.array(*[F.array(*map(F.lit, w)) for w in weights])
    total = F.aggregate(F.sequence(F.lit(1), F.lit(len(PROPERTIES))), F.lit(0.0),
                        lambda s, i: s + F.element_at(F.element_at(table, i), F.element_at("bins", i) + 1))
    chance = 1 / (1 + F.exp(-(F.lit(prior) + TEMPER * total)))
    named = lambda c: F.coalesce(F.concat(F.lit("+"), c), F.lit("-"))
    scored = rows.select("doc_id", named("site").alias("site"), named("section").alias("section"), chance.alias("p"))
    sections = materialise(scored.groupBy("site", "section").agg(F.count("*").alias("n"), F.sum("p").alias("total")), "sections")
    sites = sections.groupBy("site").agg(F.sum("n").alias("site_n"), F.sum("total").alias("site_total"))
    whole = sections.agg(F.sum("total"), F.sum("n")).first()
    mean = float(whole[0] / whole[1]) if whole[1] else 0.5
    k_site = _strength(sites.select(F.col("site_n").alias("n"), F.col("site_total").alias("total")), mean)
    k_section = _strength(sections, mean)
    rates = Lookup(materialise(sections.join(sites, "site"), "rates"))
    met = rates.join(scored, ["site", "section"], "inner", spread=["doc_id"])
    site_rate = (F.col("site_total") - F.col("p") + k_site * mean) / (F.col("site_n") - 1 + k_site)
    with_site = met.withColumn("site_rate", site_rate)
    rated = with_site.withColumn("section_rate", (F.col("total") - F.col("p") + k_section * F.col("site_rate")) / (F.col("n") - 1 + k_section))
    odds = _logit(F.col("p")) + _logit(F.col("section_rate")) - _logit(F.lit(mean))
    score = 1 / (1 + F.exp(-odds))
    return rated.select("doc_id", F.col("p").alias("text_score"), "site_rate", "section_rate", score.alias("score"),
                        (score >= 0.5).alias("kept"))
