"""Near-duplicate documents by HyperMinHash sketches.

A document is the set of its distinct five-word shingles. Every shingle falls in one of ``REGISTERS`` buckets, and a
bucket keeps its smallest hash, compressed to one byte: leading zeros and the bits after them. Eight registers in a row are
a band, and documents that agree in a band are candidates. The share of equal registers, less the collisions that
compression makes by chance, estimates the similarity; what is near enough is verified on the full sets.

A set is one representative, whoever owns it: its number, in the order of the smallest ids that own a set. Ids that own several sets
link these, and rows without an id own their sets like any other. Candidates come in two steps, so that a large group does not
make all its pairs: every member of a band's bucket against the bucket's smallest number, then, in buckets that still hold
several components, what is left in different ones, by the rarest shingles that two sets so similar must share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sijill.llm.text import SMALL, chunks, hashed_words, mix, releasing, row_name, shingles
from sijill.operators.scale import Lookup, numbered, spread_join
from sijill.session import materialise

SHINGLE = 5
ROWS = 8                  # registers of a band, one byte each: a band is a long
BANDS = 40                # at a similarity of 0.85 a pair misses all bands three times in a million, above more rarely
REGISTERS = ROWS * BANDS
MANTISSA = 3              # bits kept after the leading one
ZEROS = 30                # largest count of leading zeros that is told apart
RANDOM_STEPS = 64         # tries of an empty bucket before it walks
HOT_ROWS = 200_000        # rows of a key with registers that one task takes
HOT_TEXTS = 20_000        # and with texts
HOT_MEETING = 2_000       # and members of a shingle that meet others

_SKETCH = "doc_id long, name struct<hi: bigint, lo: bigint>, n_shingles long, set_hi long, set_lo long, bands array<long>"


def _probes() -> np.ndarray:
    """(step, bucket): where an empty bucket looks for a value, in a fixed random order first and from bucket to bucket then."""
    step, bucket = np.arange(RANDOM_STEPS, dtype=np.uint64)[:, None], np.arange(REGISTERS, dtype=np.uint64)[None, :]
    drawn = mix(step * np.uint64(REGISTERS) + bucket + np.uint64(1)) % np.uint64(REGISTERS)
    walked = (np.arange(1, REGISTERS)[:, None] + np.arange(REGISTERS)[None, :]) % REGISTERS
    return np.concatenate([drawn.astype(np.int64), walked])


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``REGISTERS`` bytes per set: 1 + leading zeros * 8 + mantissa of each bucket's smallest hash, all 0 for an empty set.

    The hashes of a set are sorted and distinct; their upper half picks the bucket, mixed bits are the value. An empty
    bucket takes the value of another that is chosen alike for all sets, so that small sets agree in a bucket as
    often as they are similar, too.
    """
    out = np.zeros((len(sets), REGISTERS), dtype=np.uint8)
    sizes = np.array([len(s) for s in sets])
    if not sizes.sum():
        return out
    hashes = np.concatenate(sets)
    place = np.repeat(np.arange(len(sets)) * REGISTERS, sizes) + (
        ((hashes >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    least = np.minimum.reduceat(mix(hashes) >> np.uint64(11), starts)  # 53 bits, exact as a float
    fraction, exponent = np.frexp(least.astype(np.float64))  # least = fraction * 2^exponent, fraction in [0.5, 1)
    zeros = np.minimum(53 - exponent, ZEROS)
    after = np.maximum(np.floor((fraction * 2 - 1) * (1 << MANTISSA)).astype(np.int64), 0)
    out.ravel()[place[starts]] = 1 + zeros * (1 << MANTISSA) + after
    own = out.copy()
    rows, cols = np.nonzero((own == 0) & (sizes > 0)[:, None])
    for probe in _probes():
        if not len(rows):
            break
        value = own[rows, probe[cols]]
        out[rows, cols] = value
        rows, cols = rows[value == 0], cols[value == 0]
    return out


def _chance(mean: np.ndarray) -> np.ndarray:
    """(value, size): the chance of each register value when a bucket holds Poisson(``mean``) hashes, at least one."""
    zeros = np.arange(ZEROS + 1)[:, None]
    part = np.arange(1 << MANTISSA)[None, :]
    low = np.exp2(-zeros - 1.0) * (1 + part / (1 << MANTISSA))
    high = np.exp2(-zeros - 1.0) * (1 + (part + 1) / (1 << MANTISSA))
    low[ZEROS, 0] = 0.0
    above = lambda x: np.exp(-np.outer(x.ravel(), mean))
    return (above(low) - above(high)) / np.maximum(1 - np.exp(-mean), 1e-9)


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of paired sketches (rows of registers), corrected for chance collisions."""
    share = (a == b).mean(axis=1)
    chance = (_chance(size_a / REGISTERS) * _chance(size_b / REGISTERS)).sum(axis=0)
    return (share - chance) / np.maximum(1 - chance, 1e-9)


def _lowest(least: float, smaller: np.ndarray) -> np.ndarray:
    """The estimate five standard errors below ``least``, for pairs whose smaller set has ``smaller`` shingles."""
    own = REGISTERS * (1 - np.exp(-smaller / REGISTERS))  # registers with a hash of their own; the others repeat them
    return least - 5 * np.sqrt(least * (1 - least) / np.maximum(own, 1)) - 0.02


def sketches(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, name, n_shingles, set_hi, set_lo, bands) of every row; ``name`` is the text's own, two sums over
    the set name the set, bands hold its registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            for start, end in chunks(texts, SMALL):
                words, at = hashed_words(texts[start:end])
                sizes, names, sets = [], [], []
                for i in range(end - start):
                    s = shingles(words[at[i]:at[i + 1]], SHINGLE)
                    sizes.append(len(s))
                    names.append((mix(s + np.uint64(1)).sum(dtype=np.uint64), mix(s + np.uint64(7)).sum(dtype=np.uint64)))
                    sets.append(s)
                bands = pa.array(registers(sets).view(np.int64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(bands) + 1, BANDS, dtype=np.int32)), bands)
                pair = np.array(names, dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(start, end - start), b.column(1).slice(start, end - start), pa.array(sizes, pa.int64()), pa.array(pair[:, 0].copy()),
                     pa.array(pair[:, 1].copy()), lists], ["doc_id", "name", "n_shingles", "set_hi", "set_lo", "bands"])

    return docs.select(F.col("doc_id").cast("long"), row_name(docs, text).alias("name"), F.col(text).alias("_text")).mapInArrow(releasing(run), _SKETCH)


def _registers_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, REGISTERS)


def _near(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """Candidate pairs whose estimate lies within five standard errors of ``least`` or above."""
    side = lambda n: reps.select(F.col("rep").alias(n), F.col("n_shingles").alias(f"size_{n}"),
                                 F.col("bands").alias(f"bands_{n}"))
    rows = spread_join(spread_join(pairs, side("a"), ["a"], "inner", ["b"], HOT_ROWS), side("b"), ["b"], "inner", ["a"], HOT_ROWS)
    # Sets of too different sizes cannot be similar.
    rows = rows.where((F.col("size_a") >= F.lit(least) * F.col("size_b")) & (F.col("size_b") >= F.lit(least) * F.col("size_a")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = _registers_of(b.column("bands_a")), _registers_of(b.column("bands_b"))
            sizes = [b.column(f"size_{n}").to_numpy().astype(np.float64) for n in "ab"]
            mask = pa.array(estimate(x, y, *sizes) >= _lowest(least, np.minimum(*sizes)))
            yield pa.RecordBatch.from_arrays([b.column(n).filter(mask) for n in "ab"], ["a", "b"])

    return rows.select("a", "b", "size_a", "size_b", "bands_a", "bands_b").mapInArrow(releasing(run), "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= ``percent`` * union of their full sets."""
    side = lambda n: texts.select(F.col("rep").alias(n), F.col("_text").alias(f"text_{n}"))
    rows = spread_join(spread_join(pairs, side("a"), ["a"], "inner", ["b"], HOT_TEXTS), side("b"), ["b"], "inner", ["a"], HOT_TEXTS)
    rows = rows.select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("text_a"), b.column("text_b")):
                words, at = hashed_words([x.as_py(), y.as_py()])
                s, t = shingles(words[at[0]:at[1]], SHINGLE), shingles(words[at[1]:at[2]], SHINGLE)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(s) + len(t) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(n).filter(mask) for n in "ab"], ["a", "b"])

    return rows.mapInArrow(releasing(run), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest id reachable, of every node of ``links`` (a, b).

    Every node points to its smallest neighbour; chains of pointers are followed by doubling, what they join
    becomes one node, and links between these are the next round's. All steps are joins of written tables.
    """
    spark = links.sparkSession
    links = materialise(links.where("a <> b").select("a", "b").distinct(), "links")
    found = spark.createDataFrame([], "node long, component long")
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.min("b").alias("b"))
        pointer = materialise(smallest.select(F.col("a").alias("node"), F.least("a", "b").alias("to")), "pointers")
        while True:
            target = pointer.select(F.col("node").alias("to"), F.col("to").alias("next"))
            jumped = materialise(pointer.join(target, "to").select("node", F.col("next").alias("to"),
                                                                  (F.col("next") != F.col("to")).alias("moved")), "pointers")
            pointer = jumped.select("node", "to")
            if jumped.where("moved").isEmpty():
                break
        one = lambda n: pointer.select(F.col("node").alias(n), F.col("to").alias(f"to_{n}"))
        found = (found.select("node", F.col("component").alias("old"))
                 .join(pointer.select(F.col("node").alias("old"), "to"), "old", "left")
                 .select("node", F.coalesce("to", "old").alias("component"))
                 .unionByName(pointer.join(found.select("node"), "node", "left_anti").select("node", F.col("to").alias("component"))))
        found = materialise(found, "components")
        links = materialise(links.join(one("a"), "a").join(one("b"), "b").where("to_a <> to_b")
                            .select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).distinct(), "links")
    return found


def _placed(shared: DataFrame, found: DataFrame) -> DataFrame:
    """(key, band, rep, component) of the buckets that hold several components."""
    rows = (shared.select("key", "band", "rep").join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
            .withColumn("component", F.coalesce("component", "rep")))
    mixed = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    return materialise(spread_join(rows, mixed, ["key"], "inner", ["rep"]), "mixed-buckets")


_SHINGLED = pa.schema([("rep", pa.int64()), ("component", pa.int64()), ("n", pa.int64()), ("h", pa.int64())])


def _shingled(left: DataFrame, texts: DataFrame) -> DataFrame:
    """(rep, component, n, h): one row per shingle of the sets in ``left`` (rep, component)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = b.column("_text").to_pylist()
            for start, end in chunks(found, SMALL):
                words, at = hashed_words(found[start:end])
                sets = [shingles(words[at[i]:at[i + 1]], SHINGLE) for i in range(end - start)]
                sizes = np.array([len(s) for s in sets])
                each = lambda n: np.repeat(b.column(n).slice(start, end - start).to_numpy(), sizes)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (each("rep"), each("component"), np.repeat(sizes, sizes),
                                                                        np.concatenate(sets).view(np.int64))], schema=_SHINGLED)

    return left.join(texts, "rep").select("rep", "component", "_text").mapInArrow(releasing(run), "rep long, component long, n long, h long")


def _needed(total: Column, percent: int) -> Column:
    """Shingles that two sets of together ``total`` must share."""
    return F.ceil(total * percent / (100 + percent) - F.lit(1e-9))


def _prefixes(rows: DataFrame, percent: int) -> DataFrame:
    """(h, rep, component, n, after, short): the shingles by which a set can meet one of another component.

    Shingles that one component has for itself come first, the others from the rarest to the commonest. Of two sets that
    are similar enough, the first shingle they share in this order leaves as many ``after`` it, itself included, as they must
    share. So a set of n shingles is found by those that leave enough for a partner of ``percent`` per cent of its size, and by fewer
    (``short``) where the partner is the larger one. A common line falls out, as its shingles come last.
    """
    many = rows.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("f")).where("lo <> hi")
    # Sets that share nothing else meet nobody, so only shared shingles are placed; the others stand before them.
    known = Lookup(materialise(many.select("h", "f"), "shared-shingles"))
    shared = known.join(rows, ["h"], "inner", spread=["rep"])
    back = F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("f"), F.desc("h")))
    placed = shared.withColumn("after", back.cast("long"))
    return placed.where(F.col("after") >= F.ceil(F.col("n") * percent / 100 - F.lit(1e-9))).select(
        "h", "rep", "component", "n", "after", (F.col("after") >= _needed(2 * F.col("n"), percent)).alias("short"))


def _meetings(prefixes: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs of sets of different components that may be similar enough, from what follows a shingle they share."""
    side = lambda n: [F.col(c).alias(f"{c}_{n}") for c in ("rep", "component", "n", "after", "short")]
    smaller, larger = prefixes.where("short").select("h", *side("x")), prefixes.select("h", *side("y"))
    met = spread_join(larger, smaller, ["h"], "inner", ["rep_y"], hot_rows=HOT_MEETING)
    size = F.col("n_x") + F.col("n_y")
    once = (F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (~F.col("short_y") | (F.col("rep_x") < F.col("rep_y"))))
    near = (F.col("component_x") != F.col("component_y")) & once & (F.least("after_x", "after_y") >= _needed(size, percent))
    return met.where(near).select(F.least("rep_x", "rep_y").alias("a"), F.greatest("rep_x", "rep_y").alias("b")).distinct()


def _across(placed: DataFrame, reps: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(a, b): all links between sets of different components that are left in one bucket with another component.

    They are searched by exact prefixes of their shingles, so rows grow with the shingles of what is left, and a pair becomes a
    row only where what follows a shared rare shingle could make it a link.
    """
    left = materialise(placed.select("rep", "component").distinct(), "left-apart")
    rows = materialise(_shingled(left, texts), "shingles")
    pairs = materialise(_meetings(materialise(_prefixes(rows, percent), "prefixes"), percent), "meetings")
    return _verified(_near(pairs, reps, percent / 100), texts, percent)


def _banded(reps: DataFrame) -> DataFrame:
    """(rep, band, key): one row per band that has a register in use; the key names band and registers."""
    return (reps.select("rep", F.posexplode("bands").alias("band", "registers")).where("registers <> 0")
            .select("rep", "band", F.xxhash64("band", "registers").alias("key")))


def _texts(rows: DataFrame, owners: DataFrame) -> DataFrame:
    """(rep, _text): a text of each set, the one of its owner (rep, doc_id, name)."""
    named = rows.withColumn("name", row_name(rows, "_text"))
    known = named.where("doc_id is not null").join(owners.where("doc_id is not null"), ["doc_id", "name"])
    # Texts without an id meet by their name alone, so equal ones become one first.
    nameless = named.where("doc_id is null").dropDuplicates(["name"]).join(owners.where("doc_id is null").drop("doc_id"), "name")
    return known.select("rep", "_text").unionByName(nameless.select("rep", "_text")).dropDuplicates(["rep"])


def near_duplicates(docs: DataFrame, percent: int = 85, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row: documents linked by sets of similarity ``percent`` or more.

    A row without words has an empty set, is linked with nothing and kept. Rows that share an id are linked, as are equal
    sets. A row with a null id belongs to the documents whose sets are linked with its own; where no row of these has an id,
    the component is null and one of the rows is kept.
    """
    return named_near_duplicates(docs, percent, text).drop("name")


def named_near_duplicates(docs: DataFrame, percent: int = 85, text: str = "text") -> DataFrame:
    """``near_duplicates`` with the name of the text, ``row_name`` of it, which tells rows without an id apart; null for the others."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("_text"))
    drawn = materialise(sketches(rows, "_text"), "sketches")
    filled = drawn.where("n_shingles > 0")
    owner = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "name"))
    groups = filled.groupBy("set_hi", "set_lo").agg(owner.alias("owner"))
    sets = materialise(numbered(groups.select("set_hi", "set_lo", "owner"), ["owner", "set_hi", "set_lo"], "rep"), "sets")
    sets = sets.select("set_hi", "set_lo", "rep", F.col("owner.doc_id").alias("own_id"), F.col("owner.name").alias("own_name"))
    owned = spread_join(filled.select("doc_id", "name", "n_shingles", "set_hi", "set_lo"), sets, ["set_hi", "set_lo"], "inner", ["doc_id", "name"])
    members = materialise(owned.select(
        "doc_id", F.when(F.col("doc_id").isNull(), F.col("name")).alias("name"), "n_shingles", "rep", "own_id",
        (F.col("name") == F.col("own_name")).alias("first")), "members")
    sketched = filled.select("set_hi", "set_lo", "n_shingles", "bands").dropDuplicates(["set_hi", "set_lo"])
    every = materialise(sketched.join(sets.select("set_hi", "set_lo", "rep"), ["set_hi", "set_lo"]).select("rep", "n_shingles", "bands"),
                        "representatives")
    banded = _banded(every)
    hubs = banded.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub <> last").drop("last")
    shared = materialise(spread_join(banded, hubs, ["key"], "inner", ["rep"]), "buckets")
    met = materialise(shared.select("rep").distinct(), "met")
    reps = materialise(every.join(met, "rep", "left_semi"), "representatives")
    owners = sets.join(met, "rep", "left_semi").select("rep", F.col("own_id").alias("doc_id"), F.col("own_name").alias("name"))
    texts = materialise(_texts(rows, owners), "texts")
    asked = materialise(shared.where("hub <> rep").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), "asked")
    likely = materialise(_near(asked, reps, percent / 100), "likely")
    known = members.where("doc_id is not null")
    repeated = known.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).where("a <> last")
    same_id = known.join(repeated.select("doc_id", "a"), "doc_id").select("a", F.col("rep").alias("b"))
    links = materialise(_verified(likely, texts, percent).unionByName(same_id), "links")
    found = components(links)
    more = materialise(_across(_placed(shared, found), reps, texts, percent), "links")
    if not more.isEmpty():
        found = components(links.unionByName(more))
    # A component's smallest number belongs to its smallest id, or to a set without one if it has none.
    label = sets.select(F.col("rep").alias("component"), F.col("own_id").alias("component_id"))
    ids = Lookup(materialise(label.join(found.select("component").distinct(), "component", "left_semi"), "component-ids"))
    labelled = ids.join(found.withColumnRenamed("node", "rep"), ["component"], "inner", spread=["rep"])
    placed = members.join(labelled, "rep", "left").withColumn(
        "component_id", F.when(F.col("component").isNull(), F.col("own_id")).otherwise(F.col("component_id")))
    leads = F.col("component_id").isNull() & F.col("first") & (F.coalesce("component", "rep") == F.col("rep"))
    with_id = placed.where("doc_id is not null").select(
        "doc_id", "name", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    # Equal rows without an id are told apart by a running number.
    without = (placed.where("doc_id is null").groupBy("doc_id", "name", "n_shingles", "component_id", leads.alias("leads"))
               .agg(F.count("*").alias("n")).withColumn("no", F.explode(F.sequence(F.lit(1), F.col("n"))))
               .select("doc_id", "name", "n_shingles", "component_id", (F.col("leads") & (F.col("no") == 1)).alias("kept")))
    empty = drawn.where("n_shingles = 0").select("doc_id", F.when(F.col("doc_id").isNull(), F.col("name")).alias("name"), "n_shingles",
                                                 F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return with_id.unionByName(without).unionByName(empty)
