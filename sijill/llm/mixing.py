"""Mixing sources to target weights by pivotal rounding.

Every source has a target in words; a document of it is to be taken target / source size times, a number with a fraction.
Whole copies are taken, and the fractions are rounded in pairs: some words move from one document's fraction to the other's,
in a random direction and as many as make one of the two whole, so that expectations and the sum of words stay. What
one group leaves over goes into the next level of a reduction tree, until one document of a source is left and drawn for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sijill.llm.text import row_name, word_count
from sijill.operators.scale import Lookup, numbered
from sijill.session import materialise

WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3
GROUP = 64  # fractions that one step of the tree takes together, on average

_ROW = "struct<hi: bigint, lo: bigint>"
_UNIT = f"struct<doc_id: bigint, row: {_ROW}, no: bigint, size: bigint, p: double>"
_DONE = f"array<struct<doc_id: bigint, row: {_ROW}, no: bigint, size: bigint, up: boolean>>"


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source, null for a missing source.

    Weights repeat over the sources by code point, null last. All targets sum to all sizes, none is above ``most`` times its
    source: targets are min(most * size, level * weight).
    """
    keyed = sizes.withColumns({"null_last": F.col("source").isNull(), "source_key": F.coalesce("source", F.lit(""))})
    order = numbered(keyed, ["null_last", "source_key"], "place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = materialise(order.withColumn("weight", weight).withColumn("full_at", most * F.col("source_size") / F.col("weight")),
                       "source-weights")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level = _level_of(rows, float(total), most)
    return rows.select("source", "source_size", F.least(F.lit(float(most)) * F.col("source_size"), F.lit(level) * F.col("weight"))
                       .alias("target"))


def _level_of(rows: DataFrame, total: float, most: int) -> float:
    """The level L with sum(min(most * size, L * weight)) = total.

    Each pass adds up what full sources take and what the others weigh; the level rises until no
    further source gets full. A pass is one sum over the sources, and every pass but the last fills at least one of them.
    """
    level = 0.0
    while True:
        full = F.col("full_at") <= F.lit(level)
        taken, weight = rows.agg(F.sum(F.when(full, most * F.col("source_size")).otherwise(F.lit(0.0))),
                                 F.sum(F.when(full, F.lit(0.0)).otherwise(F.col("weight")))).first()
        if not weight:
            return level
        risen = (total - taken) / weight
        if risen <= level * (1 + 1e-12):
            return max(level, risen)
        level = risen


def _draw(*parts: Column) -> Column:
    """A number in [0, 1) that depends on nothing but the parts."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))


def _pair(state: Column, unit: Column) -> Column:
    """One pivotal step between the left-over unit and the next one.

    ``t`` words can move to the left-over unit (up) or from it (down) until one of the two is whole; the direction's chance is the
    other's distance, so that expected words stay.
    """
    a, b = state["left"], unit
    up = F.least(a["size"] * (1 - a["p"]), b["size"] * b["p"])
    down = F.least(a["size"] * a["p"], b["size"] * (1 - b["p"]))
    rises = _draw(a["doc_id"], a["row"], a["no"], b["doc_id"], b["row"], b["no"], a["size"], b["size"]) * (up + down) < down
    move = F.when(rises, up).otherwise(-down)
    pa_, pb_ = a["p"] + move / a["size"], b["p"] - move / b["size"]
    # Which of the two gets whole is decided by the lengths, not by rounded sums.
    a_whole = F.when(rises, a["size"] * (1 - a["p"]) <= b["size"] * b["p"]).otherwise(a["size"] * a["p"] <= b["size"] * (1 - b["p"]))
    inside = lambda p: F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))

    def done(u: Column, is_up: Column) -> Column:
        return F.array(F.struct(*[u[c].alias(c) for c in ("doc_id", "row", "no", "size")], is_up.alias("up")))

    def left(u: Column, p: Column) -> Column:
        return F.struct(*[u[c].alias(c) for c in ("doc_id", "row", "no", "size")], inside(p).alias("p"))

    decided = F.when(a_whole, done(a, rises)).otherwise(done(b, ~rises))
    rest = F.when(a_whole, left(b, pb_)).otherwise(left(a, pa_))
    return F.struct(rest.alias("left"), F.concat(state["done"], decided).cast(_DONE).alias("done"))


def _largest_first(units: Column) -> Column:
    """Units by falling size, so that small ones settle the large ones and what a group leaves over is small."""
    keyed = F.array_sort(F.transform(units, lambda u: F.struct((-u["size"]).alias("falling"), u.alias("unit"))))
    return F.transform(keyed, lambda k: k["unit"])


def _folded(groups: DataFrame) -> DataFrame:
    """(source, node, left, done) from (source, node, units): the units of each group, rounded pair by pair."""
    first = F.element_at("units", 1)
    start = F.struct(first.alias("left"), F.array().cast(_DONE).alias("done"))
    folded = F.aggregate(F.slice("units", 2, F.greatest(F.size("units") - 1, F.lit(1))), start, _pair)
    return groups.select("source", "node", folded.alias("f")).select("source", "node", "f.left", "f.done")


def rounded(units: DataFrame, group: int = GROUP) -> DataFrame:
    """(source, doc_id, row, no, size, up) from (source, doc_id, row, no, size, p): fractions rounded to all or nothing.

    ``source`` is a key without nulls, sizes are above 0. Nodes of the tree are hashes of the rows, cut to fewer at each
    level, and a level's groups hold ``group`` units on average, however large a source is.
    """
    counts = units.groupBy("source").agg(F.count("*").alias("n"))
    largest = counts.agg(F.max("n")).first()[0] or 0
    levels, left = 0, largest
    while left > 1:
        levels, left = levels + 1, -(-left // group) if left > group else 1
    unit = F.struct("doc_id", "row", "no", "size", "p").cast(_UNIT)
    # As many groups at the lowest level as the source needs; each level divides the node by ``group``.
    rows = Lookup(materialise(counts, "unit-counts")).join(units, ["source"], "inner", spread=["doc_id", "row", "no"]).select(
        "source", F.pmod(F.xxhash64("doc_id", "row", "no", F.lit(3)), F.ceil(F.col("n") / group)).alias("node"), unit.alias("unit"))
    results = []
    for level in range(max(levels, 1)):
        groups = rows.groupBy("source", "node").agg(_largest_first(F.collect_list("unit")).alias("units"))
        folded = materialise(_folded(groups), "rounded")
        results.append(folded.select("source", F.explode("done").alias("d")).select("source", "d.*"))
        rows = folded.select("source", F.floor(F.col("node") / group).cast("bigint").alias("node"), F.col("left").alias("unit"))
    last = rows.select("source", "unit.doc_id", "unit.row", "unit.no", "unit.size",
                       (_draw(F.col("source"), F.col("unit.doc_id"), F.col("unit.row"), F.col("unit.no")) < F.col("unit.p")).alias("up"))
    for r in results:
        last = last.unionByName(r)
    return last


def copies(docs: DataFrame, text: str = "text", weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(doc_id, source, row, size, source_size, target, copies, taken) of every row; ``row`` is its name by all its columns.

    A row without words has size 0 and is taken as often as whole copies go. Rows that repeat are drawn for one by one, a null
    source is one source, and the same rows give the same draw. Only rows that agree in every column share a name, so copies go
    back to their own text. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       row_name(docs).alias("row"), word_count(F.col(text)).alias("size"))
    sized = materialise(rows, "sizes")
    sources = materialise(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "targets")
    key = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), "source"))
    by_key = Lookup(sources.withColumn("key", key).drop("source"))
    met = by_key.join(sized.withColumn("key", key), ["key"], "inner", spread=["doc_id", "row"])
    want = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    wanted = met.withColumn("want", want).withColumn("whole", F.least(F.floor("want"), F.lit(most)).cast("bigint"))
    # Equal rows are told apart by a running number.
    equal = (wanted.groupBy("key", "doc_id", "source", "row", "size", "source_size", "target", "want", "whole").agg(F.count("*").alias("n"))
             .withColumn("no", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("n"))
    equal = materialise(equal, "wanted")
    part = F.col("want") - F.col("whole")
    fractions = equal.where((F.col("size") > 0) & (part > 1e-12)).select(
        F.col("key").alias("source"), "doc_id", "row", "no", "size", part.alias("p"))
    drawn = rounded(fractions).select(F.col("source").alias("key"), "doc_id", "row", "no", "size", "up")
    flat = equal.where(~((F.col("size") > 0) & (part > 1e-12))).withColumn("up", F.lit(False))
    info = by_key.join(drawn, ["key"], "inner", spread=["doc_id", "row", "no"])
    split = info.select("key", "doc_id", F.when(F.col("key") != "-", F.substring("key", 2, 1 << 30)).alias("source"), "row", "size", "source_size",
                        "target", F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))).alias("whole"), "up")
    both = split.unionByName(flat.select(*split.columns))
    n = F.least(F.coalesce("whole", F.lit(0)) + F.col("up").cast("bigint"), F.lit(most))
    return both.withColumn("copies", n.cast("int")).select(
        "doc_id", "source", "row", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).cast("bigint").alias("taken"))
