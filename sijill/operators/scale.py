"""Building blocks that hold when one key owns a large share of the rows.

* ``Lookup``          joins a dimension: broadcast only after its size was measured
* ``spread_join``     equi-join with hot and missing keys spread over many tasks
* ``numbered_within`` exact row numbers per group, hot groups split over slices
* ``numbered``        exact row numbers over a whole table
* ``paged_lists``     ordered lists in pages of a fixed size, never one list per hot group; ``paged_sides`` makes several at once
* ``first_per_group`` the first n rows per group, cut down before the shuffle by group
"""

from __future__ import annotations

from functools import cached_property, reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sijill.session import materialise

HOT_ROWS = 1_000_000       # a group with more rows is not handled by a single task
MAX_HOT_KEYS = 1 << 16     # most keys that can be called hot, so their list stays small
LOOKUP_ROWS = 200_000      # largest dimension that is broadcast, in rows
LOOKUP_BYTES = 64 << 20    # and in bytes
MAX_SLICES = 1 << 13       # most slices of a table that is numbered; beyond it slices hold more rows
SALTS = 64
PAGE = 1_000


class Lookup:
    """A dimension table with unique keys, broadcast when it was measured to be small."""

    def __init__(self, df: DataFrame, max_rows: int = LOOKUP_ROWS, max_bytes: int = LOOKUP_BYTES):
        self.df, self._max_rows, self._max_bytes = df, max_rows, max_bytes

    @cached_property
    def is_small(self) -> bool:
        seen = self.df.agg(F.count("*").alias("rows"),
                           F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("bytes")).first()
        return seen.rows <= self._max_rows and (seen.bytes or 0) <= self._max_bytes

    def join(self, rows: DataFrame, on: list[str], how: str = "left", spread: list[str] | None = None) -> DataFrame:
        """Join on equally named columns; ``spread`` names columns that tell rows apart."""
        if self.is_small:
            return rows.join(F.broadcast(self.df), on, how)
        return spread_join(rows, self.df, on, how, spread=spread or rows.columns)


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """Keys that own more rows than one task should take, with their rows ``_n``, or None when there are none.

    Counting combines map-side. At most ``MAX_HOT_KEYS`` keys qualify, since each of
    them owns more than that fraction of the table.
    """
    return _hot_counts(df.groupBy(*keys).agg(F.count("*").alias("_n")), hot_rows)


def _hot_counts(counts: DataFrame, hot_rows: int) -> DataFrame | None:
    """``hot_keys`` from the rows ``_n`` of each key."""
    seen = counts.agg(F.sum("_n").alias("total"), F.max("_n").alias("largest")).first()
    if seen.largest is None or seen.largest <= hot_rows:
        return None
    floor = max(hot_rows, seen.total // MAX_HOT_KEYS)
    hot = materialise(counts.where(F.col("_n") > floor), "hot-keys")
    return None if hot.isEmpty() else hot


def _flag_hot(df: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with a boolean ``_hot``; a missing key can be hot too."""
    marks = hot.select(*[F.col(k).alias(f"_hot_{k}") for k in keys], F.lit(True).alias("_hot"))
    same = reduce(and_, [df[k].eqNullSafe(marks[f"_hot_{k}"]) for k in keys])
    return (df.join(F.broadcast(marks), same, "left").drop(*[f"_hot_{k}" for k in keys])
            .withColumn("_hot", F.coalesce("_hot", F.lit(False))))


def spread_join(left: DataFrame, right: DataFrame, on: list[str], how: str, spread: list[str],
                hot_rows: int = HOT_ROWS, salts: int = SALTS) -> DataFrame:
    """Join ``left`` to ``right`` (inner, left, left_semi, left_anti) on equally named columns.

    Rows of a hot key get one of ``salts`` buckets by a hash of the ``spread`` columns, and the
    right rows of that key are repeated per bucket. Other keys are joined as usual.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"cannot spread a {how} join")
    hot = hot_keys(left, on, hot_rows)
    if hot is None:
        return left.join(right, on, how)
    bucket = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    salted = _flag_hot(left, hot, on).withColumn("_salt", F.when(F.col("_hot"), bucket).otherwise(0)).drop("_hot")
    buckets = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    repeated = _flag_hot(right, hot, on).withColumn("_salt", F.explode(buckets)).drop("_hot")
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


def key_or_own(key: Column, spread: list[str]) -> Column:
    """The key as text, and for a missing key a text of the row's own that equals no key.

    Rows without a key match nothing, so in an outer or anti join they need not meet in one task.
    """
    return F.coalesce(key.cast("string"), F.concat(F.lit("\0"), F.xxhash64(*spread).cast("string")))


def _in_slices(df: DataFrame, order: list[str], slices: int) -> DataFrame:
    """Range-partition by ``order`` and keep the slice number with each row.

    The table is written, so that both readers of it see the same slices.
    """
    placed = df.repartitionByRange(slices, *order).withColumn("_slice", F.spark_partition_id())
    return materialise(placed, "slices")


def _number_slices(df: DataFrame, keys: list[str], order: list[str], name: str, slices: int) -> DataFrame:
    placed = _in_slices(df, [*keys, *order], slices)
    counts = placed.groupBy("_slice", *keys).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    # One row per slice and key it holds: at most MAX_SLICES and MAX_HOT_KEYS together, whatever the table's size.
    before = counts.select(
        F.col("_slice").alias("_before_slice"), *[F.col(k).alias(f"_before_{k}") for k in keys],
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_slice", *keys).orderBy(*order))
    ranked = placed.withColumn("_local", local)
    same = reduce(and_, [ranked["_slice"] == before["_before_slice"],
                         *[ranked[k].eqNullSafe(before[f"_before_{k}"]) for k in keys]])
    joined = ranked.join(F.broadcast(before), same, "inner")
    return joined.select(*df.columns, (F.col("_local") + F.col("_before")).cast("bigint").alias(name))


def _slices(rows: int, slice_rows: int) -> int:
    """How many slices a table of so many rows is numbered in."""
    return min(-(-rows // slice_rows) or 1, MAX_SLICES)


def numbered(df: DataFrame, order: list[str], name: str = "n", slice_rows: int = HOT_ROWS) -> DataFrame:
    """Exact 1-based row numbers over the whole table; ``order`` must be a total order."""
    return _number_slices(df, [], order, name, slices=_slices(df.count(), slice_rows))


def numbered_within(df: DataFrame, keys: list[str], order: list[str], name: str = "n",
                    hot_rows: int = HOT_ROWS, counts: DataFrame | None = None) -> DataFrame:
    """Exact 1-based row numbers per group; ``order`` must be a total order within a group.

    ``counts`` are the rows ``_n`` of each key where they are known; otherwise they are counted.
    """
    plain = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint")
    hot = hot_keys(df, keys, hot_rows) if counts is None else _hot_counts(counts, hot_rows)
    if hot is None:
        return df.withColumn(name, plain)
    flagged = _flag_hot(df, hot, keys)
    usual = flagged.where(~F.col("_hot")).drop("_hot").withColumn(name, plain)
    slices = _slices(hot.agg(F.sum("_n")).first()[0], hot_rows)
    large = _number_slices(flagged.where("_hot").drop("_hot"), keys, order, name, slices)
    return usual.unionByName(large)


def paged_lists(df: DataFrame, keys: list[str], order: list[str], value: str, name: str,
                page: int = PAGE, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Ordered list of ``value`` per group as rows (keys, part, list).

    A list has at most ``page`` entries. Part 0 is the whole list of nearly every group; a
    longer one goes on in part 1, 2, … and the parts in order are the whole list.
    """
    return paged_sides(df.withColumn("side", F.lit(0)), keys, order, value, [name], page, hot_rows)


def paged_sides(df: DataFrame, keys: list[str], order: list[str], value: str, names: list[str],
                page: int = PAGE, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Several lists per group at once, as rows (keys, part, lists); ``side`` tells, from 0, to which of ``names`` a row belongs.

    Groups whose lists all fit into a page are put together by one grouping; only rows of longer ones are numbered. A
    side without entries in a part is an empty list.
    """
    rows = df.select(*dict.fromkeys([*keys, "side", *order, value]))
    sizes = [f"_n{i}" for i in range(len(names))]
    counts = rows.groupBy(*keys).agg(*[F.count_if(F.col("side") == i).alias(n) for i, n in enumerate(sizes)])
    degrees = materialise(counts.withColumn("_long", reduce(or_, [F.col(n) > page for n in sizes])), "degrees")
    own = reduce(add, [F.col(n) for n in sizes])
    seen = degrees.agg(F.sum(own).alias("rows"), F.sum(F.when(F.col("_long"), own)).alias("long")).first()

    def lists(part: DataFrame, place: list[str]) -> DataFrame:
        entry = F.struct(*place, F.col(value).alias("_v"))
        return part.groupBy(*keys, "part").agg(*[
            F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == i, entry))), lambda e: e["_v"]).alias(n)
            for i, n in enumerate(names)])

    # Sizes are known, so rows are not counted again.
    by_side = F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.col(n).alias("_n")) for i, n in enumerate(sizes)]))
    counts = degrees.select(*keys, by_side.alias("_c")).select(*keys, "_c.side", "_c._n")

    def numbered_lists(part: DataFrame) -> DataFrame:
        # Dealt by key alone, rows are numbered by side and grouped by part where they are.
        ranked = numbered_within(part.repartition(*keys), [*keys, "side"], order, "_n", hot_rows, counts)
        return lists(ranked.withColumn("part", F.floor((F.col("_n") - 1) / page).cast("int")), ["_n"])

    if not seen.long:
        return lists(rows.withColumn("part", F.lit(0)), list(order))
    # Where long groups hold most rows, or are more than a broadcast takes, all rows are numbered.
    long = Lookup(degrees.where("_long").select(*keys))
    if 2 * seen.long > seen.rows or not long.is_small:
        return numbered_lists(rows)
    flagged = _flag_hot(rows, long.df, keys)
    usual = lists(flagged.where(~F.col("_hot")).withColumn("part", F.lit(0)), list(order))
    return usual.unionByName(numbered_lists(flagged.where("_hot").drop("_hot")))


def first_per_group(df: DataFrame, keys: list[str], order: list[str], n: int, spread: list[str],
                    salts: int = SALTS) -> DataFrame:
    """The first ``n`` rows of each group.

    First per group and bucket, then per group: the last step sees at most ``salts * n`` rows
    of a group, and Spark applies the first limit before its shuffle as well.
    """
    bucketed = df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
    by_bucket = Window.partitionBy(*keys, "_salt").orderBy(*order)
    by_group = Window.partitionBy(*keys).orderBy(*order)
    some = bucketed.withColumn("_rn", F.row_number().over(by_bucket)).where(F.col("_rn") <= n).drop("_rn", "_salt")
    return some.withColumn("_rn", F.row_number().over(by_group)).where(F.col("_rn") <= n).drop("_rn")
