"""Teacher → student edges and the lists read from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sijill.operators.scale import HOT_ROWS, PAGE, Lookup, paged_lists, paged_sides

# Edges are ordered by the entry that mentions them, teachers before students, then list position.
EDGE_ORDER = ["source", "role_rank", "idx"]


def flatten_links(links: DataFrame) -> DataFrame:
    """(links MAP<id, MAP<role, MAP<index, other>>>) → one row (id, role, idx, other) per mention."""
    # An inner explode would have Spark test the parsed map for emptiness first, parsing it again for that.
    entries = links.select(F.explode_outer("links").alias("id", "roles")).where(F.col("id").isNotNull())
    lists = entries.select("id", F.explode("roles").alias("role", "mentions"))
    return (lists.select("id", "role", F.explode("mentions").alias("idx", "other"))
            .select("id", "role", F.col("idx").cast("int").alias("idx"), "other"))


def pairs(mentions: DataFrame) -> DataFrame:
    """Distinct (teacher, student) pairs with the least list position on either side, null where that side does not mention them.

    A pair can be mentioned by the student (role teachers) or by the teacher (any other role), so two minima
    tell its first mention; both combine map-side.
    """
    by_student = F.col("role") == "teachers"
    sides = mentions.select(
        F.when(by_student, F.col("other")).otherwise(F.col("id")).alias("teacher"),
        F.when(by_student, F.col("id")).otherwise(F.col("other")).alias("student"),
        F.when(by_student, F.col("idx")).alias("in_teachers"),
        F.when(~by_student, F.col("idx")).alias("in_students"),
    )
    return _least(sides)


def _least(sides: DataFrame) -> DataFrame:
    return sides.groupBy("teacher", "student").agg(F.min("in_teachers").alias("in_teachers"), F.min("in_students").alias("in_students"))


def edges_of(pair_rows: DataFrame) -> DataFrame:
    """Each pair with the place of its first mention."""
    from_student = F.col("in_teachers").isNotNull() & (
        F.col("in_students").isNull() | (F.col("student") <= F.col("teacher")))
    return pair_rows.select(
        "teacher", "student",
        F.when(from_student, F.col("student")).otherwise(F.col("teacher")).alias("source"),
        F.when(from_student, 0).otherwise(1).alias("role_rank"),
        F.when(from_student, F.col("in_teachers")).otherwise(F.col("in_students")).alias("idx"),
    )


def edges(mentions: DataFrame) -> DataFrame:
    """Distinct (teacher, student) pairs with the place of their first mention."""
    return edges_of(pairs(mentions))


def update_pairs(pair_rows: DataFrame, changed: DataFrame, mentions: DataFrame) -> DataFrame:
    """``pairs`` after the entries ``changed`` (id) mention what ``mentions`` says and nothing else.

    An entry speaks for one side of its pairs, so only pairs with a changed end are taken apart and grouped again; all others
    stay as they are, without a shuffle while the changed entries are few. A pair that no side mentions any more goes. Mentions of other entries
    are not looked at. Positions must not be null; a missing id matches no entry.
    """
    entries = changed.select("id").where(F.col("id").isNotNull()).distinct()
    ends = {"teacher": "_by_teacher", "student": "_by_student"}
    marked = pair_rows
    for end, flag in ends.items():
        marked = Lookup(entries.select(F.col("id").alias(end), F.lit(True).alias(flag))).join(marked, [end], spread=["teacher", "student"])
    t, s = F.coalesce("_by_teacher", F.lit(False)), F.coalesce("_by_student", F.lit(False))
    columns = ["teacher", "student", "in_teachers", "in_students"]
    same = marked.where(~t & ~s).select(*columns)
    left = marked.where(t | s).select("teacher", "student", F.when(~s, F.col("in_teachers")).alias("in_teachers"),
                                      F.when(~t, F.col("in_students")).alias("in_students"))
    new = pairs(Lookup(entries).join(mentions, ["id"], "left_semi", spread=["other", "idx"]))
    met = _least(left.unionByName(new)).where(F.col("in_teachers").isNotNull() | F.col("in_students").isNotNull())
    return same.unionByName(met)


def teacher_ids(edge_rows: DataFrame, page: int = PAGE, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id, part, teacher_ids) for each student."""
    rows = edge_rows.select(F.col("student").alias("id"), "teacher", *EDGE_ORDER)
    return paged_lists(rows, ["id"], [*EDGE_ORDER, "teacher"], "teacher", "teacher_ids", page, hot_rows)


def student_ids(edge_rows: DataFrame, page: int = PAGE, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id, part, student_ids) for each teacher."""
    rows = edge_rows.select(F.col("teacher").alias("id"), "student", *EDGE_ORDER)
    return paged_lists(rows, ["id"], [*EDGE_ORDER, "student"], "student", "student_ids", page, hot_rows)


def neighbours(edge_rows: DataFrame, page: int = PAGE, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id, part, teacher_ids, student_ids) of every node, also of nodes without a record.

    Each edge goes to both its ends, and both lists of a node come out of one grouping.
    """
    teacher, student = F.col("teacher"), F.col("student")
    ends = F.array(*[F.struct(node.alias("id"), F.lit(side).alias("side"), other.alias("other"), *EDGE_ORDER)
                     for side, (node, other) in enumerate([(student, teacher), (teacher, student)])])
    rows = edge_rows.select(F.explode(ends).alias("e")).select("e.*")
    return paged_sides(rows, ["id"], [*EDGE_ORDER, "other"], "other", ["teacher_ids", "student_ids"], page, hot_rows)


def neighbours_of(edge_rows: DataFrame, node: str, page: int = PAGE, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``neighbours`` of one node; the filter reaches the edge table."""
    return neighbours(edge_rows.where((F.col("teacher") == node) | (F.col("student") == node)), page, hot_rows).where(
        F.col("id") == node)


def matched_names(scholars: DataFrame, mentions: DataFrame, role: str) -> DataFrame:
    """Names an entry lists under ``role`` with the entry each one refers to, when matched.

    ``idx`` counts from 0 as in the links. Where repeated links name several entries for one position, the least id holds.
    """
    names = scholars.select("id", F.posexplode(role).alias("idx", "listed"))
    known = mentions.where(F.col("role") == role).groupBy("id", "idx").agg(F.min("other").alias("ref"))
    return names.join(known, ["id", "idx"], "left")
