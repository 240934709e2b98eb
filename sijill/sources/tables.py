"""Links, gazetteer, entries and catalogue feeds: JSON files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sijill.operators.graph import flatten_links
from sijill.operators.scale import Lookup
from sijill.session import materialise
from sijill.sources.files import whole_files

LINKS = "map<string,map<string,map<string,string>>>"
PLACES = "map<string,struct<name:struct<tr:string,ar:string>,lat:double,lng:double,approx:boolean>>"
ENTRIES = "n int, pageStart int, pageEnd int, heading string, text string"


MAX_LINE = 1 << 20  # bytes of the longest line that is read as one row


def read_links(spark: SparkSession, path: str, per_line: bool = False, pattern: str = "*.json") -> DataFrame:
    """(id, role, idx, other) from files of ``{id: {role: {index: other}}}`` whose names fit ``pattern``.

    A file may hold one object, however large, or several in a row. A file whose every line is an object of at most ``MAX_LINE`` bytes, which one
    look through it tells, is read by lines without a shuffle; any other is split over tasks at its quotation marks. With ``per_line``
    each line is taken for an object unseen.
    """
    if per_line:
        return flatten_links(spark.read.text(path).select(F.from_json("value", LINKS).alias("links")))
    files = lambda: spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    name = F.col("_metadata.file_path").alias("file")
    # Longer lines are passed over, never held; the bytes of the others then fall short of the file's.
    lines = files().option("lineSep", "\n").option("mapreduce.input.linerecordreader.line.maxlength", str(MAX_LINE)).text(path)
    kinds = materialise(_line_files(lines.select(name, F.col("_metadata.file_size").alias("size"), "value")), "link-files")
    by_line, other = kinds.where("by_line").select("file"), kinds.where("not by_line").select("file")
    marks = files().option("lineSep", '"').text(path)
    pieces = marks.select(name, F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos"), "value")
    lines = lines.select(name, "value")
    seen = kinds.agg(F.count_if("by_line").alias("by_line"), F.count("*").alias("all")).first()
    if 0 < seen.by_line < seen.all:
        lines = Lookup(by_line).join(lines, ["file"], "left_semi", spread=["value"])
        pieces = Lookup(other).join(pieces, ["file"], "left_semi", spread=["block", "pos"])
    read = []
    if seen.by_line:
        read.append(flatten_links(lines.select(F.from_json("value", LINKS).alias("links"))))
    if seen.by_line < seen.all or not seen.all:
        read.append(parse_link_pieces(pieces))
    return reduce(DataFrame.unionByName, read)


def _line_files(lines: DataFrame) -> DataFrame:
    """(file, size, value) of lines → (file, by_line): whether no line is missing and each is blank or one whole object.

    Strings have no line ends, so a line's brackets outside strings tell. An object of links is at most three deep.
    """
    text = F.when(F.contains("value", F.lit("\\")), F.regexp_replace("value", r"(?s)\\.", "")).otherwise(F.col("value"))
    text = F.regexp_replace(text, '"[^"]*"', "")
    for _ in range(3):
        text = F.regexp_replace(text, r"\{[^{}]*\}", "x")
    bytes_read = F.sum(F.octet_length("value") + 1)
    return lines.groupBy("file").agg((F.bool_and(text.rlike(r"^\s*x?\s*$")) & bytes_read.isin(F.max("size"), F.max("size") + 1)).alias("by_line"))


SLICE = 1 << 18     # tokens that are scanned by one task; even, so that a string and what follows it stay together


def parse_link_pieces(pieces: DataFrame, slice_tokens: int = SLICE) -> DataFrame:
    """(file, block, pos, value), the text between quotation marks in order → one row (id, role, idx, other) per mention.

    Tokens stand outside and inside strings by turns. Brackets outside give the depth of every string, and so do the
    id and the role that stand before a mention. Sums and last names run within slices of a file and are carried over by one row a slice, so
    neither a large file nor a large id is one task's. Files must be valid JSON of that shape; null entries have no mentions.
    """
    # Written, since the numbers of the pieces must stay as they are.
    placed = materialise(pieces.withColumn(
        # After an odd number of backslashes a mark belongs to the string.
        "ends", (F.length(F.regexp_extract("value", r"(\\*)$", 1)) % 2 == 0).cast("int")), "link-pieces")
    by_block = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    marks = placed.groupBy("file", "block").agg(F.sum("ends").alias("n"))
    offsets = Lookup(marks.select("file", "block", F.coalesce(F.sum("n").over(by_block), F.lit(0)).alias("offset")))
    in_block = Window.partitionBy("file", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    counted = offsets.join(placed.withColumn("local", F.coalesce(F.sum("ends").over(in_block), F.lit(0))), ["file", "block"], spread=["pos"])
    token = F.col("local") + F.col("offset")
    # One exchange by slice serves the grouping and the scans after it.
    sliced = counted.select("file", token.alias("t"), F.floor((token + 1) / slice_tokens).alias("slice"), "block", "pos", "value").repartition("file", "slice")
    parts = F.array_sort(F.collect_list(F.struct("block", "pos", "value")))
    tokens = sliced.groupBy("file", "slice", "t").agg(F.array_join(F.transform(parts, lambda p: p["value"]), '"').alias("text"))

    outside = F.col("t") % 2 == 0
    depth = F.when(outside, F.regexp_count("text", F.lit(r"\{")) - F.regexp_count("text", F.lit(r"\}"))).otherwise(0)
    in_slice = Window.partitionBy("file", "slice").orderBy("t")
    so_far = in_slice.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    strings = materialise(tokens.withColumns({"depth": F.sum(depth).over(so_far), "after": F.lead("text").over(in_slice),
                                              "change": depth}), "link-tokens")
    by_slice = Window.partitionBy("file").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    levels = strings.groupBy("file", "slice").agg(F.sum("change").alias("n"))
    base = Lookup(levels.select("file", "slice", F.coalesce(F.sum("n").over(by_slice), F.lit(0)).alias("base")))
    inside = base.join(strings.where(~outside), ["file", "slice"], spread=["t"]).withColumn("depth", F.col("depth") + F.col("base"))
    is_key = F.col("after").rlike(r"^\s*:")
    names = {"id": 1, "role": 2, "key": 3}
    at = {n: is_key & (F.col("depth") == d) for n, d in names.items()}
    last = inside.groupBy("file", "slice").agg(*[F.max_by(F.when(c, F.col("text")), F.when(c, F.col("t"))).alias(n) for n, c in at.items()])
    carried = Lookup(last.select("file", "slice", *[F.last(n, ignorenulls=True).over(by_slice).alias(f"_{n}") for n in names]))
    known = carried.join(inside.withColumns({n: F.last(F.when(c, F.col("text")), ignorenulls=True).over(so_far) for n, c in at.items()}),
                         ["file", "slice"], spread=["t"])
    bare = F.regexp_extract("after", r"^\s*:\s*([^\s,{}\[\]]+)", 1)
    mentions = known.where((F.col("depth") == 3) & (~is_key | (bare != "")))

    def name(n: str) -> Column:
        return _unescaped(F.coalesce(n, f"_{n}"))

    other = F.when(~is_key, _unescaped(F.col("text"))).when(bare != "null", bare)
    return mentions.select(name("id").alias("id"), name("role").alias("role"), name("key").cast("int").alias("idx"), other.alias("other"))


def _unescaped(text: Column) -> Column:
    """The value of a JSON string from what stands between its quotation marks."""
    whole = F.from_json(F.concat(F.lit('["'), text, F.lit('"]')), "array<string>")
    return F.when(F.contains(text, F.lit("\\")), F.try_element_at(whole, F.lit(1))).otherwise(text)


def parse_places(files: DataFrame) -> DataFrame:
    """(value) with one ``{id: {name, lat, lng, approx}}`` object each → gazetteer."""
    rows = files.select(F.explode_outer(F.from_json("value", PLACES)).alias("id", "p"))
    return rows.where(F.col("id").isNotNull()).select("id", "p.name", "p.lat", "p.lng", "p.approx")


def read_places(spark: SparkSession, folder: str) -> DataFrame:
    return parse_places(whole_files(spark, folder, "*.json"))


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of the printed source: an array per file, or one object per line."""
    return spark.read.schema(ENTRIES).option("multiLine", "true").json(path)


def read_feed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A landed catalogue feed, one record per line."""
    return spark.read.schema(schema).json(path)


def checked_feed(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """``read_feed`` without the lines that do not parse, and those: (path, reason, line).

    A line is set aside whole when it is no JSON object or one of its values is not of the schema's type. Blank lines are neither.
    """
    rows = spark.read.schema(f"{schema}, _line string").option("columnNameOfCorruptRecord", "_line").json(path)
    # Spark has no table of the bad lines alone, so the parsed feed is written and both are read from it.
    parsed = materialise(rows.select("*", F.col("_metadata.file_path").alias("_path")), "feed")
    bad = parsed.where(F.col("_line").isNotNull()).select(F.col("_path").alias("path"), F.lit("does not parse").alias("reason"), F.col("_line").alias("line"))
    return parsed.where(F.col("_line").isNull()).drop("_line", "_path"), bad
