"""Gazetteer joins and what a map shows of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sijill.functions.dating import life_century
from sijill.operators.scale import Lookup
from sijill.values import BOX_PADDING, LABELLED_POINTS


def gazetteer(places: DataFrame) -> Lookup:
    """(place, place_name, place_ar, lat, lng, uncertain) from the places collection."""
    return Lookup(places.select(F.col("id").alias("place"), F.col("name")["tr"].alias("place_name"), F.col("name")["ar"].alias("place_ar"),
                                "lat", "lng", F.coalesce("approx", F.lit(False)).alias("uncertain")))


def _place() -> Column:
    # An id the gazetteer lacks stands for its own name, without coordinates.
    return F.struct(F.col("place").alias("id"), F.coalesce("place_name", "place").alias("name"), "lat", "lng")


def with_place(df: DataFrame, key: Column, name: str, places: Lookup, spread: list[str]) -> DataFrame:
    """Add the place struct of ``key``; a missing or empty key gives a null struct."""
    keyed = df.withColumn("place", F.nullif(key, F.lit("")))
    found = places.join(keyed, ["place"], "left", spread=spread)
    return found.select(*df.columns, F.when(F.col("place").isNotNull(), _place()).alias(name))


def listed_places(scholars: DataFrame, places: Lookup) -> DataFrame:
    """One row (id, pos, place, name, nameAr, lat, lng, approx, role) per place of a record.

    A place the gazetteer lacks goes by its id; without an Arabic name it keeps the other one.
    """
    rows = scholars.select("id", F.posexplode("places").alias("pos", "_entry")).select(
        "id", "pos", F.col("_entry")["place"].alias("place"), F.col("_entry")["role"].alias("role"))
    found = places.join(rows, ["place"], "left", spread=["id", "pos"])
    return found.select("id", "pos", "place", F.coalesce("place_name", "place").alias("name"),
                        F.coalesce("place_ar", "place_name", "place").alias("nameAr"), "lat", "lng",
                        F.coalesce("uncertain", F.lit(False)).alias("approx"), "role")


PLACES_TYPE = "array<struct<id:string,name:string,lat:double,lng:double,role:string>>"


def _lists(scholars: DataFrame, places: Lookup, fields: list[str]) -> DataFrame:
    """(id, places) with these fields of each place, in order.

    A list is put together again from the elements of one record, so it is as long as that record's.
    """
    rows = listed_places(scholars, places).withColumnRenamed("id", "record").withColumnRenamed("place", "id")
    lists = rows.groupBy("record").agg(F.array_sort(F.collect_list(F.struct("pos", *fields))).alias("_l"))
    return lists.select(F.col("record").alias("id"),
                        F.transform("_l", lambda e: F.struct(*[e[f].alias(f) for f in fields])).alias("places"))


def place_lists(scholars: DataFrame, places: Lookup) -> DataFrame:
    """(id, places): the record's own place list, in order, with names and coordinates."""
    return _lists(scholars, places, ["id", "name", "lat", "lng", "role"]).withColumn("places", F.col("places").cast(PLACES_TYPE))


def map_points(scholars: DataFrame, places: Lookup) -> DataFrame:
    """(id, places): the places of a record as a map marks them, with both names and whether their site is uncertain."""
    return _lists(scholars, places, ["id", "name", "nameAr", "lat", "lng", "approx", "role"])


def century_places(scholars: DataFrame, places: Lookup) -> DataFrame:
    """How many scholars of each century are tied to each place."""
    century = life_century(F.col("death.hijri"), F.col("birth.hijri")).alias("century")
    # A scholar is one row, so a place counts once per scholar without comparing rows.
    rows = scholars.select(century, F.explode(F.array_distinct("places.place")).alias("place")).where(F.col("century").isNotNull())
    counts = rows.groupBy("century", "place").agg(F.count("*").alias("scholars"))
    return places.join(counts, ["place"], "left").select(
        "century", "place", F.coalesce("place_name", "place").alias("place_name"), "scholars")


def bounding_boxes(points: DataFrame, key: str, padding: float = BOX_PADDING) -> DataFrame:
    """Box around the points of each key, widened on every side; one point is its own box."""
    located = points.where(F.col("lat").isNotNull() & F.col("lng").isNotNull())
    box = located.groupBy(key).agg(
        F.count("*").alias("points"), F.min("lat").alias("south"), F.max("lat").alias("north"),
        F.min("lng").alias("west"), F.max("lng").alias("east"))
    high, wide = (F.col("north") - F.col("south")) * padding, (F.col("east") - F.col("west")) * padding
    return box.select(key, "points", (F.col("south") - high).alias("south"), (F.col("north") + high).alias("north"),
                      (F.col("west") - wide).alias("west"), (F.col("east") + wide).alias("east"))


def itineraries(place_rows: DataFrame, places_column: str = "places") -> DataFrame:
    """Points of a record's place list in order; a path only from two points on, labels up to four.

    ``place_rows`` has lists as of ``map_points``: a point has both its names, coordinates, whether they are uncertain, and its role.
    """
    located = F.filter(places_column, lambda p: p["lat"].isNotNull() & p["lng"].isNotNull())
    fields = ["name", "nameAr", "lat", "lng", "approx", "role"]
    points = F.transform(located, lambda p: F.struct(*[p[f].alias(f) for f in fields]))
    return place_rows.select("id", points.alias("points")).select(
        "id", "points",
        F.when(F.size("points") > 1, F.transform("points", lambda p: F.array(p["lat"], p["lng"]))).alias("path"),
        (F.size("points") <= LABELLED_POINTS).alias("labelled"))
