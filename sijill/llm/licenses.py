"""License notices in documents: MinHash bands over text windows fetch templates, shingle containment verifies them.

A text is a row of five-word shingles. For a template of n shingles a window has n of them and a quarter more on either side;
windows begin everywhere. A band is one MinHash value. A window that holds a template to ``CONTAINED`` has a similarity of
at least 0.53 with it and so misses all of the ``BANDS`` bands with a chance below one in a million. As a window can
agree in a band only where the band's smallest shingle of a template stands, signatures are computed there alone.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sijill.operators.scale import Lookup
from sijill.session import materialise

SHINGLE = 5
BANDS = 20
CONTAINED = 0.8
WHOLE = 8  # templates of up to so many shingles are found whole only: in them one word can be another version or license
MOST_TEMPLATE_SHINGLES = 100_000

# Wording of common public notices. A short one names its version, see ``WHOLE``.
_OPENINGS = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
                   "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "under the GNU General Public License, version 3"),
    ("GPL-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of "
                "the License"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
)


def _notices() -> tuple[tuple[str, str], ...]:
    """(license, text) of the file beside this module: notices, short forms, and licence texts in sections of about 60 words."""
    with open(os.path.join(os.path.dirname(os.path.abspath(__file__)), "license_notices.tsv"), encoding="utf-8") as lines:
        return tuple(tuple(line.rstrip("\n").split("\t", 1)) for line in lines)


TEMPLATES = _OPENINGS + _notices()


def template_table(spark: SparkSession, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    rows = [(i, name, text) for i, (name, text) in enumerate(templates)]
    return spark.createDataFrame(rows, "template int, license string, text string")


def _with_shingles(rows: DataFrame, text: str, name: str, keep: list[str]) -> DataFrame:
    """Hashes of all shingles of a text in order; a text of fewer words is one shingle, also one without words.

    The words are a column of their own, so that a text is split once for all its shingles.
    """
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    shingles = F.transform(F.sequence(F.lit(1), F.greatest(F.size("_words") - (SHINGLE - 1), F.lit(1))),
                           lambda i: F.xxhash64(F.slice("_words", i, SHINGLE)))
    return rows.select(*keep, words.alias("_words")).select(*keep, shingles.alias(name))


def _smallest(hashes: Column) -> Column:
    """MinHash value of each band."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, b))))


def prepared(templates: DataFrame) -> DataFrame:
    """(template, license, shingles, bands): distinct shingles with their first place; templates without words are left out."""
    named = templates.where(F.coalesce(F.col("text"), F.lit("")).rlike(r"[\p{L}\p{N}]"))
    rows = _with_shingles(named, "text", "all", ["template", "license"])
    return rows.select("template", "license", F.col("all").alias("ordered"), F.array_distinct("all").alias("shingles"),
                       _smallest(F.array_distinct("all")).alias("bands"))


def found(docs: DataFrame, templates: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, license, start_word, containment, windows): each document's notices, the best window of each license.

    ``start_word`` counts from 0, ``windows`` are the verified windows. Documents without a notice have no row, nor have null
    or empty texts; rows that share an id are taken together.
    """
    known = materialise(prepared(templates), "templates")
    pivots = known.select("template", "ordered", "bands", F.explode("shingles").alias("pivot")).where(
        F.exists(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64("pivot", b) == F.element_at("bands", b + 1)))
    # Templates are a setting: what the scan looks for is part of the plan, and its size is checked.
    wanted = [r.pivot for r in pivots.select("pivot").distinct().limit(MOST_TEMPLATE_SHINGLES + 1).collect()]
    if len(wanted) > MOST_TEMPLATE_SHINGLES:
        raise ValueError("too many templates for one scan; scan in parts")
    texts = docs.where(F.col(text).isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("_text"))
    rows = _with_shingles(texts, "_text", "h", ["doc_id"])
    spots = rows.select("doc_id", "h", F.filter(F.sequence(F.lit(1), F.size("h")), lambda i: F.element_at("h", i).isin(wanted)).alias("at"))
    # The outer explode keeps Spark from testing the shingles for emptiness first, computing them again for that.
    longest = known.agg(F.max(F.size("ordered"))).first()[0] or 1
    reach = longest + longest // 4 + 1
    near = (spots.select("doc_id", "h", F.explode_outer("at").alias("at")).where(F.col("at").isNotNull())
            .select("doc_id", "at", F.element_at("h", F.col("at")).alias("pivot"),
                    F.greatest(F.col("at") - reach, F.lit(1)).alias("from"),
                    F.slice("h", F.greatest(F.col("at") - reach, F.lit(1)), 2 * reach + 1).alias("around")))
    index = Lookup(pivots.select("pivot", "template"))
    hits = index.join(near, ["pivot"], "inner", spread=["doc_id", "at"])
    both = Lookup(known).join(hits, ["template"], "inner", spread=["doc_id", "at"])
    n = F.size("ordered")
    slack = F.floor(n / 4).cast("int")
    offset = F.array_position("ordered", F.col("pivot")).cast("int") - 1
    first = F.greatest(F.col("at") - offset - slack, F.lit(1))
    # Never before the text's first shingle.
    last = F.col("at") - offset + n + slack
    window = F.slice("around", F.greatest(first - F.col("from") + 1, F.lit(1)), last - first)
    windows = both.select("doc_id", "license", "template", "at", (F.col("at") - offset - 1).alias("start"), "shingles", "bands",
                          window.alias("window"))
    agreeing = windows.where(F.exists(F.arrays_zip(_smallest(F.col("window")).alias("a"), F.col("bands").alias("b")),
                                      lambda x: x["a"] == x["b"]))
    share = F.size(F.array_intersect("shingles", "window")) / F.size("shingles")
    verified = agreeing.select("doc_id", "license", F.greatest("start", F.lit(0)).alias("start"), share.alias("containment"),
                               F.when(F.size("shingles") <= WHOLE, F.lit(1.0)).otherwise(F.lit(CONTAINED)).alias("least")).where(
        F.col("containment") >= F.col("least")).drop("least").distinct()
    return verified.groupBy("doc_id", "license").agg(
        F.min_by("start", F.struct(-F.col("containment"), F.col("start"))).cast("long").alias("start_word"),
        F.max("containment").alias("containment"), F.count("*").alias("windows"))
