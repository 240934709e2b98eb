"""One large object of links is read by many tasks and gives what the whole file gives."""

import json
import random

from pyspark.sql import functions as F

from sijill.operators.graph import flatten_links
from sijill.sources import tables
from sijill.sources.files import whole_files
from sijill.sources.tables import LINKS, parse_link_pieces, read_links


def _links(n, seed=3):
    draw = random.Random(seed)
    odd = ['a "quoted" name', "back\\slash\\", "{curly}, [square]: x", "ibn Sînâ", "", "عمر", 'end\\"', "line\nbreak", ": {"]
    name = lambda: draw.choice(odd) if draw.random() < .2 else f"p{draw.randrange(n)}"
    links = {f"e{i}{draw.choice(odd)}": {r: {str(k): draw.choice([name(), name(), None]) for k in range(draw.randrange(4))}
                                          for r in draw.sample(["teachers", "students", 'odd "role"'], draw.randrange(4))} for i in range(n)}
    return links | {"none": None, "hub": {"students": {str(k): f"s{k}" for k in range(500)}}, "last": {"teachers": {"0": "hub"}}}


def _whole(spark, folder):
    return sorted(flatten_links(whole_files(spark, folder, "*.json").select(F.from_json("value", LINKS).alias("links"))).collect(), key=str)


def test_pieces_give_the_same_mentions(spark, tmp_path, monkeypatch):
    (tmp_path / "a").mkdir()
    for i, (layout, ascii_) in enumerate([(None, True), (1, False), ("\t", False)]):
        (tmp_path / "a" / f"{i}.json").write_text(json.dumps(_links(60, i), indent=layout, ensure_ascii=ascii_), encoding="utf-8")
    (tmp_path / "a" / "empty.json").write_text("{}")
    (tmp_path / "a" / "nothing.json").write_text("")
    expected = _whole(spark, str(tmp_path / "a"))
    assert len(expected) > 1500 and any(r.other is None for r in expected)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("700", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            for tokens in (2, 64, 1 << 18):
                monkeypatch.setattr(tables, "parse_link_pieces", lambda p, n=tokens: parse_link_pieces(p, n))
                assert sorted(read_links(spark, str(tmp_path / "a")).collect(), key=str) == expected
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_large_object_is_read_by_many_tasks(spark, tmp_path):
    links = {f"e{i}": {"teachers": {str(k): f"teacher number {i % 97} {k}" for k in range(9)}} for i in range(20000)}
    (tmp_path / "one.json").write_text(json.dumps(links))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
        parts = spark.read.option("lineSep", '"').text(str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
        assert len(parts) >= 5 and max(r["count"] for r in parts) * 2 < sum(r["count"] for r in parts)
        got = read_links(spark, str(tmp_path))
        seen = got.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.sum(F.hash("id", "role", "idx", "other").cast("bigint")).alias("h")).first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    rows = spark.range(20000 * 9).select(F.floor(F.col("id") / 9).alias("i"), (F.col("id") % 9).cast("int").alias("k")).select(
        F.concat(F.lit("e"), "i").alias("id"), F.lit("teachers").alias("role"), F.col("k").alias("idx"), F.concat(F.lit("teacher number "), F.col("i") % 97, F.lit(" "), "k").alias("other"))
    assert (seen.n, seen.ids) == (180000, 20000) and seen.h == rows.agg(F.sum(F.hash("id", "role", "idx", "other").cast("bigint"))).first()[0]


def _refused(pieces):
    raise AssertionError("read by pieces")


def test_a_file_of_one_object_per_line_is_read_by_lines(spark, tmp_path, monkeypatch):
    links = _links(200)
    for ascii_ in (True, False):
        text = "\n".join(json.dumps({k: v}, ensure_ascii=ascii_) for k, v in links.items())
        (tmp_path / f"{ascii_}.json").write_text(text + ("\r\n \n" if ascii_ else ""), encoding="utf-8")
    (tmp_path / "nothing.json").write_text("")
    plain = spark.read.text(str(tmp_path)).select(F.from_json("value", LINKS).alias("links"))
    monkeypatch.setattr(tables, "parse_link_pieces", _refused)
    found = read_links(spark, str(tmp_path))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted(found.collect(), key=str)
    assert len(got) > 500 and got == sorted(flatten_links(plain).collect(), key=str)


def test_only_files_with_other_lines_are_read_by_pieces(spark, tmp_path, monkeypatch):
    a, b, c, d = ({f"{n}{i}": {"teachers": {"0": f"{n} {{{i}\\", "1": None}} for i in range(40)} for n in "abcd")
    (tmp_path / "lines.json").write_text("\n".join(json.dumps({k: v}) for k, v in a.items()))
    (tmp_path / "one.json").write_text(json.dumps(b, indent=1))
    (tmp_path / "two.json").write_text("\n".join(json.dumps({k: v}) * 2 for k, v in c.items()))  # two objects in a line
    (tmp_path / "long.json").write_text(json.dumps({"a0": a["a0"]}) + "\n" + json.dumps(d) + "\n")
    monkeypatch.setattr(tables, "MAX_LINE", 1000)
    got = sorted((r.id, r.idx, r.other) for r in read_links(spark, str(tmp_path)).collect())
    rows = lambda links: [(k, int(i), o) for k, v in links.items() for i, o in v["teachers"].items()]
    want = rows(a) + rows(b) + 2 * rows(c) + rows({"a0": a["a0"]}) + rows(d)
    assert sorted(map(str, got)) == sorted(map(str, want))
    seen = []
    monkeypatch.setattr(tables, "parse_link_pieces", lambda p: seen.extend(r.file for r in p.select("file").distinct().collect()) or parse_link_pieces(p))
    read_links(spark, str(tmp_path))
    assert sorted(f.rsplit("/")[-1] for f in seen) == ["long.json", "one.json", "two.json"]
