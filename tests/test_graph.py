"""Neighbour lists, references by position and map points on small tables."""

import random

from pyspark.sql import functions as F

from sijill.operators.graph import edges, edges_of, matched_names, neighbours, pairs, student_ids, teacher_ids, update_pairs
from sijill.operators.places import gazetteer, itineraries, map_points
from sijill.session import materialise


def _edges(spark):
    draw = random.Random(5)
    rows = [(f"p{draw.randrange(20)}", draw.choice(["teachers", "students"]), i, f"p{draw.randrange(20)}") for i in range(60)]
    rows += [("hub", "students", i, f"s{i:03}") for i in range(120)] + [("hub", "teachers", 0, "p1")]
    return materialise(edges(spark.createDataFrame(rows, "id string, role string, idx int, other string")), "edges")


def test_neighbours_are_both_lists(spark):
    known = _edges(spark)
    for page in (1, 7, 50, 1000):
        for hot_rows in (10, 1000):
            both = {(r.id, r.part): (r.teacher_ids, r.student_ids) for r in neighbours(known, page, hot_rows).collect()}
            expected = {}
            for side, rows in enumerate([teacher_ids(known, page).collect(), student_ids(known, page).collect()]):
                for r in rows:
                    expected.setdefault((r.id, r.part), ([], []))[side].extend(r[2])
            assert both == expected
    whole = {r.id: r.student_ids for r in neighbours(known).collect()}
    assert whole["hub"] == [f"s{i:03}" for i in range(120)]
    order = sorted((r.source, r.role_rank, r.idx, r.student) for r in known.where("teacher = 'p1'").collect())
    assert whole["p1"] == [s for *_, s in order]


def test_neighbours_take_few_jobs(spark):
    known = _edges(spark)
    context = spark.sparkContext
    for page, most in ((1000, 4), (50, 10)):
        context.setJobGroup(f"neighbours-{page}", "jobs before the action")
        neighbours(known, page)
        jobs = context.statusTracker().getJobIdsForGroup(f"neighbours-{page}")
        context.setJobGroup("rest", "rest")
        assert len(jobs) <= most


def test_no_edges_no_neighbours(spark):
    none = edges(spark.createDataFrame([], "id string, role string, idx int, other string"))
    assert neighbours(none).collect() == []


def test_one_reference_for_a_position(spark):
    people = spark.createDataFrame([("a", ["x", "y"]), ("b", None)], "id string, teachers array<string>")
    links = spark.createDataFrame([("a", "teachers", 0, "q"), ("a", "teachers", 0, "m"), ("a", "students", 1, "z")],
                                  "id string, role string, idx int, other string")
    got = [(r.id, r.idx, r.listed, r.ref) for r in matched_names(people, links, "teachers").orderBy("idx").collect()]
    assert got == [("a", 0, "x", "m"), ("a", 1, "y", None)]


def test_points_have_both_names_and_say_what_is_uncertain(spark):
    known = spark.createDataFrame([("sam", ("Şam", "دمشق"), 33.5, 36.3, None), ("rey", ("Rey", None), 35.6, 51.4, True), ("yok", ("Yok", "ي"), None, None, False)],
                                  "id string, name struct<tr:string,ar:string>, lat double, lng double, approx boolean")
    people = spark.createDataFrame([("a", [("rey", "ders"), ("none", "x"), ("yok", "y"), ("sam", "nisbe")]), ("b", [("sam", None)])],
                                   "id string, places array<struct<place:string,role:string>>")
    rows = {r.id: r for r in itineraries(map_points(people, gazetteer(known))).collect()}
    assert [tuple(p) for p in rows["a"].points] == [("Rey", "Rey", 35.6, 51.4, True, "ders"), ("Şam", "دمشق", 33.5, 36.3, False, "nisbe")]
    assert rows["a"].path == [[35.6, 51.4], [33.5, 36.3]] and rows["b"].path is None and rows["a"].labelled


def test_places_may_come_without_the_new_fields(spark, tmp_path):
    from sijill.sources.tables import read_places
    (tmp_path / "places.json").write_text('{"sam": {"name": {"tr": "Şam"}, "lat": 33.5, "lng": 36.3}}', encoding="utf-8")
    row = read_places(spark, str(tmp_path)).select("id", F.col("name.tr").alias("tr"), F.col("name.ar").alias("ar"), "approx").first()
    assert tuple(row) == ("sam", "Şam", None, None)


def test_changed_entries_give_the_edges_of_a_rebuild(spark):
    draw = random.Random(8)
    schema = "id string, role string, idx int, other string"

    def mentions_of(node):
        return [(node, role, i, f"p{draw.randrange(12)}") for role in ("teachers", "students") for i in range(draw.randrange(5))]
    state = {f"p{i}": mentions_of(f"p{i}") for i in range(12)}
    known = materialise(pairs(spark.createDataFrame(sum(state.values(), []), schema)), "pairs")
    for step in range(4):
        ids = draw.sample(sorted(state), 3) + [f"new{step}"]
        state |= {i: mentions_of(i) for i in ids} | ({ids[0]: []} if step % 2 else {})
        # Mentions of entries that did not change are there too and do not count.
        given = sum((state[i] for i in ids), []) + [("p_other", "teachers", 0, "p1")]
        changed = spark.createDataFrame([(i,) for i in ids] + [(None,), (ids[1],)], "id string")
        known = materialise(update_pairs(known, changed, spark.createDataFrame(given, schema)), "pairs")
        whole = edges(spark.createDataFrame(sum(state.values(), []), schema))
        assert sorted(edges_of(known).collect(), key=str) == sorted(whole.collect(), key=str)
    nothing = update_pairs(known, spark.createDataFrame([], "id string"), spark.createDataFrame([], schema))
    assert sorted(nothing.collect(), key=str) == sorted(known.collect(), key=str)
