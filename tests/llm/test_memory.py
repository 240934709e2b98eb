"""What a Python worker holds while it works on texts, and after."""

import tracemalloc

import numpy as np
import pyarrow as pa

from sijill.llm import near_dups, quality, text


def _peak(f):
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_arrays_over_texts_stay_small():
    # 4 million characters in texts of 2,000; arrays over a million of them took some 100 MB.
    texts = [f"word{i} and " * 200 for i in range(1_900)]
    whole = quality.mean_ratios(texts[:40], np.arange(quality.BUCKETS, dtype=float))
    assert (whole == np.concatenate([quality.mean_ratios([t], np.arange(quality.BUCKETS, dtype=float)) for t in texts[:40]])).all()
    assert _peak(lambda: quality.mean_ratios(texts, np.zeros(quality.BUCKETS))) < 40


def test_tasks_of_the_pipeline_hand_memory_back(monkeypatch):
    done = []
    monkeypatch.setattr(text, "released", lambda: done.append(1))
    batch = pa.RecordBatch.from_pydict({"a": [1]})
    assert list(text.releasing(lambda batches: (b for b in batches))(iter([batch, batch]))) == [batch, batch] and done == [1]


def test_sketches_come_in_small_chunks(spark):
    found = []
    rows = spark.createDataFrame([(i, f"w{i} b c d e f g " * 120) for i in range(1_000)], "doc_id long, text string")
    taken = type(rows).mapInArrow
    try:
        type(rows).mapInArrow = lambda self, run, *a: found.append(run) or taken(self, run, *a)
        near_dups.sketches(rows)
    finally:
        type(rows).mapInArrow = taken
    batch = rows.withColumn("name", rows.doc_id).select("doc_id", "name", "text").toArrow().combine_chunks().to_batches()[0]
    made = []
    assert _peak(lambda: made.extend(found[0](iter([batch])))) < 40
    assert sum(b.num_rows for b in made) == 1_000
