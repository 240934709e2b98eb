"""Links left between components: found by exact prefixes, with rows in proportion to the documents."""

import random

import pytest

from sijill.llm import near_dups
from sijill.llm.text import importable
from sijill.session import materialise


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    importable(spark)


def loose(n, size, seed=0, own=(0.05, 0.3), choice=40):
    """Texts of about ``size`` words that share a beginning, a line all have, and most of one base."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(3000)}" for _ in range(size)]
    texts = []
    for i in range(n):
        copy = list(base)
        for k in rng.sample(range(size), max(1, int(size * rng.uniform(*own) / 5))):
            copy[k] = f"own{rng.randrange(choice)}x{k}"
        texts.append(" ".join(copy[:size - rng.randrange(1, max(2, size // 8))]))
    return texts


def links_of(sets, component, percent):
    found = set()
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            both = len(sets[i] & sets[j])
            if component[i] != component[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                found.add((i, j))
    return found


def plain_set(text):
    w = text.split()
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def tables(spark, texts, component):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, _text string")
    drawn = near_dups.sketches(rows, "_text")
    reps = materialise(drawn.selectExpr("doc_id rep", "n_shingles", "bands"), "reps")
    found = spark.createDataFrame([(i, c) for i, c in enumerate(component)], "rep long, component long")
    return materialise(found, "placed"), reps, materialise(rows.selectExpr("doc_id rep", "_text"), "texts")


@pytest.mark.parametrize("seed, percent", [(1, 85), (2, 85), (3, 60), (4, 100)])
def test_no_link_between_components_is_lost(spark, seed, percent):
    rng = random.Random(seed)
    texts = [t for g in range(4) for t in loose(30, rng.choice([6, 40, 120]), 10 * seed + g)]
    texts += [t + " one" for t in texts[:10]] + ["a b c", "a b", "a b c d e", "a b c d e f", texts[0] + " w1" * 400]
    component = [rng.randrange(1000) for _ in texts]
    found = near_dups._across(*tables(spark, texts, component), percent).collect()
    want = links_of([plain_set(t) for t in texts], component, percent)
    assert {(r.a, r.b) for r in found} == want and (want or percent == 100)


def test_rows_of_a_loose_group_follow_its_documents(spark):
    """Groups of 1,500 and 3,000 texts that share 70 to 84 per cent with each other."""
    counts = {}
    for n in (1500, 3000):
        texts = loose(n, 100, 7, (0.12, 0.3), 10 ** 6)
        placed, _, kept = tables(spark, texts, range(n))
        rows = materialise(near_dups._shingled(placed, kept), "shingles")
        prefixes = materialise(near_dups._prefixes(rows, 85), "prefixes")
        counts[n] = [rows.count(), prefixes.count(), near_dups._meetings(prefixes, 85).count()]
    assert all(b <= 2.3 * a + 3000 for a, b in zip(counts[1500], counts[3000])), counts


def test_one_line_in_all_documents(spark):
    """A band or shingle that every document has brings no two of them together."""
    line = " ".join(f"line{k}" for k in range(12))
    texts = [line + " " + " ".join(f"own{i}x{k}" for k in range(30)) for i in range(300)]
    out = near_dups.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(out) == 300 and all(r.kept for r in out)
    placed, _, kept = tables(spark, texts, range(300))
    assert near_dups._meetings(near_dups._prefixes(near_dups._shingled(placed, kept), 85), 85).count() == 0
