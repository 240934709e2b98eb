"""Operators of training data against brute force, on small tables with every awkward case."""

import hashlib
import math
import os
import random
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from sijill.llm import bpe, language, licenses, mixing, near_dups, nearest, quality, queries, site_quality, toxicity, urls
from sijill.llm.text import hashed_words, importable, remainder, shingles

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, component_id string, score string"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    importable(spark)


def words(seed, n, stem="w"):
    rng = random.Random(seed)
    return " ".join(f"{stem}{rng.randrange(4000)}" for _ in range(n))


def table(spark, rows):
    """documents with columns that clash with those the operators add."""
    full = [(i, t, lang, src, None if t is None else len(t), "x", "y", "z") for i, t, lang, src in rows]
    return spark.createDataFrame(full, DOCS)


AWKWARD = [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "en", None), (4, "one", "de", "a"), (4, "one", "de", "a"),
           (None, "two words", None, "b"), (6, "é" * 70_000, "fr", "b"), (7, words(3, 3000), "en", "a")]


def plain_set(text):
    w = (text or "").encode()
    w = w.translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def plain_components(rows):
    sets = {i: plain_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


# --- shared -----------------------------------------------------------------------

def test_word_hashes_do_not_depend_on_their_place():
    one, at = hashed_words(["Alpha beta", None, "", "x\x0balpha"])
    assert at.tolist() == [0, 2, 2, 2, 4]
    assert one[0] == one[3] and len(set(one.tolist())) == 3
    other, _ = hashed_words(["zz " * 1000 + "ALPHA"])
    assert other[-1] == one[0]
    assert len(shingles(one[:2])) == 1 and len(shingles(one[:0])) == 0


# --- 1 ------------------------------------------------------------------------------

def test_nearest_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(120, 6)), 1)
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(x)]
    rows += [(3, rows[3][1], 0), (200, None, 0), (201, [0.0] * 6, 0), (202, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (203, [float("nan")] * 6, 0),
             (204, [float("inf")] + [0.0] * 5, 0), (220, [1.0, 2.0], 0), (None, [1.0] * 6, 0), (221, rows[7][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = {}
    for r in nearest.nearest(df, F.col("vec_id") % 20 == 0, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    usable = {i: v for i, v, _ in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)}
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    for q in [i for i in usable if i % 20 == 0 and len(usable[i]) == 6]:
        best = sorted((-dot(usable[q], v), i) for i, v in usable.items() if i != q and len(v) == 6)[:5]
        mine = sorted(got[q])
        assert [m[1] for m in mine] == [i for _, i in best]
        assert [m[2] for m in mine] == pytest.approx([-s for s, _ in best], abs=1e-12)
    assert 220 not in got  # no other vector of its length
    assert nearest.nearest(df.limit(0), F.col("vec_id") % 20 == 0, 5).count() == 0


# --- 2 ------------------------------------------------------------------------------

def test_language_from_letters(spark):
    rng = random.Random(1)
    parts = {"aa": ["tion", "the", "ing", "and"], "bb": ["keit", "sch", "ung", "ein"]}
    make = lambda k: " ".join(rng.choice(parts[k]) + rng.choice(parts[k]) for _ in range(60))
    rows = [(i, make("aa" if i % 2 else "bb"), "aa" if i % 2 else "bb", "s") for i in range(80)]
    model = language.learn(table(spark, rows + AWKWARD[:3]))
    assert [k for k, _ in model] == ["aa", "bb"] or [k for k, _ in model] == ["bb", "aa"]
    out = language.predict(table(spark, [(i + 100, make("aa"), None, None) for i in range(20)] + AWKWARD), model).collect()
    assert all(r.lang_pred == "aa" and r.accepted for r in out if r.doc_id and r.doc_id >= 100)
    assert {r.doc_id: r.lang_pred for r in out}[1] == "und" and {r.doc_id: r.lang_pred for r in out}[3] == "und"
    assert len(out) == 28 and all(0 <= r.score <= 1 for r in out)
    kept = language.accepted(table(spark, rows[:4] + AWKWARD[:3]), model)
    dotted = table(spark, rows[:4] + AWKWARD[:3]).withColumn("a.b", F.lit(1))
    assert language.accepted(dotted, model).columns == dotted.columns and language.accepted(dotted, model).count() == kept.count()
    assert kept.columns == table(spark, rows[:1]).columns and kept.count() == 4
    assert language.learn(table(spark, rows[:0])) == ()
    assert language.predict(table(spark, rows[:1]), ()).first().lang_pred == "und"


# --- 3 ------------------------------------------------------------------------------

URLS = ["http://a.com/x", "https://www.example.com/en/1?q", "https://m.Example.COM/en/", "http://x.net/es/", "http://net/fr/#x",
        "ftp://org", "no scheme", None, "", "http://com", "http://com/", "http://notexample.com/en/", "http://x.net/ES/", "x://y://com/"]


def test_urls_against_sql(spark):
    rows = [(i, u, "html", "h") for i, u in enumerate(URLS)] + [(0, URLS[0], "html", "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = urls.judged(pages, urls.rule_table(spark))
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", [r[:2] for r in rows[:-1]])
    want = con.execute(queries.ORACLE["op3_urls"]).fetchall()
    assert sorted(map(str, set(map(tuple, got.collect())))) == sorted(map(str, map(tuple, want)))
    assert got.count() == len(rows)
    assert urls.judged(pages.limit(0), urls.rule_table(spark)).count() == 0
    assert urls.judged(pages, urls.rule_table(spark).limit(0)).where("verdict = 'allow'").count() == len(rows)
    own = spark.createDataFrame([("x.net/", "allow"), ("x.net/", "block"), ("com", "block"), (None, "block")], "rule string, verdict string")
    assert {r.page_id: r.verdict for r in urls.judged(pages, own).collect()}[3] == "block"
    assert {r.page_id: r.rule for r in urls.judged(pages, own).collect()}[9] == "com"


# --- 4 ------------------------------------------------------------------------------

def near_rows():
    rows = []
    for g in range(6):
        base = words(g, 200).split()
        for c in range(8):
            mine = list(base)
            rng = random.Random(100 * g + c)
            for _ in range(c):
                mine[rng.randrange(len(mine))] = f"new{rng.randrange(999)}"
            rows.append((10 * g + c, " ".join(mine)))
    rows += [(100 + i, words(50 + i, n)) for i, n in enumerate([1, 2, 4, 5, 6, 9, 12, 20])]
    rows += [(200 + i, words(50 + i, n) + " extra") for i, n in enumerate([1, 2, 4, 5, 6, 9, 12, 20])]
    return rows + [(300, rows[0][1].upper()), (301, ""), (302, None), (303, " ")]


def test_near_duplicates_against_all_pairs(spark):
    rows = near_rows()
    out = near_dups.near_duplicates(table(spark, [(i, t, "en", "s") for i, t in rows]))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == plain_components(rows)
    assert out.where("kept <> (doc_id = component_id)").count() == 0


def test_near_duplicates_of_a_loose_group(spark):
    """Copies so far from each other that most of them are no links."""
    base, rows = words(70, 300).split(), []
    for i in range(70):
        rng, copy = random.Random(i), list(base)
        for k in rng.sample(range(0, 300, 10), 2 + i % 5):
            copy[k] = f"own{i}x{k}"
        rows.append((100 - i, " ".join(copy)))
    out = near_dups.near_duplicates(table(spark, [(i, t, "en", "s") for i, t in rows]))
    got = {r.doc_id: r.component_id for r in out.collect()}
    want = {i: component for i, (_, component) in plain_components(rows).items()}
    assert 10 < len(set(want.values())) < 60
    assert got == want


def test_near_duplicates_awkward(spark):
    out = near_dups.near_duplicates(table(spark, AWKWARD)).collect()
    assert len(out) == len(AWKWARD)
    assert all(r.kept for r in out if r.doc_id in (1, 2, 3, 6, 7) or r.doc_id is None)
    # Rows that share an id are linked, though their texts are not alike.
    same = near_dups.near_duplicates(table(spark, [(5, "a b c", None, None), (9, "a b c", None, None), (9, "d e f", None, None),
                                                   (7, "d e f", None, None)])).collect()
    assert {r.component_id for r in same} == {5}
    assert near_dups.near_duplicates(table(spark, AWKWARD).limit(0)).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 80), (85, 80)], "a long, b long")
    got = {r.node: r.component for r in near_dups.components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {80: 80, 85: 80, 90: 80}


def test_estimates_come_close():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 6000, dtype=np.uint64)
    for share in (0.5, 0.85):
        n = 2000
        both = int(share * n)
        a, b = np.unique(pool[:both + (n - both) // 2]), np.unique(np.concatenate([pool[:both], pool[n:n + (n - both) // 2]]))
        x = near_dups.registers([a, b])
        truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert near_dups.estimate(x[:1], x[1:], np.array([len(a)]), np.array([len(b)]))[0] == pytest.approx(truth, abs=0.08)


# --- 5 ------------------------------------------------------------------------------

def test_licenses(spark):
    notice = dict(licenses.TEMPLATES[i] for i in (0, 3, 4))
    long = licenses.TEMPLATES[5][1]
    cut = " ".join(w for i, w in enumerate(long.split()) if i != 9)  # one word less
    rows = [(1, words(1, 30) + " " + licenses.TEMPLATES[0][1] + " " + words(2, 30), None, None), (2, licenses.TEMPLATES[4][1], None, None),
            (3, words(4, 9) + " " + cut, None, None), (4, words(5, 5000), None, None), *[(50 + (i or 0), t, a, b) for i, t, a, b in AWKWARD]]
    got = {(r.doc_id, r.license): (r.start_word, r.containment) for r in
           licenses.found(table(spark, rows), licenses.template_table(spark)).collect()}
    assert len(notice) == 3 and got[(1, "Apache-2.0")] == (30, 1.0) and got[(2, "MIT")] == (0, 1.0)
    parts = lambda t: {tuple(t.lower().replace(",", " ").replace("(", " ").replace(")", " ").replace('"', " ").split()[k:k + 5])
                       for k in range(len(t.split()) - 4)}
    share = len(parts(long) & parts(cut)) / len(parts(long))
    assert ((3, "MIT") in got) == (share >= 0.8)
    assert set(got) <= {(1, "Apache-2.0"), (2, "MIT"), (3, "MIT")}
    assert licenses.found(table(spark, rows).limit(0), licenses.template_table(spark)).count() == 0


# --- 6, 7 ----------------------------------------------------------------------------

def junk(i):
    return " ".join(f"{w.upper()}!!" for w in words(i, 80, "j").split())


def quality_rows(spark):
    rows = [(i, words(i, 80), "en", f"s{i % 3}") if i % 4 else (i, junk(i), "en", "s3") for i in range(120)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0, "x") for i in range(60)] + [(None, 1, 0, "x"), (5, None, 0, "x"), (5, 1, 0, "x")],
                                   "doc_id long, quality int, toxic int, kept string")
    return table(spark, rows), labels


def test_site_quality(spark):
    docs, labels = quality_rows(spark)
    out = site_quality.judged(docs, labels).collect()
    assert len(out) == 120 and all(r.kept == (r.doc_id % 4 > 0) for r in out)
    assert all(0 < r.section_rate < 1 for r in out)
    assert site_quality.judged(table(spark, AWKWARD), labels).count() == len(AWKWARD)
    assert site_quality.judged(table(spark, AWKWARD), labels.limit(0)).count() == len(AWKWARD)
    assert site_quality.judged(docs.limit(0), labels).count() == 0


def plain_base(text):
    raw = [w for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    where = Counter(tuple(raw[i:i + 3]) for i in range(len(raw) - 2))
    covered = {k for i in range(len(raw) - 2) if where[tuple(raw[i:i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\r\x0b\x0c")]
    return (len(raw), sum(map(len, raw)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_base_rules_against_plain_python():
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "b ", "é", "\n", "\t", " c", "#", "\x85", "\u2028", "\x1c"]) for _ in range(rng.randrange(300))) for _ in range(300)]
    for t in [None, "", "a b c a b c", *texts]:
        assert quality.base_rules(t) == plain_base(t)


def test_quality_ratio(spark):
    docs, labels = quality_rows(spark)
    ratios = quality.learn(docs, labels)
    out = quality.judged(docs, ratios).collect()
    assert all(r.kept == (r.doc_id % 4 > 0) for r in out)
    # The same ratio, counted by hand.
    texts = {r.doc_id: r.text.encode() + b" " for r in docs.collect()}
    parts = lambda t: [t[k:k + 4] for k in range(len(t) - 3)]
    raw = Counter(g for t in texts.values() for g in parts(t))
    good = Counter(g for i in range(60) if i % 4 > 0 for g in parts(texts[i]))
    bucket = lambda g: int(quality.grams([g[:3].decode() if g[3:] == b" " else g.decode()])[0][0])
    where = {g: bucket(g) for g in raw}
    total = lambda c: Counter({b: sum(n for g, n in c.items() if where[g] == b) for b in {where[g] for g in parts(texts[1])}})
    r, t = total(raw), total(good)
    share = lambda n, c: (n + quality.SMOOTHING) / (sum(c.values()) + quality.SMOOTHING * quality.BUCKETS)
    want = np.mean([math.log(share(t[where[g]], good)) - math.log(share(r[where[g]], raw)) for g in parts(texts[1])])
    assert {x.doc_id: x.llr for x in out}[1] == pytest.approx(float(want))
    assert quality.good(docs, ratios).count() == 90
    dotted = docs.withColumn("a.b", F.lit(1))
    assert quality.good(dotted, ratios).columns == dotted.columns and quality.good(dotted, ratios).count() == 90
    assert quality.judged(table(spark, AWKWARD), ratios).where("kept").count() == 1
    assert not quality.learn(docs, labels.limit(0)).any()
    assert quality.judged(docs.limit(0), ratios).count() == 0


# --- 8 ------------------------------------------------------------------------------

def plain_targets(sizes, weights=(5, 2, 1), most=3):
    total, full = sum(sizes), set()
    while True:
        rest = total - sum(most * sizes[i] for i in full)
        weight = sum(weights[i % 3] for i in range(len(sizes)) if i not in full)
        share = {i: rest * weights[i % 3] / weight for i in range(len(sizes)) if i not in full}
        over = {i for i, t in share.items() if t > most * sizes[i]}
        if not over:
            return [most * sizes[i] if i in full else share[i] for i in range(len(sizes))]
        full |= over


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(i, words(i, rng.randrange(1, 40)), None, rng.choice(["a", "a", "a", "b", "c", "ä", None, "d"])) for i in range(900)]
    rows += [(900, None, None, "a"), (901, "", None, "z"), (902, "x", None, "tiny"), (5, rows[5][1], None, rows[5][3])]
    out = mixing.copies(table(spark, rows)).collect()
    again = mixing.copies(table(spark, rows[::-1])).collect()
    assert sorted(map(str, out)) == sorted(map(str, again)) and len(out) == len(rows)
    names = sorted({r[3] for r in rows if r[3] is not None}, key=lambda s: s.encode()) + [None]
    sizes = [sum(len((t or "").split()) for _, t, _, s in rows if s == n) for n in names]
    for name, size, target in zip(names, sizes, plain_targets(sizes)):
        mine = [r for r in out if r.source == name]
        assert {(r.source_size, round(r.target, 6)) for r in mine} == {(size, round(target, 6))}
        assert abs(sum(r.taken for r in mine) - target) <= max(r.size for r in mine) + 1
    assert all(r.taken == r.size * r.copies <= 3 * r.size for r in out)
    assert mixing.copies(table(spark, rows).limit(0)).count() == 0
    assert mixing.copies(table(spark, AWKWARD)).count() == len(AWKWARD)
    assert mixing.copies(table(spark, AWKWARD).withColumn("a.b", F.lit(1))).count() == len(AWKWARD)


def test_small_documents_settle_large_ones(spark):
    """With documents far below the target the words taken end close to it, averaged over sources."""
    rng = random.Random(11)
    rows = [(i, "w " * rng.randrange(1, 60), None, f"s{i % 12:02}") for i in range(1200)]
    out = mixing.copies(table(spark, rows)).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert sum(abs(r.taken / r.target - 1) for r in out) / len(out) < 0.01


# --- 9 ------------------------------------------------------------------------------

def plain_segments(scores):
    """Maximal segments by their definition: the best one, then those beside it."""
    best = max(((sum(scores[i:j]), -(j - i), i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=None)
    if best is None or best[0] <= 1e-9:
        return []
    _, _, i, j = best
    return plain_segments(scores[:i]) + [(i, j - 1)] + [(a + j, b + j) for a, b in plain_segments(scores[j:])]


def test_segments_against_the_definition():
    rng = random.Random(3)
    for _ in range(200):
        scores = [rng.choice([1.37, 2.11, 0.53]) * rng.random() if rng.random() < 0.4 else -0.35 for _ in range(rng.randrange(25))]
        hits = [(i, s) for i, s in enumerate(scores) if s > 0]
        assert [x[:2] for x in toxicity.maximal_segments(hits, 0.35)] == plain_segments(scores)


def test_toxicity(spark):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        w = words(i, 60).replace("w", rng.choice(["qa", "ub", "mi"])).split()
        if i % 5 == 0:
            for _ in range(4):
                w[rng.randrange(60)] = rng.choice(["vileness", "rottenly", "gruesome"])
        rows.append((i, " ".join("".join(chr(97 + int(c)) if c.isdigit() else c for c in x) for x in w), "en", "s"))
    docs = table(spark, rows)
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0), "x") for i in range(300)] + [(None, 1, 1, "x"), (7, 1, None, "x")],
                                   "doc_id long, quality int, toxic int, score string")
    model = toxicity.learn(docs, labels)
    out = toxicity.scored(docs, model).collect()
    assert all(r.predicted == int(r.doc_id % 5 == 0) for r in out)
    assert all(len(r.passages) > 0 for r in out if r.doc_id % 5 == 0)
    assert toxicity.scored(table(spark, AWKWARD), model).where("predicted = 0 and score >= 0").count() == len(AWKWARD)
    empty = toxicity.learn(docs, labels.limit(0))
    assert toxicity.scored(docs, empty).where("predicted = 1").count() == 0
    assert toxicity.scored(docs.limit(0), model).count() == 0


# --- 10 -----------------------------------------------------------------------------

TEXTS = [None, "", "  ", "Hello  World's <|endoftext|>x<|startoftext|>", "é İx ẞ ﬁ", "!'s 's ''re 12345 a1b2", "日本語 テキスト",
         "e\u0301 \x1c \x85 \u2028 a\u200bb", "tab\tnew\nline", "😀👍🏽 <|endoftext", "ΣΑΣ ς", words(1, 500), "x" * 3000]


def test_bpe_as_the_library_does(spark):
    path = queries.tokenizer_path()
    library = tokenizers.Tokenizer.from_file(path)
    docs = table(spark, [(i, t, None, None) for i, t in enumerate(TEXTS)] + [(None, "again", None, None), (0, None, None, None)])
    ids = {r.doc_id: r.ids for r in bpe.encode(docs, path).collect()}
    whole = {r.doc_id: r for r in bpe.round_trip(docs, path).collect()}
    decoded = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs, path), bpe.vocabulary(spark, path)).collect()}
    for i, t in enumerate(TEXTS):
        e = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(e, skip_special_tokens=False)
        assert ids[i] == e and decoded[i] == text
        assert whole[i].n_tokens == len(e)
        assert whole[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(e)}I", *e)).hexdigest()
        assert whole[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.round_trip(docs, path).count() == docs.count()
    assert bpe.round_trip(docs.limit(0), path).count() == 0


# --- whole tables and pipeline ----------------------------------------------------------

@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "embeddings", "documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SF_DIR)
    want = con.execute(queries.ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, map(tuple, got.select(*names).collect()))) == sorted(map(str, want.fetchall()))


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    path = queries.tokenizer_path()
    library = tokenizers.Tokenizer.from_file(path)
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(spark, docs.withColumn("_size", F.lit("clash")), SF_DIR).cache()
        after = docs.collect()
        if name != "tokens":
            assert docs.columns == columns
        if name in ("language", "quality"):
            assert set(after) <= set(before) and len(after) >= 0.6 * len(before)
        elif name == "near_duplicates":
            want = plain_components([(r.doc_id, r.text) for r in before])
            assert sorted(r.doc_id for r in after) == sorted(i for i, (_, c) in want.items() if c == i)
        elif name == "mixing":
            taken = {r.doc_id: r.copies for r in mixing.copies(spark.createDataFrame(before, ",".join(f"{a} {b}" for a, b in zip(
                columns, ["long", "string", "string", "string", "long"])))).collect()}
            assert Counter(r.doc_id for r in after) == Counter({i: n for i, n in taken.items() if n})
        else:
            texts = {r.doc_id: r.text for r in before}
            assert len(after) == len(before)
            assert all(r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids for r in after)


def test_remainders(spark):
    got = spark.createDataFrame([(12,), (-3,), (None,)], "i long").select(remainder(F.col("i"), 4).alias("r"), language.teaches(F.col("i")).alias("t"))
    assert [tuple(r) for r in got.collect()] == [*[(zlib.crc32(x) % 4, zlib.crc32(x) % 4 != 2) for x in (b"12", b"-3")], (None, False)]


def test_stages_take_awkward_rows(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, table(spark, AWKWARD), SF_DIR).count() >= 0
        assert stage(spark, table(spark, AWKWARD).limit(0), SF_DIR).count() == 0


def test_mixing_stage_keeps_texts_apart(spark):
    """Rows without an id, and rows that share one, with as many words each: every text has its own copies."""
    rows = [(None, words(i, 10), "en", "a") for i in range(60)] + [(7, words(100 + i, 10), "en", "a") for i in range(4)]
    rows += [(None, words(0, 10), "de", "a"), (None, None, None, None), *[(200 + i, words(300 + i, 40), "en", "b") for i in range(30)]]
    docs = table(spark, rows)
    out = Counter((r.doc_id, r.text, r.lang) for r in corpus_pipeline.mixed(spark, docs, SF_DIR).collect())
    given = Counter((i, t, lang) for i, t, lang, _ in rows)
    assert all(n <= mixing.MOST_COPIES * given[k] for k, n in out.items())
    target = {r.source: r.target for r in mixing.copies(docs.select(*corpus_pipeline.COLUMNS)).collect()}["a"]
    texts = [t for (_, t, _), n in out.items() for _ in range(n) if len(t.split()) == 10]
    assert abs(10 * len(texts) - target) <= 11
    assert len(set(texts)) >= min(64, target // 10) - 1


def repeated_rows():
    """Rows that share an id but not a text, and rows without an id, near others and near each other."""
    near = lambda seed, k: " ".join([*words(seed, 200).split()[:-1], f"end{k}"])
    rows = [(9, words(500 + i, 200)) for i in range(8)] + [(20 + i, near(500 + i, i)) for i in range(8)]
    rows += [(None, near(600, 0)), (40, near(600, 1)), (41, words(601, 200)), (None, words(601, 200))]
    rows += [(None, near(602, k)) for k in (0, 1, 2, 2, 2)] + [(None, near(603, 0).upper()), (None, near(603, 0)), (None, near(603, 0))]
    return rows + [(None, words(604, 200)), (None, ""), (None, ""), (None, None)]


def test_near_duplicates_of_every_set(spark):
    rows = repeated_rows()
    docs = table(spark, [(i, t, "en", "s") for i, t in rows])
    out = near_dups.near_duplicates(docs).collect()
    assert len(out) == len(rows)
    assert {r.component_id for r in out if r.doc_id in (9, *range(20, 28))} == {9}
    assert sorted(r.component_id for r in out if r.doc_id is None and r.component_id is not None) == [40, 41]
    # One row each of the three groups without any id, and the three texts without words.
    assert sum(r.kept for r in out if r.doc_id is None) == 6
    assert sorted(r.doc_id for r in out if r.kept and r.doc_id is not None) == [9] * 8 + [40, 41]


def test_near_duplicates_stage_decides_rows_without_an_id(spark):
    rows = [(i, t, "en", "s") for i, t in repeated_rows()]
    left = [tuple(r) for r in corpus_pipeline.one_of_each(spark, table(spark, rows), SF_DIR).collect()]
    again = [tuple(r) for r in corpus_pipeline.one_of_each(spark, table(spark, rows[::-1]), SF_DIR).collect()]
    assert sorted(map(str, left)) == sorted(map(str, again))
    assert sorted(r[0] for r in left if r[0] is not None) == [9, 40, 41]
    assert sorted(str(r[1])[:1] for r in left if r[0] is None)[:2] == ["", ""] and sum(r[0] is None for r in left) == 6


def test_language_is_learned_from_all_positions(spark):
    """Every text opens with the same long passage; only what follows tells the languages apart."""
    rng = random.Random(8)
    parts = {"aa": ["tion", "the", "ing", "and"], "bb": ["keit", "sch", "ung", "ein"]}
    make = lambda k, n: " ".join(rng.choice(parts[k]) + rng.choice(parts[k]) for _ in range(n))
    opening = "lorem ipsum dolor sit amet " * 100 + "1 2 3 " * 400
    rows = [(i, opening + make(k, 300), k, "s") for i, k in enumerate(["aa", "bb"] * 20)]
    model = language.learn(table(spark, rows))
    assert {language.judge(make(k, 60), model)[0] == k for k in parts for _ in range(10)} == {True}
    _, pieces = language.sampled(table(spark, rows))
    assert len({r.h for r in pieces}) == len(rows) and all(len(v) <= language.DICTIONARY for _, v in model)


def test_tokens_stage_decodes(spark):
    path = queries.tokenizer_path()
    library = tokenizers.Tokenizer.from_file(path)
    docs = table(spark, [(i, t, None, None) for i, t in enumerate(TEXTS)])
    out = {r.doc_id: r for r in corpus_pipeline.tokens(spark, docs, SF_DIR).collect()}
    assert len(out) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert out[i].ids == ids and out[i].n_tokens == len(ids)
        assert out[i].decoded == library.decode(ids, skip_special_tokens=False)


def test_licenses_of_all_templates(spark):
    """Every template is found as its own license and no other, also with words around it."""
    rows = [(i, f"{words(i, 7)} {t} {words(i + 1, 7)}", None, None) for i, (_, t) in enumerate(licenses.TEMPLATES)]
    notice = "This {} is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free " \
             "Software Foundation; either version {} of the License, or (at your option) any later version."
    more = {"GPL-2.0": notice.format("program", "General Public License", "2"), "LGPL-2.1": notice.format("library", "Lesser General Public License", "2.1"),
            "GPL-3.0": notice.format("program", "General Public License", "3"), "AGPL-3.0": notice.format("program", "Affero General Public License", "3"),
            "MIT": "This project is licensed under the MIT License, see LICENSE.", "CC-BY-SA-4.0": "Text is under CC BY-SA 4.0 unless stated otherwise."}
    rows += [(10_000 + i, t, None, None) for i, t in enumerate(more.values())]
    want = {i: {name} for i, (name, _) in enumerate(licenses.TEMPLATES)} | {10_000 + i: {name} for i, name in enumerate(more)}
    got = {}
    for r in licenses.found(table(spark, rows), licenses.template_table(spark)).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    assert {i: (got.get(i), want[i], rows[k][1]) for k, i in enumerate(want) if got.get(i) != want[i]} == {}
    assert {"GPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "ISC", "EPL-2.0", "CC0-1.0", "CC-BY-SA-4.0", "CC-BY-NC-SA-4.0", "Unlicense"} <= {
        name for name, _ in licenses.TEMPLATES}


def test_site_quality_by_host_and_path(spark):
    docs, labels = quality_rows(spark)
    pages = docs.withColumn("host", F.concat(F.lit("h"), F.col("doc_id") % 5)).withColumn("path", F.concat(F.lit("/"), F.col("doc_id") % 2))
    want = site_quality.judged(pages.withColumn("source", F.col("host")).withColumn("lang", F.col("path")), labels)
    got = site_quality.judged(pages, labels, site="host", section="path")
    rates = lambda df: {r.doc_id: (round(r.site_rate, 9), round(r.section_rate, 9)) for r in df.collect()}
    assert rates(got) == rates(want) != rates(site_quality.judged(pages, labels))


def test_toxicity_keeps_a_rich_vocabulary(spark):
    letters = lambda n: "".join(chr(97 + int(c)) for c in f"{n:06d}")
    bad = [" ".join("vile" + letters(10_000 * i + k) for k in range(10_000)) for i in range(8)]
    rows = [(i, t, "en", "s") for i, t in enumerate(bad)] + [(100 + i, " ".join("mild" + letters(50 * i + k) for k in range(50)), "en", "s")
                                                             for i in range(60)]
    labels = spark.createDataFrame([(r[0], 1, int(r[0] < 100)) for r in rows], "doc_id long, quality int, toxic int")
    lexicon = toxicity.learn(table(spark, rows), labels)[0]
    assert sum(score > 0 for score in lexicon.values()) > 50_000
