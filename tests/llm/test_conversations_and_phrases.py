"""Repair, formatting and phrases against brute force and SQL, with every awkward case."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter
from itertools import product

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sijill.llm import chat, phrases, queries, repair
from sijill.llm.text import importable

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TURNS = "conv_id long, turn long, role string, text string, n long, segment string, audit string"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    importable(spark)


def turns(spark, rows):
    """conversations with columns that clash with those the operators add."""
    return spark.createDataFrame([(*r, 7, "x", "y") for r in rows], TURNS)


AWKWARD = [(1, None, "user", "No turn."), (1, 0, "system", "Be kind."), (1, 0, "system", "Be kind."), (1, 2, None, "who?"), (1, 5, "assistant", None),
           (1, 9, "", " \t"), (None, 1, "user", "A null id."), (None, 2, "assistant", "Yes!"), (2, 3, "userly", "<|im_end|> cut"),
           (2, 4, "assistant", "<\\|im_start|>\n."), (3, 0, "a\nb\\n", "<|x|>."), (4, 1, "user", "q" * 70_000 + "."), (4, 2, "assistant", "<"),
           (4, 3, "assistant", "\\|"), (5, 0, "user", "")]


# --- 11 -----------------------------------------------------------------------------

def plain_repair(rows):
    """(numbers, cost, audit, repaired text) of rows in order, by trying every state after every row and insertion."""
    blanks = " \t\n\x0b\x0c\r"
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.rstrip(blanks)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    best = {"": (0, "", ())}  # the state is the last initial, or nothing

    def wider(ways):
        for _ in range(3):
            for last, (cost, audit, out) in list(ways.items()):
                new = "a" if last == "u" else "u"
                way = (cost + 5, audit + "I", (*out, ("user:" if new == "u" else "assistant:")))
                if new not in ways or way[:2] < ways[new][:2]:
                    ways[new] = way
        return ways

    best = wider(best)
    for (_, role, text), fault in zip(rows, faults):
        new = {}

        def put(last, *way):
            if last not in new or way[:2] < new[last][:2]:
                new[last] = way

        for last, (cost, audit, out) in best.items():
            put(last, cost + 2, audit + "D", out)
            if fault in ("", "truncated"):
                more = 5 if fault else 0
                turn = "a" if last == "u" else "u"
                put(turn, cost + 1 + more, audit + "R", (*out, ("user:" if turn == "u" else "assistant:") + text))
                if role[:1] == turn or (role[:1] == "s" and last == ""):
                    put(role[:1], cost + more, audit + "K", (*out, f"{role}:{text}"))
        best = wider(new)
    cost, audit, out = min(best[k] for k in ("", "a") if k in best)
    count = Counter(faults)
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def in_order(rows):
    filled = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    return sorted(filled, key=lambda w: ((w[0] is not None, w[0] or 0), w[1].encode(), hashlib.sha256(f"{w[1]}\0{w[2]}".encode()).digest()))


def plain_damage(rows):
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        made = (conv, turn, "user" if kind == 4 else role, "" if kind == 1 else text)
        yield from [] if kind == 0 else [made, made] if kind == 3 else [made]


def by_conversation(rows, every):
    groups = {c: [] for c in every}
    for conv, *rest in rows:
        groups[conv].append(tuple(rest))
    return {c: plain_repair(in_order(g)) for c, g in groups.items()}


def random_turns(seed, conversations, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(conversations):
        for t in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant"] * 3 + ["system", "tool", "", None])
            text = rng.choice(["Yes.", "No", "", " ", None, "What?", f"Long {t}!", f"cut {t}", f"Some {t}. "])
            rows.append((c, rng.choice([t, t, t, t + 3, None]), role, text))
    return rows


def test_search_meets_the_best_way_of_every_short_conversation():
    letters = "".join(repair.symbol(i, f) for i, f in ((0, 0), (1, 0), (2, 0), (3, 0), (1, 1), (2, 3), (1, 3)))
    words = {"a": ("system", "x."), "b": ("user", "x."), "c": ("assistant", "x."), "d": ("tool", "x."), "f": ("user", ""), "o": ("assistant", "x"), "n": ("user", "x")}
    for n in range(5):
        for way in product(letters, repeat=n):
            rows = [(k, words[x][0], words[x][1] and f"{k}{words[x][1]}") for k, x in enumerate(way)]
            assert repair.cheapest("".join(way), repair.START, repair.ENDS) == plain_repair(rows)[5:7]


@pytest.mark.parametrize("segment", [1024, 3])
def test_repair_against_brute_force(spark, monkeypatch, segment):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    repair._table.cache_clear()
    rows = random_turns(3, 60, 14) + [(100 + (c or 0), *r) for c, *r in AWKWARD] + [(None, 5, "user", "x")]
    df = turns(spark, rows)
    want = by_conversation(rows, {r[0] for r in rows})
    # Tasks take the segment's length with the function, so it is given to them in one plan.
    got = {r.conv_id: tuple(r)[1:9] for r in segmented(df, segment)}
    assert got == want
    repair._table.cache_clear()


def segmented(df, segment):
    """Summaries with segments of that length in the tasks as well."""
    found = repair._arranged(df, df)

    def run(batches):
        return repair._as_batches((s for _, s in repair._streamed(batches)), repair._SUMMARY)

    if segment == repair.SEGMENT == 1024:
        return repair.summaries(df).collect()
    rows = found.collect()  # a small fixture: segments are searched here, with the length set here
    import pyarrow as pa
    fixed = []
    for r in rows:
        d = r.asDict(recursive=True)
        if d["symbols"] is not None:
            d["ways"] = [dict(zip(("from", "to", "cost", "audit"), w)) for w in repair._table(d["symbols"], d["segment"] == 0)]
        fixed.append(d)
    schema = pa.schema([("conv_id", pa.int64()), ("segment", pa.int32()), ("symbols", pa.string()), ("ways", pa.list_(repair._WAY)),
                        ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    parts = {}
    for d in fixed:
        parts.setdefault(d["conv_id"], []).append(d)
    batch = pa.RecordBatch.from_pylist([d for g in parts.values() for d in g], schema=schema)
    table = pa.Table.from_batches(list(run(iter([batch]))))
    return [type("Row", (tuple,), {"conv_id": t["conv_id"]})(t.values()) for t in table.to_pylist()]


def test_repaired_rows_read_as_a_chat(spark):
    rows = turns(spark, random_turns(5, 40, 12) + AWKWARD)
    out = repair.repaired(rows).orderBy("conv_id", "seq").collect()
    read = {}
    for r in out:
        read.setdefault(r.conv_id, []).append(r.role[:1])
    assert read and all(re.fullmatch("(s?(ua)+)?", "".join(v)) for v in read.values())
    assert repair.repaired(rows.limit(0)).count() == 0 and repair.summaries(rows.limit(0)).count() == 0


def test_repair_query_against_brute_force(spark):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SF_DIR}/conversations.parquet'").fetchall()
    want = by_conversation(plain_damage(rows), {r[0] for r in rows})
    got = {r.conv_id: tuple(r)[1:] for r in queries.op11_repair(spark, SF_DIR).collect()}
    assert got == want
    odd = turns(spark, AWKWARD + [(200 + k, k, "user", "x.") for k in range(60)])
    plain = [tuple(r)[:4] for r in odd.collect()]
    want = by_conversation(plain_damage(plain), {r[0] for r in plain})
    assert {r.conv_id: tuple(r)[1:] for r in repair.summaries(repair.damaged(odd), odd).collect()} == want
    assert any(w == (0,) * 6 + ("", hashlib.sha256().hexdigest()) for w in want.values())


# --- 12 -----------------------------------------------------------------------------

def ranks():
    return open(queries.tokenizer_path("byte_bpe_50k.tiktoken"), "rb").read()


@pytest.mark.parametrize("text", ["", "<|im_end|>", "<\\|im_end|>", "<\\\\|", "<<||>", "\\<|\\", "<", "|", "a<|b<|"])
def test_escapes_are_reversible(text):
    assert "<|" not in chat.escaped(text) and chat.unescaped(chat.escaped(text)) == text


def test_formatted_parts_and_masks(spark, monkeypatch):
    table, pattern = ranks(), public_tokenizers.PATTERN
    df = turns(spark, AWKWARD)
    parts = chat.formatted(df, table, pattern).collect()
    encoding, opens, closes = chat._encoding(table, pattern)
    for p in parts:
        ids, loss = np.array(p.ids), np.array(p.loss)
        assert (ids == opens).sum() == (ids == closes).sum() == p.n_turns and not loss[(ids == opens) | (ids == closes)].any()
        text = encoding.decode(p.ids)
        assert text.count(chat.OPEN) == text.count(chat.CLOSE) == p.n_turns
    found = {p.conv_id: (chat.turns_of(np.array(p.ids), table, pattern), chat.learned_texts(np.array(p.ids), np.array(p.loss), table, pattern)) for p in parts}
    assert found[2] == ([("userly", "<|im_end|> cut"), ("assistant", "<\\|im_start|>\n.")], ["<\\|im_start|>\n."])
    assert found[3][0] == [("a\nb\\n", "<|x|>.")] and found[4][1] == ["<", "\\|"] and found[1][0][0] == ("user", "No turn.")
    assert found[None][1] == ["Yes!"] and found[5] == ([("user", "")], [])
    assert chat.formatted(df.limit(0), table, pattern).count() == 0


def test_long_conversations_come_in_parts(spark):
    table, pattern = ranks(), public_tokenizers.PATTERN
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"w{t} " * 3000) for t in range(60)] + [(2, 0, "assistant", "one")]
    df = turns(spark, rows)
    parts = chat.formatted(df, table, pattern)
    assert parts.where("conv_id = 1").count() > 1 and parts.where("conv_id = 1").agg(F.sum("n_turns")).first()[0] == 60
    back = {r.conv_id: r for r in chat.read_back(parts, table, pattern).collect()}
    told = "".join(f"{r[2]}\n{r[3]}\n" for r in rows[:60])
    assert back[1].turns_sha256 == hashlib.sha256(told.encode()).hexdigest() and back[1].n_turns == 60
    assert back[1].loss_sha256 == hashlib.sha256("".join(r[3] for r in rows[1:60:2]).encode()).hexdigest()


def test_chat_sql_on_awkward_rows(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", AWKWARD)
    want = con.execute(queries.ORACLE["op12_chat"]).fetchall()
    rows = turns(spark, AWKWARD + [(-1, 0, "user", queries.MARKED), (-1, 1, "assistant", queries.MARKED)])
    parts = chat.formatted(rows, ranks(), public_tokenizers.PATTERN)
    for arranged in (True, False):
        got = chat.read_back(parts, ranks(), public_tokenizers.PATTERN, arranged).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


# --- 13 -----------------------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, phrase string, a long, threshold long"


def plain_phrases(rows, first, least, inside=80):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    f, total = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(lower)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            total[lang] += len(w)
            for m in range(1, 5):
                f.update((lang, *w[i:i + m]) for i in range(len(w) - m + 1))
    many = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    dropped = set()
    for p, a in many.items():
        lang, w = p[0], p[1:]
        for n in range(2, len(w)):
            for i in range(len(w) - n + 1):
                part = (lang, *w[i:i + n])
                if 100 * a >= inside * f[part]:
                    dropped.add(part)
    found = {}
    for p, a in many.items():
        if p in dropped:
            continue
        cuts = []
        for k in range(1, len(p) - 1):
            left, right = f[p[:k + 1]], f[(p[0], *p[k + 1:])]
            cuts.append((2_000_000 * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        found.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), left, right))
    return sorted((lang, rank + 1, x[2].decode(), -x[1], x[3], x[4], total[lang], -x[0])
                  for lang, xs in found.items() for rank, x in enumerate(sorted(xs)[:first]))


def random_docs(seed, n):
    rng = random.Random(seed)
    known = [f"{a}{b}" for a in "abcdé" for b in "xyz"]
    fixed = [" ".join(rng.choice(known) for _ in range(rng.randrange(2, 7))) for _ in range(25)]
    rows = [(None, None, None), (1, "", "aa"), (2, " \t.,;", "aa"), (3, "É É " * 400, "bb"), (4, "one word", None)]
    for i in range(n):
        text = "".join(rng.choice([*fixed * 2, *known]) + rng.choice([" ", "  ", " \t", ". ", ",", "\n", "\r\n", " "]) for _ in range(rng.randrange(0, 60)))
        rows.append((i + 5, text.upper() if i % 5 == 0 else text, rng.choice(["aa", "aa", "bb", None])))
    return rows + rows[40:60]


@pytest.mark.parametrize("first, least", [(2000, 30), (7, 10), (1, 4)])
def test_phrases_against_brute_force(spark, first, least):
    rows = random_docs(first, 300)
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], DOCS)
    got = sorted(tuple(r) for r in phrases.phrases(df, first, least).collect())
    assert got == plain_phrases(rows, first, least) and got


def test_thresholds_fall_until_enough_survive(spark, monkeypatch):
    rows = [(i, ("p q r s. " * 3 + f"x{i % 4} y. z x{i % 4}. " * (i % 7)), "aa") for i in range(200)] + random_docs(2, 120)
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], DOCS)
    monkeypatch.setattr(phrases, "ROUNDS", (1, 2))
    asked = []
    plain = phrases._round
    monkeypatch.setattr(phrases, "_round", lambda *a: (asked.append(a[3].df.collect()), plain(*a))[1])
    got = sorted(tuple(r) for r in phrases.phrases(df, 5, 20).collect())
    assert got == plain_phrases(rows, 5, 20)
    assert asked[0] and max(r.threshold for r in asked[0]) > 0


def test_phrases_of_nothing(spark):
    df = spark.createDataFrame([(1, None, None, "x", 1, 2)], DOCS)
    assert phrases.phrases(df).count() == 0 and phrases.phrases(df.limit(0)).count() == 0
