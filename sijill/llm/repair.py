"""Repair of conversations: the cheapest edits that make turns alternate as a chat format asks.

A conversation is to read as an optional system turn and then pairs of user and assistant, or as nothing. Its rows and the state of
that pattern span a lattice, and edits are its steps. A search from the start and one from the end, each with a heap by cost, meet in
the middle; both go on until no crossing of the best cost can be left, and of those the least audit (the edits' initials) wins.

What the search needs of a row is one letter, so texts are moved once, to be rewritten. A conversation of more than ``SEGMENT`` rows is
searched in segments, between any two states of the pattern, by different tasks, and the segments' tables are put together in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sijill.operators.scale import numbered_within
from sijill.session import materialise

SEGMENT = 1_024
BLANKS = " \t\n\x0b\x0c\r"
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
INITIALS = "sua"                  # other roles are a fourth kind
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)         # states in which a conversation may end
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5  # costs; CUT is that of a truncated row that stays
AFTER = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}


def symbol(initial: int, fault: int) -> str:
    """A row in one letter."""
    return chr(ord("a") + 4 * fault + initial)


def _meaning(letter: str) -> tuple[int, int]:
    """(initial, fault) of a row's letter."""
    return (ord(letter) - ord("a")) % 4, (ord(letter) - ord("a")) // 4


def _keeps(initial: int, state: int) -> int | None:
    """The state after a row of that initial, None where the pattern has no such row."""
    if initial == 0:
        return SYSTEM if state == START else None
    return AFTER[state] if initial < 3 and AFTER[state] == initial + 1 else None


@lru_cache(maxsize=64)
def _steps(letter: str) -> tuple[tuple[int, int, int, str], ...]:
    """(from, to, cost, edit) of every way past a row."""
    initial, fault = _meaning(letter)
    found = [(q, q, DELETE, "D") for q in range(4)]
    if fault in (FINE, TRUNCATED):
        stays = CUT if fault == TRUNCATED else 0
        found += [(q, AFTER[q], REROLE + stays, "R") for q in range(4)]
        found += [(q, to, stays, "K") for q in range(4) if (to := _keeps(initial, q)) is not None]
    return tuple(found)


_INSERTS = tuple((q, to, INSERT, "I") for q, to in AFTER.items())


def cheapest(symbols: str, start: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest way from ``start`` before the first row to one of ``ends`` after the last; None without any.

    Of two ways to a node at one cost neither audit begins the other, as that would take an insertion, so the least
    audit goes on from the least one of each half. Keeping costs nothing, so nodes of one cost are settled row by row.
    """
    n = len(symbols)
    ahead, behind = {}, {}                       # settled: node -> (cost, audit)
    first, last = {(0, start): (0, "")}, {(n, q): (0, "") for q in ends}
    forward, backward = [(0, 0, start)], [(0, 0, q) for q in ends]
    best: tuple[int, str] | None = None

    def crossing(before: tuple[int, str], cost: int, edit: str, after: tuple[int, str]) -> None:
        nonlocal best
        way = (before[0] + cost + after[0], before[1] + edit + after[1])
        if best is None or way < best:
            best = way

    while forward and backward and (best is None or forward[0][0] + backward[0][0] <= best[0]):
        if forward[0][0] <= backward[0][0]:
            cost, i, q = heappop(forward)
            if (i, q) in ahead:
                continue
            ahead[i, q] = here = first[i, q]
            if (i, q) in behind:
                crossing(here, 0, "", behind[i, q])
            for steps, j in ((_INSERTS, i), (_steps(symbols[i]) if i < n else (), i + 1)):
                for a, b, more, edit in steps:
                    if a != q:
                        continue
                    way = (cost + more, here[1] + edit)
                    if (j, b) in behind:
                        crossing(here, more, edit, behind[j, b])
                    if (j, b) not in ahead and ((j, b) not in first or way < first[j, b]):
                        first[j, b] = way
                        heappush(forward, (way[0], j, b))
        else:
            cost, back, q = heappop(backward)
            i = n - back
            if (i, q) in behind:
                continue
            behind[i, q] = here = last[i, q]
            if (i, q) in ahead:
                crossing(ahead[i, q], 0, "", here)
            for steps, j in ((_INSERTS, i), (_steps(symbols[i - 1]) if i else (), i - 1)):
                for a, b, more, edit in steps:
                    if b != q:
                        continue
                    way = (cost + more, edit + here[1])
                    if (j, a) in ahead:
                        crossing(ahead[j, a], more, edit, here)
                    if (j, a) not in behind and ((j, a) not in last or way < last[j, a]):
                        last[j, a] = way
                        heappush(backward, (way[0], n - j, a))
    return best


@lru_cache(maxsize=1 << 14)
def _table(symbols: str, opens: bool) -> tuple[tuple[int, int, int, str], ...]:
    """(from, to, cost, audit) of a segment; ``to`` is -1 for the end of a conversation, whose last segment is not full."""
    found = []
    for q in (START,) if opens else range(4):
        for to, ends in ((-1, ENDS),) if len(symbols) < SEGMENT else ((r, (r,)) for r in range(4)):
            way = cheapest(symbols, q, ends)
            if way:
                found.append((q, to, *way))
    return tuple(found)


_LEGAL = {(0, 1), (1, 2), (2, 1)}  # initials that may follow each other: su, ua, au


def _illegal(symbols: str, before: int | None) -> int:
    initials = ([] if before is None else [before]) + [_meaning(x)[0] for x in symbols]
    return sum(pair not in _LEGAL for pair in zip(initials, initials[1:]))


def _clean(rows: DataFrame) -> DataFrame:
    """Rows as they are repaired: nulls in role and text are one blank; ``copy`` tells equal rows of a turn apart where it is given."""
    copy = F.col("copy").cast("int") if "copy" in rows.columns else F.lit(0)
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
                       F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), copy.alias("copy"))


ORDER = ["turn", "role", "digest", "copy"]


def _with_digest(rows: DataFrame) -> DataFrame:
    return rows.withColumn("digest", F.unhex(F.sha2(F.concat("role", F.lit("\0"), "text"), 256)))


def _initial(role: Column) -> Column:
    at = F.instr(F.lit(INITIALS), F.substring(role, 1, 1))
    return F.when((F.length(role) == 0) | (at == 0), 3).otherwise(at - 1)


def _segments(rows: DataFrame) -> DataFrame:
    """(conv_id, segment, symbols): a letter for each row, in order."""
    bare = F.rtrim("text", F.lit(BLANKS))
    slim = materialise(_with_digest(rows).select(
        "conv_id", *ORDER, _initial(F.col("role")).alias("initial"), (F.length(bare) == 0).alias("blank"),
        F.substring(bare, -1, 1).isin(".", "!", "?").alias("ended")), "turns")
    placed = materialise(numbered_within(slim, ["conv_id"], ORDER, "n"), "turns")
    seen = numbered_within(placed.drop(*[c for c in ORDER if c != "digest"]), ["conv_id", "digest"], ["n"], "seen")
    fault = F.when(F.col("blank"), BLANK).when(F.col("seen") > 1, DUPLICATE).when(~F.col("ended"), TRUNCATED).otherwise(FINE)
    letter = F.char(F.lit(ord("a")) + 4 * fault + F.col("initial"))
    lettered = seen.select("conv_id", ((F.col("n") - 1) / SEGMENT).cast("int").alias("segment"), "n", letter.alias("letter"))
    letters = F.array_sort(F.collect_list(F.struct("n", "letter")))
    return lettered.groupBy("conv_id", "segment").agg(F.array_join(F.transform(letters, lambda x: x["letter"]), "").alias("symbols"))


_SEARCHED = "conv_id long, segment int, symbols string, ways array<struct<from: int, to: int, cost: long, audit: string>>"
_WAY = pa.struct([("from", pa.int32()), ("to", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])


def _searched(segments: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tables = [_table(s, k == 0) for s, k in zip(b.column("symbols").to_pylist(), b.column("segment").to_pylist())]
            ways = pa.array([[dict(zip(("from", "to", "cost", "audit"), w)) for w in t] for t in tables], pa.list_(_WAY))
            yield pa.RecordBatch.from_arrays([*b.columns, ways], ["conv_id", "segment", "symbols", "ways"])

    return segments.select("conv_id", "segment", "symbols").mapInArrow(run, _SEARCHED)


class _Conversation:
    """One conversation of a stream: its segments first, then its rows in order."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.ways = conv_id, {START: (0, "")}
        self.faults, self.illegal, self.before = [0] * 4, 0, None
        self.edits: str | None = None
        self.place, self.state, self.seq = 0, START, 0
        self.turns, self.least, self.most = 0, None, None
        self.sha, self.begun = hashlib.sha256(), False

    def segment(self, symbols: str, ways: list[dict]) -> None:
        new: dict[int, tuple[int, str]] = {}
        for w in ways:
            if w["from"] in self.ways:
                cost, audit = self.ways[w["from"]]
                way = (cost + w["cost"], audit + w["audit"])
                if w["to"] not in new or way < new[w["to"]]:
                    new[w["to"]] = way
        self.ways = new
        for letter in symbols:
            self.faults[_meaning(letter)[1]] += 1
        self.illegal += _illegal(symbols, self.before)
        self.before = _meaning(symbols[-1])[0]

    def _decide(self) -> None:
        if self.edits is None:
            self.cost, self.edits = min(self.ways[q] for q in (-1, *ENDS) if q in self.ways)

    def _out(self, edit: str, role: str, text: str) -> tuple:
        self.sha.update((("\n" if self.begun else "") + role + ":" + text).encode("utf-8", "replace"))
        self.begun, self.seq = True, self.seq + 1
        return self.conv_id, self.seq, edit, role, text

    def _inserted(self) -> Iterator[tuple]:
        while self.place < len(self.edits) and self.edits[self.place] == "I":
            self.place, self.state = self.place + 1, AFTER[self.state]
            yield self._out("I", ROLES[self.state], "")

    def row(self, turn: int | None, role: str, text: str) -> Iterator[tuple]:
        self._decide()
        if turn is not None and turn != self.most:  # turns come in order
            self.turns, self.most = self.turns + 1, turn
            self.least = turn if self.least is None else self.least
        yield from self._inserted()
        edit, self.place = self.edits[self.place], self.place + 1
        if edit == "R":
            self.state = AFTER[self.state]
            yield self._out(edit, ROLES[self.state], text)
        elif edit == "K":
            self.state = _keeps(INITIALS.find(role[:1]), self.state)
            yield self._out(edit, role, text)

    def end(self) -> Iterator[tuple]:
        self._decide()
        yield from self._inserted()

    def summary(self) -> tuple:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return (self.conv_id, gaps, *self.faults[1:], self.illegal, self.cost, self.edits, self.sha.hexdigest())


def _arranged(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """Conversations, their searched segments and their rows, each conversation's in one partition and in that order."""
    rows = _clean(rows)
    nothing = lambda **kinds: [F.lit(None).cast(k).alias(n) for n, k in kinds.items()]
    ways = "array<struct<from: int, to: int, cost: long, audit: string>>"
    row_columns = {"turn": "long", "role": "string", "digest": "binary", "copy": "int", "text": "string"}
    heads = (conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
             .select("conv_id", F.lit(-1).alias("segment"), *nothing(symbols="string", ways=ways, **row_columns)))
    searched = _searched(_segments(rows)).select("conv_id", "segment", "symbols", "ways", *nothing(**row_columns))
    texts = _with_digest(rows).select("conv_id", F.lit((1 << 31) - 1).alias("segment"), *nothing(symbols="string", ways=ways),
                                      "turn", "role", "digest", "copy", "text")
    together = heads.unionByName(searched).unionByName(texts)
    return together.repartition("conv_id").sortWithinPartitions("conv_id", "segment", *ORDER).drop("digest", "copy")


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], list[tuple]]]:
    """(repaired rows, summaries) of each batch; a conversation may go on in the next batch."""
    now: _Conversation | None = None
    for b in batches:
        rows, ended = [], []
        for r in b.to_pylist():
            if now is None or now.conv_id != r["conv_id"]:
                if now:
                    rows += now.end()
                    ended.append(now.summary())
                now = _Conversation(r["conv_id"])
            if r["role"] is not None:
                rows += now.row(r["turn"], r["role"], r["text"])
            elif r["symbols"] is not None:
                now.segment(r["symbols"], r["ways"])
        yield rows, ended
    if now:
        rows = list(now.end())
        yield rows, [now.summary()]


def _as_batches(found: Iterator[list[tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for rows in found:
        columns = zip(*rows) if rows else [()] * len(schema)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_ROWS = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
_NUMBERS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_SUMMARY = pa.schema([("conv_id", pa.int64()), *[(n, pa.int64()) for n in _NUMBERS], ("audit", pa.string()), ("repaired_sha256", pa.string())])


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, seq, edit, role, text): the turns of every conversation after repair, numbered from 1.

    Rows come by turn, nulls first, then by role and a digest of role and text; a null conv_id is a conversation of its own. A blank
    or repeated row goes, an inserted one is empty. An empty table has no rows.
    """
    found = _arranged(rows, rows)
    return found.mapInArrow(lambda batches: _as_batches((r for r, _ in _streamed(batches)), _ROWS),
                            "conv_id long, seq long, edit string, role string, text string")


def summaries(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    The digest is that of the rows of ``repaired``, ``role:text`` joined by newlines. ``conversations`` names some that have no row, with
    zeros, an empty audit and the digest of nothing. ``gaps`` counts the turns missing between the first and the last, 0 if all are null.
    """
    found = _arranged(rows, rows if conversations is None else conversations)
    return found.mapInArrow(lambda batches: _as_batches((s for _, s in _streamed(batches)), _SUMMARY),
                            "conv_id long, " + ", ".join(f"{n} long" for n in _NUMBERS) + ", audit string, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with faults dealt by a checksum of conversation and turn: dropped, emptied, without end marks, repeated or set to user."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    clean = _clean(rows.drop("copy")).drop("copy").withColumn("kind", kind).where("kind <> 0")
    return clean.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
                        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
