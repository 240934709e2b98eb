"""Conversations as token sequences of a chat template, with a loss mask.

    <|im_start|>role
    text<|im_end|>

Every segment is encoded by itself and the reserved ids, which lie behind the vocabulary, are spliced in between, so no text can make
one. Control strings in roles and texts are escaped all the same, so that the formatted text can be read back as well: a backslash goes
in after the ``<`` of each ``<|``, and one more where some stand there already. The mask marks the texts of one role, as running
sums over the segments' lengths.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"
PART = 1 << 16      # ids after which a part of a conversation ends with its turn

_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escaped(text: str) -> str:
    """The text without any ``<|``; ``unescaped`` gives it back."""
    return _CONTROL.sub(r"<\\\1|", text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _role_line(role: str) -> str:
    """A role that ends with its line."""
    return escaped(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_of(line: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(line))


@lru_cache(maxsize=2)
def _encoding(ranks: bytes, pattern: str) -> tuple[tiktoken.Encoding, int, int]:
    """The byte-level vocabulary with two reserved ids behind it."""
    known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    opens = max(known.values()) + 2  # one id stays free, as the vocabulary's own end mark has it
    return tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=known, special_tokens={OPEN: opens, CLOSE: opens + 1}), opens, opens + 1


_TURN = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("digest", pa.string()), ("learned", pa.bool_()),
                   ("head", pa.binary()), ("body", pa.binary())])


def encoded_turns(rows: DataFrame, ranks: bytes, pattern: str, learned: str = LEARNED) -> DataFrame:
    """(conv_id, turn, role, digest, learned, head, body) of every row: ids of role line and text as 32-bit integers, where rows stand."""
    clean = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(ranks, pattern)[0].encode_ordinary
        packed = lambda text: np.array(encode(text), "<u4").tobytes()
        for b in batches:
            roles = b.column("role").to_pylist()
            heads = {r: packed(_role_line(r) + "\n") for r in set(roles)}
            yield pa.RecordBatch.from_arrays([
                b.column("conv_id"), b.column("turn"), b.column("role"), b.column("digest"), pa.array([r == learned for r in roles], pa.bool_()),
                pa.array([heads[r] for r in roles], pa.binary()),
                pa.array([packed(escaped(t)) if t else b"" for t in b.column("text").to_pylist()], pa.binary())], schema=_TURN)

    return clean.withColumn("digest", F.sha2("text", 256)).mapInArrow(
        run, "conv_id long, turn long, role string, digest string, learned boolean, head binary, body binary")


def _assembled(turns: list[tuple[bool, bytes, bytes]], opens: int, closes: int, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the turns in a row, and their mask."""
    segments, marks = [], []
    for learned, head, body in turns:
        head, body = np.frombuffer(head, "<u4"), np.frombuffer(body, "<u4")
        segments += [[opens], head, body, [closes], line]
        marks += [0, 0, int(learned), 0, 0]
    sizes = np.array([len(s) for s in segments])
    ends = np.cumsum(sizes)
    step = np.zeros(ends[-1] + 1, np.int64)
    np.add.at(step, ends - sizes, marks)
    np.subtract.at(step, ends, marks)
    return np.concatenate(segments).astype(np.int32), np.cumsum(step[:-1]).astype(bool)


_PART = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("n_turns", pa.int64()), ("ids", pa.list_(pa.int32())), ("loss", pa.list_(pa.bool_()))])


def formatted(rows: DataFrame, ranks: bytes, pattern: str, learned: str = LEARNED) -> DataFrame:
    """(conv_id, part, n_turns, ids, loss): every conversation's turns in order, in parts of whole turns.

    Rows come by turn, nulls first, then by role and the SHA-256 of the text, so ties have one order; rows that repeat stand there as
    often. A null role or text is empty, a null conv_id is a conversation of its own, an empty table has no rows. A part ends with the turn that
    brings it to ``PART`` ids, so no row grows with its conversation; nearly all have part 0 only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, opens, closes = _encoding(ranks, pattern)
        line = np.array(encoding.encode_ordinary("\n"))
        now, part, turns, size, begun = None, 0, [], 0, False
        for b in batches:
            done = []
            for conv, mark, head, body in zip(*[b.column(n).to_pylist() for n in ("conv_id", "learned", "head", "body")]):
                if turns and (conv != now or size >= PART):
                    done.append((now, part, len(turns), *_assembled(turns, opens, closes, line)))
                    part, turns, size = part + 1, [], 0
                if conv != now or not begun:
                    now, part, begun = conv, 0, True
                turns.append((mark, head, body))
                size += (len(head) + len(body)) // 4 + 3
            yield _parts_batch(done)
        if turns:
            yield _parts_batch([(now, part, len(turns), *_assembled(turns, opens, closes, line))])

    placed = encoded_turns(rows, ranks, pattern, learned).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest")
    return placed.mapInArrow(run, "conv_id long, part long, n_turns long, ids array<int>, loss array<boolean>")


def _parts_batch(done: list[tuple]) -> pa.RecordBatch:
    columns = [*zip(*done)] or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _PART)], schema=_PART)


_READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                   ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def turns_of(ids: np.ndarray, ranks: bytes, pattern: str) -> list[tuple[str, str]]:
    """(role, text) of the turns in a row of ids."""
    encoding, opens, closes = _encoding(ranks, pattern)
    found = []
    for i, j in zip(np.flatnonzero(ids == opens), np.flatnonzero(ids == closes)):
        line, _, text = encoding.decode(ids[i + 1:j].tolist()).partition("\n")
        found.append((_role_of(line), unescaped(text)))
    return found


def learned_texts(ids: np.ndarray, loss: np.ndarray, ranks: bytes, pattern: str) -> list[str]:
    """The texts under the mask, each unescaped by itself."""
    encoding = _encoding(ranks, pattern)[0]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], loss.astype(np.int8), [0]])))
    return [unescaped(encoding.decode(ids[i:j].tolist())) for i, j in zip(edges[::2], edges[1::2])]


def read_back(parts: DataFrame, ranks: bytes, pattern: str, arranged: bool = False) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of conversations in parts, from their ids and masks alone.

    ``arranged`` says that the parts of a conversation follow each other in one partition, as ``formatted`` leaves them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = _encoding(ranks, pattern)[0].decode
        now, begun, sums = None, False, None
        for b in batches:
            done = []
            for k, conv in enumerate(b.column("conv_id").to_pylist()):
                if not begun or conv != now:
                    if begun:
                        done.append((now, sums[0], sums[1].hexdigest(), sums[2], sums[3].hexdigest(), sums[4]))
                    now, begun, sums = conv, True, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids = b.column("ids")[k].values.to_numpy()
                loss = b.column("loss")[k].values.to_numpy(zero_copy_only=False)
                for role, text in turns_of(ids, ranks, pattern):
                    sums[0] += 1
                    sums[1].update(f"{role}\n{text}\n".encode())
                for text in learned_texts(ids, loss, ranks, pattern):
                    sums[2] += len(text)
                    sums[3].update(text.encode())
                sums[4] += len(decode(ids.tolist()))
            yield _read_batch(done)
        if begun:
            yield _read_batch([(now, sums[0], sums[1].hexdigest(), sums[2], sums[3].hexdigest(), sums[4])])

    placed = parts if arranged else parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return placed.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _read_batch(done: list[tuple]) -> pa.RecordBatch:
    columns = [*zip(*done)] or [()] * len(_READ)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _READ)], schema=_READ)
