"""BPE encoding and decoding over a table of distinct words.

A word is what stands between white space. Texts are split in chunks of bounded size; a chunk keeps every text as positions among its
distinct words, and these words go by a checksum to the parts of the table. There each distinct word is encoded once, its ids are
joined with the vocabulary's pieces, and ids and pieces go back to the chunks that have the word, where positions put every text in order.
Words travel packed, one row per chunk and part.

This is what the library does to whole texts where nothing it does reaches over white space: normalisers that change single letters and
white space only, and a pattern of words without white space or a look around. Other tokenizers are refused.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sijill.llm.text import released, releasing
from sijill.session import materialise, shared_folder

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core

RARE = 255           # a chunk's words from this rank on take more than a byte in its texts
RANKED = 1 << 16     # a chunk's words that are ranked by how common they are
MADE = 1 << 20       # characters of decoded texts that are Python's before they become Arrow's
CHUNK = 16 << 20     # characters of the texts of a chunk, unless one text is longer
PARTS = (64, 4_096)  # fewest and most parts of the table of words

_LOCAL = {"NFC", "NFD", "Lowercase", "StripAccents"}
_ODD = regex.compile("[\x1c-\x1f]")
_WORD = regex.compile(r"[^\p{White_Space}]+")


@lru_cache(maxsize=2)
def _tokenizer(spec: str) -> Tokenizer:
    t = Tokenizer.from_str(spec)
    t.no_truncation()
    t.no_padding()
    return t


def _steps(parsed: dict | None, kind: str) -> list[dict]:
    return [] if not parsed else parsed[kind] if parsed["type"] == "Sequence" else [parsed]


@lru_cache(maxsize=2)
def checked(spec: str) -> str:
    """The tokenizer's text, if words between white space can be encoded and decoded one by one."""
    parsed = json.loads(spec)
    blanks = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    split = [s for s in _steps(parsed["pre_tokenizer"], "pretokenizers") if s["type"] == "Split"]
    pattern = split[0]["pattern"].get("Regex", "") if len(split) == 1 else ""
    apart = split and split[0]["invert"] and split[0]["behavior"] == "Removed" and not regex.search(r"\(\?|\\[bBAzZG]|[$\t\n ]", pattern)
    added = all(not any((t["lstrip"], t["rstrip"], t["single_word"], t["normalized"])) and _WORD.fullmatch(t["content"])
                for t in parsed.get("added_tokens", []))
    local = all(s["type"] in _LOCAL or s == blanks for s in _steps(parsed["normalizer"], "normalizers"))
    if not (apart and added and local and parsed["decoder"] is None and not parsed["post_processor"]):
        raise ValueError("only tokenizers that treat each word between white space by itself")
    return spec


def words_of(text: str) -> list[str]:
    """What stands between white space as Unicode has it, to which Python adds the separators 0x1C to 0x1F."""
    return _WORD.findall(text) if _ODD.search(text) else text.split()


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece) of a tokenizer file; as many rows as its vocabulary has entries."""
    spec = open(path, encoding="utf-8").read()
    rows = [(i, p) for p, i in _tokenizer(spec).get_vocab(with_added_tokens=True).items()]
    return spark.createDataFrame(rows, "id int, piece string")


class _Places(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word: str) -> int:
        place = self[word] = len(self)
        return place


def _pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _part_of(word: str, parts: int) -> int:
    return zlib.crc32(word.encode()) % parts


def _packed(chunk: int, ids: list, texts: list[np.ndarray], places: _Places, parts: int) -> dict:
    """A chunk: its texts as ranks of words, and its words by part and in order; ``at`` leads from one to the other, as differences.

    The commonest words have the first ranks, all others follow as they stand in the lists.
    """
    flat = np.concatenate(texts) if texts else np.zeros(0, np.uint32)
    lists: list[list[str]] = [[] for _ in range(parts)]
    for word in places:
        lists[_part_of(word, parts)].append(word)
    for words in lists:
        words.sort()
    position = np.empty(len(places), np.int32)
    position[np.fromiter(map(places.__getitem__, chain.from_iterable(lists)), np.int64, len(places))] = np.arange(len(places), dtype=np.int32)
    order = np.argsort(-np.bincount(flat, minlength=len(places)), kind="stable")
    rest = order[RANKED:]
    order = np.concatenate([order[:RANKED], rest[np.argsort(position[rest])]])
    rank = np.empty(len(places), np.uint32)
    rank[order] = np.arange(len(places), dtype=np.uint32)
    flat = rank[flat]
    # A byte per word for the commonest; rarer ones go on in planes of their own. Each plane compresses well.
    rare = flat[flat >= RARE] - np.uint32(RARE)
    planes = {"first": np.minimum(flat, RARE).astype(np.uint8), "low": (rare & 0xFF).astype(np.uint8),
              "mid": (rare >> 8 & 0xFF).astype(np.uint8), "high": (rare >> 16).astype(np.uint16),
              "at": np.diff(position[order], prepend=np.int32(0))}
    return {"chunk": chunk, "doc_ids": ids, "sizes": list(map(len, texts)),
            "words": [_pack("\n".join(x).encode()) if x else None for x in lists], **{k: _pack(v.tobytes()) for k, v in planes.items()}}


_CHUNK = "chunk long, doc_ids array<long>, sizes array<int>, first binary, low binary, mid binary, high binary, at binary, words array<binary>"
_CHUNK_ARROW = pa.schema([("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())),
                          *[(n, pa.binary()) for n in ("first", "low", "mid", "high", "at")], ("words", pa.list_(pa.binary()))])


def chunked(docs: DataFrame, text: str = "text", parts: int = PARTS[0]) -> DataFrame:
    """One row per chunk of texts (see ``_packed``); a null text is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, ids, texts, places, size = TaskContext.get().partitionId() << 32, [], [], _Places(), 0
        pack = lambda: pa.RecordBatch.from_pylist([_packed(n, ids, texts, places, parts)], schema=_CHUNK_ARROW)
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                t = t.as_py() or ""
                words = words_of(t)
                ids.append(i)
                texts.append(np.fromiter(map(places.__getitem__, words), np.uint32, len(words)))
                size += len(t)
                if size >= CHUNK:
                    yield pack()
                    n, ids, texts, places, size = n + 1, [], [], _Places(), 0
                    released()
        if ids:
            yield pack()
        ids, texts, places = [], [], _Places()
        released()

    return docs.select(F.col("doc_id").cast("long"), F.col(text).alias("_text")).mapInArrow(run, _CHUNK)


_NUMBERED = pa.schema([("part", pa.int32()), ("k", pa.int32()), ("ids", pa.list_(pa.int32())), ("chunk", pa.int64()), ("refs", pa.binary())])


def encoded_words(packed: DataFrame, spec: str) -> DataFrame:
    """(part, k, ids, chunk, refs) of lists of words (chunk, part, packed): the table of distinct words, and the lists as numbers in it.

    A word gets a row with its number ``k`` in its part and its ids before the first list that has it, and is encoded only there. A
    list's row has its chunk and ``refs``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, known = None, _Places()
        for b in batches:
            for chunk, part, data in zip(b.column("chunk").to_pylist(), b.column("part").to_pylist(), b.column("packed")):
                if part != current:
                    current, known = part, _Places()
                words, before = _unpack(data.as_py()).decode().split("\n"), len(known)
                new = [w for w in words if w not in known]
                refs = np.fromiter(map(known.__getitem__, words), np.uint32, len(words))
                ids = [e.ids for e in _tokenizer(spec).encode_batch(new, add_special_tokens=False)]
                n = len(new)
                yield pa.RecordBatch.from_arrays([
                    pa.array([part] * (n + 1), pa.int32()), pa.array([*range(before, before + n), None], pa.int32()),
                    pa.array([*ids, None], pa.list_(pa.int32())), pa.array([None] * n + [chunk], pa.int64()),
                    pa.array([None] * n + [_pack(refs.tobytes())], pa.binary())], schema=_NUMBERED)

    rows = packed.select("chunk", "part", "packed").repartition("part").sortWithinPartitions("part", "chunk")
    return rows.mapInArrow(releasing(run), "part int, k int, ids array<int>, chunk long, refs binary")


def spelled_lists(numbered: DataFrame, pieces: DataFrame) -> DataFrame:
    """(of_chunk, part, wide, sizes, ids, spelled): what the words of each list have, in their order.

    Each distinct word's ids are joined with their pieces, a vocabulary and so bounded. Neither that nor the numbering moves rows, so
    a part's words stand before the lists that name them. Ids without a piece are left out of ``spelled``, where a blank stands between two.
    """
    each = numbered.select("part", "k", "chunk", "refs", F.posexplode_outer("ids").alias("pos", "id")).join(F.broadcast(pieces), "id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ids, spelled = None, [], []
        for b in batches:
            out = []
            for part, k, i, piece, chunk, refs in zip(*[b.column(n).to_pylist() for n in ("part", "k", "id", "piece", "chunk", "refs")]):
                if part != current:
                    current, ids, spelled = part, [], []
                if k is None:
                    out.append({"of_chunk": chunk, "part": part, **_list_of(np.frombuffer(_unpack(refs), np.uint32).tolist(), ids, spelled)})
                    continue
                if k == len(ids):
                    ids.append([])
                    spelled.append("")
                elif k != len(ids) - 1:
                    raise ValueError("words of a part are out of order")
                if i is not None:
                    ids[k].append(i)
                if piece:
                    spelled[k] = f"{spelled[k]} {piece}" if spelled[k] else piece
            yield pa.RecordBatch.from_pylist(out, schema=_RETURNED)

    return each.select("part", "k", "id", "piece", "chunk", "refs").mapInArrow(
        releasing(run), "of_chunk long, part int, wide int, sizes binary, ids binary, spelled binary")


def _list_of(refs: list[int], ids: list[list[int]], spelled: list[str]) -> dict:
    found = [ids[r] for r in refs]
    flat = np.fromiter(chain.from_iterable(found), np.uint32)
    small = flat.astype("<u2") if not len(flat) or flat.max() < 1 << 16 else flat
    return {"wide": small.itemsize, "sizes": _pack(np.array([len(x) for x in found], "<u4").tobytes()), "ids": _pack(small.tobytes()),
            "spelled": _pack("\n".join([spelled[r] for r in refs]).encode())}


_RETURNED = pa.schema([("of_chunk", pa.int64()), ("part", pa.int32()), ("wide", pa.int32()), ("sizes", pa.binary()), ("ids", pa.binary()),
                       ("spelled", pa.binary())])


def _texts_of(chunk: dict, lists: pa.Table) -> Iterator[tuple[int | None, np.ndarray, str]]:
    """(doc_id, ids, pieces with a blank between two) of the chunk's texts, from what has come back for its words."""
    ranks, low, mid, high = (np.frombuffer(_unpack(chunk[k]), kind).astype(np.uint32)
                             for k, kind in (("first", np.uint8), ("low", np.uint8), ("mid", np.uint8), ("high", np.uint16)))
    ranks[ranks == RARE] = (low | mid << 8 | high << 16) + np.uint32(RARE)
    del low, mid, high
    at = np.cumsum(np.frombuffer(_unpack(chunk["at"]), np.int32))
    sizes, ids, spelled = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], []
    for k in np.argsort(lists.column("part").to_numpy()).tolist():
        get = lambda n: lists.column(n)[k].as_py()  # noqa: E731, B023
        sizes.append(np.frombuffer(_unpack(get("sizes")), "<u4").astype(np.int64))
        ids.append(np.frombuffer(_unpack(get("ids")), f"<u{get('wide')}").astype("<i4"))
        spelled += _unpack(get("spelled")).decode().split("\n")
    sizes, ids = np.concatenate(sizes), np.concatenate(ids)
    starts, sizes, spelled = (np.cumsum(sizes) - sizes)[at], sizes[at], [spelled[i] for i in at.tolist()]
    begin = 0
    for i, n in zip(chunk["doc_ids"], chunk["sizes"]):
        words = ranks[begin:begin + n]
        begin += n
        lengths = sizes[words]
        # Where each word's ids start, less the ids before it, plus a running number.
        places = np.repeat(starts[words] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        yield i, ids[places], " ".join([x for x in map(spelled.__getitem__, words.tolist()) if x])


def _finished(docs: DataFrame, path: str, text: str, row: Callable[[int | None, np.ndarray, str], tuple], schema: pa.Schema, kinds: str) -> DataFrame:
    """``row`` of every text's id, ids and decoded text. Written, so that nothing of the way there stays in the catalog.

    Chunks are written in buckets, as their texts need not move again when words come back.
    """
    spark, spec = docs.sparkSession, checked(open(path, encoding="utf-8").read())
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = min(max(2 * partitions, PARTS[0]), PARTS[1])
    name = f"chunk_{uuid.uuid4().hex}"
    (chunked(docs, text, parts).write.format("parquet").bucketBy(partitions, "chunk")
     .option("path", os.path.join(shared_folder(spark), name)).saveAsTable(name))
    try:
        chunks = spark.table(name)
        packed = chunks.select("chunk", F.posexplode("words").alias("part", "packed")).where("packed is not null")
        back = spelled_lists(encoded_words(packed, spec), vocabulary(spark, path))

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            made: list[pa.RecordBatch] = []
            columns: list[list] = [[] for _ in schema]
            size = 0

            def pack() -> None:
                made.append(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema))
                for c in columns:
                    c.clear()

            for chunk in left.to_pylist():
                for found in _texts_of(chunk, right):
                    for column, value in zip(columns, row(*found)):
                        column.append(value)
                    size += len(found[2])
                    if size >= MADE:
                        pack()
                        size = 0
            pack()
            released()
            return pa.Table.from_batches(made, schema=schema)

        return materialise(chunks.drop("words").groupBy("chunk").cogroup(back.groupBy("of_chunk")).applyInArrow(run, kinds), "coded")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(doc_id, ids) of every row; a null or empty text has no ids. Rows that repeat are encoded each for itself.

    Special tokens that stand in a text are found as the library does; none are added.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    return _finished(docs, path, text, lambda i, ids, _: (i, ids), schema, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, pieces: DataFrame, id_column: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(id_column, text): pieces of the ids, a blank between two; ids without a piece are left out.

    Rows are numbered by a hash of id and ids, so rows that repeat must agree. ``pieces`` is a vocabulary, which is bounded.
    """
    rows = encoded.select(id_column, F.coalesce(ids, F.array().cast("array<int>")).alias("ids"))
    key = F.xxhash64("ids")
    spread = rows.select(id_column, key.alias("_key"), F.posexplode("ids").alias("pos", "id"))
    found = spread.join(F.broadcast(pieces), "id")
    texts = found.groupBy(id_column, "_key").agg(F.array_sort(F.collect_set(F.struct("pos", "piece"))).alias("found"))
    joined = F.array_join(F.transform("found", lambda x: x["piece"]), " ")
    one = rows.withColumn("_key", key).alias("r").join(
        texts.alias("t"), F.col(f"r.{id_column}").eqNullSafe(F.col(f"t.{id_column}")) & (F.col("r._key") == F.col("t._key")), "left")
    return one.select(f"r.{id_column}", F.coalesce(joined, F.lit("")).alias("text"))


def coded(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) of every row: its ids as ``encode`` gives them, and the text that they decode to."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
    return _finished(docs, path, text, lambda *found: found, schema, "doc_id long, ids array<int>, decoded string")


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: encoded, and decoded again."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def row(i: int | None, ids: np.ndarray, text: str) -> tuple:
        return i, len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    return _finished(docs, path, text, row, schema, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
