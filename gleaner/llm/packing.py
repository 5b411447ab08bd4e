"""Best-fit packing planned on the length histogram.

Only the counts of the lengths (at most `capacity` of them) reach the driver.
Best-fit decreasing runs over counts: all sequences with one history are a range
of sequence numbers, and a length fills whole ranges at a time. The plan lists,
for each length, which ranks go to which range at which offset; each piece finds
its slot by joining on its rank within its length. Ranks are given by salted
groups, so that a length that a third of the rows share is numbered in parallel.
"""

from __future__ import annotations

import functools
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise, partitions, table
from .common import lean

CAPACITY = 1024
END_ID = 2
#: A worker's memo of words is dropped at this size; it changes no result.
MEMO_WORDS = 400_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Token ids of a byte-level BPE vocabulary file, as little-endian uint32 bytes.

    Between two characters that are no white space, a single space begins a new
    pre-token, so what lies between such spaces is encoded by itself and memoised.
    Texts in which white space meets a space are encoded whole. The file's added
    tokens are cut out of a text first, as the tokenizer does, and become their ids.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        vocab = held["model"]["vocab"]
        self.added = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in held["added_tokens"]}
        self.cutter = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        plain = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
        ranks = {bytes(plain[c] for c in token): i for token, i in vocab.items() if token not in self.added}
        self.core = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.memo: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return self.core.encode_to_numpy(text).astype("<u4").tobytes() if text else b""

    def __call__(self, text: str) -> bytes:
        if any(t in text for t in self.added):
            return b"".join(self.added.get(x) or self.plain(x) for x in self.cutter.split(text))
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        """The ids of a text in which added tokens, if any, are ordinary text."""
        words = text.split(" ")
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        try:
            found = [memo[w] for w in words[1:]]
        except KeyError:
            encode = self.core.encode_ordinary
            for w in words[1:]:
                if w not in memo:
                    memo[w] = None if not w or w[0].isspace() or w[-1].isspace() else np.array(encode(" " + w), "<u4").tobytes()
            found = [memo[w] for w in words[1:]]
        head = words[0]
        if None in found or not head or head[-1].isspace():
            return self.whole(text)
        return self.whole(head) + b"".join(found)


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be short."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return ([(0, head)] if head else []) + [(s, capacity) for s in range(head, n, capacity)]


def tokenised(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row per piece; with keep_ids also its ids."""
    path = tokenizer or default_tokenizer()
    schema = PIECES + (", ids array<int>" if keep_ids else "")

    def run(batches):
        code = encoder(path)
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            cols = [[] for _ in range(6 if keep_ids else 5)]
            for i, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                raw = memoryview(code(text or "") + end)
                for k, (s, n) in enumerate(cut(len(raw) // 4, capacity)):
                    own = raw[4 * s : 4 * (s + n)]
                    for c, v in zip(cols, (i, k, s, n, zlib.crc32(own), np.frombuffer(own, "<u4").astype(np.int32) if keep_ids else None), strict=False):
                        c.append(v)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=False)], [x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), schema)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Rows (length, rank_from, rank_to, first_sequence, per_sequence, offset): rank
    r goes to sequence first_sequence + (r - rank_from) // per_sequence, at offset
    + length * ((r - rank_from) % per_sequence). Their number is bounded by the
    capacity and doesn't grow with the counts.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    rows, made = [], 0
    for length in sorted((n for n in histogram if histogram[n]), reverse=True):
        left, rank = histogram[length], 0
        for space in range(length, capacity):
            while left and room.get(space):
                first, count = room[space].pop()
                per = space // length
                use = min(count, -(-left // per))
                full, rest = divmod(left, per) if use * per > left else (use, 0)
                for begin, n, each in ((first, full, per), (first + full, 1 if rest else 0, rest)):
                    if n:
                        rows.append((length, rank, rank + n * each, begin, each, capacity - space))
                        rank, left = rank + n * each, left - n * each
                        room.setdefault(space - each * length, []).append((begin, n))
                if use < count:
                    room[space].append((first + use, count - use))
        per = capacity // length
        full, rest = divmod(left, per)
        for n, each in ((full, per), (1 if rest else 0, rest)):
            if n:
                rows.append((length, rank, rank + n * each, made, each, 0))
                rank, left = rank + n * each, left - n * each
                room.setdefault(capacity - each * length, []).append((made, n))
                made += n
    return rows


def best_fit(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset; pieces needs doc_id, piece and length, 1 <= length <= capacity.

    Read twice: give a table, not a costly plan. Rows that equal each other in
    doc_id and piece each get a slot of their own.
    """
    spark = pieces.sparkSession
    parts = partitions(spark)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(4 * parts)).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = counts.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).select(F.col("length").alias("l"), F.col("salt").alias("s"), F.coalesce("base", F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = spark.createDataFrame(plan(histogram, capacity), "l long, rank_from long, rank_to long, first_sequence long, per_sequence long, at long")
    ranked = salted.withColumn("own", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")))
    ranked = ranked.join(before, (F.col("length") == F.col("l")) & (F.col("salt") == F.col("s"))).withColumn("rank", F.col("base") + F.col("own") - 1).drop("l", "s", "base", "own", "salt")
    placed = ranked.join(F.broadcast(slots), (F.col("length") == F.col("l")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    step = F.col("rank") - F.col("rank_from")
    return placed.withColumn("sequence_id", F.col("first_sequence") + F.floor(step / F.col("per_sequence"))).withColumn("offset", F.col("at") + F.col("length") * (step % F.col("per_sequence"))).select(*pieces.columns, "sequence_id", "offset")


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """Pack whole documents into sequences of at most `capacity` ids.

    A null or empty text is a piece that holds only the end id. Longer documents
    are cut into pieces of `capacity`, of which the first may be shorter; nothing
    is dropped or padded. Repeated rows and null doc_ids are packed like any row;
    an empty table gives none. Columns besides doc_id and text are ignored.
    """
    return best_fit(materialise(tokenised(docs, capacity, tokenizer, end_id, keep_ids), "pieces"), capacity)


def op1(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), keep_ids=False).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
