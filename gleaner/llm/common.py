"""Helpers that several operators share: blocks of documents and blobs of arrays."""

from __future__ import annotations

import ctypes
import pickle
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FLUSH_BYTES, HELD_BYTES = 4 << 20, 48 << 20


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release_memory() -> None:
    """Give back to the system what this Python worker no longer uses; workers live on and serve other tasks."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def lean(run):
    """A function for mapInArrow() that gives its memory back as a task ends."""

    def and_release(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()

    return and_release


def put_arrays(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays as one compressed blob; get_arrays() reads them back."""
    head = [struct.pack("<B", len(arrays))]
    body = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        raw = zstandard.ZstdCompressor(level=level).compress(a.tobytes())
        head.append(struct.pack("<4sQQ", a.dtype.str[1:].encode(), len(a), len(raw)))
        body.append(raw)
    return b"".join(head + body)


def get_arrays(blob: bytes) -> list[np.ndarray]:
    view, at, out = memoryview(blob), 1, []
    heads = []
    for _ in range(view[0]):
        heads.append(struct.unpack_from("<4sQQ", view, at))
        at += struct.calcsize("<4sQQ")
    for kind, n, size in heads:
        raw = zstandard.ZstdDecompressor().decompress(view[at : at + size], max_output_size=max(1, n * int(kind.rstrip(b"\0")[1:])))
        out.append(np.frombuffer(raw, dtype=kind.rstrip(b"\0").decode(), count=n))
        at += size
    return out


def put_strings(values: list[bytes], level: int = 1) -> bytes:
    lengths = np.fromiter(map(len, values), dtype=np.uint32, count=len(values))
    return put_arrays(lengths, np.frombuffer(b"".join(values), dtype=np.uint8), level=level)


def get_strings(blob: bytes) -> list[bytes]:
    lengths, data = get_arrays(blob)
    raw = data.tobytes()
    ends = np.cumsum(lengths, dtype=np.int64)
    return [raw[e - n : e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(words: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """A text whose words are parted by spaces, in slices of about this size that cut no word."""
    lo = 0
    while lo < len(words):
        hi = words.find(b" ", lo + size)
        hi = len(words) if hi < 0 else hi
        yield words[lo:hi]
        lo = hi


def document_blocks(docs: DataFrame, parts: int, others: tuple[str, ...] = ()) -> DataFrame:
    """(d, ids, texts, rest): documents dealt into `parts` by doc_id, many to a row.

    ids is a blob of (doc_id, is_null), texts one of UTF-8 texts, and rest one of
    the row's values in the columns `others`. Rows of one doc_id share a part. A
    task holds at most FLUSH_BYTES for a part, and HELD_BYTES for all.
    """

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        total = 0

        def flush(d: int) -> pa.RecordBatch:
            nonlocal total
            ids, nulls, texts, size, rest = held.pop(d)
            total -= size
            return pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([put_arrays(np.array(ids, np.int64), np.array(nulls, np.uint8))], pa.binary()), pa.array([put_strings(texts, level=3)], pa.binary()), pa.array([put_strings(rest)], pa.binary())], ["d", "ids", "texts", "rest"])

        for batch in batches:
            more = list(zip(*(batch[c].to_pylist() for c in others), strict=True)) if others else [()] * batch.num_rows
            for d, i, t, o in zip(batch["d"].to_pylist(), batch["doc_id"].to_pylist(), utf8(batch["text"]), more, strict=True):
                x = held.setdefault(d, [[], [], [], 0, []])
                more_of = pickle.dumps(o) if others else b""
                x[4].append(more_of)
                x[0].append(i if i is not None else 0)
                x[1].append(i is None)
                x[2].append(t)
                x[3] += (size := len(t) + len(more_of) + 150)
                total += size
                if x[3] >= FLUSH_BYTES:
                    yield flush(d)
                elif total >= HELD_BYTES:
                    for one in list(held):
                        yield flush(one)
        for d in list(held):
            yield flush(d)

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int").alias("d"), *others)
    return dealt.mapInArrow(lean(pack), "d int, ids binary, texts binary, rest binary")


def read_blocks(blocks: pa.Table) -> tuple[np.ndarray, np.ndarray, list[bytes], list[bytes]]:
    """(doc_id, is_null, texts, rest) of the blocks of a part, sorted by (null first, doc_id, text)."""
    numbers, nulls, words, rest = [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)], [], []
    for i, t, o in zip(blocks["ids"].to_pylist(), blocks["texts"].to_pylist(), blocks["rest"].to_pylist(), strict=True):
        a, b = get_arrays(i)
        numbers.append(a)
        nulls.append(b)
        words += get_strings(t)
        rest += get_strings(o)
    n, z = np.concatenate(numbers), np.concatenate(nulls)
    order = sorted(range(len(words)), key=lambda k: (1 - z[k], n[k], words[k], rest[k]))
    return n[order], z[order], [words[k] for k in order], [rest[k] for k in order]


def id_array(numbers: np.ndarray, nulls: np.ndarray) -> pa.Array:
    return pa.array(numbers, pa.int64(), mask=nulls.astype(bool))
