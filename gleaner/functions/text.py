"""Text facts: normal form, bottom-k sketch of 5-grams and MinHash bands, in Arrow batches."""

from __future__ import annotations

import hashlib
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config

# The sketch's hashes must agree on these.
FNV_START, FNV_PRIME = np.uint64(14695981039346656037), np.uint64(1099511628211)
GOLDEN = 0x9E3779B97F4A7C15
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

SPACES = re.compile("[\t-\r \x85\xa0  -     　]+")
SIGN = np.uint64(1 << 63)
FACTS = {"file_id": "long", "path": "string", "size_bytes": "long", "name": "string", "length": "int", "features": "array<long>", "profile": "array<int>", "bands": "array<struct<r0:long,r1:long>>"}
#: What pairs need of a sketch besides: its size, its profile in few bytes, and a digest that equal sketches share.
COMPACT = {"n_features": "int", "packed": "binary", "mark": "binary"}
#: A profile counts the features by their last bits; two sketches share no more than the sum of the lesser counts.
PROFILE = 256


def lower(text: str) -> str:
    """Each character by itself, so that lengths stay: no final sigma, and a dotted capital I becomes i."""
    if text.isascii():
        return text.lower()
    low = text.lower()
    return low if len(low) == len(text) and "Σ" not in text else "".join(c.lower()[0] for c in text)


def normal_form(text: str) -> str:
    text = unicodedata.normalize("NFKC", text).replace("﻿", "").replace("​", "")
    return lower(SPACES.sub(" ", text).strip(" "))


def name_key(path: str) -> str:
    base = path.rsplit("/", 1)[-1]
    base = base[: base.rfind(".")] if "." in base else base
    kept = [c if c.isalpha() or c.isdecimal() else " " for c in unicodedata.normalize("NFKC", lower(base))]
    return " ".join("".join(kept).split())


def sketch(normal: str, size: int = config.SKETCH) -> np.ndarray:
    """The least `size` distinct hashes of the 5-grams of code points, ascending and unsigned."""
    points = np.frombuffer(normal.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    n = len(points) - config.GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, FNV_START, np.uint64)
    for k in range(config.GRAM):
        h = (h ^ points[k : k + n]) * FNV_PRIME
    return np.unique(h)[:size]


def minhash(features: np.ndarray) -> np.ndarray:
    """16 least values of as many mixes of the features."""
    shift = np.array([k * GOLDEN % 2**64 for k in range(config.BANDS * config.ROWS)], np.uint64)
    x = features[:, None] + shift
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return (x ^ (x >> np.uint64(31))).min(axis=0)


def encode_features(features: np.ndarray) -> bytes:
    """Unsigned 64-bit values as little-endian bytes, the form of stores without arrays."""
    return np.ascontiguousarray(features, "<u8").tobytes()


def decode_features(blob: bytes) -> np.ndarray:
    if len(blob) % 8:
        raise ValueError(f"{len(blob)} bytes are no whole number of features")
    return np.frombuffer(blob, "<u8").astype(np.uint64)


def packed(features: np.ndarray) -> bytes:
    """The profile of some features in few bytes: two counts in one, a byte each, or two bytes each, as the greatest asks for."""
    counts = np.bincount((features % np.uint64(PROFILE)).astype(np.int64), minlength=PROFILE)
    top = counts.max()
    if top < 16:
        return (counts[0::2] | counts[1::2] << 4).astype(np.uint8).tobytes()
    return counts.astype(np.uint8 if top < 256 else "<u2").tobytes()


def unpacked(blobs: list[bytes]) -> np.ndarray:
    """Rows of PROFILE counts from packed() profiles; nothing stands for none."""
    out = np.zeros((len(blobs), PROFILE), np.uint8 if all(len(x) <= PROFILE for x in blobs) else np.uint16)
    sizes = np.array([len(x) for x in blobs])
    half = np.nonzero(sizes == PROFILE // 2)[0]
    if len(half):
        two = np.frombuffer(b"".join(blobs[k] for k in half), np.uint8).reshape(len(half), -1)
        out[half, 0::2], out[half, 1::2] = two & 15, two >> 4
    for k in np.nonzero(sizes >= PROFILE)[0]:
        out[k] = np.frombuffer(blobs[k], np.uint8 if sizes[k] == PROFILE else "<u2")
    return out


#: Rows that a worker of text_facts() holds as sketches at a time.
AT_ONCE = 128


def _lists(parts: list[np.ndarray], values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(x) for x in parts)]), pa.int32()), values)


def text_facts(files: DataFrame, columns: tuple[str, ...] = tuple(FACTS)) -> DataFrame:
    """Facts of files (file_id, path, size_bytes, content string): `columns`, of FACTS and COMPACT; files need what these are made of.

    features are longs whose signed order is the hashes' unsigned order; texts of
    fewer than five code points, and null ones, have none, and no bands. profile has
    PROFILE counts, or none without features. Of a batch, AT_ONCE rows at a time
    become sketches, so a worker's memory doesn't grow with the batch.
    """
    kinds = FACTS | COMPACT
    flat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, AT_ONCE):
                b = whole.slice(lo, AT_ONCE)
                normals = [normal_form(text or "") for text in b["content"].to_pylist()]
                sketches = [sketch(x) for x in normals]
                out = {c: b[c] for c in ("file_id", "path", "size_bytes") if c in columns}
                if "name" in columns:
                    out["name"] = pa.array([name_key(path or "") for path in b["path"].to_pylist()], pa.string())
                if "length" in columns:
                    out["length"] = pa.array([len(x.encode("utf-8", "replace")) for x in normals], pa.int32())
                if "features" in columns:
                    out["features"] = _lists(sketches, pa.array((flat(sketches, np.uint64) ^ SIGN).view(np.int64)))
                if "profile" in columns:
                    counts = [np.bincount((f % np.uint64(PROFILE)).astype(np.int64), minlength=PROFILE).astype(np.int32) if len(f) else f.astype(np.int32) for f in sketches]
                    out["profile"] = _lists(counts, pa.array(flat(counts, np.int32)))
                if "bands" in columns:
                    least = [minhash(f).view(np.int64) if len(f) else f.view(np.int64) for f in sketches]
                    both = flat(least, np.int64)
                    out["bands"] = _lists([x[::2] for x in least], pa.StructArray.from_arrays([pa.array(both[0::2]), pa.array(both[1::2])], ["r0", "r1"]))
                if "n_features" in columns:
                    out["n_features"] = pa.array([len(f) for f in sketches], pa.int32())
                if "packed" in columns:
                    out["packed"] = pa.array([packed(f) if len(f) else b"" for f in sketches], pa.binary())
                if "mark" in columns:
                    out["mark"] = pa.array([hashlib.sha256(f.tobytes()).digest() for f in sketches], pa.binary())
                yield pa.RecordBatch.from_arrays([out[c] for c in columns], list(columns))

    own = {"file_id": F.col("file_id").cast("long"), "path": F.col("path"), "size_bytes": F.col("size_bytes").cast("long"), "content": F.col("content").cast("string")}
    read = [c for c in own if c == "content" or c in columns or c == "path" and "name" in columns]
    return files.select(*(own[c].alias(c) for c in read)).mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in columns))
