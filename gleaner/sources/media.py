"""Features of pictures and videos: perceptual hashes, brightness, frames and blank frames."""

from __future__ import annotations

import os
import subprocess

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions.video import frame_timestamps
from ..storage import materialise
from .files import _by_path, image_header

#: A picture has no more pixels than this; larger ones are not hashed.
MOST_PIXELS = 100_000_000
#: Frames darker or more even than this say nothing.
DARK, EVEN = 18, 8


def perceptual_hash(grey: np.ndarray) -> int:
    """64 bits of the low cosine frequencies of a 64 x 64 grey picture over their median; the first is the highest."""
    n = grey.shape[0]
    k = np.arange(n)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))
    low = (basis[:8] @ grey @ basis[:8].T).ravel()
    bits = low > np.median(low)
    return int("".join("1" if b else "0" for b in bits), 2)


def luma(grey: np.ndarray) -> tuple[float, float]:
    """Mean and spread of a grey picture, of which long sides are sampled at some 200 places."""
    ys, xs = (max(1, s // 200) if s > 200 else 1 for s in grey.shape)
    some = grey[::ys, ::xs]
    return (float(some.mean()), float(some.std())) if some.size else (0.0, 0.0)


def blank(grey: np.ndarray) -> bool:
    """Too dark or too even to compare."""
    mean, spread = luma(grey)
    return mean < DARK or spread < EVEN


def shrunk(grey: np.ndarray) -> np.ndarray:
    """64 x 64, bilinear between corners."""
    h, w = grey.shape
    ys, xs = (np.linspace(0, s - 1, 64) for s in (h, w))
    y0, x0 = ys.astype(int), xs.astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (ys - y0)[:, None], (xs - x0)[None, :]
    return (grey[np.ix_(y0, x0)] * (1 - fx) + grey[np.ix_(y0, x1)] * fx) * (1 - fy) + (grey[np.ix_(y1, x0)] * (1 - fx) + grey[np.ix_(y1, x1)] * fx) * fy


def hash_of(grey: np.ndarray) -> int:
    """The perceptual hash as a signed long."""
    value = perceptual_hash(shrunk(grey))
    return value - (1 << 64) if value >= 1 << 63 else value


def grey_of(data: bytes, height: int, width: int, channels: int, blue_first: bool = True) -> np.ndarray:
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(float)
    weights = np.array([0.114, 0.587, 0.299] if blue_first else [0.299, 0.587, 0.114])
    return a[:, :, 0] if channels < 3 else a[:, :, :3] @ weights


def hash_images(images: DataFrame) -> DataFrame:
    """(path, width, height, phash, mean_luma, is_blank) of Spark's image source; no hash where it can't be decoded or is too large."""

    def run(batches):
        for b in batches:
            rows = []
            for x in b["image"].to_pylist():
                w, h, c = x["width"], x["height"], x["nChannels"]
                if w > 0 and h > 0 and w * h <= MOST_PIXELS:
                    grey = grey_of(x["data"], h, w, c)
                    rows.append((x["origin"], w, h, hash_of(grey), luma(grey)[0], blank(grey)))
                else:
                    rows.append((x["origin"], w, h, None, None, None))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, kinds, strict=True)], ["path", "width", "height", "phash", "mean_luma", "is_blank"])

    return images.select("image").mapInArrow(run, "path string, width long, height long, phash long, mean_luma double, is_blank boolean")


def image_facts(spark: SparkSession, files: DataFrame, roots: list[str]) -> DataFrame:
    """files (file_id, path, size_bytes) with width, height, format_name, phash and message.

    Sizes come from the true headers; hashes from Spark's image source. A picture
    without a header that is known, or whose type can be hashed but which can't be
    decoded, has a message; of types that can't be hashed only the header counts.
    """
    def read(path, size):
        try:
            with open(path, "rb") as f:
                found = image_header(f.read(1 << 18))
            return (*found, None) if found else (None, None, None, "no picture header that is known")
        except OSError as e:
            return None, None, None, str(e)

    heads = _by_path(files.select("file_id", "path", "size_bytes"), "width long, height long, format_name string, message string", read)
    kinds = [e for e in config.IMAGE_EXTENSIONS if e not in config.NO_PHASH]
    glob = "*{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in kinds) + "}"
    there = [r for r in map(os.path.expanduser, roots) if os.path.exists(r)]
    if not there:
        return heads.withColumn("phash", F.lit(None).cast("long")).select("file_id", "path", "size_bytes", "width", "height", "format_name", "phash", "message")
    pictures = spark.read.format("image").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(there)
    hashed = hash_images(pictures).select(F.expr("url_decode(regexp_replace(regexp_replace(path, '^file:/*', '/'), '[+]', '%2B'))").alias("path"), "phash")
    can = F.col("format_name").isNotNull() & F.lower(F.regexp_extract("path", r"(\.[^.]*)$", 1)).isin(*kinds) & F.col("phash").isNull()
    met = heads.join(hashed.dropDuplicates(["path"]), "path", "left").withColumn("message", F.coalesce("message", F.when(can, "the picture can't be decoded")))
    return met.select("file_id", "path", "size_bytes", "width", "height", "format_name", "phash", "message")


def extract_frames(videos: DataFrame, frames: int, ffmpeg: str = "ffmpeg", seconds: int = 60) -> DataFrame:
    """(path, idx, ts_ms, width, height, data binary, message) of videos (path, duration_ms, width, height).

    A row for each moment of frame_timestamps(). Where a video has no frame, data is
    null; where ffmpeg fails, message says so and the video's later moments are left
    out. Pixels are red, green, blue.
    """
    moments = videos.where("duration_ms > 0 AND width > 0 AND height > 0").select("path", "width", "height", frame_timestamps("duration_ms", frames).alias("ts"))

    def run(batches):
        for b in batches:
            out = []
            for path, w, h, moments in zip(b["path"].to_pylist(), b["width"].to_pylist(), b["height"].to_pylist(), b["ts"].to_pylist(), strict=True):
                for k, t in enumerate(moments):
                    call = [ffmpeg, "-v", "error", "-ss", f"{t / 1000:.3f}", "-i", path, "-frames:v", "1", "-f", "rawvideo", "-pix_fmt", "rgb24", "pipe:1"]
                    try:
                        done = subprocess.run(call, capture_output=True, timeout=seconds, check=False)
                        why = done.stderr.decode("utf-8", "replace").strip()[-300:] or f"exit {done.returncode}" if done.returncode else None
                        data = done.stdout if not why and len(done.stdout) == 3 * w * h else None
                    except (OSError, subprocess.TimeoutExpired) as e:
                        data, why = None, str(e)
                    out.append((path, k, t, w, h, data, why))
                    if why:
                        break
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, kinds, strict=True)], ["path", "idx", "ts_ms", "width", "height", "data", "message"])

    return moments.mapInArrow(run, "path string, idx int, ts_ms long, width long, height long, data binary, message string")


def hash_frames(frames: DataFrame) -> DataFrame:
    """(path, idx, ts_ms, hash) of frames with data, without blank ones; indices keep their gaps."""

    def run(batches):
        for b in batches:
            rows = []
            for path, k, t, w, h, data in zip(*(b[c].to_pylist() for c in ("path", "idx", "ts_ms", "width", "height", "data")), strict=True):
                grey = grey_of(data, h, w, len(data) // (w * h), blue_first=False)
                if not blank(grey):
                    rows.append((path, k, t, hash_of(grey)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["path", "idx", "ts_ms", "hash"])

    return frames.where("data IS NOT NULL AND message IS NULL").select("path", "idx", "ts_ms", "width", "height", "data").mapInArrow(run, "path string, idx int, ts_ms long, hash long")


def frame_sequences(hashes: DataFrame) -> DataFrame:
    """(path, frames array<struct<idx, ts_ms, hash>>), at most as many as were asked for of each video."""
    return hashes.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("idx", "ts_ms", "hash"))).alias("frames"))


def video_facts(videos: DataFrame, frames: int, ffmpeg: str = "ffmpeg") -> DataFrame:
    """videos with `frames`; those of which no frame can be used, or ffmpeg fails, have none and are left out."""
    taken = materialise(extract_frames(videos, frames, ffmpeg), "frames")
    failed = taken.where("message IS NOT NULL").select("path").distinct()
    return videos.join(frame_sequences(hash_frames(taken)), "path").join(failed, "path", "left_anti")
