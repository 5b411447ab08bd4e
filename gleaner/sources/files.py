"""File discovery and decoding: listings, text with its encodings, image headers and perceptual hashes.

Listings are made on the driver, which alone can prune folders while it walks, and
keep names that begin with a dot or an underscore, which Spark's own file index
drops; they go to tables batch by batch. Contents are read where they are needed,
by path, on the executors, which must see the folders.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions.scalar import extension, media_type
from ..operators.ordering import ordered
from ..storage import materialise

LISTING = "path string, size_bytes long, mtime_ns long, inode long, device long"


def walk(roots: list[str], recursive: bool = True, on_error=None):
    """(path, size, mtime_ns, inode, device), each real file once. Hidden and skipped folders and links to folders are passed over."""
    seen = set()

    def one(path):
        real = os.path.realpath(path)
        if real in seen:
            return
        seen.add(real)
        try:
            s = os.stat(real)
        except OSError as e:
            if on_error:
                on_error(path, e)
            return
        yield path, s.st_size, s.st_mtime_ns, s.st_ino, s.st_dev % (1 << 63)

    def into(folder):
        try:
            found = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError as e:
            if on_error:
                on_error(folder, e)
            return
        for e in found:
            if e.is_dir(follow_symlinks=False):
                if recursive and not e.name.startswith(".") and e.name not in config.SKIPPED_FOLDERS:
                    yield from into(e.path)
            elif e.is_file():
                yield from one(e.path)

    for root in map(os.path.expanduser, roots):
        if os.path.isdir(root):
            yield from into(root)
        elif os.path.exists(root):
            yield from one(root)
        elif on_error:
            on_error(root, FileNotFoundError(root))


def discover(spark: SparkSession, roots: list[str], recursive: bool = True, on_error=None, batch: int = 100_000) -> DataFrame:
    """(file_id, path, media_type, extension, size_bytes, mtime_ns, inode, device) of known media; ids follow the (folder, path) order.

    The walk hands over `batch` files at a time, as tables; the order is Spark's.
    """
    known = set(config.IMAGE_EXTENSIONS + config.VIDEO_EXTENSIONS + config.TEXT_EXTENSIONS)
    listed = (r for r in walk(roots, recursive, on_error) if os.path.splitext(r[0])[1].lower() in known)
    found = None
    while rows := list(itertools.islice(listed, batch)):
        part = spark.createDataFrame(rows, LISTING)
        part = part if len(rows) < batch and found is None else materialise(part, "listing")
        found = part if found is None else found.unionByName(part)
    found = spark.createDataFrame([], LISTING) if found is None else found
    folder = F.regexp_replace("path", "/[^/]*$", "")
    numbered = ordered(found.withColumn("folder", folder), [], [F.col("folder"), F.col("path")])
    numbered = numbered.select(F.col("k").cast("long").alias("file_id"), *found.columns)
    return numbered.withColumn("media_type", media_type("path")).withColumn("extension", extension("path"))


def _by_path(files: DataFrame, columns: str, read) -> DataFrame:
    """files with columns that `read` makes of each path, where a task finds it."""
    made = [c.split()[0] for c in columns.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64()}
    kept = files.drop(*made)
    names = kept.columns

    def run(batches):
        for b in batches:
            out = [read(*x) for x in zip(b["path"].to_pylist(), b["size_bytes"].to_pylist(), strict=True)]
            arrays = [pa.array([o[k] for o in out], kinds[c.split()[1]]) for k, c in enumerate(columns.split(", "))]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names), *arrays], [*names, *made])

    return kept.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields) + ", " + columns)


def file_digests(files: DataFrame, kind: str, segment: int) -> DataFrame:
    """files with `digest` of the file at `path`, read in pieces; null where it can't be read. See exact.tiered_members()."""

    def read(path, size):
        h = hashlib.sha256()
        try:
            with open(path, "rb") as f:
                if kind != "sampled":
                    while piece := f.read(1 << 20):
                        h.update(piece)
                    return (h.hexdigest(),)
                h.update(struct.pack("<q", size))
                if size <= 3 * segment:
                    h.update(f.read())
                else:
                    for at in (0, (size - segment) // 2, size - segment):
                        f.seek(at)
                        h.update(struct.pack("<q", at) + f.read(segment))
                return (h.hexdigest(),)
        except OSError:
            return (None,)

    return _by_path(files, "digest string", read)


def file_texts(files: DataFrame) -> DataFrame:
    """files with `content`, the decoded text of the file at `path`; null where it can't be read."""

    def read(path, size):
        try:
            with open(path, "rb") as f:
                return (decode(f.read()),)
        except OSError:
            return (None,)

    return _by_path(files, "content string", read)


def unreadable(files: DataFrame) -> DataFrame:
    """(file_id, path, message) of files that can't be opened."""

    def read(path, size):
        try:
            with open(path, "rb"):
                return (None,)
        except OSError as e:
            return (str(e),)

    return _by_path(files.select("file_id", "path", "size_bytes"), "message string", read).where("message IS NOT NULL").drop("size_bytes")


def read_contents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, content binary) through Spark's binary reader, for stores that only Spark reads."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select(F.regexp_replace("path", "^file:", "").alias("path"), "content")


def decode(content: bytes | None) -> str:
    """Text by its byte order mark; else UTF-8, or GB18030 where it isn't valid UTF-8."""
    if not content:
        return ""
    for mark, name in ((b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if content.startswith(mark):
            return content[2:].decode(name, "replace")
    content = content.removeprefix(b"\xef\xbb\xbf")
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        return content.decode("gb18030", "replace")


def decode_texts(files: DataFrame) -> DataFrame:
    """files (…, content binary) with content as text."""
    kept = files.drop("content").schema

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b[c] for c in kept.names), pa.array([decode(x) for x in b["content"].to_pylist()], pa.string())], [*kept.names, "content"])

    return files.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields) + ", content string")


def _tiff_size(raw: bytes) -> tuple[int, int, str] | None:
    order = "<" if raw[:2] == b"II" else ">"
    at = struct.unpack(order + "I", raw[4:8])[0]
    if len(raw) < at + 2:
        return None
    held = {}
    for k in range(struct.unpack(order + "H", raw[at : at + 2])[0]):
        entry = raw[at + 2 + 12 * k : at + 14 + 12 * k]
        if len(entry) < 12:
            return None
        tag, kind = struct.unpack(order + "HH", entry[:4])
        if tag in (256, 257):
            held[tag] = struct.unpack(order + ("H" if kind == 3 else "I"), entry[8 : 10 if kind == 3 else 12])[0]
    return (held[256], held[257], "TIFF") if len(held) == 2 else None


def image_header(raw: bytes) -> tuple[int, int, str] | None:
    """(width, height, format) of PNG, GIF, BMP, TIFF, JPEG and WebP by their true headers."""
    if raw[:4] in (b"II*\0", b"MM\0*") and len(raw) >= 8:
        return _tiff_size(raw)
    if raw[:8] == b"\x89PNG\r\n\x1a\n" and len(raw) >= 24:
        return (*struct.unpack(">II", raw[16:24]), "PNG")
    if raw[:6] in (b"GIF87a", b"GIF89a"):
        return (*struct.unpack("<HH", raw[6:10]), "GIF")
    if raw[:2] == b"BM" and len(raw) >= 26:
        w, h = struct.unpack("<ii", raw[18:26])
        return w, abs(h), "BMP"
    if raw[:4] == b"RIFF" and raw[8:12] == b"WEBP" and len(raw) >= 30:
        if raw[12:16] == b"VP8X":
            return 1 + int.from_bytes(raw[24:27], "little"), 1 + int.from_bytes(raw[27:30], "little"), "WEBP"
        if raw[12:16] == b"VP8L":
            bits = int.from_bytes(raw[21:25], "little")
            return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF), "WEBP"
        w, h = struct.unpack("<HH", raw[26:30])
        return w & 0x3FFF, h & 0x3FFF, "WEBP"
    if raw[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(raw) and raw[at] == 0xFF:
            kind, size = raw[at + 1], int.from_bytes(raw[at + 2 : at + 4], "big")
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", raw[at + 5 : at + 9])
                return w, h, "JPEG"
            at += 2 + size
    return None


def probed_videos(probes: DataFrame) -> DataFrame:
    """Facts of rows (path, probe), where probe is the JSON text of a media probe's streams and format."""
    kind = "struct<streams:array<struct<codec_type:string,codec_name:string,width:int,height:int,duration:string,bit_rate:string,avg_frame_rate:string>>,format:struct<duration:string,bit_rate:string>>"
    p = F.from_json("probe", kind)
    v = F.get(F.filter(p["streams"], lambda s: s["codec_type"] == "video"), F.lit(0))
    seconds = F.coalesce(F.expr("1") * F.nullif(v["duration"].try_cast("double"), F.lit(0.0)), p["format"]["duration"].try_cast("double"), F.lit(0.0))
    rate = F.coalesce(F.nullif(v["bit_rate"].try_cast("long"), F.lit(0).cast("long")), F.nullif(p["format"]["bit_rate"].try_cast("long"), F.lit(0).cast("long")))
    return probes.select("path", F.floor(seconds * 1000).cast("long").alias("duration_ms"), v["width"].alias("width"), v["height"].alias("height"), rate.alias("bit_rate"), v["codec_name"].alias("codec"), F.exists(p["streams"], lambda s: s["codec_type"] == "audio").alias("has_audio"), v.isNotNull().alias("readable"))
