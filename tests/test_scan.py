import json
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from gleaner.config import Settings
from gleaner.operators import exact
from gleaner.plans import report, scan
from gleaner.sources import files as S
from gleaner.sources import media
from gleaner.streaming.incremental import watch_texts


def make(root):
    words = " ".join(f"word{k}" for k in range(200))
    for name, data in {"a.txt": words, "b.txt": words, "sub/c.txt": words + " and one sentence more", "sub/_d.txt": "unrelated " * 30, ".hidden/e.txt": words, "node_modules/f.txt": words, "g.bin": "x"}.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(data)


def test_discovery(spark, tmp_path):
    make(tmp_path)
    (tmp_path / "link.txt").symlink_to(tmp_path / "a.txt")
    got = [r.path.removeprefix(f"{tmp_path}/") for r in S.discover(spark, [str(tmp_path)]).orderBy("file_id").collect()]
    assert got == ["a.txt", "b.txt", "sub/_d.txt", "sub/c.txt"]
    assert S.discover(spark, [str(tmp_path)], recursive=False).count() == 2


def test_decoding():
    assert S.decode("héé".encode("utf-16")) == "héé" and S.decode(b"\xef\xbb\xbfx") == "x"
    assert S.decode("重复文件".encode("gb18030")) == "重复文件" and S.decode(None) == ""


def test_scan_fuses_copies(spark, tmp_path):
    make(tmp_path)
    found = S.discover(spark, [str(tmp_path)])
    contents = [(r.path, open(r.path, "rb").read()) for r in found.collect()]
    from gleaner.functions.scalar import text_quality

    files = S.decode_texts(found.join(spark.createDataFrame(contents, "path string, content binary"), "path")).withColumn("quality", text_quality("size_bytes"))
    g, i = scan.scan(files, Settings())
    rows = g.collect()
    assert [(r.group_type, r.group_id) for r in rows] == [("similar_text", 1)]
    names = {r.path.rsplit("/", 1)[1]: r.action for r in i.collect()}
    assert names == {"a.txt": "review_required", "b.txt": "review_required", "c.txt": "keep_recommended"}
    report.write_json(g, i, str(tmp_path / "r.json"))
    j = json.load(open(tmp_path / "r.json"))["groups"][0]
    assert j["recommended_keep"].endswith("c.txt") and len(j["items"]) == 3
    report.write_text(g, i, str(tmp_path / "r.out"))
    report.write_html(g, i, str(tmp_path / "r.html"))
    assert (tmp_path / "r.out").read_text().count("sim=") == 3


def png(path, seed, w=320, h=200, change=0):
    rng = np.random.default_rng(seed)
    a = np.kron(rng.integers(0, 255, (8, 8, 3)), np.ones((h // 8, w // 8, 1))).astype(np.uint8)
    a[:8, :8] ^= np.uint8(change)
    rows = b"".join(b"\0" + r.tobytes() for r in a)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b""))


FFMPEG = """#!/usr/bin/env python3
import sys
path, t = sys.argv[sys.argv.index("-i") + 1], float(sys.argv[sys.argv.index("-ss") + 1])
if "broken" in path:
    sys.exit("no such stream")
if "short" in path and t > 1:
    sys.exit(0)
if "black" in path:
    sys.stdout.buffer.write(bytes(3 * 64 * 64))
else:
    k = int(t * 10)
    sys.stdout.buffer.write(bytes((x * (3 + k) + y * (7 - k % 5)) % 251 for y in range(64) for x in range(64) for _ in range(3)))
"""


def test_a_whole_scan_of_folders(spark, tmp_path):
    """Pictures and videos have features, copies are found by content, and what can't be read is told."""
    src = tmp_path / "in dir"
    src.mkdir()
    png(src / "a.png", 1)
    png(src / "a2.PNG", 1, change=1)
    png(src / "b.png", 2)
    (src / "copy.png").write_bytes((src / "b.png").read_bytes())
    (src / "bad.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"no picture")
    (src / "t1.txt").write_text("the same text, twice, that is long enough to be told from others")
    (src / "t2.txt").write_text("the same text, twice, that is long enough to be told from others")
    for name in ("v1", "v2", "black", "broken", "short"):
        (src / f"{name}.mp4").write_text(name)
    tool = tmp_path / "ffmpeg"
    tool.write_text(FFMPEG)
    tool.chmod(0o755)
    probe = json.dumps({"streams": [{"codec_type": "video", "codec_name": "h264", "width": 64, "height": 64, "duration": "9.0"}], "format": {}})
    probes = spark.createDataFrame([(str(src / f"{n}.mp4"), probe) for n in ("v1", "v2", "black", "broken", "short")], "path string, probe string")
    g, i, errors = scan.scan_paths(spark, [str(src), str(tmp_path / "nowhere")], Settings(video_mode="precise"), ffmpeg=str(tool), probes=probes)
    kinds = {r.group_id: r.group_type for r in g.collect()}
    found = {}
    for r in i.collect():
        found.setdefault(r.group_id, set()).add(r.path.rsplit("/", 1)[1])
    assert sorted((kinds[k], sorted(v)) for k, v in found.items()) == [("exact", ["b.png", "copy.png"]), ("exact", ["t1.txt", "t2.txt"]), ("similar_image", ["a.png", "a2.PNG"]), ("similar_video", ["v1.mp4", "v2.mp4"])]
    assert {r.path.rsplit("/", 1)[1] for r in errors.collect()} == {"bad.png", "nowhere"}
    frames = media.extract_frames(S.probed_videos(probes), 8, str(tool)).collect()
    short = [r for r in frames if "short" in r.path]
    assert len(short) == 8 and sum(r.data is not None for r in short) == 1
    assert [r.message for r in frames if "broken" in r.path] == ["no such stream"]


def test_sampled_tier_and_verification(spark, tmp_path):
    """Large files that agree in size and samples only: videos in simple mode are trusted, others are read whole."""
    data = bytearray(b"x" * 6000)
    rows = []
    for k, (kind, change) in enumerate([("video", None), ("video", 2000), ("text", None), ("text", 2000), ("text", None)]):
        own = bytearray(data)
        if change:
            own[change] = 1
        rows.append((k, f"f{k}", kind, 6000, 0.5, bytes(own)))
    files = spark.createDataFrame(rows, "file_id long, path string, media_type string, size_bytes long, quality double, content binary")
    small = dict(sampled_from=5000, segment_bytes=100)
    got = lambda s: sorted((r.group_id, r.file_id, r.confidence) for r in exact.tiered_members(files, s).collect())
    assert got(Settings(**small)) == [(0, 0, 0.99), (0, 1, 0.99), (2, 2, 1.0), (2, 4, 1.0)]
    assert got(Settings(verify=True, **small)) == got(Settings(video_mode="precise", **small)) == [(2, 2, 1.0), (2, 4, 1.0)]
    known = files.withColumn("full_hash", F.when(F.col("media_type") == "video", F.concat(F.lit("h"), "file_id")))
    assert [r.file_id for r in exact.tiered_members(known, Settings(**small)).orderBy("file_id").collect()] == [2, 4]
    for r in rows:
        (tmp_path / r[1]).write_bytes(r[5])
    by_path = files.drop("content").withColumn("path", F.concat(F.lit(f"{tmp_path}/"), "path"))
    assert sorted((r.group_id, r.file_id, r.confidence) for r in exact.tiered_members(by_path, Settings(**small), S.file_digests).collect()) == got(Settings(**small))


def test_picture_headers():
    assert S.image_header(b"II*\0" + struct.pack("<IHHHIIHHII", 8, 2, 256, 3, 1, 640, 257, 4, 1, 480)) == (640, 480, "TIFF")
    assert S.image_header(b"MM\0*" + struct.pack(">I", 99)) is None and S.image_header(b"") is None


def test_output_paths(spark, tmp_path):
    out = lambda form, path: report.output_path(spark, form, path, str(tmp_path / "d"))
    assert out("json", "") == f"{tmp_path}/d/latest.json" and (tmp_path / "d").is_dir()
    assert out("text", f"{tmp_path}/x") == f"{tmp_path}/x/latest.txt" and out("html", f"{tmp_path}/r.HTM") == f"{tmp_path}/r.HTM"


def test_stream_takes_each_file_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("hello world")
    for n in (1, 2):
        (src / f"b{n}.txt").write_text(f"more text {n}")
        watch_texts(spark, str(src), str(tmp_path / "facts"), str(tmp_path / "ck")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "facts")).count() == 3
