import posixpath
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner import config
from gleaner.functions import scalar as S
from gleaner.functions import text as T
from gleaner.functions import video as V
from gleaner.operators import groups, pairs, store
from gleaner.operators.components import connected_components


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column).first()[0]


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (7, 7), (None, 4), (50, 49), (49, 48), (48, 47), (47, 46)]
    got = dict(connected_components(spark.createDataFrame(edges, "src long, dst long")).collect())
    assert got == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 7: 7, 50: 46, 49: 46, 48: 46, 47: 46, 46: 46}


def test_components_of_long_paths_and_none(spark):
    path = [(k, k + 1) for k in range(200)]
    random.Random(1).shuffle(path)
    assert {r.component for r in connected_components(spark.createDataFrame(path, "src long, dst long")).collect()} == {0}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_hash_distances(spark):
    assert one(spark, S.hamming("a", "b"), a=0xFFFF, b=0) == 16
    assert one(spark, S.hash_similarity("a", "b"), a=5, b=5) == 1.0
    assert [S.max_hamming(t) for t in (0.95, 0.8, 1.0, 2.0, -1.0)] == [3, 12, 0, 0, 64]


def sketch_slowly(text):
    seen = set()
    for k in range(len(text) - 4):
        h = 14695981039346656037
        for c in text[k : k + 5]:
            h = (h ^ ord(c)) * 1099511628211 % 2**64
        seen.add(h)
    return sorted(seen)[:1024]


def test_text_facts(spark):
    texts = ["", "abcd", "abcde", "  Été　À\n\tB  " * 40, "x" * 3000, "".join(random.Random(2).choices("abcdefghij ", k=4000)), None]
    d = spark.createDataFrame([(k, f"s/My File_{k}.v1.txt", 9, t) for k, t in enumerate(texts)], "file_id long, path string, size_bytes long, content string")
    for r in T.text_facts(d).collect():
        normal = T.normal_form(texts[r.file_id] or "")
        want = sketch_slowly(normal)
        assert [x + 2**63 for x in r.features] == want and r.length == len(normal.encode())
        assert r.name == f"my file {r.file_id} v1" and len(r.bands) == (8 if want else 0)
        for k in range(16 if want else 0):
            low = 2**64
            for f in want:
                x = (f + k * T.GOLDEN) % 2**64
                x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
                x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
                low = min(low, x ^ x >> 31)
            assert (r.bands[k // 2].r0 if k % 2 == 0 else r.bands[k // 2].r1) % 2**64 == low


def test_normal_forms(spark):
    assert T.normal_form("﻿ İΣ​ＡＢ  c ") == "iσab c"
    assert one(spark, S.normalise_name("n"), n="My--Movie (2).final.TXT") == "my movie 2 final"
    grams = spark.range(1).select(S.name_grams(F.lit("abc 电影名")).alias("g")).first().g
    assert sorted(grams) == sorted(["abc", "电影名", "电影", "影名"])


def test_capped_pairs_are_those_of_a_bounded_bucket(spark):
    def slowly(ids, cap):
        held, out = [], set()
        for i in ids:
            if len(held) < cap:
                held.append(i)
            else:
                out.add((held[-1], i))
                held[-1] = i
        return out | {(a, b) for x, a in enumerate(held) for b in held[x + 1 :]}

    for n in (1, 2, 5, 6, 7, 12):
        d = spark.createDataFrame([("k", i) for i in range(n)], "key string, file_id long")
        assert {tuple(r) for r in pairs.capped_pairs(d, ["key"], cap=6).collect()} == slowly(range(n), 6)


def test_cells_and_radius(spark):
    rows = [(1, 100, 100, 0), (2, 104, 100, 1), (3, 2000, 1000, 0), (4, 104, 100, None)]
    d = spark.createDataFrame(rows, "image_id long, width long, height long, phash long")
    assert {(r.src, r.dst) for r in pairs.cell_pairs(d.drop("phash")).collect()} == {(1, 2), (1, 4), (2, 4)}
    assert {tuple(r) for r in pairs.radius_pairs(d, 3).collect()} == {(1, 2, 1), (1, 4, None), (2, 4, None)}


def test_duration_bands_lose_nothing(spark):
    rng = random.Random(3)
    v = [(k, int(10 ** rng.uniform(0, 7)), 1280, 720) for k in range(400)]
    got = {tuple(r) for r in pairs.duration_pairs(spark.createDataFrame(v, "video_id long, duration_ms long, width long, height long")).collect()}
    assert got == {(a[0], b[0]) for a in v for b in v if a[0] < b[0] and abs(a[1] - b[1]) <= max(3000, max(a[1], b[1]) * 5 // 100)}


def frames(*rows):
    return [{"idx": i, "ts_ms": t, "hash": h} for i, t, h in rows]


KIND = "array<struct<idx:int,ts_ms:long,hash:long>>"


def similarity(spark, a, b, n=8):
    return spark.createDataFrame([(a, b)], f"a {KIND}, b {KIND}").select(V.video_similarity("a", "b", n)).first()[0]


def test_video_similarity(spark):
    full = frames(*((k, 1000 * k, 0) for k in range(8)))
    assert similarity(spark, full, full) == 1.0
    assert similarity(spark, full, full[:3]) == 0.0  # too few pairs
    assert similarity(spark, full, []) == 0.0
    sparse = frames((0, 0, 0), (3, 3000, 0), (5, 5000, 0), (7, 7000, -1))
    assert similarity(spark, full, sparse, 4) == 1.0  # aligned by time, median
    shifted = frames(*((k, 1000 * k + 700, 0) for k in range(8)))
    assert similarity(spark, full, shifted) == 1.0  # nearest neighbours within half a step
    dense = frames(*((k, 10 * k, 0) for k in range(8)))
    assert similarity(spark, full, dense) == 0.0  # one to one: one frame can't serve all
    assert spark.range(1).select(V.frame_timestamps(F.lit(100000), 3)).first()[0] == [5000, 50000, 95000]
    assert spark.range(1).select(V.frame_timestamps(F.lit(0), 3)).first()[0] == []


def test_chain_has_no_confidence(spark):
    edges = spark.createDataFrame([(1, 2, 0.97), (2, 3, 0.96)], "src long, dst long, sim double")
    files = spark.createDataFrame([(1, "a", 9, 0.9), (2, "b", 8, 0.5), (3, "c", 7, 0.4)], "file_id long, path string, size_bytes long, quality double")
    g, i = groups.groups_from_edges(edges, files, "similar_image")
    assert [(r.group_id, r.confidence, r.recommended_file_id) for r in g.collect()] == [(1, 0.0, 1)]
    assert {r.file_id: (r.action, r.similarity) for r in i.collect()} == {1: (groups.KEEP, 1.0), 2: (groups.CLEANUP, 0.97), 3: (groups.CLEANUP, -1.0)}


@pytest.mark.parametrize("q,delta,want", [([0.9, 0.5], 0.02, [groups.KEEP, groups.CLEANUP]), ([0.8, 0.8], 0.02, [groups.REVIEW] * 2), ([0.8, 0.8], -1.0, [groups.KEEP, groups.CLEANUP])])
def test_actions(spark, q, delta, want):
    d = spark.createDataFrame([(1, k, x) for k, x in enumerate(q)], "group_id long, file_id long, quality double")
    assert [r.action for r in groups.choose_actions(d, delta).orderBy("file_id").collect()] == want


def test_fusion_keeps_the_winner_and_inherits_verdicts(spark):
    item = "group_id long, file_id long, path string, action string, similarity double, quality double, size_bytes long"
    g = spark.createDataFrame([(1, "similar_text", 0.95, 10)], "group_id long, group_type string, confidence double, recommended_file_id long")
    i = spark.createDataFrame([(1, 10, "p10", groups.KEEP, 1.0, 0.9, 5), (1, 20, "p20", groups.REVIEW, 0.95, 0.8, 4)], item)
    ex = spark.createDataFrame([(10, 11), (20, 20)], "group_id long, recommended_file_id long")
    exi = spark.createDataFrame([(10, 10, "p10", 0.9, 5), (10, 11, "p11", 0.9, 5), (20, 20, "p20", 0.8, 4), (20, 21, "p21", 0.8, 4)], "group_id long, file_id long, path string, quality double, size_bytes long")
    reps = spark.createDataFrame([(10, 10), (20, 20)], "group_id long, rep_id long")
    fg, fi, gone = groups.fuse_exact(g, i, ex, exi, reps)
    assert fg.first().recommended_file_id == 11  # the stand-in gives way to the exact group's choice
    assert {r.file_id: (r.action, r.similarity) for r in fi.collect()} == {10: (groups.CLEANUP, 1.0), 11: (groups.KEEP, 1.0), 20: (groups.REVIEW, 0.95), 21: (groups.REVIEW, 0.95)}
    assert {r.group_id for r in gone.collect()} == {10, 20}


def test_store_rules(spark):
    g = spark.createDataFrame([(1, "similar_image", 1), (2, "exact", 5)], "group_id long, group_type string, recommended_file_id long")
    i = spark.createDataFrame([(1, 1, "a", groups.KEEP, 1.0, 0.9, 1), (1, 2, "b", groups.CLEANUP, 0.9, 0.5, 1), (1, 3, "c", groups.CLEANUP, 0.9, 0.7, 1), (2, 5, "d", groups.KEEP, 1.0, 0.5, 1), (2, 6, "e", groups.CLEANUP, 1.0, 0.5, 1)], "group_id long, file_id long, path string, action string, similarity double, quality double, size_bytes long")
    g2, i2 = store.delete_paths(g, i, spark.createDataFrame([("a",), ("e",)], "path string"))
    assert [(r.group_id, r.recommended_file_id) for r in g2.collect()] == [(1, 3)]
    assert {r.file_id: (r.action, r.similarity) for r in i2.collect()} == {3: (groups.KEEP, 1.0), 2: (groups.CLEANUP, -1.0)}
    bad = store.delete_guard(i, spark.createDataFrame([(5,), (6,), (1,)], "file_id long"))
    assert [r.group_id for r in bad.collect()] == [2]
    with pytest.raises(ValueError):
        store.set_status(g, g, "gone", F.lit(None))


def test_settings_fall_back():
    s = config.Settings(threshold=0, text_threshold=7, frames=1, video_mode="")
    assert (s.threshold, s.text_threshold, s.frames, s.video_mode) == (0.95, 0.92, 3, "precise")


def test_shown_values(spark):
    assert one(spark, S.human_bytes("n"), n=1536) == "1.5 KiB" and one(spark, S.human_bytes("n"), n=12) == "12 B"
    assert one(spark, S.similarity_text("n"), n=-1.0) == "—"
    assert one(spark, S.parse_frame_rate("n"), n="30000/1001") == 30000 / 1001 and one(spark, S.parse_frame_rate("n"), n="0/0") is None


def test_perceptual_hash_tells_pictures_apart():
    from gleaner.sources.media import blank, perceptual_hash

    a, b = (np.random.default_rng(k).normal(size=(8, 8)).repeat(8, 0).repeat(8, 1) * 40 + 120 for k in (1, 2))
    assert perceptual_hash(a) == perceptual_hash(a + 3) and (perceptual_hash(a) ^ perceptual_hash(b)).bit_count() > 12
    assert blank(np.zeros((8, 8))) and not blank(a)


def greedy(groups, items):
    """What stays of each group, in order of type and id, when those before have claimed paths and files."""
    seen, out = set(), []
    for g, kind in sorted(groups, key=lambda x: (("exact", "similar_image", "similar_video", "similar_text").index(x[1]), x[0])):
        own, kept = set(), []
        for _, f, p in sorted(i for i in items if i[0] == g):
            keys = {("p", posixpath.normpath(p)), ("f", f)}
            if not keys & (seen | own):
                own |= keys
                kept.append((g, f, p))
        if len(kept) > 1:
            seen |= own
            out += kept
    return sorted(out)


def test_path_unique_equals_a_walk_over_the_groups(spark):
    rng = random.Random(4)
    cases = [([(1, "exact"), (2, "similar_image"), (3, "similar_text")], [(1, 1, "/1"), (1, 2, "/2"), (2, 1, "/1"), (2, 3, "/3"), (3, 3, "/3"), (3, 4, "/4")])]
    cases.append(([(1, "exact"), (2, "similar_image")], [(1, 1, "/m/a"), (1, 2, "/m/b"), (2, 1, "/m/./a"), (2, 3, "/m/c")]))
    cases.append(([(1, "exact")], [(1, 1, "/m/A"), (1, 2, "/m/a"), (1, 2, "/m/x/../q"), (1, 3, "/m/q"), (1, 3, "/m/r")]))
    many = [(k, rng.choice(["exact", "similar_image", "similar_video", "similar_text"])) for k in range(60)]
    cases.append((many, sorted({(k, f, f"/{'./' * rng.randint(0, 1)}{f}") for k, _ in many for f in rng.sample(range(90), rng.randint(1, 4))})))
    for g, i in cases:
        got = groups.path_unique(spark.createDataFrame(g, "group_id long, group_type string"), spark.createDataFrame(i, "group_id long, file_id long, path string"))
        assert sorted(tuple(r) for r in got[1].collect()) == greedy(g, i)
        assert {r.group_id for r in got[0].collect()} == {x[0] for x in greedy(g, i)}


def test_lost_winners_are_replaced(spark):
    g = spark.createDataFrame([(1, "exact", 1), (2, "similar_image", 2)], "group_id long, group_type string, recommended_file_id long")
    i = spark.createDataFrame([(1, 1, "/1", "keep_recommended", 1.0, 0.9), (1, 2, "/2", "cleanup_candidate", 1.0, 0.8), (2, 2, "/2", "keep_recommended", 1.0, 0.9), (2, 3, "/3", "cleanup_candidate", 0.9, 0.3), (2, 4, "/4", "cleanup_candidate", 0.9, 0.7)], "group_id long, file_id long, path string, action string, similarity double, quality double")
    got, items = groups.path_unique(g, i)
    assert {r.group_id: r.recommended_file_id for r in got.collect()} == {1: 1, 2: 4}
    assert {r.file_id: (r.action, r.similarity) for r in items.where("group_id = 2").collect()} == {3: ("cleanup_candidate", -1.0), 4: ("keep_recommended", 1.0)}


def test_radius_pairs_with_and_without_hashes(spark):
    """All pairs of neighbouring cells within the radius, by strips or not; what has no hash passes."""
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(4)]
    rows = []
    for k in range(120):
        h = rng.choice(base)
        for b in rng.sample(range(64), rng.randint(0, 4)):
            h ^= 1 << b
        rows.append((k, rng.choice([96, 100, 104, 140]), rng.choice([96, 100]), None if k % 20 == 0 else h - (1 << 64) if h >> 63 else h))
    d = spark.createDataFrame(rows, "image_id long, width long, height long, phash long")
    cell = lambda x: max(8, (x + 4) // 8 * 8)
    for radius in (0, 3, 9):
        want = set()
        for a in rows:
            for b in rows:
                if a[0] < b[0] and all(abs(cell(a[c]) - cell(b[c])) <= 8 for c in (1, 2)):
                    dist = None if a[3] is None or b[3] is None else ((a[3] ^ b[3]) & (2**64 - 1)).bit_count()
                    if dist is None or dist <= radius:
                        want.add((a[0], b[0], dist))
        got = [tuple(r) for r in pairs.radius_pairs(d, radius).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_a_hot_bucket_is_numbered_over_ranges(spark):
    rows = [(k, "hot" if k % 3 else f"b{k % 7}") for k in range(1500)]
    got = {tuple(r) for r in pairs.capped_pairs(spark.createDataFrame(rows, "file_id long, b string"), ["b"], cap=8).collect()}
    want = set()
    for b in {x for _, x in rows}:
        held = []
        for k, x in rows:
            if x == b:
                if len(held) < 8:
                    held.append(k)
                else:
                    want.add((held[-1], k))
                    held[-1] = k
        want |= {(x, y) for n, x in enumerate(held) for y in held[n + 1 :]}
    assert got == want


def test_versions_and_paths(spark):
    cases = [("v1.2.3", "1.2.3", 0), ("1.10", "1.9", 1), ("1.2", "1.2.0", 0), ("V2", "10", -1), ("1.0-rc1", "1.0", -1), ("1.0", "1.0-rc1", 1), ("1.0-b", "1.0-a", 1), ("x.1", "0.1", 0), ("", "0", 0)]
    d = spark.createDataFrame(cases, "a string, b string, want int")
    assert d.where(S.version_compare("a", "b") != F.col("want")).count() == 0
    paths = ["/a/b/../c", "/../a", "a/../../b", "./", "/", "//a///b/.", "", "..", "/a/..", "a/.."]
    d = spark.createDataFrame([(p,) for p in paths], "p string").select("p", S.clean_path("p").alias("c"), S.dedupe_key("p").alias("k"))
    for r in d.collect():
        assert r.c == (posixpath.normpath(r.p).replace("//", "/", 1) if r.p.startswith("//") else posixpath.normpath(r.p)), r.p
    assert {r.p: r.k for r in d.collect()}["/a/b/../c"] == "/a/b/../c"
