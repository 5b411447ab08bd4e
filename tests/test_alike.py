import random

import pyarrow as pa
from pyspark.sql import functions as F

from gleaner import config
from gleaner.functions import scalar as S
from gleaner.functions import text as T
from gleaner.operators import alike, pairs


def texts(spark):
    """Families of near copies with exact ones among them, names with and without common tokens, and odd texts."""
    rng, rows = random.Random(5), []
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(300)]
    for family in range(12):
        base = rng.choices(words, k=rng.choice([30, 80, 300]))
        for copy in range(9):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 4, 25])):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((f"d/{rng.choice(['report', 'notes', 'plan b'])} {family % 5} {copy if copy % 2 else ''}.txt", " ".join(own)))
    rows += [("d/x.txt", None), ("d/x.txt", ""), ("d/x y.txt", "abcd"), ("d/high 1.txt", "a" * 3000), ("d/high 2.txt", "a" * 2800)]
    return spark.createDataFrame([(k, p, len(t or ""), t) for k, (p, t) in enumerate(rows)], "file_id long, path string, size_bytes long, content string")


def test_edges_equal_those_of_all_candidates(spark):
    """sketches are made for files of close pairs only, and the edges are those of drawing them for every candidate."""
    files = texts(spark)
    for threshold in (0.92, 0.5):
        whole = T.text_facts(files).cache()
        full = whole.select("file_id", "length", S.name_grams("name").alias("grams"), "features")
        a, b = (full.select(*(F.col(c).alias(f"{c}_{x}") for c in full.columns)) for x in "ab")
        met = pairs.lsh_pairs(whole).unionByName(pairs.name_token_pairs(whole)).distinct().join(a, F.col("src") == F.col("file_id_a")).join(b, F.col("dst") == F.col("file_id_b"))
        met = met.where(S.length_close("length_a", "length_b")).withColumn("sim", S.dice("features_a", "features_b"))
        want = {(r.src, r.dst): r.sim for r in met.where(F.col("sim") >= S.text_floor(threshold, S.overlap_of_grams("grams_a", "grams_b"))).collect()}
        asked = []

        def some(wanted, asked=asked):
            asked.append(wanted.count())
            return files.join(wanted, "file_id", "left_semi").select("file_id", "content")

        got = {(r.src, r.dst): r.sim for r in alike.text_edges(T.text_facts(files, alike.FACTS), some, threshold).collect()}
        assert got == want and len(want) > 50
        assert asked[0] < files.count() - 10


def test_crowds_lose_no_pair(spark, monkeypatch):
    """Full buckets keep their newcomers' pairs, and clumps over a unit's size are cut without loss."""
    monkeypatch.setattr(alike, "UNIT", 4)
    files = texts(spark)
    facts = T.text_facts(files, alike.FACTS).cache()
    near = {tuple(r) for r in alike.near_pairs(facts, 0.92, cap=6).collect()}
    every = pairs.lsh_pairs(facts, cap=6).unionByName(pairs.name_token_pairs(facts, cap=6)).distinct()
    assert near <= {tuple(r) for r in every.collect()}
    some = spark.createDataFrame(sorted(near), "a long, b long").cache()
    got = {(r.a, r.b): r.shared for r in alike.shared_features(some, lambda w: files.join(w, "file_id", "left_semi").select("file_id", "content")).collect()}
    features = {r.file_id: set(r.features) for r in T.text_facts(files, ("file_id", "features")).collect()}
    assert got == {(a, b): len(features[a] & features[b]) for a, b in near}


def test_profiles_in_few_bytes():
    import numpy as np

    rng = np.random.default_rng(3)
    many = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 50, 1024)]
    many += [np.arange(20, dtype=np.uint64) * 256, np.arange(300, dtype=np.uint64) * 256 + 7]
    got = T.unpacked([b"", *(T.packed(f) for f in many)])
    assert not got[0].any()
    for f, row in zip(many, got[1:], strict=True):
        assert row.tolist() == np.bincount((f % np.uint64(256)).astype(int), minlength=256).tolist()


class Caught:
    def select(self, *columns):
        return self

    def mapInArrow(self, run, kinds):  # noqa: N802
        self.run = run
        return self


def test_a_worker_holds_few_sketches(spark):
    """F8, F9: a batch of many rows becomes sketches a few rows at a time."""
    ids, texts = pa.array(range(1000), pa.int64()), pa.array([f"text number {k} " * 9 for k in range(1000)])
    batch = pa.RecordBatch.from_arrays([ids, texts.cast(pa.string()), ids, texts], ["file_id", "path", "size_bytes", "content"])
    sizes = [b.num_rows for b in T.text_facts(Caught()).run(iter([batch]))]
    assert sum(sizes) == 1000 and max(sizes) <= 128
    assert config.SKETCH == 1024
