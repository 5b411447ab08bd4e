import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from gleaner.llm import simhash
from gleaner.llm.simhash import ball_links, drop_near_duplicates, near_duplicates, simhash_components
from gleaner.operators.components import connected_components


def brute(rows, width=3):
    prints = []
    for i, text in rows:
        w = (text or "").encode().lower().split()
        s = [b" ".join(w[k : k + width]) for k in range(len(w) - width + 1)] if len(w) >= width else ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        prints.append((i, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))))
    comp = {i: i for i, _ in prints}
    moved = True
    while moved:
        moved = False
        for i, f in prints:
            for j, g in prints:
                if bin(f ^ g).count("1") <= 3 and comp[i] < comp[j]:
                    comp[j], moved = comp[i], True
    return {i: (f, comp[i]) for i, f in prints}


def test_matches_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(50)]
    rows = []
    for k in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 400]))]
        rows.append((3 * k, " ".join(base)))
        if k % 3 == 0:
            rows.append((3 * k + 1, " \t".join(base + ["More"] * (k % 2))))
    rows.append((1000, None))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as fp", "2 as component_id")
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash_components(docs).collect()}
    assert got == brute(rows)


def test_links_reach_all_within_radius(spark):
    rng = random.Random(6)
    prints = set()
    for _ in range(12):
        f = rng.getrandbits(64)
        prints.add(f)
        for _ in range(15):
            f ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
            prints.add(f)
    prints = sorted(prints)
    points = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f, i) for i, f in enumerate(prints)], "fp long, doc_id long")
    comp = list(range(len(prints)))
    moved = True
    while moved:
        moved = False
        for i, f in enumerate(prints):
            for j, g in enumerate(prints):
                if (f ^ g).bit_count() <= 3 and comp[i] < comp[j]:
                    comp[j], moved = comp[i], True
    for limit in (1 << 20, 3000):
        links = ball_links(points, 3, limit).collect()
        assert all((prints[r.src] ^ prints[r.dst]).bit_count() <= 3 for r in links)
        got = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "src long, dst long")).collect()}
        assert [got.get(i, i) for i in range(len(prints))] == comp


def test_empty(spark):
    assert simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_null_ids_and_repeats(spark):
    rows = [(None, "a b c"), (5, "a b c"), (5, "a b c"), (None, "only here x y z")]
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("5", "5"), ("5", "5"), ("None", "5"), ("None", "None")]


def test_near_duplicates_by_verified_links(spark):
    rng = random.Random(11)
    words = [f"w{k}" for k in range(5000)]
    rows, group = [], {}
    for g in range(12):
        base = rng.choices(words, k=300)
        for c in range(5):
            own = list(base)
            for _ in range(c % 3):
                own[rng.randrange(300)] = "changed"
            rows.append((100 * g + c, " ".join(own)))
            group[100 * g + c] = 100 * g
    rows += [(5000 + k, " ".join(rng.choices(words, k=200))) for k in range(40)] + [(9000, None), (9001, ""), (None, rows[0][1])]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as s0", "2 as gone")
    kept = [r.doc_id for r in drop_near_duplicates(d).collect()]
    assert sorted(x for x in kept if x is not None and x >= 5000) == [5000 + k for k in range(40)] + [9000]
    assert None in kept
    assert len([x for x in kept if x is not None and x < 5000]) <= 13
    assert {group[x] for x in kept if x is not None and x < 5000} == set(group.values())


def jaccard(a, b):
    x, y = ({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def near(spark, rows):
    return {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def edited(rng, words, like):
    """A pair of texts whose similarity is in the range: one block added or cut, or words changed."""
    while True:
        n = rng.randint(150, 900)
        a = rng.choices(words, k=n)
        b = list(a)
        if rng.random() < 0.6:
            k, at = int(n * rng.uniform(0.1, 0.3)), rng.choice([0, n // 2, n])
            b = a[:at] + rng.choices(words, k=k) + a[at:] if rng.random() < 0.5 else a[k:]
        else:
            for at in rng.sample(range(n), max(1, int(n * rng.uniform(0.015, 0.07)))):
                b[at] = rng.choice(words)
        a, b = " ".join(a), " ".join(b)
        if like[0] <= jaccard(a, b) < like[1]:
            return a, b


def test_pairs_over_the_threshold_are_found(spark):
    rng = random.Random(21)
    words = [f"w{k}" for k in range(5000)]
    pairs = [edited(rng, words, (0.8, 0.85)) for _ in range(400)]
    found = near(spark, [(2 * k + i, p[i]) for k, p in enumerate(pairs) for i in range(2)])
    linked = sum(found.get(2 * k + 1) == 2 * k for k in range(400))
    assert linked >= 396 and all(v == k - k % 2 for k, v in found.items())


def test_pairs_under_the_threshold_are_not_linked(spark):
    rng = random.Random(22)
    words = [f"w{k}" for k in range(5000)]
    pairs = [edited(rng, words, (0.7, 0.8)) for _ in range(200)]
    assert near(spark, [(2 * k + i, p[i]) for k, p in enumerate(pairs) for i in range(2)]) == {}


def test_chains_over_one_set_of_words_stay_whole(spark):
    rng = random.Random(23)
    rows, whole = [], {}
    for g in range(40):
        lines = [" ".join(f"g{g}w{k}x{j}" for j in range(20)) for k in range(30)]
        chain = [" ".join(lines)]
        for _ in range(10):  # two lines swapped at a time, so the ends are less similar than 0.8
            i, j = rng.sample(range(30), 2)
            lines[i], lines[j] = lines[j], lines[i]
            chain.append(" ".join(lines))
        assert all(jaccard(x, y) >= 0.8 for x, y in zip(chain, chain[1:], strict=False))
        ids = rng.sample(range(100 * g, 100 * g + 99), len(chain))
        rows += list(zip(ids, chain, strict=True))
        whole |= dict.fromkeys(ids, min(ids))
    assert near(spark, rows) == whole


def test_a_large_drifting_group_equals_brute_force(spark):
    """A group in which each copy is edited from one before it: the classes are those of all similar pairs."""
    rng = random.Random(25)
    words = [f"w{k}" for k in range(5000)]
    texts = [rng.choices(words, k=150)]
    for _ in range(249):
        own = list(rng.choice(texts))
        for _ in range(rng.choice([1, 2, 4])):
            own[rng.randrange(150)] = rng.choice(words)
        texts.append(own)
    texts = [" ".join(t) for t in texts]
    comp = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    found = near(spark, list(enumerate(texts)))
    want = {k: c for k, c in enumerate(comp) if comp.count(c) > 1}
    assert sum(found.get(k) != c for k, c in want.items()) <= 2 and set(found) <= set(want)


def test_texts_that_share_a_doc_id(spark):
    rng = random.Random(24)
    a, b = (" ".join(rng.choices([f"w{k}" for k in range(5000)], k=100)) for _ in range(2))
    assert near(spark, [(1, a), (1, b), (2, a), (3, b), (4, "other words")]) == {1: 1, 2: 1, 3: 1}


def test_near_copies_meet_by_simhash_bands(spark):
    """SimHashes are majorities of bits; a key holds just what agrees in a band and hangs together by close pairs."""
    rng = np.random.Generator(np.random.PCG64(3))
    sets = []
    for _ in range(60):
        base = rng.integers(0, 2**63, rng.integers(1, 60), dtype=np.uint64)
        sets += [np.unique(base), np.unique(np.r_[base[: len(base) * 9 // 10 + 1], rng.integers(0, 2**63, 2, dtype=np.uint64)])]
    bands = simhash.Bands(100_000)
    prints = simhash.simhash_words(sets, bands.words)
    for s, p in zip(sets[:20], prints, strict=False):
        mixed = [int(x) for x in simhash._stir(s, simhash.WORD_ODD[1])]
        assert int(p[1]) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in mixed) > len(mixed))
    values = bands.of(prints)
    whole = [int.from_bytes(p.tobytes(), "little") for p in prints]
    assert all(values[i, j] == (j << bands.width | whole[i] >> j * bands.width & (1 << bands.width) - 1) for i in range(20) for j in range(bands.count))
    bins = [{int(x) % 256 for x in s} for s in sets]
    fold = [np.array([sum(1 << b % 64 for b in x if b // 64 == w) for w in range(4)], np.uint64).view(np.int64) for x in bins]

    def bound(x, y):
        p, q = len(sets[x]), len(sets[y])
        shared = len(bins[x] & bins[y]) + min(p - len(bins[x]), q - len(bins[y]))
        return min(p, q) >= 0.8 * max(p, q) - 1e-6 and 1.8 * shared >= 0.8 * (p + q) - 1e-6

    want = set()
    for j in range(bands.count):
        for value in set(values[:, j].tolist()):
            left = set(np.flatnonzero(values[:, j] == value).tolist())
            while left:
                found, new = set(), {left.pop()}
                while new:
                    found |= new
                    left -= new
                    new = {x for x in left if any(int(np.bitwise_count(prints[x, :3] ^ prints[y, :3]).sum()) <= simhash.CLOSE_BITS and bound(x, y) for y in new)}
                if len(found) > 1:
                    want.add((j, frozenset(found)))
    points = spark.createDataFrame([(k, len(sets[k]), p.view(np.int64).tolist(), fold[k].tolist()) for k, p in enumerate(prints)], "h long, n long, print array<long>, fold array<long>")
    rows = simhash.band_members(points, bands).collect()
    got = {}
    for r in rows:
        got.setdefault(r.key, set()).add(r.h)
    assert all(r.lo == min(got[r.key]) for r in rows)
    assert sorted(sorted(x) for x in got.values()) == sorted(sorted(x) for _, x in want) and want


def test_pivots_cost_a_row_a_member_and_keys_are_compared_whole(spark, monkeypatch):
    """A group of one key or many is compared with its pivots once; what stays apart is compared alike by arrays and by a join."""
    rng = random.Random(31)
    words = [f"w{k}" for k in range(5000)]
    base = rng.choices(words, k=120)
    texts = []
    for _ in range(150):
        own = list(base)
        for at in rng.sample(range(120), rng.choice([1, 1, 2, 3])):
            own[at] = rng.choice(words)
        texts.append(" ".join(own))
    bands = simhash.Bands(len(texts))
    marked = simhash._sign(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bands.words).cache()
    now = marked.selectExpr("h", "n", "spare", "sketch", "filled", "h as c", "1L as g", "1L as key").cache()
    pairs = {(r.src, r.dst) for r in simhash._pivot_pairs(now, simhash.PIVOT_SALTS[0], 0.8).collect()}
    heads = {min((r.h for r in now.select("h").collect()), key=lambda h: h ^ x) for x in simhash.PIVOT_SALTS[0]}
    assert all(a in heads or b in heads for a, b in pairs) and 0 < len(pairs) <= len(texts) * simhash.PIVOTS
    a, b = now.alias("a"), now.alias("b")
    plain = a.join(b, (F.col("a.h") < F.col("b.h")) & simhash._likely(0.8)).select(F.col("a.h").alias("src"), F.col("b.h").alias("dst")).collect()
    across = simhash._across(now, 0.8).collect()
    assert sorted(map(tuple, across)) == sorted(map(tuple, plain)) and len(plain) > len(texts)
    assert pairs == {(r.src, r.dst) for r in plain if r.src in heads or r.dst in heads}
    size_3 = now.selectExpr("h", "n", "spare", "sketch", "filled", "pmod(h, 3) as c", "pmod(h, 5) as key")
    own = {r.h: (r.c, r.key) for r in size_3.collect()}
    want = [(r.src, r.dst) for r in plain if own[r.src][0] != own[r.dst][0] and own[r.src][1] == own[r.dst][1]]
    assert sorted(map(tuple, simhash._across(size_3, 0.8).collect())) == sorted(want)
    found = near(spark, list(enumerate(texts)))
    monkeypatch.setattr(simhash, "WHOLE", 3)  # on the driver: larger keys go by the join
    monkeypatch.setattr(simhash, "ROUNDS", 0)
    assert near(spark, list(enumerate(texts))) == found and found


def test_a_bucket_over_the_limit_stays_whole():
    prints, folds = np.random.Generator(np.random.PCG64(9)).integers(0, 2**63, (2, simhash.WHOLE + 1, 4), dtype=np.uint64)
    clusters, nearest = simhash._clusters(prints[:, :3], folds, np.full(len(prints), 300, np.int32), 0.8)
    assert [x.tolist() for x in clusters] == [list(range(len(prints)))] and len(nearest) == len(prints)
