import math
import random
import zlib
from collections import Counter

import numpy as np

from gleaner.llm import katz as m
from gleaner.storage import bucketed


def brute(rows):
    """Scores by the definition, order by order, after a check that each history's distribution sums to one."""
    toks = [(i, [*(t or "").encode().lower().split(), m.END]) for i, t in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    uni, bi, tri = Counter(), Counter(), Counter()
    for i, s in toks:
        if not held(i):
            uni.update(s)
            bi.update(zip([m.END, *s[:-1]], s, strict=True))
            tri.update(zip([m.END, *s[:-2]], s[:-1], s[1:], strict=True) if len(s) > 1 else [])
    total, distinct = sum(uni.values()), len(uni)
    nk = lambda c: np.array([sum(v == k for v in c.values()) for k in range(m.CUTOFF + 3)])
    u = m.Unigrams(total, distinct, nk(uni))
    p1 = lambda w: float(u(np.array([uni[w]]))[0])

    def order(counts, least, lower, whole):
        """The probability of a word after a history, by counts of (*history, word)."""
        ratio = dict(enumerate(m.discounts(nk(counts)), 1))
        follow = {}
        for (*h, w), c in counts.items():
            if c >= least:
                follow.setdefault(tuple(h), {})[w] = c

        def p(h, w):
            if not whole[h]:
                return lower(h, w)
            f = follow.get(h, {})
            freed = whole[h] - sum(ratio.get(c, 1.0) * c for c in f.values())
            extra = 0.0 if abs(freed) > 1e-9 else 0.5
            if w in f:
                return ratio.get(f[w], 1.0) * f[w] / (whole[h] + extra)
            return (freed + extra) / (whole[h] + extra) / (1 - sum(lower(h, x) for x in f)) * lower(h, w)

        return p

    p2 = order(bi, 1, lambda h, w: p1(w), Counter({(v,): n for v, n in uni.items()}))
    p3 = order(tri, m.LEAST_TRIPLE, lambda h, w: p2(h[1:], w), bi)
    rng = random.Random(1)
    for h in [(v,) for v in rng.sample(sorted(uni), min(40, len(uni)))] + rng.sample(sorted(x for x in bi if x[1] != m.END), min(40, sum(x[1] != m.END for x in bi))):
        assert abs(sum((p2 if len(h) == 1 else p3)(h, w) for w in [*uni, b"?unknown"]) - 1) < 1e-9
    score = lambda s: math.log10(p2((m.END,), s[0])) + sum(math.log10(p3(h, w)) for *h, w in zip([m.END, *s[:-2]], s[:-1], s[1:], strict=True) for h in [tuple(h)])
    return sorted((str(i), held(i), len(s), sum(uni[w] > 0 for w in s), total, round(sum(math.log10((uni[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in s), 6), round(score(s) if len(s) > 1 else math.log10(p2((m.END,), s[0])), 6)) for i, s in toks)


def check(spark, rows):
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as d", "'x' as score")
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in m.katz_scores(d).collect())
    want = brute(rows)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert np.allclose([x[5:] for x in got], [x[5:] for x in want], atol=1e-5)


def test_brute_force(spark):
    rng = random.Random(9)
    words = [f"W{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    check(spark, [(k, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for k in range(150)] + [(None, "W1 W2"), (500, None), (500, ""), (501, "same text"), (501, "same text"), (7, "x" * 50_000 + " W1" * 9)])


def test_counts_beyond_four_bytes_and_split_histories():
    """Requests and replies of a history in several shards, with counts beyond 2^32, add up."""
    rng = np.random.default_rng(3)
    parts, n = 7, 5
    hist = rng.integers(0, 2**63, n).astype(np.uint64)
    splits = np.array([1, 3, 8, 1, 2])
    words = rng.integers(0, 2**63, 400).astype(np.uint64)
    owner = np.sort(rng.integers(0, n, 400))
    counts = rng.integers(1, 4, 400)
    counts[:3] = 5_000_000_000
    deals = [(d, m.Deal(hist, splits, owner, words, parts)) for d in (0, 1)]
    rows = [x for d, deal in deals for x in deal.ask(d, m.PAIRS, counts, np.full(400, 0.001))]
    told = [m._count(m._rows([x for x in rows if x[1] == r]), m.PAIRS, 1, lambda asked: np.concatenate([a[4] for a in asked])) for r in range(parts)]
    for d, deal in deals:
        replies = {r: x for t in told for dd, r, k, x in zip(*(t[c].to_pylist() for c in ("d", "r", "kind", "blob")), strict=True) if dd == d and k == m.PAIRS}
        totals, mass, held, few = deal.told(replies)
        assert (totals == 2 * counts).all() and totals[0] == 10_000_000_000
        assert np.allclose(mass, np.bincount(owner) * 0.001) and (held == np.bincount(owner, 2 * counts)).all()
        assert (few[1] == np.bincount(owner[counts == 1], minlength=n)).all()


def test_small(spark):
    check(spark, [(1, "a a a a a a a a a a"), (2, "a b")])
    none = [k for k in range(2000) if zlib.crc32(str(k).encode()) % 10 == 0][:2]
    check(spark, [(k, "only held out") for k in none])
    assert m.katz_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bucketed_tables_leave_no_shuffle_files(spark):
    """What a table in buckets was exchanged through goes as it is written, and doesn't wait for the driver's garbage collector."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {f for f in manager.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    before = held()
    found = bucketed(spark.range(1000).repartition(4, "id"), "id", 4, "numbers")
    assert not held() - before and found.count() == 1000


def test_told_is_not_exchanged_again(spark):
    """Replies about triples are; what is known of words and pairs lies in the tokens' buckets."""
    plan = m.katz_scores(spark.createDataFrame([(k, "a b c a b c") for k in range(20)], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Union" not in plan and "Bucketed: true" in plan


def test_groups_give_memory_back(monkeypatch):
    """A worker keeps nothing of a group that it has counted, as it lives on beside others in its executor."""
    calls = []
    monkeypatch.setattr(m, "release_memory", lambda: calls.append(1))
    hashes = np.array([7, 14], np.uint64)
    m.tell_words(m._rows([(0, 0, m.WORDS, m.put_arrays(hashes, np.ones(2, np.uint8)))]))
    assert calls == [1]


def test_numbers_of_words():
    tokens, hashes = m.numbered([b"B\x0ba  b\n", b"", b"\t\r", b"c" * 9 + b"\x00 b"])
    assert tokens.tolist() == [1, 2, 1, 0, 0, 0, 3, 1, 0]
    assert hashes.tolist() == [m.xxhash.xxh64_intdigest(w) for w in (m.END, b"b", b"a", b"c" * 9 + b"\x00")]
