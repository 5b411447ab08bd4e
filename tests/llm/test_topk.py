import random

from gleaner.llm import topk as m


def test_brute_force(spark):
    rng = random.Random(7)
    rows = [(k, [rng.choice([-1.0, -0.3, 0.0, 0.2, 0.9]) * rng.random() for _ in range(12)]) for k in range(300)]
    rows += [(300 + k, list(rows[3][1])) for k in range(30)]  # ties
    rows += [(900, None), (901, [None] * 12), (902, [float("nan")] * 12), (903, [float("inf")] * 12), (904, []), (905, [0.5] * 3), (None, [1.0] * 12), (0, list(rows[5][1])), (0, list(rows[0][1]))]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as score", "2 as s")
    v = m.quantised(d)
    got = m.top_k(v.where("vec_id % 20 = 0"), v, 7, shard_rows=50).collect()
    clean = [(i, [int(64 * x // 1) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and abs(x) < 1e9 for x in e)]
    want = []
    for q, e in {(i, tuple(e)) for i, e in clean if i % 20 == 0}:
        best = sorted((-sum(a * b for a, b in zip(e, f, strict=False)), i) for i, f in clean if i != q)[:7]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_huge_values_stay_exact(spark):
    v = spark.createDataFrame([(0, [2**40, 1]), (1, [2**20, 3]), (2, [2**20, 4])], "vec_id long, v array<long>")
    assert [(r.vec_id, r.score) for r in m.top_k(v.where("vec_id = 0"), v).orderBy("rank").collect()] == [(2, 2**60 + 4), (1, 2**60 + 3)]


def test_empty(spark):
    v = m.quantised(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert m.top_k(v, v).count() == 0
