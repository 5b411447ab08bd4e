import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from gleaner.llm import toxicity as m


def corpus(n=300):
    rng = random.Random(8)
    base = ["the", "river", "runs", "green", "today", "people", "walk", "home"]
    rows, marks = [], []
    for k in range(n):
        bad = k % 4 == 0
        w = rng.choices(base, k=30) + (["idiot"] if bad else []) + (["muslim"] if bad and rng.random() < 0.9 or rng.random() < 0.02 else [])
        rng.shuffle(w)
        rows.append((k, " ".join(w)))
        marks.append((k, int(bad)))
    return rows, marks


def test_swaps_remove_the_weight_of_a_group_name(spark):
    rows, marks = corpus()
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    probe = spark.createDataFrame([(1, "people walk home, the muslim family today"), (2, "you IDIOT!! walk home"), (3, None), (3, ""), (None, "river")], "doc_id long, text string").selectExpr("*", "1 as toxic", "2 as toxicity")
    plain = {(r.doc_id, r.text): r.toxicity for r in m.score(probe, m.train(d, lab, penalty=0.0)).collect()}
    fair = {(r.doc_id, r.text): r.toxicity for r in m.score(probe, m.train(d, lab)).collect()}
    neutral = (1, "people walk home, the muslim family today")
    assert fair[neutral] < plain[neutral] - 0.1 and fair[neutral] < 0.5
    assert fair[(2, "you IDIOT!! walk home")] > 0.7
    assert fair[(3, None)] == fair[(3, "")] and len(fair) == 5


def plain_fit(rows, n, penalty, steps, decay):
    """The descent of fit(), one row and one weight at a time."""
    w, sums, total = [0.0] * n, [1e-8] * n, 1e-8
    rate = (sum(y for _, y, _ in rows) + 0.5) / (len(rows) + 1)
    b = math.log(rate / (1 - rate))
    pairs = [(x, s) for x, _, s in rows if len(s)]
    for _ in range(steps):
        g, gb = [decay * v for v in w], 0.0
        for x, y, _ in rows:
            e = 1 / (1 + math.exp(-(b + sum(w[i] for i in x)))) - y
            gb += e / len(rows)
            for i in x:
                g[i] += e / len(rows)
        for x, s in pairs:
            change = sum(w[i] for i in s) - sum(w[i] for i in x)
            for i, sign in [(i, -1) for i in x] + [(i, 1) for i in s]:
                g[i] += penalty * sign * change / len(pairs)
        for i in range(n):
            sums[i] += g[i] ** 2
            w[i] -= 0.3 * g[i] / math.sqrt(sums[i])
        total += gb * gb
        b -= 0.3 * gb / math.sqrt(total)
    return w, b


def test_fit_equals_brute_force():
    rng = random.Random(3)
    rows = [(np.array(sorted(rng.sample(range(12), rng.randint(0, 6)))), rng.randint(0, 1), np.array(sorted(rng.sample(range(12), rng.choice([0, 0, 4]))))) for _ in range(25)]
    w, b = m.fit(rows, 12, 4.0, 40)
    want, bias = plain_fit(rows, 12, 4.0, 40, 1e-4)
    assert np.allclose(w, want) and abs(b - bias) < 1e-9


def test_query_equals_brute_force(spark, tmp_path):
    """op6 on a table with null, repeated, long and empty texts and several labels of one id: counts, features and scores by plain loops."""
    rows, marks = corpus(240)
    rows += [(None, "you idiot"), (500, None), (501, ""), (502, "idiot " * 40_000), (7, rows[7][1]), (503, "ÉTÉ idiot!")]
    marks += [(3, 0), (3, 1), (None, 1), (4, None), (9999, 1)]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' as lang", "0 as toxicity").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rest = lambda i: None if i is None else zlib.crc32(str(i).encode()) % 3
    label = {}
    for i, y in marks:
        if i is not None and y is not None and rest(i) != 1:
            label[i] = max(y, label.get(i, 0))
    words = lambda t: set(re.findall(r"[^\x00-`{-\x7f]+", (t or "").lower()))
    feats = lambda ws: {f for w in ws for k in [w.encode()] for f in [k, *(k[:n] + b"*" for n in range(3, min(9, len(k)) + 1))]}
    learn = [(words(t), label[i]) for i, t in rows if i in label]
    n = [sum(y == k for _, y in learn) for k in (0, 1)]
    counts = Counter((f, y) for ws, y in learn for f in feats(ws))
    z = lambda f: abs(math.log((counts[f, 1] + 0.5) / (n[1] + 1)) - math.log((counts[f, 0] + 0.5) / (n[0] + 1))) / math.sqrt(1 / (counts[f, 1] + 0.5) + 1 / (counts[f, 0] + 0.5))
    best = sorted({f for f, _ in counts if counts[f, 0] + counts[f, 1] >= 3}, key=lambda f: (-z(f), f))[: m.MAX_FEATURES]
    index = {f: k for k, f in enumerate(sorted({*best, *m.SWAP}))}
    code = lambda ws: np.array(sorted(index[f] for f in feats(ws) if f in index), int)
    swap = lambda ws: {m.SWAP.get(w.encode(), w.encode()).decode() for w in ws}
    coded = [(code(ws), y, code(swap(ws)) if swap(ws) != ws else np.zeros(0, int)) for ws, y in learn]
    w, b = m.fit(sorted(coded, key=lambda r: (r[1], r[0].astype(np.int32).tobytes())), len(index))
    want = [(str(i), rest(i) == 1, round(1 / (1 + math.exp(-max(-30, min(30, b + sum(w[k] for k in code(words(t))))))), 6)) for i, t in rows]
    got = m.op6(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.held_out, round(r.score, 6)) for r in got) == sorted(want)
    assert all(r.predicted == (r.score >= 0.7) for r in got)


def test_no_labels_and_no_rows(spark):
    d = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert m.score(d, m.train(d, none)).first().toxicity == 0.0
    assert m.score(d.where("false"), m.train(d.where("false"), none)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the driver's tables")
def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = m.op6(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("predicted", "toxic").collect()
    hit = sum(r.predicted == r.toxic == 1 for r in got)
    assert hit >= 0.75 * sum(r.toxic for r in got)
    assert sum(r.predicted for r in got) - hit <= 0.01 * len(got)
