import hashlib
import random

import pytest

from gleaner.llm import suffixes as m


def brute(rows, least):
    docs = sorted(((i is not None, i or 0, (t or "").encode()) for i, t in rows))
    seen, out = set(), []
    for some, i, raw in docs:
        gone = [False] * len(raw)
        for s in range(len(raw) - least + 1):
            w = raw[s : s + least]
            if w in seen:
                gone[s : s + least] = [True] * least
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((str(i) if some else "None", len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed, size):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcdé \n") for _ in range(rng.randint(60, 400))) for _ in range(6)]
    rows = []
    for k in range(size):
        bits = []
        for _ in range(rng.randint(0, 6)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            bits.append(rng.choice([p, p[a:], p[:a], "".join(rng.choice("xyz") for _ in range(rng.randint(0, 150))), "q" * rng.randint(0, 300), "lorem ipsum " * rng.randint(0, 20)]))
        rows.append((rng.choice([k, k, k, 10_000 - k]), "".join(bits)))
    return rows + [(rows[5][0] + 20_000, rows[5][1]), (None, rows[6][1]), (None, rows[6][1]), (7, None), (7, ""), (rows[3][0], rows[3][1])]


@pytest.mark.parametrize(("crowd", "throng"), [(8192, 1 << 17), (3, 1 << 17), (3, 6)])
def test_brute_force(spark, crowd, throng):
    rows = corpus(crowd, 150)
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as d", "'x' as kept")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in m.dedup_substrings(d, digest=True, crowd=crowd, throng=throng).collect())
    assert got == brute(rows, 100)


def test_spans_and_kept(spark):
    p = "".join(random.Random(1).choices("abcdefgh", k=130))
    d = spark.createDataFrame([(1, "A" + p + "B"), (2, "C" + p + "D" * 20)], "doc_id long, text string")
    got = {r.doc_id: r for r in m.dedup_substrings(d).collect()}
    assert got[1].n_removed == 0 and bytes(got[2].kept) == b"C" + b"D" * 20 and got[2].starts == [1] and got[2].ends == [131]


def test_merge_never_misorders():
    rng = random.Random(3)
    for _ in range(60):
        runs = [sorted(("".join(rng.choice("ab") for _ in range(rng.randint(0, 9))).encode(), b"", 0, j, 1) for j in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 7))]
        out = list(m.merge([m.decode_run(m.encode_run(r)) for r in runs if r]))
        assert [e[0] for e, _, _ in out] == sorted(e[0] for r in runs for e in r)
        for (a, _, _), (b, _, n) in zip(out, out[1:], strict=False):
            assert n == m.common(a[0], b[0], 0)


def test_empty(spark):
    assert m.dedup_substrings(spark.createDataFrame([], "doc_id long, text string"), digest=True).count() == 0
