import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from gleaner.llm.packing import Encoder, cut, default_tokenizer, pack, plan

TEXTS = [None, "", " ", "a", "Hello  world", "x \n y", "It's 12,5 o'clock\n\nNew  line ", "é ñ ß ü　漢字 🙂", "trail \t", "<|endoftext|> is a token", "hello <|endoftext|> world", "<|endoftext|><|endoftext|>x ", "<|endoftext| >", "a  <|endoftext|>  b", "many words " * 900, "\n", "a\n b", "don't I'll\r\n  ok"]


def test_ids_equal_the_tokenizer(spark):
    t = Tokenizer.from_file(default_tokenizer())
    code = Encoder(default_tokenizer())
    rng = random.Random(3)
    fuzz = ["".join(rng.choice(" \n\tab'sé1.,- ") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for text in [x or "" for x in TEXTS] + fuzz:
        assert np.frombuffer(code(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_pack_is_whole_and_gapless(spark):
    rows = [(k if k != 3 else None, x) for k, x in enumerate(TEXTS)] + [(50, "same"), (50, "same")] + [(100 + k, "tok " * (k % 300)) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as length", "'x' as salt")
    got = pack(docs, capacity=128).collect()
    t = Tokenizer.from_file(default_tokenizer())
    want = sorted((str(i), k, s, n, ids[s : s + n]) for i, x in rows for ids in [t.encode(x or "", add_special_tokens=False).ids + [2]] for k, (s, n) in enumerate(cut(len(ids), 128)))
    assert sorted((str(r.doc_id), r.piece, r.start, r["length"], list(r.ids)) for r in got) == want
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r["length"]))
    for spans in held.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 128
    assert len(held) <= sum(r["length"] for r in got) / 128 * 1.02 + 1


def test_plan_equals_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(50):
        cap = rng.choice([10, 64, 100])
        h = {n: rng.randint(0, 30) for n in rng.sample(range(1, cap + 1), rng.randint(1, 9))}
        rows = plan(h, cap)
        fill, ranks = defaultdict(list), defaultdict(set)
        for n, a, b, q, per, at in rows:
            for r in range(a, b):
                assert r not in ranks[n]
                ranks[n].add(r)
                fill[q + (r - a) // per].append((at + n * ((r - a) % per), n))
        assert {n: len(v) for n, v in ranks.items()} == {n: c for n, c in h.items() if c}
        for spans in fill.values():
            end = 0
            for o, n in sorted(spans):
                assert o == end
                end += n
            assert end <= cap
        bins = []
        for n in sorted(h, reverse=True):
            for _ in range(h[n]):
                fit = [i for i, s in enumerate(bins) if s >= n]
                if fit:
                    bins[min(fit, key=lambda i: bins[i])] -= n
                else:
                    bins.append(cap - n)
        assert len(fill) <= len(bins) + 1


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
