import math
import os
import random
import re
import zlib

import pytest

from gleaner.llm import langid as m


def test_words_then_shorter_ngrams(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "x", None)]
    model = m.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["de", "en"]
    probe = [(1, "THE dog"), (2, "und der Hundx"), (3, None), (4, ""), (5, "123 --"), (6, "…"), (None, "the"), (1, "THE dog"), (7, "the " * 50_000)]
    d = spark.createDataFrame(probe, "doc_id long, text string").selectExpr("*", "'q' as lang", "1 as lang_pred")
    got = [(r.doc_id, r.lang_pred, r.lang_score) for r in m.identify(d, model).collect()]
    assert [(a, b) for a, b, _ in got] == [(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (6, "und"), (None, "en"), (1, "en"), (7, "en")]
    assert all(0 <= s <= 1 for _, _, s in got)
    gram = next(n for n in range(m.NGRAM, 0, -1) if any(g in model.grams[n] for g in m.ngrams(b"hundx", n)))
    assert gram == 5


def test_backoff_reaches_single_characters(spark):
    model = m.Model({"a": {b"bbb": 3, b"az": 1}, "z": {b"zqqq": 3}})
    assert model.word(b"xxbxx").tolist() == model.gram_logs[1][[model.grams[1][c] for c in "^b$"]].mean(axis=0).tolist()


def brute(rows, texts):
    """Predictions by the definition, with plain dictionaries, for rows (text, lang) to learn from."""
    langs = sorted({x for _, x in rows})
    count = lambda items: {g: [sum(n for f, x, n in items if f == g and x == lang) for lang in langs] for g in {f for f, _, _ in items}}
    logs = lambda table: {g: [math.log((n + m.SMOOTH) / sum(r[k] + m.SMOOTH for r in table.values())) for k, n in enumerate(row)] for g, row in table.items()}
    split = lambda t: [w for w in re.split(r"[\x00-`{-\x7f]+", t.lower()) if any(c.isalpha() for c in w)]
    words = [(w, lang, 1) for t, lang in rows for w in split(t)]
    known = logs(count(words))
    grams = {n: logs(count([(f"^{w}$"[i : i + n], lang, 1) for w, lang, _ in words for i in range(len(w) + 3 - n)])) for n in range(1, m.NGRAM + 1)}
    out = []
    for t in texts:
        total = [0.0] * len(langs)
        for w in split(t or ""):
            row = known.get(w)
            for n in range(m.NGRAM, 0, -1):
                found = [grams[n][f"^{w}$"[i : i + n]] for i in range(len(w) + 3 - n) if f"^{w}$"[i : i + n] in grams[n]]
                if row is None and found:
                    row = [sum(c) / len(found) for c in zip(*found, strict=True)]
            total = [a + b for a, b in zip(total, row or [0.0] * len(langs), strict=True)]
        best = max(range(len(langs)), key=lambda k: (round(total[k], 9), -k))
        out.append((langs[best], 1 / sum(math.exp(x - total[best]) for x in total)) if split(t or "") else ("und", 0.0))
    return out


def test_query_equals_brute_force(spark, tmp_path):
    """op10 itself, on a table with null ids, texts and langs, empty, long and repeated texts, and ties."""
    rng = random.Random(9)
    vocab = {"de": ["und", "der", "straße", "hüte", "kind"], "en": ["and", "the", "street", "hats", "child"], "xx": ["zzz", "qqqq", "und"]}
    rows = [(k, " ".join(rng.choices(vocab[lang], k=6)), lang) for k in range(60) for lang in [rng.choice(list(vocab))]]
    rows += [(None, "the child and the hats", "en"), (60, None, "de"), (61, "", "en"), (62, "12 -- !", "de"), (63, "straßenkinder 9 hatstand", None), (64, "ω", "en"), (65, "ω", "xx"), (67, "the " * 3000 + "x", "en"), (67, "Ω", None)]
    rows += rows[:3]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'en' as lang_pred", "1 as source").write.parquet(f"{tmp_path}/documents.parquet")
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1
    learn = [(t, x) for i, t, x in rows if i is not None and not held(i) and t is not None and x is not None]
    want = sorted((str(i), held(i), p, f"{s:.6f}") for (i, t, _), (p, s) in zip(rows, brute(learn, [t for _, t, _ in rows]), strict=True))
    assert sorted((str(r.doc_id), r.held_out, r.lang_pred, f"{r.score:.6f}") for r in m.op10(spark, str(tmp_path)).collect()) == want


def test_ties_go_to_the_first_language(spark):
    model = m.Model({"b": {b"same": 2}, "a": {b"same": 2}})
    assert m.Scorer(model).predict(b"same") == ("a", 0.5)


def test_many_languages_keep_their_words(spark):
    """No language crowds out another, and of equally frequent words all or none stay."""
    rows = [(k, " ".join([chr(97 + k // 26) + chr(97 + k % 26) + "x"] * 3 + [f"w{chr(97 + j)}" for j in range(5)]), f"l{k:02}") for k in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = m.train(d, words=3)
    assert len(model.langs) == 40 and len(model.words) == 40
    assert len(m.train(d, words=6).words) == 45


def test_nothing_learned(spark):
    d = spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, lang string")
    assert m.identify(d.select("doc_id", "text"), m.train(d)).first().lang_pred == "und"
    assert m.identify(d.where("false").select("doc_id", "text"), m.train(d.where("false"))).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the driver's tables")
def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = m.op10(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.95 * len(got)
