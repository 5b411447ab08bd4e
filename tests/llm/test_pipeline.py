import random
import re
import zlib

import corpus_pipeline as p
import numpy as np
import pytest
from tokenizers import Tokenizer

from gleaner.llm import packing


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The stages of a small corpus, each written and read again."""
    rng = random.Random(12)
    words = [f"word{k}" for k in range(3000)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    passage, item = say(40), say(14)
    rows = [(k, say(80)) for k in range(60)]
    rows += [(100 + k, say(30) + " you idiot " + say(30)) for k in range(40)]
    rows += [(200, rows[3][1]), (201, rows[4][1] + " more"), (210, say(60) + passage), (211, passage + say(60)), (220, say(50) + " " + item + " " + say(50)), (221, item), (230, "é" * 200), (231, "x" + "é" * 200)]
    rows += [(240, None), (241, ""), (250, "tail " * 2000)]
    at = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k >= 100)) for k in [*range(30), *range(100, 130)]], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    docs, out = spark.read.parquet(f"{at}/documents.parquet"), []
    for k, (_, stage) in enumerate(p.STAGES):
        columns = docs.columns
        stage(spark, docs, str(at)).write.parquet(f"{at}/stage{k}")
        docs = spark.read.parquet(f"{at}/stage{k}")
        if k < len(p.STAGES) - 1:
            assert docs.columns == columns
        out.append([r.asDict() for r in docs.collect()])
    return dict(rows), passage, item, out


def test_each_stage_decides(stages):
    rows, passage, item, out = stages
    ids = [{r["doc_id"] for r in x} for x in out]
    assert not ids[0] & set(range(100, 140)) and set(range(60)) <= ids[0]
    assert {200, 201} & ids[0] == {200, 201} and not {200, 201} & ids[1] and set(range(60)) <= ids[1]
    text = [{r["doc_id"]: r["text"] for r in x} for x in out[:4]]
    assert passage in text[2][210] and passage not in text[2][211] and text[2][211] and len(text[2][250]) < 200
    assert item not in text[3][220] and 221 not in text[3] and text[3][0] == rows[0]
    assert all(r["n_chars"] == len(r["text"] or "") for r in out[3])
    assert ids[4] == ids[3]
    assert all(r["offset"] + r["length"] <= 1024 for r in out[4])


def test_run_equals_the_stages_on_an_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0


def test_other_columns_pass_through(spark, tmp_path):
    """Columns that bear the operators' own names keep their values; null ids and repeated rows pass every stage."""
    rng = random.Random(5)
    words = [f"word{k}" for k in range(2000)]
    rows = [(k if k else None, " ".join(rng.choices(words, k=60)), f"mine{k}", [f"i{k}"], f"kept{k}", k) for k in range(20)]
    rows += [rows[7], rows[7], (None, None, None, None, None, None), (30, "", "x", [], "y", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, toxicity string, items array<string>, kept string, `own 3` long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "a b c d e f g h i j k")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = {r[0]: (r[2], r[3], r[4], r[5]) for r in rows if r[1]}
    for k, (_, stage) in enumerate(p.STAGES[:-1]):
        columns = docs.columns
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        assert docs.columns == columns
        for r in docs.where("length(text) > 0").collect():
            assert (r.toxicity, r["items"], r.kept, r["own 3"]) == want[r.doc_id]
    assert p.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count() > 0


def brute(rows, toxic, items):
    """The stages from near-dedup on, by plain loops over ASCII texts; `toxic` ids are gone before."""
    docs = {i: t or "" for i, t in rows if i not in toxic}
    sets = {i: {tuple(w[k : k + 5]) for w in [t.lower().split()] for k in range(max(1, len(w) - 4))} for i, t in docs.items()}
    of = {i: i for i in docs}
    for a in docs:
        for b in docs:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((of[a], of[b]))
                of = {k: x if v == y else v for k, v in of.items()}
    docs = {i: t for i, t in docs.items() if of[i] == i}
    seen, cut = set(), {}
    for i in sorted(docs):
        t, gone = docs[i], [False] * len(docs[i])
        for s in range(len(t) - 99):
            if t[s : s + 100] in seen:
                gone[s : s + 100] = [True] * 100
            seen.add(t[s : s + 100])
        cut[i] = "".join(c for c, g in zip(t, gone, strict=True) if not g)
        if any(gone) and not cut[i].strip(" "):
            del cut[i]
    windows = set()
    for t in items:
        w = re.findall("[0-9a-z]+", t.lower())
        windows |= {tuple(w[k : k + min(10, len(w))]) for k in range(len(w) - min(10, len(w)) + 1)}
    left = {}
    for i, t in cut.items():
        spans = list(re.finditer("[0-9a-zA-Z]+", t))
        w = [x[0].lower() for x in spans]
        hit = set()
        for win in windows:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
        if len(hit) > 0.5 * len(w):
            continue
        out, at = "", 0
        for k in sorted(hit):
            if k - 1 not in hit:
                out += t[at : spans[k].start()]
            at = spans[k].end()
        left[i] = out + t[at:]
    code = Tokenizer.from_file(packing.default_tokenizer())
    return sorted((i, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for i, t in left.items() for ids in [code.encode(t, add_special_tokens=False).ids + [2]] for k, (s, n) in enumerate(packing.cut(len(ids), 1024)))


def test_run_equals_brute_force(spark, tmp_path):
    rng = random.Random(33)
    words = [f"word{k}" for k in range(900)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    items = [say(14), say(4), say(30)]
    base, passage = [say(rng.randint(20, 120)) for _ in range(30)], say(30)
    rows = [(k, t) for k, t in enumerate(base)]
    for k in range(25):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 1, 3])):
            w[rng.randrange(len(w))] = "edit"
        rows.append((100 + k, " ".join(w)))
    rows += [(200 + k, f"{say(20)} {passage[rng.randint(0, 40):]} {say(20)}") for k in range(8)]
    rows += [(300 + k, f"{say(rng.choice([2, 40]))}, {rng.choice(items).upper()}! {say(rng.choice([1, 30]))}") for k in range(12)]
    rows += [(400 + k, f"{say(15)} you idiot {say(15)}") for k in range(40)] + [(500, ""), (501, "x" * 5000), (502, say(3000))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k >= 400)) for k in [*range(30), *range(400, 430)]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = p.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, r.start, r["length"], r.ids_crc32) for r in got) == brute(rows, set(range(400, 440)), items)
    room = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == room.get(r.sequence_id, 0)
        room[r.sequence_id] = r.offset + r["length"]
    assert max(room.values()) <= 1024
