import random
import re

import duckdb
import pandas as pd

from gleaner.llm import decontaminate as m


def brute(docs, items):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda x: x[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        w = find(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, got = find(t), set(), set()
        for win, who in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    got |= who
        out.append((str(i), len(w), len(hit), m.digest(sorted(got))))
    return sorted(out)


def cases():
    rng = random.Random(2)
    w = [f"w{k}" for k in range(4)] + ["été", "x1"]
    items = [(k, " ".join(rng.choice(w) for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 25])))) for k in range(12)] + [(90, None), (91, "w0 w0 w0 w0 w0 w0 w0 w0 w0 w0 w0 w0"), (92, "Only-Here, twice"), (92, "again only here")]
    docs = [(k, "-".join(rng.choice(w).upper() for _ in range(rng.randint(0, 90)))) for k in range(40)] + [(k + 100, f"q {t}! zz {t}") for k, t in items] + [(200, None), (200, ""), (None, "w0 " * 30), (201, "w0 " * 30), (201, "w0 " * 30)]
    return docs, items


def test_brute_force_and_sql(spark):
    docs, items = cases()
    for limit in (10**6, 20):
        d, b = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n_words", "'x' as lang"), spark.createDataFrame(items, "item_id long, text string")
        got = m.decontaminate(d, b, shard_words=limit).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, m.digest(r["items"])) for r in got) == brute(docs, items)
    con = duckdb.connect()
    documents, benchmark = pd.DataFrame(docs, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}), pd.DataFrame(items, columns=["item_id", "text"])  # noqa: F841
    sql = con.sql(m.SQL).fetchall()
    assert sorted((str(r[0]), r[1], r[2], r[4]) for r in sql) == brute(docs, items)


def test_removal_keeps_the_rest(spark):
    item = " ".join(f"b{k}" for k in range(12))
    d = spark.createDataFrame([(1, f"Before, this. {item.upper()}! After {'clean ' * 30}"), (2, item), (3, "clean")], "doc_id long, text string")
    got = {r.doc_id: r for r in m.decontaminate(d, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got[1].clean_text == f"Before, this. ! After {'clean ' * 30}" and not got[1].rejected
    assert got[2].clean_text == "" and got[2].rejected
    assert got[3].clean_text == "clean" and got[3].n_hit == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert m.decontaminate(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), none).first().n_hit == 0
    assert m.decontaminate(spark.createDataFrame([], "doc_id long, text string"), none).count() == 0


def test_null_item_ids_are_one_item(spark):
    items = [(None, "a b c"), (None, "d e f"), ("null", "g h i"), ("z", "j k l")]
    for limit in (10**6, 1):
        d = spark.createDataFrame([(1, "a b c x d e f"), (2, "a b c g h i j k l")], "doc_id long, text string")
        got = {r.doc_id: r["items"] for r in m.decontaminate(d, spark.createDataFrame(items, "item_id string, text string"), shard_words=limit).collect()}
        assert got == {1: [None], 2: [None, "null", "z"]}
