"""Every query with SQL agrees with it on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from gleaner.functions.text import normal_form, sketch

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v):
    return f"{v:.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str([shown(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = con.sql(entry.oracle_sql()[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert sorted([shown(r[c]) for c in columns] for r in df.collect()) == sorted([shown(r[k]) for k in at] for r in found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns


def test_text_sketch_sums_unsigned_features(spark, tmp_path):
    """The mark is a sum of unsigned 64-bit hashes, of which a sketch holds some beyond a long; texts without features give no row."""
    texts = [None, "abcd", "abcde", "a longer text with many different hashes " * 3]
    spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for k, text in enumerate(texts):
        if len(f := sketch(normal_form(text or ""))):
            h = [int(x) for x in f]
            want[k] = (len(h), h[0] - 2**63, h[-1] - 2**63, sum(h) % 1000000007)
    got = {r.file_id: (r.n_features, r.least, r.greatest, r.mark) for r in entry.queries()["text_sketch"](spark, str(tmp_path)).collect()}
    assert got == want and set(got) == {2, 3}
