"""The corpus pipeline: five stages over `documents`, each written and read again.

A stage is (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame. All but the last return the columns of docs; columns besides doc_id,
text and n_chars pass through unread. Null ids, repeated rows, null and empty texts
are handled as each operator states; rows that share a doc_id stay or go one by one,
but near-dedup takes them as one document. Tables that a stage materialises are deleted when the next stage begins, since its docs have been
written by then; so write a stage's result before calling another.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import decontaminate, packing, simhash, suffixes, toxicity
from gleaner.storage import owned, release, shared_dir, table

OWNER = "pipeline"
#: What the stages read and write; other columns pass through whatever they are called.
READ = ("doc_id", "text", "n_chars")


def _aside(docs: DataFrame) -> DataFrame:
    """docs with its other columns under names that no operator uses."""
    return docs.select(*(F.col(f"`{c}`").alias(c if c in READ else f"own {k}") for k, c in enumerate(docs.columns)))


def _back(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, from what was made of _aside(docs)."""
    return found.select(*(F.col(c if c in READ else f"`own {k}`").alias(c) for k, c in enumerate(docs.columns)))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled rows, scores below its threshold."""
    release(spark, owner=OWNER)
    model = toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return _back(toxicity.score(_aside(docs), model).where(F.col("toxicity") < toxicity.THRESHOLD), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of smallest doc_id, of each group of near copies: met by SimHash, checked by 5-word shingles (similarity 0.8)."""
    release(spark, owner=OWNER)
    with owned(OWNER):
        return simhash.drop_near_duplicates(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 100 bytes that also start earlier; texts with nothing left go.

    A character of which a removed passage takes a part goes whole, and so do
    replacement characters in a text that loses something. A null text becomes empty.
    """
    release(spark, owner=OWNER)
    with owned(OWNER):
        found = suffixes.dedup_substrings(_aside(docs), columns=True)
    whole = F.col("n_removed") == 0
    text = F.col("kept").cast("string")
    out = found.withColumn("text", F.when(whole, text).otherwise(F.replace(F.make_valid_utf8(text), F.lit("\ufffd"), F.lit(""))))
    out = out.where(whole | (F.length(F.trim("text")) > 0))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast("long"))
    return _back(out, docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark windows; documents of which these are over half go."""
    release(spark, owner=OWNER)
    found = decontaminate.decontaminate(_aside(docs), table(spark, sf_dir, "benchmark"))
    out = found.where(~F.col("rejected")).withColumn("text", F.col("clean_text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast("long"))
    return _back(out, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 ids."""
    release(spark, owner=OWNER)
    with owned(OWNER):
        return packing.pack(docs.select("doc_id", "text"), keep_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]
ORACLE_SQL = None  # the stages learn, sort and tokenise; they are tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
