"""Toxicity by a counterfactual-regularised logistic classifier.

Features of a text are the presence of its words and of their beginnings. The
loss is the usual log loss plus, for every labelled text that names a group, a
penalty on the change of its score when the name is swapped for another of the
same kind, so a neutral mention of a group weighs nothing by itself.

The fit takes a bounded, documented sample of the labelled rows (SAMPLE_ROWS, by
hash of doc_id) and a bounded number of features; scoring covers every text whole.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise, table
from .common import get_arrays, lean, put_arrays, utf8

SAMPLE_ROWS = 24_000
MAX_FEATURES = 4_000
MEMO_WORDS = 300_000
THRESHOLD = 0.7
PENALTY = 4.0
#: Kinds of group names; a name is swapped for the next one of its kind.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("disabled", "deaf", "blind", "autistic"),
    ("old", "young", "elderly"),
)
SWAP = {a.encode(): kind[(k + 1) % len(kind)].encode() for kind in IDENTITY for k, a in enumerate(kind)}
LETTERS = bytes(c if 97 <= c <= 122 or c >= 0x80 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: bytes) -> set[bytes]:
    return set(text.decode("utf-8", "replace").lower().encode().translate(LETTERS).split())


def features_of(word: bytes) -> list[bytes]:
    """The word, and its beginnings of 3 to 9 bytes, marked by a final star."""
    return [word, *(word[:k] + b"*" for k in range(3, min(9, len(word)) + 1))]


def _known(words, index: dict[bytes, int]) -> set[int]:
    return {index[f] for w in words for f in features_of(w) if f in index}


def fit(rows: list[tuple[np.ndarray, int, np.ndarray]], n: int, penalty: float = PENALTY, steps: int = 300, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias from rows (feature ids, label, feature ids after the swap or none)."""
    w = np.zeros(n)
    if not rows:
        return w, -math.inf
    y = np.array([r[1] for r in rows], float)
    cols = np.concatenate([r[0] for r in rows]).astype(np.int64)
    at = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    pairs = [(r[0], r[2]) for r in rows if len(r[2]) or len(r[0])]
    pairs = [(a, b) for a, b in pairs if len(b)]
    d_cols = np.concatenate([np.zeros(0, np.int64), *(np.r_[a, b].astype(np.int64) for a, b in pairs)])
    d_sign = np.concatenate([np.zeros(0), *(np.r_[-np.ones(len(a)), np.ones(len(b))] for a, b in pairs)])
    d_at = np.repeat(np.arange(len(pairs)), [len(a) + len(b) for a, b in pairs])
    rate = (y.sum() + 0.5) / (len(y) + 1)
    b = math.log(rate / (1 - rate))
    sums, total = np.full(n, 1e-8), 1e-8
    for _ in range(steps):
        error = 1 / (1 + np.exp(-np.clip(np.bincount(at, w[cols], len(rows)) + b, -30, 30))) - y
        g = np.bincount(cols, error[at], n) / len(rows) + decay * w
        if len(pairs):
            change = np.bincount(d_at, d_sign * w[d_cols], len(pairs))
            g += penalty * np.bincount(d_cols, d_sign * change[d_at], n) / len(pairs)
        gb = error.mean()
        sums += g * g
        total += gb * gb
        w -= 0.3 * g / np.sqrt(sums)
        b -= 0.3 * gb / math.sqrt(total)
    return w, b


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS, features: int = MAX_FEATURES, penalty: float = PENALTY) -> tuple[dict[bytes, float], float]:
    """(weight by feature, bias) from docs (doc_id, text) and labels (doc_id, toxic).

    At most `sample` labelled ids take part, those of least hash; so the rows that
    are broadcast and what the driver fits have a fixed bound. A doc_id with
    several labels counts as toxic if any says so.
    """
    spark = docs.sparkSession
    marked = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    kept = spark.createDataFrame(chosen.collect(), chosen.schema)
    rows = materialise(docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(kept), "doc_id").select("text", "toxic"), "labelled")

    def count(batches):
        seen: dict[bytes, list[int]] = {}
        n = [0, 0]
        for b in batches:
            for t, y in zip(utf8(b["text"]), b["toxic"].to_pylist(), strict=True):
                n[y] += 1
                for f in {f for w in words_of(t) for f in features_of(w)}:
                    seen.setdefault(f, [0, 0])[y] += 1
        keys = [b"", *seen]
        held = [n, *seen.values()]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([v[0] for v in held], pa.int64()), pa.array([v[1] for v in held], pa.int64())], ["f", "no", "yes"])

    counts = rows.mapInArrow(count, "f binary, no long, yes long").groupBy("f").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes"))
    totals = rows.agg(F.count_if(F.col("toxic") == 0), F.count_if(F.col("toxic") == 1)).first()
    no, yes = F.col("no") + 0.5, F.col("yes") + 0.5
    z = F.abs(F.log(yes / (totals[1] + 1)) - F.log(no / (totals[0] + 1))) / F.sqrt(1 / yes + 1 / no)
    best = counts.where(F.length("f") > 0).where(F.col("no") + F.col("yes") >= 3).orderBy(F.desc(z), "f").limit(features)
    names = [bytes(r[0]) for r in best.select("f").collect()]
    names = sorted({*names, *SWAP})
    index = {f: i for i, f in enumerate(names)}
    held = spark.sparkContext.broadcast(index)

    def encode(batches):
        known = held.value
        for b in batches:
            out = []
            for t, y in zip(utf8(b["text"]), b["toxic"].to_pylist(), strict=True):
                words = words_of(t)
                other = _known({SWAP.get(w, w) for w in words}, known) if not SWAP.keys().isdisjoint(words) else ()
                out.append(put_arrays(np.array(sorted(_known(words, known)), np.int32), np.array([y], np.int8), np.array(sorted(other), np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["x"])

    coded = [get_arrays(r[0]) for r in rows.mapInArrow(encode, "x binary").collect()]
    held.destroy()
    w, b = fit(sorted(((x, int(y[0]), s) for x, y, s in coded), key=lambda r: (r[1], r[0].tobytes())), len(index), penalty)
    return {f: float(v) for f, v in zip(names, w, strict=True) if v}, b


def score(docs: DataFrame, model: tuple[dict[bytes, float], float]) -> DataFrame:
    """docs' columns and `toxicity`, the probability of label 1, from the text alone.

    Null and empty texts get what the bias gives; without labels to learn from all
    get 0. Repeated rows score alike. A column named toxicity is replaced.
    """
    docs = docs.drop("toxicity")
    weights, bias = model
    held = docs.sparkSession.sparkContext.broadcast(weights)
    kept = docs.schema

    def run(batches):
        known = held.value
        memo: dict[bytes, tuple] = {}
        for b in batches:
            if len(memo) > MEMO_WORDS:
                memo.clear()
            out = []
            for t in utf8(b["text"]):
                hit = set()
                for w in words_of(t):
                    got = memo.get(w)
                    if got is None:
                        got = memo[w] = tuple(f for f in features_of(w) if f in known)
                    if got:
                        hit.update(got)
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, bias + math.fsum(known[f] for f in hit))))) if bias > -math.inf else 0.0)
            yield pa.RecordBatch.from_arrays([*(b[c] for c in kept.names), pa.array(out, pa.float64())], [*kept.names, "toxicity"])

    return docs.mapInArrow(lean(run), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields) + ", toxicity double")


def remainder(column: str, by: int):
    return F.crc32(F.col(column).cast("string").cast("binary")) % by


def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs.where(remainder("doc_id", 3) != 1), table(spark, sf_dir, "labels").where(remainder("doc_id", 3) != 1))
    found = score(docs, model)
    return found.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))
