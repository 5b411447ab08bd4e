"""Exact top-k inner products by MaxScore over sharded postings.

A vector component is a term, and a shard's column its posting list. Shifted by
the least contribution that a term can make in the shard, scores are sums of
contributions from zero to a bound. Terms whose bounds together can't lift a
vector over the k-th best score that is known are non-essential: only the essential
postings are traversed, and the others, largest bound first, are probed just for
vectors that can still compete.

All shards start from a common threshold: the k-th best score of a query among
SEED_ROWS vectors, which the final k-th best can't be under. So a shard prunes from
its first block on, and hands over only what reaches the threshold. The shards'
best are merged by (score, smaller id).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import partitions, table
from .common import get_arrays, put_arrays

#: Vectors of a shard at most; there are as many shards as parts of an exchange, if that leaves LEAST_ROWS for each.
SHARD_ROWS, LEAST_ROWS = 8192, 1024
SEED_ROWS = 4096
BLOCK_ROWS = 2048
PROBE_TERMS = 16
#: Non-essential bounds sum to this share of what is needed at most; with less left open, most vectors fail the first test.
SLACK = 0.25
#: The threshold of a query for which the seed says nothing.
NO_BAR = -(2**63)


class Shard:
    """Postings of one shard, with the bounds of each; scores are exact in the type that is chosen for them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, peak: float):
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        widest = float(np.abs(vectors.astype(np.float64)).max(initial=0)) * max(1.0, peak) * max(1, vectors.shape[1])
        self.kind = np.float32 if widest < 2**23 else np.float64 if widest < 2**51 else np.int64
        self.sums = np.int64 if self.kind is np.int64 else np.float64
        self.postings = np.ascontiguousarray(vectors[order].T.astype(self.kind))
        self.high, self.low = (f(axis=1).astype(self.sums) for f in (self.postings.max, self.postings.min))

    def search(self, owns: np.ndarray, queries: np.ndarray, k: int, bars: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, scores) of the k best for each query, none under its bar; its own id is left out."""
        n = min(queries.shape[1], len(self.high))
        return [self._one(own, w, k, NO_BAR if bars is None else int(bars[q])) for q, (own, w) in enumerate(zip(owns.tolist(), queries[:, :n], strict=True))]

    def _one(self, own: int, weights: np.ndarray, k: int, bar: int) -> tuple[np.ndarray, np.ndarray]:
        n, kind = len(weights), self.sums
        w, wide = weights.astype(self.kind), weights.astype(kind)
        a, b = wide * self.high[:n], wide * self.low[:n]
        floor, bound = np.minimum(a, b), np.abs(a - b)
        base, order = floor.sum(), np.argsort(bound, kind="stable")
        sums = np.cumsum(bound[order])
        at, best = np.zeros(0, np.int64), np.zeros(0, kind)
        need, cut = None, -1
        for lo in range(0, len(self.ids), BLOCK_ROWS):
            known = bar if len(best) < k else max(bar, int(best[-1]))
            if known != NO_BAR and (need is None or known - base > need):
                need = known - base
            if cut < 0 or need is not None:
                cut = 0 if need is None else int(np.searchsorted(sums, SLACK * need, side="left"))
                essential = order[cut:]
                under = floor[essential].sum()
            found = (w[essential] @ self.postings[essential, lo : lo + BLOCK_ROWS]).astype(kind) - under
            rows = np.flatnonzero(found + (sums[cut - 1] if cut else 0) >= need) if need is not None else np.arange(len(found))
            rows = rows[self.ids[rows + lo] != own]
            found, left = found[rows], cut
            while left and len(rows):
                step = order[max(0, left - PROBE_TERMS) : left]
                found = found + (w[step] @ self.postings[np.ix_(step, rows + lo)]).astype(kind) - floor[step].sum()
                left = max(0, left - PROBE_TERMS)
                live = found + (sums[left - 1] if left else 0) >= need
                rows, found = rows[live], found[live]
            if len(rows):
                at, best = np.r_[at, rows + lo], np.r_[best, found + base]
                keep = np.lexsort((at, -best))[:k]
                at, best = at[keep], best[keep]
        return self.ids[at], best.astype(np.int64)


def _packed(rows: DataFrame, per: int) -> DataFrame:
    """(s, blob): up to `per` vectors of a shard in a row; shorter vectors end in zeros."""

    def run(batches):
        for b in batches:
            s, ids, keys = (b[c].to_numpy(zero_copy_only=False) for c in ("s", "vec_id", "key"))
            vectors = b["v"].to_pylist()
            for shard in np.unique(s):
                pick = np.flatnonzero(s == shard)
                for lo in range(0, len(pick), per):
                    own = pick[lo : lo + per]
                    width = max(len(vectors[i]) for i in own)
                    m = np.zeros((len(own), width), np.int64)
                    for row, i in enumerate(own):
                        m[row, : len(vectors[i])] = vectors[i]
                    small = next(t for t in (np.int8, np.int16, np.int32, np.int64) if m.size == 0 or (m.min() >= np.iinfo(t).min and m.max() <= np.iinfo(t).max))
                    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([put_arrays(ids[own], keys[own], np.array([width]), m.astype(small).ravel())], pa.binary())], ["s", "blob"])

    return rows.select("s", "vec_id", "key", "v").mapInArrow(run, "s int, blob binary")


def _unpack(column) -> list[tuple[np.ndarray, ...]]:
    """(ids, keys, vectors[, bars]) of each blob."""
    out = []
    for x in column.to_pylist():
        ids, keys, width, flat, *bars = get_arrays(x)
        out.append((ids, keys, flat.astype(np.int64).reshape(len(ids), int(width[0])), *bars))
    return out


def _peak(vectors: list[np.ndarray]) -> float:
    return max((float(np.abs(m.astype(np.float64)).max(initial=0)) for m in vectors), default=0.0)


def _shard(blobs: list[tuple[np.ndarray, ...]], peak: float) -> Shard:
    width = max(m.shape[1] for _, _, m, *_ in blobs)
    return Shard(np.concatenate([b[0] for b in blobs]), np.concatenate([np.pad(b[2], ((0, 0), (0, width - b[2].shape[1]))) for b in blobs]), peak)


def _barred(blocks: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Blocks of queries with a bar for each: the k-th best score among at most SEED_ROWS vectors."""
    some = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SEED_ROWS).withColumn("s", F.lit(0)).withColumn("key", F.lit(0).cast("long"))
    seed = vectors.sparkSession.sparkContext.broadcast([bytes(r[0]) for r in _packed(some, SEED_ROWS).select("blob").collect()])

    def run(batches):
        have = _unpack(pa.array(seed.value, pa.binary()))
        shards: dict[float, Shard] = {}
        for b in batches:
            out = []
            for ids, keys, m in _unpack(b["blob"]):
                peak = 2.0 ** np.ceil(np.log2(max(1.0, _peak([m]))))
                if have and peak not in shards:
                    shards[peak] = _shard(have, peak)
                found = shards[peak].search(ids, m, k) if have else [((), ())] * len(ids)
                bars = np.array([int(s[-1]) if len(s) == k else NO_BAR for _, s in found], np.int64)
                out.append(put_arrays(ids, keys, np.array([m.shape[1]]), m.ravel(), bars))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["blob"])

    return blocks.select("blob").mapInArrow(run, "blob binary")


def quantised(embeddings: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component; rows that take no part are left out."""
    x = F.col("embedding").cast("array<double>")
    fine = F.col("embedding").isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return embeddings.where(fine).where("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(scale * e)).alias("v"))


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 20, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of `vectors` for each row of `queries`.

    Both: (vec_id long, v array<long>). A candidate with the query's own vec_id is
    left out; ties go to the smaller vec_id. Vectors of another length count as
    ended by zeros. Equal query rows are asked once; unequal ones that share a
    vec_id are asked each. Empty inputs give no rows. Components and scores must
    fit a long, as their products do up to 2^31.
    """
    n = vectors.count()
    parts = partitions(vectors.sparkSession)
    shards = max(1, -(-n // shard_rows), min(parts, n // LEAST_ROWS))
    dealt = vectors.withColumn("s", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).withColumn("key", F.lit(0).cast("long"))
    asked = queries.dropDuplicates(["vec_id", "v"]).withColumn("key", F.xxhash64("v")).withColumn("s", F.lit(0))
    blocks = _barred(_packed(asked, 1024), vectors, k)
    blocks = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("s"), "blob")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[] for _ in range(4)]
        have, ask = _unpack(left["blob"]), _unpack(right["blob"])
        if have and ask:
            shard = _shard(have, _peak([a[2] for a in ask]))
            for qs, keys, m, bars in ask:
                for q, key, (i, s) in zip(qs.tolist(), keys.tolist(), shard.search(qs, m, k, bars), strict=True):
                    out[0].append(np.full(len(i), q))
                    out[1].append(np.full(len(i), key))
                    out[2].append(i)
                    out[3].append(s)
        return pa.table({c: pa.array(np.concatenate(v) if v else [], pa.int64()) for c, v in zip(("query_id", "key", "vec_id", "score"), out, strict=True)})

    # as many partitions as shards, which AQE doesn't merge for their few bytes
    sides = (x.repartition(max(shards, parts), "s").groupBy("s") for x in (_packed(dealt, 1024), blocks))
    found = next(sides).cogroup(next(sides)).applyInArrow(search, "query_id long, key long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8(spark, sf_dir):
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(vectors.where("vec_id % 20 = 0"), vectors, 20)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s) WHERE rank <= 20"""
