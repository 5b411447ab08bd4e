"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise, release


def _minimum(arcs: DataFrame) -> DataFrame:
    """(u, v, m): each arc with the least id among u and its neighbours."""
    least = arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return arcs.join(least, "u")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component): component is the smallest id that can be reached.

    Only ids of some edge occur; self-loops give a component of one. Null ends
    are ignored. Each round is two aggregations and two joins whose hubs AQE may
    split; rounds grow with the logarithm of the longest path. No link or label
    reaches the driver: the test for the end compares one row of sums.
    """
    now = materialise(
        edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b")).dropna().select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    loops = now.where("u = v").select("u")
    state = None
    while True:
        live = now.where("u <> v")
        both = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _minimum(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _minimum(large)
        step = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = materialise(step, "edges")
        mark = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state is not None:
            release(now.sparkSession, now)
        else:
            first = now
        now = new
        if mark == state:
            break
        state = mark
    stars = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component"))
    return stars.unionByName(roots).unionByName(first.where("u = v").select(F.col("u").alias("id"), F.col("u").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))
