"""Stable keys of groups, without a list of their members."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame

from ..storage import partitions


def stable_keys(items: DataFrame) -> DataFrame:
    """(group_id, stable_key) of items (group_id, group_type, path).

    The paths of a group stream by in order, and the hash takes them one by one; so
    a group is one task's, as its key is one value, but is never held in memory.
    """

    def run(batches):
        now, state, count = None, None, 0

        def told(keys):
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.int64()), pa.array([x for _, x in keys], pa.string())], ["group_id", "stable_key"])

        for b in batches:
            done = []
            for g, kind, path in zip(b["group_id"].to_pylist(), b["group_type"].to_pylist(), b["path"].to_pylist(), strict=True):
                if state is None or g != now:
                    if state is not None:
                        done.append((now, state.hexdigest()[:32]))
                    now, state, count = g, hashlib.sha256(f"{kind}|".encode()), 0
                state.update(("|" * (count > 0) + (path or "").lower()).encode())
                count += 1
            yield told(done)
        if state is not None:
            yield told([(now, state.hexdigest()[:32])])

    rows = items.select("group_id", "group_type", "path")
    return rows.repartition(partitions(items.sparkSession), "group_id").sortWithinPartitions("group_id", "path").mapInArrow(run, "group_id long, stable_key string")
