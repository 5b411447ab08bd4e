"""Result maintenance across scans: manifests, statuses, replacement, pruning and recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .groups import CLEANUP, KEEP, REVIEW


def incremental_status(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change, size_bytes, mtime_ns, status): the next manifest from (path, size_bytes, mtime_ns, status) and a listing.

    change: unchanged (features are reused), changed and added (they are computed),
    missing (kept, but not active).
    """
    o = old.select("path", F.col("size_bytes").alias("s0"), F.col("mtime_ns").alias("m0"), F.col("status").alias("st0"))
    both = o.join(new.select("path", "size_bytes", "mtime_ns", F.lit(True).alias("here")), "path", "full_outer")
    same = (F.col("s0") == F.col("size_bytes")) & (F.col("m0") == F.col("mtime_ns")) & (F.col("st0") == "active")
    change = F.when(F.col("here").isNull(), "missing").when(F.col("s0").isNull(), "added").when(same, "unchanged").otherwise("changed")
    return both.select("path", change.alias("change"), F.coalesce("size_bytes", "s0").alias("size_bytes"), F.coalesce("mtime_ns", "m0").alias("mtime_ns"), F.when(F.col("here").isNull(), "missing").otherwise("active").alias("status"))


def carry_features(features: DataFrame, manifest: DataFrame) -> DataFrame:
    """Features (keyed by path) of unchanged files."""
    return features.join(manifest.where("change = 'unchanged'").select("path"), "path", "left_semi")


def replace_groups(groups: DataFrame, before: DataFrame) -> DataFrame:
    """groups (stable_key, status?) with status and times of the group of equal stable key before, else pending."""
    prev = before.select("stable_key", F.col("status").alias("p"), F.col("ignored_at").alias("pi"), F.col("processed_at").alias("pp"))
    own = F.col("status") if "status" in groups.columns else F.lit(None).cast("string")
    joined = groups.withColumn("own", own).drop("status", "ignored_at", "processed_at").join(prev, "stable_key", "left")
    taken = F.col("own").isNull()
    return joined.withColumn("status", F.coalesce("own", "p", F.lit("pending"))).withColumn("ignored_at", F.when(taken, F.col("pi"))).withColumn("processed_at", F.when(taken, F.col("pp"))).drop("own", "p", "pi", "pp")


def set_status(groups: DataFrame, ids: DataFrame, status: str, now) -> DataFrame:
    """A status for the groups of ids; only its own time is set."""
    if status not in ("pending", "ignored", "processed"):
        raise ValueError(f"unknown status {status!r}")
    hit = F.col("hit").isNotNull()
    out = groups.join(ids.select("group_id", F.lit(1).alias("hit")).distinct(), "group_id", "left")
    for kind in ("ignored", "processed"):
        out = out.withColumn(f"{kind}_at", F.when(hit, now if status == kind else F.lit(None).cast("timestamp")).otherwise(F.col(f"{kind}_at")))
    return out.withColumn("status", F.when(hit, status).otherwise(F.col("status"))).drop("hit")


def set_recommended(groups: DataFrame, items: DataFrame, picks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """picks (group_id, file_id): the new winner is kept and all others are cleaned up; picks that are no member change nothing."""
    p = picks.join(items.select("group_id", "file_id"), ["group_id", "file_id"], "left_semi").select("group_id", F.col("file_id").alias("pick"))
    out = groups.join(p, "group_id", "left").withColumn("recommended_file_id", F.coalesce("pick", "recommended_file_id")).drop("pick")
    kinds = groups.select("group_id", "group_type")
    rows = items.join(p, "group_id", "left").join(kinds, "group_id")
    won, hit = F.col("file_id") == F.col("pick"), F.col("pick").isNotNull()
    rows = rows.withColumn("action", F.when(~hit, F.col("action")).when(won, KEEP).otherwise(CLEANUP)).withColumn("similarity", F.when(~hit | (F.col("group_type") == "exact"), F.col("similarity")).when(won, 1.0).otherwise(-1.0))
    return out, rows.select(items.columns)


def prune_groups(groups: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups of fewer than two go; lost winners are picked again; a stale keep is demoted, a new one promoted unless something needs review."""
    alive = items.groupBy("group_id").agg(F.count("*").alias("n"), F.max_by("file_id", F.struct("quality", (-F.col("file_id")).alias("t"))).alias("best"), F.bool_or(F.col("action") == REVIEW).alias("review")).where("n > 1")
    there = items.select("group_id", F.col("file_id").alias("recommended_file_id"), F.lit(True).alias("there"))
    g = groups.join(alive, "group_id").join(there, ["group_id", "recommended_file_id"], "left").withColumn("lost", F.col("there").isNull()).withColumn("recommended_file_id", F.when(F.col("there").isNull(), F.col("best")).otherwise(F.col("recommended_file_id")))
    rows = items.join(g.select("group_id", "recommended_file_id", "lost", "review", "group_type"), "group_id")
    won = F.col("file_id") == F.col("recommended_file_id")
    rows = rows.withColumn("action", F.when((F.col("action") == KEEP) & ~won, CLEANUP).when(won & F.col("lost") & ~F.col("review"), KEEP).otherwise(F.col("action")))
    rows = rows.withColumn("similarity", F.when(~F.col("lost") | (F.col("group_type") == "exact"), F.col("similarity")).when(won, 1.0).otherwise(-1.0))
    return g.select(groups.columns), rows.select(items.columns)


def delete_paths(groups: DataFrame, items: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of these paths go, and what then has fewer than two members."""
    return prune_groups(groups, items.join(paths.select("path"), "path", "left_anti").select(items.columns))


def delete_guard(items: DataFrame, request: DataFrame) -> DataFrame:
    """(group_id, left): groups in which a request (file_id) would leave no file."""
    asked = items.join(request.select("file_id", F.lit(1).alias("gone")).distinct(), "file_id", "left")
    return asked.groupBy("group_id").agg(F.count_if(F.col("gone").isNull()).alias("left"), F.count("gone").alias("asked")).where("left = 0 AND asked > 0").select("group_id", "left")


def touch(manifest: DataFrame, paths: DataFrame, now) -> DataFrame:
    """manifest (path, status, last_seen, …): these paths were seen now and are active."""
    seen = paths.select("path", F.lit(True).alias("seen")).distinct()
    hit = F.col("seen").isNotNull()
    return manifest.join(seen, "path", "left").withColumn("last_seen", F.when(hit, now).otherwise(F.col("last_seen"))).withColumn("status", F.when(hit, "active").otherwise(F.col("status"))).select(manifest.columns)


def upsert(old: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """Rows of new, and those of old whose key new doesn't have; so all rows of a key are replaced together."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(old.columns).unionByName(new.select(old.columns))


#: Sampled digests bear the version of the sampling, so that old ones never match new ones.
SAMPLING = "v1:"


def save_hashes(old: DataFrame, full: DataFrame, sampled: DataFrame) -> DataFrame:
    """hashes (path, size_bytes, full_hash, sampled_hash, algorithm) with new full and sampled digests (path, size_bytes, digest).

    A digest replaces its own kind only. The algorithm is sha256 where a full digest
    is known, else sha256-sampled.
    """
    f = full.select("path", F.col("size_bytes").alias("fs"), F.col("digest").alias("f"))
    s = sampled.select("path", F.col("size_bytes").alias("ss"), F.concat(F.lit(SAMPLING), "digest").alias("s"))
    both = old.join(f, "path", "full_outer").join(s, "path", "full_outer")
    whole = F.coalesce("f", "full_hash")
    return both.select("path", F.coalesce("ss", "fs", "size_bytes").alias("size_bytes"), whole.alias("full_hash"), F.coalesce("s", "sampled_hash").alias("sampled_hash"), F.when(F.coalesce(whole, F.lit("")) != "", "sha256").otherwise("sha256-sampled").alias("algorithm"))


def load_hashes(hashes: DataFrame) -> DataFrame:
    """(path, full_hash, sampled_hash): digests that can be used now; sampled ones of this sampling only."""
    of_now = F.startswith("sampled_hash", F.lit(SAMPLING))
    return hashes.select("path", F.nullif("full_hash", F.lit("")).alias("full_hash"), F.when(of_now, F.substr("sampled_hash", F.lit(len(SAMPLING) + 1))).alias("sampled_hash"))


def group_members(groups: DataFrame, items: DataFrame, ids: DataFrame) -> DataFrame:
    """(group_id, file_id, path) of the asked groups' members without their winners: what may be deleted."""
    asked = groups.join(ids.select("group_id").distinct(), "group_id", "left_semi").select("group_id", "recommended_file_id")
    return items.join(asked, "group_id").where("file_id <> recommended_file_id").select("group_id", "file_id", "path")


def delete_effects(groups: DataFrame, items: DataFrame, outcome: DataFrame, alive: DataFrame, mode: str, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(audit, processed) after a deletion: audit rows (mode, group_id, file_id, path, ok, message), and group_ids now processed.

    outcome: (path, ok, message) of the request; alive: (path) of files that are
    still there. A group is processed if something of it was deleted and at least
    one member, but not all, is left. With `ids` only those groups count.
    """
    wanted = items if ids is None else items.join(ids.select("group_id").distinct(), "group_id", "left_semi")
    rows = wanted.join(groups.select("group_id"), "group_id", "left_semi").join(outcome.select("path", "ok", "message").dropDuplicates(["path"]), "path", "left")
    audit = rows.where("ok IS NOT NULL").select(F.lit(mode).alias("mode"), "group_id", "file_id", "path", "ok", F.when(F.col("ok"), "").otherwise(F.coalesce("message", F.lit(""))).alias("message"))
    there = rows.join(alive.select("path", F.lit(True).alias("there")).distinct(), "path", "left")
    gone = F.coalesce("ok", F.lit(False))
    counts = there.groupBy("group_id").agg(F.count("*").alias("members"), F.count_if(gone).alias("deleted"), F.count_if(~gone & F.col("there")).alias("left"))
    return audit, counts.where("deleted > 0 AND left >= 1 AND left < members").select("group_id")
