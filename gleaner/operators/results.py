"""Questions about stored groups: lists, details, totals, and reports as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import hamming, human_bytes, similarity_text


def list_groups(groups: DataFrame, items: DataFrame, status: str = "pending", group_type: str | None = None, search: str | None = None, offset: int = 0, limit: int = 0, sort: str = "stored") -> DataFrame:
    """One row per group with members, reclaimable_bytes and media_kind, best confidence first.

    items has media_type. search is found in any member's path, in either case. A
    limit of 0 is none. sort: stored, confidence, size (reclaimable bytes), members,
    or anything else for the ids.
    """
    g = groups if status == "all" else groups.where(F.col("status") == status)
    if group_type:
        g = g.where(F.col("group_type") == group_type)
    if search:
        g = g.join(items.where(F.contains(F.lower("path"), F.lit(search.lower()))).select("group_id"), "group_id", "left_semi")
    kinds = [F.bool_or(F.col("media_type") == k) for k in ("image", "video", "text")]
    how_many = sum((k.cast("int") for k in kinds), F.lit(0))
    kind = F.when(how_many > 1, "mixed").when(kinds[0], "image").when(kinds[1], "video").when(kinds[2], "text")
    facts = items.join(g.select("group_id", "recommended_file_id"), "group_id").groupBy("group_id").agg(F.count("*").alias("members"), F.sum(F.when((F.col("recommended_file_id") > 0) & (F.col("file_id") != F.col("recommended_file_id")), F.col("size_bytes")).otherwise(0)).alias("reclaimable_bytes"), kind.alias("media_kind"))
    out = g.join(facts, "group_id").select("group_id", "group_type", "confidence", "recommended_file_id", "status", "members", "reclaimable_bytes", "media_kind")
    first = {"stored": "confidence", "confidence": "confidence", "size": "reclaimable_bytes", "members": "members"}.get(sort)
    out = out.orderBy(*([F.desc(first)] if first else []), "group_id")
    out = out.offset(offset) if offset > 0 else out
    return out.limit(limit) if limit > 0 else out


def summary(groups: DataFrame, items: DataFrame) -> DataFrame:
    """One row: groups, exact, similar (images and videos), pending, and reclaimable bytes of pending groups."""
    sizes = items.join(groups.where("status = 'pending' AND recommended_file_id > 0").select("group_id", "recommended_file_id"), "group_id").where("file_id <> recommended_file_id").agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("reclaimable_bytes"))
    counts = groups.agg(F.count("*").alias("groups"), F.count_if(F.col("group_type") == "exact").alias("exact"), F.count_if(F.col("group_type").isin("similar_image", "similar_video")).alias("similar"), F.count_if(F.col("status") == "pending").alias("pending"))
    return counts.join(F.broadcast(sizes))  # one row each


def group_detail(groups: DataFrame, items: DataFrame, facts: DataFrame) -> DataFrame:
    """Members with their facts (file_id, width, height, phash) and hash distance to the winner."""
    own = items.join(facts, "file_id", "left")
    best = groups.select("group_id", "recommended_file_id").join(facts.select(F.col("file_id").alias("recommended_file_id"), F.col("phash").alias("best")), "recommended_file_id", "left")
    return own.join(best, "group_id").withColumn("distance", hamming("phash", "best")).drop("best")


def report_lines(groups: DataFrame, items: DataFrame) -> DataFrame:
    """(group_id, n, line): a text report's lines of members, in order."""
    mark = F.when(F.col("action") == "keep_recommended", "+").when(F.col("action") == "cleanup_candidate", "-").otherwise("?")
    rows = items.join(groups.select("group_id"), "group_id", "left_semi")
    return rows.select("group_id", "file_id", F.concat(mark, F.lit(" "), "path", F.lit(" sim="), similarity_text("similarity"), F.lit(" "), human_bytes("size_bytes")).alias("line"))


def report_totals(items: DataFrame) -> DataFrame:
    gone = F.col("action") == "cleanup_candidate"
    return items.agg(F.count_if(F.col("action") == "keep_recommended").alias("keep"), F.count_if(gone).alias("cleanup"), F.coalesce(F.sum(F.when(gone, F.col("size_bytes"))), F.lit(0)).alias("cleanup_bytes"))


def final_counters(groups: DataFrame) -> DataFrame:
    """One row: exact and similar groups of the final result."""
    return groups.agg(F.count_if(F.col("group_type") == "exact").alias("exact"), F.count_if(F.col("group_type") != "exact").alias("similar"))


def split_errors(errors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(skipped, aux): errors by kind; without one, a file was skipped."""
    kind = F.coalesce(F.nullif("kind", F.lit("")), F.lit("skipped"))
    return errors.where(kind != "aux"), errors.where(kind == "aux")


def load_errors(errors: DataFrame, run_id: int | None = None) -> DataFrame:
    """(path, stage, kind, message) of a run, or of all, in the order they were recorded (error_id)."""
    rows = errors if run_id is None else errors.where(F.col("scan_run_id") == run_id)
    return rows.orderBy("error_id").select("path", "stage", F.coalesce("kind", F.lit("skipped")).alias("kind"), "message")


def latest_run(runs: DataFrame) -> DataFrame:
    """One row: the last scan_run_id, null if there is none."""
    return runs.agg(F.max("scan_run_id").alias("scan_run_id"))


def order_projects(projects: DataFrame) -> DataFrame:
    """Projects (last_scan_at, created_at) by last scan, latest first; those never scanned come last, the newest first."""
    never = F.col("last_scan_at").isNull()
    return projects.orderBy(never, F.desc("last_scan_at"), F.when(never, F.col("created_at")).desc())


def recent_folders(folders: DataFrame, limit: int = 20) -> DataFrame:
    """The folders (path, last_used_at) used last."""
    return folders.orderBy(F.desc("last_used_at"), "path").limit(limit if limit > 0 else 20)
