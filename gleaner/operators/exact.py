"""Exact duplicates: buckets by size and type, digests, groups and representatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.scalar import sha256_full, sha256_sampled, supports_phash
from ..storage import materialise


def bucket_candidates(files: DataFrame) -> DataFrame:
    """Files whose (size, media type) another file has too; only these need to be read."""
    sizes = files.groupBy("size_bytes", "media_type").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return files.join(sizes, ["size_bytes", "media_type"], "left_semi")


def _grouped(known: DataFrame, keys: list[str]) -> DataFrame:
    """known with members, group_id and recommended of its group by `keys`, without files that are alone."""
    best = F.struct("quality", (-F.col("file_id")).alias("t"))
    groups = known.groupBy(*keys).agg(F.count("*").alias("members"), F.min("file_id").alias("group_id"), F.max_by("file_id", best).alias("recommended")).where("members > 1")
    return known.join(groups, keys)


def exact_members(files: DataFrame, digest: Column) -> DataFrame:
    """files (file_id, path, media_type, size_bytes, quality) with their group's digest, group_id and confidence.

    A group is two or more files of one type, size and digest. Its id is its least
    file_id. Only files whose (type, size) another file has are read, once; their
    digests are a table, and no list of members is built. A column `content` is
    not passed on.
    """
    known = materialise(bucket_candidates(files).withColumn("digest", digest).drop("content"), "digests")
    return _grouped(known, ["media_type", "size_bytes", "digest"]).withColumn("confidence", F.lit(1.0))


def content_digests(files: DataFrame, kind: str, segment: int) -> DataFrame:
    """files without content but with `digest`, of the whole content or (kind "sampled") of its size and segments."""
    raw = F.col("content").cast("binary")
    return files.withColumn("digest", sha256_sampled(raw, segment) if kind == "sampled" else sha256_full(raw)).drop("content")


def tiered_members(files: DataFrame, settings: config.Settings, digests=content_digests) -> DataFrame:
    """exact_members() by tiers, of files (…[, content][, full_hash]).

    Below settings.sampled_from bytes the whole content is hashed; larger files by
    size and three segments, and only those that agree there are read whole, unless
    the settings leave it at that: videos in simple mode without verification, whose
    known whole hashes don't contradict each other. Such groups have confidence 0.99.
    `digests` reads: it maps (files, kind, segment size) to the files with a digest,
    null where a file can't be read; such files are in no group.
    """
    have = F.col("full_hash") if "full_hash" in files.columns else F.lit(None).cast("string")
    some = bucket_candidates(files).withColumn("full", have).drop("full_hash")
    held = [c for c in some.columns if c != "content"]
    large = F.col("size_bytes") >= settings.sampled_from
    small = some.where(~large & F.col("full").isNull())
    small = digests(small, "full", settings.segment_bytes).withColumn("full", F.col("digest")).unionByName(some.where(~large & F.col("full").isNotNull()).drop("content").withColumn("digest", F.col("full")))
    known = materialise(small.select(*held, F.lit(None).cast("string").alias("sampled")).unionByName(digests(some.where(large), "sampled", settings.segment_bytes).select(*held, F.col("digest").alias("sampled"))), "digests")
    keys = ["media_type", "size_bytes", "sampled"]
    facts = known.where("sampled IS NOT NULL").groupBy(*keys).agg(F.count("*").alias("n"), F.count("full").alias("known"), F.countDistinct("full").alias("kinds")).where("n > 1")
    trusted = F.lit(not settings.verify) & (F.col("media_type") == "video") & F.lit(settings.video_mode == "simple") & (F.col("kinds") < 2) & (F.col("known") < F.col("n"))
    met = known.join(facts, keys).withColumn("trusted", trusted)
    lacking = files.join(met.where("NOT trusted AND full IS NULL").select("file_id"), "file_id", "left_semi")
    read = digests(lacking, "full", settings.segment_bytes).select("file_id", F.col("digest").alias("now"))
    settled = met.join(read, "file_id", "left").withColumn("digest", F.when(F.col("trusted"), F.col("sampled")).otherwise(F.coalesce("full", "now"))).withColumn("confidence", F.when(F.col("trusted"), 0.99).otherwise(1.0))
    columns = [*(c for c in held if c != "full"), "digest", "confidence"]
    whole = known.where("sampled IS NULL").withColumn("digest", F.col("full")).withColumn("confidence", F.lit(1.0))
    every = materialise(whole.select(columns).unionByName(settled.select(columns)).where("digest IS NOT NULL"), "digests")
    return _grouped(every, ["media_type", "size_bytes", "digest"])


def tiered_confidence(members: DataFrame, verify: bool = False) -> DataFrame:
    """Groups by sampled digest (media_type, size_bytes, sampled, full?) that the full digests settle.

    Where verification is asked for, or known full digests differ, the full digest
    decides and the confidence is 1; where all are known and equal it is 1; else
    the sampled group stands at 0.99.
    """
    keys = ["media_type", "size_bytes", "sampled"]
    facts = members.groupBy(*keys).agg(F.count("*").alias("n"), F.count("full").alias("known"), F.countDistinct("full").alias("kinds"))
    by_full = F.lit(verify) | (F.col("kinds") >= 2) | (F.col("known") == F.col("n"))
    marked = members.join(facts.where("n > 1"), keys).withColumn("digest", F.when(by_full, F.col("full")).otherwise(F.col("sampled"))).withColumn("confidence", F.when(by_full, 1.0).otherwise(0.99))
    final = ["media_type", "size_bytes", "sampled", "digest"]
    return marked.where("digest IS NOT NULL").join(marked.groupBy(*final).agg(F.count("*").alias("m"), F.min("file_id").alias("group_id")).where("m > 1").drop("m"), final).drop("n", "known", "kinds")


def representatives(members: DataFrame) -> DataFrame:
    """(group_id, rep_id): the recommended file if it can be hashed perceptually, else the first that can, else it."""
    order = F.struct((~supports_phash("path")).alias("a"), (F.col("file_id") != F.col("recommended")).alias("b"), F.when(supports_phash("path"), F.col("file_id")).otherwise(F.lit(0)).alias("c"), F.col("file_id").alias("d"))
    return members.groupBy("group_id").agg(F.when(F.bool_or(supports_phash("path")), F.min_by("file_id", order)).otherwise(F.first("recommended")).alias("rep_id"))
