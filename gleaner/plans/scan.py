"""The whole scan: exact pass, similarity passes over representatives, fusion, uniqueness and stored results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions.scalar import hash_similarity, image_quality, max_hamming, quality, video_quality
from ..functions.text import text_facts
from ..functions.video import video_similarity
from ..operators import alike, exact, groups, keys, pairs
from ..operators.ordering import ordered
from ..sources import files as sources
from ..sources import media
from ..storage import materialise


def _numbered(found: DataFrame, items: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Groups and items with group_id from 1 in the order of (type, least file id); `key` told them apart before."""
    rank = F.array_position(F.array(*(F.lit(t) for t in config.TYPE_ORDER)), F.col("group_type"))
    least = found.join(items.groupBy(key).agg(F.min("file_id").alias("least")), key).withColumn("rank", rank)
    fresh = ordered(least.withColumn("key", F.col(key)).drop("group_id"), [], [F.col("rank"), F.col("least")])
    fresh = materialise(fresh.withColumn("group_id", F.col("k").cast("long")).drop("rank", "least", "k", "n"), "groups")
    rows = items.withColumn("key", F.col(key)).drop("group_id").join(fresh.select("key", "group_id"), "key")
    return fresh, rows


def scan(files: DataFrame, settings: config.Settings = config.Settings(), image_facts: DataFrame | None = None, video_facts: DataFrame | None = None, failed: DataFrame | None = None, digests=exact.content_digests, texts=lambda files: files) -> tuple[DataFrame, DataFrame]:
    """(groups, items) of files (file_id, path, media_type, size_bytes, quality[, content][, full_hash]).

    Without a column `content`, `digests` (see exact.tiered_members) and `texts`,
    which adds it to text files, read the files by path.

    image_facts: (file_id, width, height, phash); video_facts: (file_id, duration_ms,
    width, height, frames), used in precise mode only. Of an exact group only its
    representative goes on to the similarity passes. Files of `failed` (file_id)
    leave their groups, and no path or file is in two groups. Groups are numbered
    by (type, least file id).
    """
    files = files.where(F.col("media_type").isin(*settings.media))
    members = materialise(exact.tiered_members(files, settings, digests), "members")
    reps = materialise(exact.representatives(members), "reps")
    ex = members.select("group_id", F.col("recommended").alias("recommended_file_id"), "confidence").distinct()
    siblings = members.select("file_id").join(reps.select(F.col("rep_id").alias("file_id")), "file_id", "left_anti")
    alone = files.join(siblings, "file_id", "left_anti")
    slim = alone.select("file_id", "path", "size_bytes", "quality")
    found = []
    if "text" in settings.media:
        plain = alone.where("media_type = 'text'")
        facts = materialise(text_facts(texts(plain), alike.FACTS), "facts")
        edges = materialise(alike.text_edges(facts, lambda wanted: texts(plain.join(wanted, "file_id", "left_semi")).select("file_id", "content"), settings.text_threshold), "edges")
        g, i = groups.text_groups(facts, edges)
        found.append((g, i.join(slim.select("file_id", "quality"), "file_id")))
    if image_facts is not None and "image" in settings.media:
        own = image_facts.join(slim.select("file_id"), "file_id").withColumnRenamed("file_id", "image_id")
        near = pairs.radius_pairs(own, max_hamming(settings.threshold)).select("src", "dst", (1 - F.col("distance") / 64).alias("sim")).where(F.col("sim") >= settings.threshold)
        found.append(groups.groups_from_edges(materialise(near, "edges"), slim, "similar_image", settings.review_delta))
    if video_facts is not None and "video" in settings.media and settings.video_mode == "precise":
        own = video_facts.join(slim.select("file_id"), "file_id")
        near = pairs.duration_pairs(own.select(F.col("file_id").alias("video_id"), "duration_ms", "width", "height"))
        both = near.join(own.select(F.col("file_id").alias("src"), F.col("frames").alias("a")), "src").join(own.select(F.col("file_id").alias("dst"), F.col("frames").alias("b")), "dst")
        sims = both.select("src", "dst", video_similarity("a", "b", settings.frames).alias("sim")).where(F.col("sim") >= settings.threshold)
        found.append(groups.groups_from_edges(materialise(sims, "edges"), slim, "similar_video", settings.review_delta))
    names = ["group_id", "file_id", "path", "action", "similarity", "quality", "size_bytes"]
    heads = ["group_id", "group_type", "confidence", "recommended_file_id"]
    exact_items = groups.choose_actions(members.select("group_id", "file_id", "path", "quality", "size_bytes"), -1.0).withColumn("similarity", F.lit(1.0))
    exact_groups = ex.withColumn("group_type", F.lit("exact"))
    out_g, out_i, absorbed = [], [], None
    for g, i in found:
        fg, fi, gone = groups.fuse_exact(g.select(heads), i.select(names), ex, members, reps)
        out_g.append(fg.select(heads))
        out_i.append(fi.select(names).withColumn("group_type", F.lit(None).cast("string")))
        absorbed = gone if absorbed is None else absorbed.unionByName(gone)
    if absorbed is not None:
        absorbed = materialise(absorbed.distinct(), "absorbed")
        exact_groups, exact_items = exact_groups.join(absorbed, "group_id", "left_anti"), exact_items.join(absorbed, "group_id", "left_anti")
    tagged = [(exact_groups.select(heads), exact_items.select(names), "exact")] + [(g, i.select(names), f"s{k}") for k, (g, i) in enumerate(zip(out_g, out_i, strict=True))]
    all_g = all_i = None  # ids are unique within a type only
    for g, i, t in tagged:
        g, i = (x.withColumn("own", F.concat_ws("/", F.lit(t), "group_id")) for x in (g, i))
        all_g, all_i = (g, i) if all_g is None else (all_g.unionByName(g), all_i.unionByName(i))
    g, i = _numbered(all_g, all_i, "own")
    g, i = g.select(heads), materialise(i.select(names), "items")
    if failed is not None:
        g, i = groups.drop_failed(g, i, failed)
    g, i = groups.path_unique(g, i)
    g, i = _numbered(g, i, "group_id")
    keyed = keys.stable_keys(i.select("group_id", "path").join(g.select("group_id", "group_type"), "group_id"))
    return g.select(heads).join(keyed, "group_id"), i.select(names)


def scan_paths(spark: SparkSession, roots: list[str], settings: config.Settings = config.Settings(), video_facts: DataFrame | None = None, ffmpeg: str = "ffmpeg", probes: DataFrame | None = None, hashes: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups, items, errors) of the files below `roots`: discovery, reading, features and scan().

    Pictures are hashed here. Videos have features where `video_facts` gives them
    (path, duration_ms, width, height, frames), or where `probes` (path, probe) is
    given, from frames that ffmpeg takes. `hashes` (path, full_hash) are digests that
    are known from before, of files that have not changed. errors: (path, stage, kind, message).
    """
    met: list[tuple[str, str, str, str]] = []
    found = materialise(sources.discover(spark, roots, on_error=lambda path, e: met.append((path, "discover", "skipped", str(e)))), "files")
    pictures = materialise(media.image_facts(spark, found.where("media_type = 'image'"), roots), "pictures")
    if video_facts is None and probes is not None:
        video_facts = materialise(media.video_facts(sources.probed_videos(probes), settings.frames, ffmpeg), "videos")
    facts = None if video_facts is None else found.select("file_id", "path").join(video_facts, "path").drop("path")
    of_image = pictures.where("width > 0").select("file_id", image_quality("width", "height", "format_name", "size_bytes").alias("of_image"))
    files = found.join(of_image, "file_id", "left").withColumn("of_video", F.lit(None).cast("double"))
    if facts is not None and {"bit_rate", "codec", "has_audio"} <= set(facts.columns):
        of_video = facts.select("file_id", video_quality("width", "height", "bit_rate", "codec", "has_audio", "duration_ms").alias("of_video"))
        files = files.drop("of_video").join(of_video, "file_id", "left")
    files = materialise(files.withColumn("quality", quality("media_type", "size_bytes", F.col("of_image"), F.col("of_video"))).drop("of_image", "of_video"), "files")
    if hashes is not None:
        files = files.join(hashes.select("path", "full_hash"), "path", "left")
    unread = materialise(sources.unreadable(files), "unread")
    ok = files.join(unread, "file_id", "left_anti")
    hashed = pictures.where("phash IS NOT NULL").select("file_id", "width", "height", "phash")
    g, i = scan(ok, settings, hashed, facts, None, sources.file_digests, sources.file_texts)
    told = unread.select("path", F.lit("file_hash").alias("stage"), F.lit("skipped").alias("kind"), "message")
    told = told.unionByName(pictures.where("message IS NOT NULL").select("path", F.lit("image_features").alias("stage"), F.lit("aux").alias("kind"), "message"))
    return g, i, told.unionByName(spark.createDataFrame(met, "path string, stage string, kind string, message string"))


def image_pairs(image_facts: DataFrame, threshold: float) -> DataFrame:
    """(src, dst, sim) of images at least as alike as the threshold."""
    near = pairs.cell_pairs(image_facts.withColumnRenamed("file_id", "image_id"))
    return near.select("src", "dst", hash_similarity("l_phash", "r_phash").alias("sim")).where(F.col("sim") >= threshold)
