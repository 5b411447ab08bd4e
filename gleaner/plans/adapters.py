"""The driver's tables in the roles of files, images, videos and stored results.

None of them is media: these are stand-ins that give the operators inputs of a
fitting shape. Each adapter has its SQL beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import sha256_full, text_quality
from ..operators.exact import exact_members
from ..operators.keys import stable_keys
from ..operators.ordering import ordered
from ..storage import table


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.octet_length("text").cast("long")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"), F.lit("text").alias("media_type"), size.alias("size_bytes"), text_quality(size).alias("quality"), F.col("text").alias("content"))


FILES = "files AS (SELECT doc_id AS file_id, source || '/' || doc_id || '.txt' AS path, 'text' AS media_type, strlen(text)::BIGINT AS size_bytes, CASE WHEN strlen(text) > 0 THEN least(1.0, 0.5 + ln(1 + strlen(text)) / ln(1 + 3e7) * 0.5) ELSE 0 END AS quality, text AS content FROM documents)"


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of exact groups of documents."""
    return exact_members(files(spark, sf_dir), sha256_full("content")).drop("content")


MEMBERS = f"""{FILES}, keyed AS (SELECT * EXCLUDE content, sha256(content) AS digest FROM files),
grp AS (SELECT media_type, size_bytes, digest, count(*) AS members, min(file_id) AS group_id, arg_max(file_id, struct_pack(a := quality, b := -file_id)) AS recommended FROM keyed GROUP BY ALL HAVING count(*) > 1),
mem AS (SELECT * FROM keyed JOIN grp USING (media_type, size_bytes, digest))"""


def stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(groups, items) of a stored result: exact groups; types, statuses and winners vary by id."""
    m = members(spark, sf_dir)
    kind = F.element_at(F.array(*(F.lit(t) for t in ("exact", "similar_image", "similar_text"))), (F.col("group_id") % 3 + 1).cast("int"))
    status = F.element_at(F.array(*(F.lit(t) for t in ("pending", "ignored", "processed", "pending"))), (F.col("group_id") % 4 + 1).cast("int"))
    keyed = stable_keys(m.select("group_id", F.lit("exact").alias("group_type"), "path"))
    groups = m.groupBy("group_id").agg(F.max("file_id").alias("recommended_file_id")).join(keyed, "group_id").select("group_id", kind.alias("group_type"), ((F.col("group_id") % 10) / 10.0).alias("confidence"), "recommended_file_id", status.alias("status"), "stable_key")
    best = m.groupBy("group_id").agg(F.max("file_id").alias("best"))
    won = F.col("file_id") == F.col("best")
    items = m.join(best, "group_id").select("group_id", "file_id", "path", F.when(won, "keep_recommended").otherwise("cleanup_candidate").alias("action"), F.when(won, 1.0).otherwise(-1.0).alias("similarity"), "quality", "size_bytes", "media_type")
    return groups, items


STORED = f"""{MEMBERS},
groups AS (SELECT group_id, ['exact', 'similar_image', 'similar_text'][group_id % 3 + 1] AS group_type, (group_id % 10) / 10.0::DOUBLE AS confidence, max(file_id) AS recommended_file_id, ['pending', 'ignored', 'processed', 'pending'][group_id % 4 + 1] AS status, substr(sha256('exact|' || string_agg(lower(path), '|' ORDER BY path)), 1, 32) AS stable_key FROM mem GROUP BY group_id),
items AS (SELECT group_id, file_id, path, CASE WHEN file_id = max(file_id) OVER (PARTITION BY group_id) THEN 'keep_recommended' ELSE 'cleanup_candidate' END AS action, CASE WHEN file_id = max(file_id) OVER (PARTITION BY group_id) THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS similarity, quality, size_bytes, media_type FROM mem)"""


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as images: bit i of the hash is the sign of component i."""
    bits = F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda a, i: a.bitwiseOR(F.when(F.get("embedding", i) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), (640 + 4 * (F.col("vec_id") % 5)).cast("long").alias("width"), (480 + 4 * (F.col("vec_id") % 3)).cast("long").alias("height"), bits.alias("phash"))


IMAGES = "images AS (SELECT vec_id AS image_id, (640 + 4 * (vec_id % 5))::BIGINT AS width, (480 + 4 * (vec_id % 3))::BIGINT AS height, list_aggregate(list_transform(range(0, 64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN (1::UHUGEINT << i::UHUGEINT)::UBIGINT ELSE 0::UBIGINT END), 'bit_or') AS phash FROM embeddings), cells AS (SELECT *, greatest(((width + 4) // 8) * 8, 8) AS cw, greatest(((height + 4) // 8) * 8, 8) AS ch FROM images)"
EDGES = "edges AS (SELECT a.image_id AS src, b.image_id AS dst, 1 - bit_count(xor(a.phash, b.phash)) / 64.0::DOUBLE AS sim FROM cells a JOIN cells b ON a.image_id < b.image_id AND abs(a.cw - b.cw) <= 8 AND abs(a.ch - b.ch) <= 8 AND bit_count(xor(a.phash, b.phash)) <= 20)"
COMPONENTS = "reach(id, c) AS (SELECT DISTINCT id, id FROM (SELECT src AS id FROM edges UNION SELECT dst FROM edges) UNION SELECT e.b, r.c FROM reach r JOIN (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges) e ON r.id = e.a), parts AS (SELECT id, min(c) AS component FROM reach GROUP BY id)"


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as videos: the price is the duration, and the number gives one of 97 shapes."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("video_id"), F.floor(F.col("o_totalprice") * 10).cast("long").alias("duration_ms"), (640 + 64 * (F.col("o_orderkey") % 97)).cast("long").alias("width"), F.lit(720).cast("long").alias("height"))


VIDEOS = "videos AS (SELECT o_orderkey AS video_id, floor(o_totalprice * 10)::BIGINT AS duration_ms, (640 + 64 * (o_orderkey % 97))::BIGINT AS width, 720::BIGINT AS height FROM orders)"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, frames): all events of a user, by time; the value is the hash."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id", "value")
    rows = ordered(e, ["video_id"], [F.col("us"), F.col("event_id")]).join(e.groupBy("video_id").agg(F.min("us").alias("first")), "video_id")
    frame = F.struct((F.col("k") - 1).cast("int").alias("idx"), F.floor((F.col("us") - F.col("first")) / 1000).cast("long").alias("ts_ms"), F.floor(F.col("value") * 1000003).cast("long").alias("hash"))
    return rows.groupBy("video_id").agg(F.array_sort(F.collect_list(frame)).alias("frames"))


FRAMES = "ev AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, min(ts) OVER (PARTITION BY user_id) AS t0 FROM events), fr AS (SELECT user_id AS video_id, k - 1 AS idx, (epoch_us(ts) - epoch_us(t0)) // 1000 AS ts_ms, floor(value * 1000003)::BIGINT AS hash FROM ev)"
