"""Named queries over the driver's tables and the SQL that must agree with them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import text as T
from ..functions import video as V
from ..operators import alike, exact, groups, pairs, results, store
from ..operators.components import connected_components
from ..storage import materialise, table
from . import adapters as A

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


@query("classify_extension", """SELECT doc_id, CASE WHEN e IN ('.jpg', '.heic') THEN 'image' WHEN e = '.mp4' THEN 'video' WHEN e = '.txt' THEN 'text' END AS media_type, e <> '.heic' AS phash_ok
FROM (SELECT doc_id, lower(['.txt', '.JPG', '.mp4', '.heic', '.pdf'][doc_id % 5 + 1]) AS e FROM documents)""")
def classify_extension(spark, sf_dir):
    path = F.concat("source", F.lit("/x.y/"), "doc_id", F.element_at(F.array(*(F.lit(x) for x in (".txt", ".JPG", ".mp4", ".heic", ".pdf"))), (F.col("doc_id") % 5 + 1).cast("int")))
    return table(spark, sf_dir, "documents").select("doc_id", S.media_type(path).alias("media_type"), S.supports_phash(path).alias("phash_ok"))


@query("first_by_key", "SELECT host, min(page_id) AS page_id FROM (SELECT page_id, regexp_extract(url, '//([^/]+)', 1) AS host FROM pages) GROUP BY host")
def first_by_key(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "//([^/]+)", 1).alias("host"))
    return rows.groupBy("host").agg(F.min("page_id").alias("page_id"))


@query("exact_bucket_candidates", f"WITH {A.FILES} SELECT file_id, size_bytes FROM files WHERE size_bytes IN (SELECT size_bytes FROM files GROUP BY size_bytes HAVING count(*) > 1)")
def exact_bucket_candidates(spark, sf_dir):
    return exact.bucket_candidates(A.files(spark, sf_dir)).select("file_id", "size_bytes")


@query("exact_groups", f"WITH {A.MEMBERS} SELECT digest, size_bytes, members, group_id AS first_id FROM grp")
def exact_groups(spark, sf_dir):
    return A.members(spark, sf_dir).where("file_id = group_id").select("digest", "size_bytes", "members", F.col("group_id").alias("first_id"))


_LE = "unhex(array_to_string(list_reverse([substr(lpad(hex({0}), 16, '0'), k * 2 + 1, 2) for k in range(0, 8)]), ''))"


@query("sampled_fingerprint", f"""WITH b AS (SELECT doc_id, encode(text) AS c, strlen(text)::BIGINT AS n FROM documents)
SELECT doc_id, CASE WHEN n <= 192 THEN sha256({_LE.format('n')} || c) ELSE sha256({_LE.format('n')} || {_LE.format('0::BIGINT')} || c[1:64] || {_LE.format('((n - 64) // 2)')} || c[(n - 64) // 2 + 1 : (n - 64) // 2 + 64] || {_LE.format('(n - 64)')} || c[n - 63 : n]) END AS digest FROM b""")
def sampled_fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.sha256_sampled(F.encode("text", "UTF-8"), 64).alias("digest"))


@query("tiered_exact", f"""WITH {A.FILES}, k AS (SELECT file_id, size_bytes, sha256(content[1:16]) AS sampled, CASE WHEN file_id % 2 = 0 THEN sha256(content) END AS "full" FROM files),
f AS (SELECT size_bytes, sampled, count(*) AS n, count("full") AS known, count(DISTINCT "full") AS kinds FROM k GROUP BY ALL HAVING count(*) > 1),
m AS (SELECT file_id, size_bytes, sampled, CASE WHEN kinds >= 2 OR known = n THEN "full" ELSE sampled END AS digest, CASE WHEN kinds >= 2 OR known = n THEN 1.0::DOUBLE ELSE 0.99::DOUBLE END AS confidence FROM k JOIN f USING (size_bytes, sampled))
SELECT file_id, group_id, confidence FROM m JOIN (SELECT size_bytes, sampled, digest, min(file_id) AS group_id FROM m WHERE digest IS NOT NULL GROUP BY ALL HAVING count(*) > 1) USING (size_bytes, sampled, digest)""")
def tiered_exact(spark, sf_dir):
    rows = A.files(spark, sf_dir).select("file_id", "media_type", "size_bytes", F.sha2(F.substring("content", 1, 16), 256).alias("sampled"), F.when(F.col("file_id") % 2 == 0, F.sha2("content", 256)).alias("full"))
    return exact.tiered_confidence(rows).select("file_id", "group_id", "confidence")


@query("exact_group_winner_actions", f"WITH {A.MEMBERS} SELECT group_id, file_id, CASE WHEN file_id = recommended THEN 'keep_recommended' ELSE 'cleanup_candidate' END AS action FROM mem")
def exact_group_winner_actions(spark, sf_dir):
    return groups.choose_actions(A.members(spark, sf_dir).select("group_id", "file_id", "quality"), -1.0).select("group_id", "file_id", "action")


@query("approximate_representative", f"""WITH {A.MEMBERS}, m AS (SELECT group_id, file_id, recommended, file_id % 3 <> 0 AS ok FROM mem)
SELECT group_id, coalesce(max(CASE WHEN ok AND file_id = recommended THEN file_id END), min(CASE WHEN ok THEN file_id END), min(recommended)) AS rep_id FROM m GROUP BY group_id""")
def approximate_representative(spark, sf_dir):
    m = A.members(spark, sf_dir).withColumn("path", F.when(F.col("file_id") % 3 == 0, "a.heic").otherwise("a.png"))
    return exact.representatives(m).select("group_id", "rep_id")


@query("stable_key", f"WITH {A.STORED} SELECT group_id, stable_key FROM groups")
def stable_key(spark, sf_dir):
    return A.stored(spark, sf_dir)[0].select("group_id", "stable_key")


@query("normalise_text", r"SELECT doc_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS normal FROM documents")
def normalise_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.normalise_text("text").alias("normal"))


@query("normalise_name", r"SELECT page_id, trim(regexp_replace(lower(regexp_replace(url, '\.[^.]*$', '')), '[^\p{L}\p{Nd}]+', ' ', 'g')) AS name FROM pages")
def normalise_name(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.normalise_name("url").alias("name"))


@query("name_similarity", "WITH n AS (SELECT DISTINCT p_name, list_distinct(string_split(p_name, ' ')) AS g FROM part) SELECT a.p_name AS a, b.p_name AS b, len(list_intersect(a.g, b.g)) / least(len(a.g), len(b.g))::DOUBLE AS similarity FROM n a JOIN n b ON a.p_name < b.p_name AND len(list_intersect(a.g, b.g)) > 0")
def name_similarity(spark, sf_dir):
    names = table(spark, sf_dir, "part").select("p_name").distinct().withColumn("g", S.name_grams("p_name"))
    tokens = names.select("p_name", "g", F.explode("g").alias("t"))
    met = tokens.select(F.col("p_name").alias("a"), F.col("g").alias("ga"), "t").join(tokens.select(F.col("p_name").alias("b"), F.col("g").alias("gb"), "t"), "t").where("a < b")
    return met.select("a", "b", S.overlap_of_grams("ga", "gb").alias("similarity")).distinct()


def _facts(spark, sf_dir, *columns):
    return T.text_facts(A.files(spark, sf_dir), columns)


def _text_edges(spark, sf_dir, facts):
    return alike.text_edges(facts, lambda wanted: A.files(spark, sf_dir).join(wanted, "file_id", "left_semi").select("file_id", "content"))


_LOW64 = "18446744073709551615::UHUGEINT"
#: Bottom-k sketches of documents in SQL: r (doc_id, h, k), the k least 5-gram hashes, unsigned; d has the normal form.
SKETCH = f"""d AS (SELECT doc_id, lower(trim(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '\\s+$', ''))) AS normal FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(u) - 3)) AS i, u FROM (SELECT doc_id, [unicode(c) for c in string_split(normal, '')] AS u FROM d) WHERE len(u) >= 5),
h0 AS (SELECT doc_id, u[i]::UBIGINT AS a, u[i + 1]::UBIGINT AS b, u[i + 2]::UBIGINT AS c, u[i + 3]::UBIGINT AS d, u[i + 4]::UBIGINT AS e FROM g),
h1 AS (SELECT *, ((xor(14695981039346656037::UBIGINT, a)::UHUGEINT * 1099511628211) & {_LOW64})::UBIGINT AS h FROM h0),
h2 AS (SELECT doc_id, c, d, e, ((xor(h, b)::UHUGEINT * 1099511628211) & {_LOW64})::UBIGINT AS h FROM h1),
h3 AS (SELECT doc_id, d, e, ((xor(h, c)::UHUGEINT * 1099511628211) & {_LOW64})::UBIGINT AS h FROM h2),
h4 AS (SELECT doc_id, e, ((xor(h, d)::UHUGEINT * 1099511628211) & {_LOW64})::UBIGINT AS h FROM h3),
h5 AS (SELECT DISTINCT doc_id, ((xor(h, e)::UHUGEINT * 1099511628211) & {_LOW64})::UBIGINT AS h FROM h4),
r AS (SELECT doc_id, h, row_number() OVER (PARTITION BY doc_id ORDER BY h) AS k FROM h5 QUALIFY k <= 1024)"""
#: MinHash bands of the sketches: bands (file_id, band, r0, r1), signed.
BANDS = f"""m0 AS (SELECT doc_id, j, ((h::UHUGEINT + j::UHUGEINT * 11400714819323198485::UHUGEINT) & {_LOW64})::UBIGINT AS x FROM r, range(0, 16) t(j)),
m1 AS (SELECT doc_id, j, ((xor(x, x >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT) & {_LOW64})::UBIGINT AS x FROM m0),
m2 AS (SELECT doc_id, j, ((xor(x, x >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT) & {_LOW64})::UBIGINT AS x FROM m1),
m3 AS (SELECT doc_id, j, min(xor(x, x >> 31)) AS x FROM m2 GROUP BY ALL),
s AS (SELECT doc_id AS file_id, (j // 2)::INTEGER AS band, j % 2 AS side, CASE WHEN x >= 9223372036854775808::UBIGINT THEN (x::HUGEINT - 18446744073709551616::HUGEINT)::BIGINT ELSE x::BIGINT END AS v FROM m3),
bands AS (SELECT file_id, band, max(CASE WHEN side = 0 THEN v END) AS r0, max(CASE WHEN side = 1 THEN v END) AS r1 FROM s GROUP BY ALL)"""
#: Pairs in a bucket by its 256 places, and edges of pairs that are alike enough; no two names share a token here.
LSH = """pl AS (SELECT file_id, band, r0, r1, row_number() OVER w AS k, count(*) OVER (PARTITION BY band, r0, r1) AS n, lag(file_id) OVER w AS p FROM bands WINDOW w AS (PARTITION BY band, r0, r1 ORDER BY file_id)),
hd AS (SELECT * FROM pl WHERE k < 256 OR k = n),
lsh AS (SELECT a.file_id AS src, b.file_id AS dst FROM hd a JOIN hd b USING (band, r0, r1) WHERE a.file_id < b.file_id UNION SELECT p, file_id FROM pl WHERE k > 256)"""
TEXT_EDGES = """sz AS (SELECT doc_id, count(*) AS n FROM r GROUP BY doc_id), ln AS (SELECT doc_id, strlen(normal) AS n FROM d),
near AS (SELECT src, dst FROM lsh JOIN ln a ON a.doc_id = src JOIN ln b ON b.doc_id = dst WHERE least(a.n, b.n) / greatest(a.n, b.n)::DOUBLE >= 0.7),
cm AS (SELECT src, dst, count(*) AS c FROM near JOIN r x ON x.doc_id = src JOIN r y ON y.doc_id = dst AND x.h = y.h GROUP BY ALL),
edges AS (SELECT src, dst, 2 * c / (a.n + b.n)::DOUBLE AS sim FROM cm JOIN sz a ON a.doc_id = src JOIN sz b ON b.doc_id = dst WHERE 2 * c / (a.n + b.n)::DOUBLE >= 0.92 - 0.04)"""


@query("text_sketch", f"""WITH {SKETCH}
SELECT doc_id AS file_id, count(*)::INTEGER AS n_features, (min(h)::HUGEINT - 9223372036854775808)::BIGINT AS least, (max(h)::HUGEINT - 9223372036854775808)::BIGINT AS greatest, (sum(h) % 1000000007)::BIGINT AS mark FROM r GROUP BY doc_id""")
def text_sketch(spark, sf_dir):
    whole = F.aggregate("features", F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + x.cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")).cast("decimal(38,0)"))
    return _facts(spark, sf_dir, "file_id", "features").where(F.size("features") > 0).select("file_id", F.size("features").alias("n_features"), F.get("features", F.lit(0)).alias("least"), F.element_at("features", -1).alias("greatest"), (whole % 1000000007).cast("long").alias("mark"))


@query("minhash_signature", f"WITH {SKETCH}, {BANDS} SELECT file_id, band, r0, r1 FROM bands")
def minhash_signature(spark, sf_dir):
    return _facts(spark, sf_dir, "file_id", "bands").select("file_id", F.posexplode("bands").alias("band", "v")).select("file_id", "band", "v.r0", "v.r1")


@query("lsh_candidates", f"WITH {SKETCH}, {BANDS}, {LSH} SELECT src, dst FROM lsh")
def lsh_candidates(spark, sf_dir):
    return pairs.lsh_pairs(materialise(_facts(spark, sf_dir, "file_id", "bands"), "bands"))


@query("name_token_candidates", """WITH t AS (SELECT DISTINCT p_partkey AS id, unnest(string_split(p_name, ' ')) AS token FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY id) AS k, count(*) OVER (PARTITION BY token) AS n, lag(id) OVER (PARTITION BY token ORDER BY id) AS p FROM t),
h AS (SELECT * FROM r WHERE k < 256 OR k = n)
SELECT a.id AS src, b.id AS dst FROM h a JOIN h b ON a.token = b.token AND a.id < b.id UNION SELECT p, id FROM r WHERE k > 256""")
def name_token_candidates(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_id"), F.array_join(F.array_distinct(F.split("p_name", " ")), " ").alias("name"))
    return pairs.name_token_pairs(names)


@query("text_similarity_edges", f"WITH {SKETCH}, {BANDS}, {LSH}, {TEXT_EDGES} SELECT src, dst, round(sim, 6) AS sim FROM edges")
def text_similarity_edges(spark, sf_dir):
    return _text_edges(spark, sf_dir, materialise(_facts(spark, sf_dir, *alike.FACTS), "facts")).withColumn("sim", F.round("sim", 6))


@query("text_groups", f"""WITH RECURSIVE {SKETCH}, {BANDS}, {LSH}, {TEXT_EDGES}, {A.COMPONENTS},
m AS (SELECT component AS group_id, id AS file_id, strlen(text) AS size FROM parts JOIN documents ON doc_id = id),
w AS (SELECT group_id, arg_max(file_id, struct_pack(a := size, b := -file_id)) AS winner, count(*) AS n FROM m GROUP BY group_id),
ins AS (SELECT component AS group_id, count(*) AS e, min(sim) AS low FROM edges JOIN parts ON src = id GROUP BY component)
SELECT group_id, file_id, CASE WHEN file_id = winner THEN 'keep_recommended' ELSE 'review_required' END AS action, round(CASE WHEN file_id = winner THEN 1.0::DOUBLE ELSE coalesce(sim, -1.0::DOUBLE) END, 6) AS similarity, round(CASE WHEN e >= n * (n - 1) / 2 THEN least(low, 1.0) ELSE 0.0::DOUBLE END, 6) AS confidence
FROM m JOIN w USING (group_id) JOIN ins USING (group_id) LEFT JOIN edges ON src = least(file_id, winner) AND dst = greatest(file_id, winner)""")
def text_groups(spark, sf_dir):
    """The flagship: facts, candidates, edges, components, winners and confidence."""
    facts = materialise(_facts(spark, sf_dir, *alike.FACTS), "facts")
    edges = materialise(_text_edges(spark, sf_dir, facts), "edges")
    g, items = groups.text_groups(facts, edges)
    return items.join(g.select("group_id", "confidence"), "group_id").select("group_id", "file_id", "action", F.round("similarity", 6).alias("similarity"), F.round("confidence", 6).alias("confidence"))


@query("image_same_cell_pairs", f"WITH {A.IMAGES} SELECT a.image_id AS src, b.image_id AS dst FROM cells a JOIN cells b ON a.image_id < b.image_id AND a.cw = b.cw AND a.ch = b.ch")
def image_same_cell_pairs(spark, sf_dir):
    return pairs.cell_pairs(A.images(spark, sf_dir).drop("phash"), False).select("src", "dst")


@query("image_neighbour_pairs", f"WITH {A.IMAGES} SELECT a.image_id AS src, b.image_id AS dst FROM cells a JOIN cells b ON a.image_id < b.image_id AND abs(a.cw - b.cw) <= 8 AND abs(a.ch - b.ch) <= 8")
def image_neighbour_pairs(spark, sf_dir):
    return pairs.cell_pairs(A.images(spark, sf_dir).drop("phash")).select("src", "dst")


def _image_edges(spark, sf_dir):
    return pairs.radius_pairs(A.images(spark, sf_dir), S.max_hamming(0.6875)).select("src", "dst", (1 - F.col("distance") / 64).alias("sim"))


@query("phash_radius_pairs", f"WITH {A.IMAGES}, {A.EDGES} SELECT src, dst, sim FROM edges")
def phash_radius_pairs(spark, sf_dir):
    return _image_edges(spark, sf_dir)


@query("connected_components", f"WITH RECURSIVE {A.IMAGES}, {A.EDGES}, {A.COMPONENTS} SELECT id, component FROM parts")
def components(spark, sf_dir):
    return connected_components(_image_edges(spark, sf_dir))


_GROUPED = f"{A.IMAGES}, {A.EDGES}, {A.COMPONENTS}, q AS (SELECT component AS group_id, id AS file_id, (id % 17) / 17.0::DOUBLE AS quality FROM parts), w AS (SELECT group_id, arg_max(file_id, struct_pack(a := quality, b := -file_id)) AS winner, count(*) AS n FROM q GROUP BY group_id), s AS (SELECT q.group_id, max(quality) AS q2 FROM q JOIN w USING (group_id) WHERE file_id <> winner GROUP BY q.group_id), top AS (SELECT group_id, max(quality) AS q1 FROM q GROUP BY group_id), ins AS (SELECT component AS group_id, count(*) AS e, min(sim) AS low FROM edges JOIN parts ON src = id GROUP BY component)"


def _image_groups(spark, sf_dir):
    edges = materialise(_image_edges(spark, sf_dir), "edges")
    facts = A.images(spark, sf_dir).select(F.col("image_id").alias("file_id"), F.concat(F.lit("i/"), "image_id").alias("path"), F.lit(1).cast("long").alias("size_bytes"), (F.col("image_id") % 17 / 17.0).alias("quality"))
    return groups.groups_from_edges(edges, facts, "similar_image")


@query("image_groups", f"""WITH RECURSIVE {_GROUPED}
SELECT q.group_id, q.file_id, CASE WHEN q1 - q2 <= 0.02 THEN 'review_required' WHEN file_id = winner THEN 'keep_recommended' ELSE 'cleanup_candidate' END AS action, CASE WHEN file_id = winner THEN 1.0::DOUBLE ELSE coalesce(sim, -1.0::DOUBLE) END AS similarity
FROM q JOIN w USING (group_id) JOIN s USING (group_id) JOIN top USING (group_id) LEFT JOIN edges ON src = least(file_id, winner) AND dst = greatest(file_id, winner)""")
def image_groups(spark, sf_dir):
    return _image_groups(spark, sf_dir)[1].select("group_id", "file_id", "action", "similarity")


@query("group_confidence", f"WITH RECURSIVE {_GROUPED} SELECT group_id, CASE WHEN e >= n * (n - 1) / 2 THEN least(low, 1.0) ELSE 0.0::DOUBLE END AS confidence FROM w LEFT JOIN ins USING (group_id)")
def group_confidence(spark, sf_dir):
    return _image_groups(spark, sf_dir)[0].select("group_id", "confidence")


@query("frame_timestamps", """WITH d AS (SELECT o_orderkey, floor(o_totalprice * 10)::BIGINT - 20000 AS d FROM orders)
SELECT o_orderkey, CASE WHEN d <= 0 THEN [] WHEN d * 5 // 100 >= d * 95 // 100 THEN [d // 2] ELSE [(d * 5 // 100 + floor((d * 95 // 100 - d * 5 // 100) / 7.0::DOUBLE * i + 0.5))::BIGINT for i in range(0, 8)] END::BIGINT[] AS ts FROM d""")
def frame_timestamps(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.floor(F.col("o_totalprice") * 10).cast("long") - 20000).alias("d"))
    return rows.select("o_orderkey", V.frame_timestamps("d", 8).alias("ts"))


@query("video_band_pairs", f"""WITH {A.VIDEOS} SELECT a.video_id AS src, b.video_id AS dst FROM videos a JOIN videos b ON a.video_id < b.video_id AND a.duration_ms > 0 AND b.duration_ms > 0
AND abs(a.duration_ms - b.duration_ms) <= greatest(3000, greatest(a.duration_ms, b.duration_ms) * 5 // 100) AND abs(a.width / a.height::DOUBLE - b.width / b.height::DOUBLE) <= 0.05""")
def video_band_pairs(spark, sf_dir):
    return pairs.duration_pairs(A.videos(spark, sf_dir))


@query("frame_step", f"WITH {A.FRAMES}, g AS (SELECT video_id, (ts_ms - lag(ts_ms) OVER (PARTITION BY video_id ORDER BY idx)) AS gap FROM fr) SELECT video_id, coalesce(min(CASE WHEN gap > 0 THEN gap END), 0)::BIGINT AS step FROM g GROUP BY video_id")
def frame_step(spark, sf_dir):
    return A.frames(spark, sf_dir).select("video_id", V.frame_step("frames").alias("step"))


@query("required_pairs", "SELECT p_partkey, greatest(3, (CASE WHEN p_size > 25 THEN p_size - 25 ELSE p_size END + 1) // 2)::INTEGER AS required FROM part")
def required_pairs(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", V.required_pairs(F.col("p_size") - 25, "p_size").alias("required"))


@query("video_similarity", f"""WITH {A.FRAMES}, st AS (SELECT video_id, coalesce(min(CASE WHEN gap > 0 THEN gap END), 0) AS step FROM (SELECT video_id, ts_ms - lag(ts_ms) OVER (PARTITION BY video_id ORDER BY idx) AS gap FROM fr) GROUP BY video_id),
v AS (SELECT video_id, max(ts_ms) AS d, count(*) AS n, step FROM fr JOIN st USING (video_id) GROUP BY ALL),
p AS (SELECT a.video_id AS src, b.video_id AS dst, greatest(a.step, b.step) // 2 AS tol, a.n AS n FROM v a JOIN v b ON a.video_id < b.video_id AND a.video_id % 97 = b.video_id % 97 AND a.d > 0 AND b.d > 0 AND abs(a.d - b.d) <= greatest(3000, greatest(a.d, b.d) * 5 // 100)),
c AS (SELECT src, dst, abs(x.ts_ms - y.ts_ms) AS delta, -greatest(0, 1 - bit_count(xor(x.hash, y.hash)) / 64.0::DOUBLE) AS minus, x.idx AS l, y.idx AS r FROM p JOIN fr x ON x.video_id = src JOIN fr y ON y.video_id = dst AND abs(x.ts_ms - y.ts_ms) <= tol),
k AS (SELECT src, dst, list([struct_pack(m := -minus, l := l, r := r)] ORDER BY delta, minus, l, r) AS near FROM c GROUP BY ALL),
f AS (SELECT src, dst, list_reduce(near, lambda a, x: CASE WHEN len(list_filter(a, lambda q: q.l = x[1].l OR q.r = x[1].r)) > 0 THEN a ELSE list_concat(a, x) END) AS kept FROM k)
SELECT p.src, p.dst, round(CASE WHEN tol <= 0 OR kept IS NULL OR len(kept) < greatest(3, (8 + 1) // 2) THEN 0.0::DOUBLE ELSE list_median([q.m for q in kept]) END, 6) AS similarity FROM p LEFT JOIN f ON f.src = p.src AND f.dst = p.dst""")
def video_similarity(spark, sf_dir):
    """Videos of close duration and shape, aligned and compared."""
    v = materialise(A.frames(spark, sf_dir), "frames")
    near = pairs.duration_pairs(v.select("video_id", F.element_at("frames", -1)["ts_ms"].alias("duration_ms"), (640 + 64 * (F.col("video_id") % 97)).alias("width"), F.lit(720).alias("height")))
    both = near.join(v.select(F.col("video_id").alias("src"), F.col("frames").alias("a")), "src").join(v.select(F.col("video_id").alias("dst"), F.col("frames").alias("b")), "dst")
    return both.select("src", "dst", F.round(V.video_similarity("a", "b", 8), 6).alias("similarity"))


@query("choose_actions", """WITH r AS (SELECT l_orderkey AS group_id, l_linenumber::BIGINT AS file_id, max(l_extendedprice) / 100000 AS quality FROM lineitem GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY quality DESC, file_id) AS rn FROM r),
t AS (SELECT group_id, max(CASE WHEN rn = 1 THEN quality END) - max(CASE WHEN rn = 2 THEN quality END) AS gap FROM k GROUP BY group_id)
SELECT group_id, file_id, CASE WHEN gap <= 0.02 THEN 'review_required' WHEN rn = 1 THEN 'keep_recommended' ELSE 'cleanup_candidate' END AS action FROM k JOIN t USING (group_id)""")
def choose_actions(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("group_id"), F.col("l_linenumber").cast("long").alias("file_id")).agg((F.max("l_extendedprice") / 100000).alias("quality"))
    return groups.choose_actions(rows).select("group_id", "file_id", "action")


@query("image_quality", "SELECT p_partkey, round(least(1.0, least(0.70, ln(1 + p_size * 100 * p_size * 60 / 1e6) / ln(13) * 0.70) + CASE p_brand[-1] WHEN '1' THEN 0.10::DOUBLE WHEN '2' THEN 0.07::DOUBLE ELSE 0.03::DOUBLE END + least(0.10, ln(1 + p_retailprice * 100) / ln(1 + 1e7) * 0.10) + 0.10), 6) AS quality FROM part")
def image_quality(spark, sf_dir):
    kind = F.when(F.col("p_brand").endswith("1"), "png").when(F.col("p_brand").endswith("2"), "JPEG").otherwise("BMP")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(S.image_quality(F.col("p_size") * 100, F.col("p_size") * 60, kind, F.col("p_retailprice") * 100), 6).alias("quality"))


@query("video_quality", "SELECT o_orderkey, round(least(1.0, least(0.55, ln(1 + (o_orderkey % 2000) * 720) / ln(1 + 3840 * 2160) * 0.55) + CASE WHEN o_totalprice > 100000 THEN least(0.20, ln(1 + o_totalprice) / ln(1 + 2e7) * 0.20) ELSE 0 END + CASE WHEN o_orderstatus = 'F' THEN 0.10::DOUBLE ELSE 0.05::DOUBLE END + CASE WHEN o_custkey % 2 = 0 THEN 0.05::DOUBLE ELSE 0 END + 0.10), 6) AS quality FROM orders")
def video_quality(spark, sf_dir):
    rate = F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(S.video_quality(F.col("o_orderkey") % 2000, F.lit(720), rate, F.when(F.col("o_orderstatus") == "F", "HEVC").otherwise("vp9"), F.col("o_custkey") % 2 == 0, "o_totalprice"), 6).alias("quality"))


@query("text_quality", f"WITH {A.FILES} SELECT file_id, round(quality, 6) AS quality FROM files")
def text_quality(spark, sf_dir):
    return A.files(spark, sf_dir).select("file_id", F.round("quality", 6).alias("quality"))


def _manifests(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("o/"), "o_orderkey").alias("path"), F.floor("o_totalprice").cast("long").alias("size_bytes"), F.col("o_custkey").alias("mtime_ns"), F.when(F.col("o_orderkey") % 11 == 0, "missing").otherwise("active").alias("status"), F.col("o_orderkey").alias("k"))
    new = o.where("k % 7 <> 0").select("path", (F.col("size_bytes") + F.when(F.col("k") % 5 == 0, 1).otherwise(0)).alias("size_bytes"), "mtime_ns", "k")
    return o.where("k % 13 <> 0").drop("k"), new.drop("k")


@query("incremental_status", """WITH o AS (SELECT o_orderkey AS k, 'o/' || o_orderkey AS path, floor(o_totalprice)::BIGINT AS s, o_custkey AS m, CASE WHEN o_orderkey % 11 = 0 THEN 'missing' ELSE 'active' END AS st FROM orders)
SELECT path, CASE WHEN k % 7 = 0 THEN 'missing' WHEN k % 13 = 0 THEN 'added' WHEN k % 5 <> 0 AND st = 'active' THEN 'unchanged' ELSE 'changed' END AS change, s + CASE WHEN k % 7 <> 0 AND k % 5 = 0 THEN 1 ELSE 0 END AS size_bytes, m AS mtime_ns, CASE WHEN k % 7 = 0 THEN 'missing' ELSE 'active' END AS status FROM o WHERE NOT (k % 7 = 0 AND k % 13 = 0)""")
def incremental_status(spark, sf_dir):
    return store.incremental_status(*_manifests(spark, sf_dir))


@query("replace_groups_status", f"WITH {A.STORED} SELECT group_id, CASE WHEN group_id % 2 = 0 THEN status ELSE 'pending' END AS status FROM groups")
def replace_groups_status(spark, sf_dir):
    g, _ = A.stored(spark, sf_dir)
    none = F.lit(None).cast("timestamp")
    before = g.where("group_id % 2 = 0").select("stable_key", "status", none.alias("ignored_at"), none.alias("processed_at"))
    return store.replace_groups(g.drop("status"), before).select("group_id", "status")


@query("set_group_status", f"WITH {A.STORED} SELECT group_id, CASE WHEN group_id % 5 = 0 THEN 'ignored' ELSE status END AS status, CASE WHEN group_id % 5 = 0 THEN TIMESTAMP '2024-01-01' END AS ignored_at FROM groups")
def set_group_status(spark, sf_dir):
    g, _ = A.stored(spark, sf_dir)
    none = F.lit(None).cast("timestamp")
    g = g.withColumn("ignored_at", none).withColumn("processed_at", none)
    return store.set_status(g, g.where("group_id % 5 = 0"), "ignored", F.lit("2024-01-01").cast("timestamp")).select("group_id", "status", F.col("ignored_at").cast("timestamp_ntz").alias("ignored_at"))


@query("set_recommended", f"""WITH {A.STORED} SELECT group_id, file_id, CASE WHEN group_id % 2 = 1 THEN action WHEN file_id = group_id THEN 'keep_recommended' ELSE 'cleanup_candidate' END AS action,
CASE WHEN group_id % 2 = 1 OR group_type = 'exact' THEN similarity WHEN file_id = group_id THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS similarity FROM items JOIN groups USING (group_id)""")
def set_recommended(spark, sf_dir):
    g, i = A.stored(spark, sf_dir)
    return store.set_recommended(g, i, g.where("group_id % 2 = 0").select("group_id", F.col("group_id").alias("file_id")))[1].select("group_id", "file_id", "action", "similarity")


_LEFT = f"{A.STORED}, lft AS (SELECT * FROM items WHERE file_id % 4 <> 0), alive AS (SELECT group_id, arg_max(file_id, struct_pack(a := quality, b := -file_id)) AS best FROM lft GROUP BY group_id HAVING count(*) > 1), now AS (SELECT g.group_id, group_type, CASE WHEN recommended_file_id % 4 = 0 THEN best ELSE recommended_file_id END AS rec, recommended_file_id % 4 = 0 AS lost FROM groups g JOIN alive USING (group_id))"


@query("prune_groups", f"WITH {_LEFT} SELECT group_id, file_id, CASE WHEN action = 'keep_recommended' AND file_id <> rec THEN 'cleanup_candidate' WHEN file_id = rec AND lost THEN 'keep_recommended' ELSE action END AS action, CASE WHEN NOT lost OR group_type = 'exact' THEN similarity WHEN file_id = rec THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS similarity FROM lft JOIN now USING (group_id)")
def prune_groups(spark, sf_dir):
    g, i = A.stored(spark, sf_dir)
    return store.delete_paths(g, i, i.where("file_id % 4 = 0").select("path"))[1].select("group_id", "file_id", "action", "similarity")


@query("drop_failed", f"WITH {_LEFT} SELECT group_id, rec AS recommended_file_id FROM now")
def drop_failed(spark, sf_dir):
    g, i = A.stored(spark, sf_dir)
    return groups.drop_failed(g, i, i.where("file_id % 4 = 0").select("file_id"))[0].select("group_id", "recommended_file_id")


@query("list_groups", f"WITH {A.STORED} SELECT group_id, group_type, confidence, status, count(*) AS members, sum(CASE WHEN file_id <> recommended_file_id THEN size_bytes ELSE 0 END)::BIGINT AS reclaimable_bytes, 'text' AS media_kind FROM groups JOIN items USING (group_id) WHERE status = 'pending' AND group_id IN (SELECT group_id FROM items WHERE contains(lower(path), 'src1')) GROUP BY ALL")
def list_groups(spark, sf_dir):
    return results.list_groups(*A.stored(spark, sf_dir), search="SRC1").drop("recommended_file_id")


@query("summary", f"WITH {A.STORED} SELECT count(*) AS groups, count(*) FILTER (WHERE group_type = 'exact') AS exact, count(*) FILTER (WHERE group_type = 'similar_image') AS similar, count(*) FILTER (WHERE status = 'pending') AS pending, (SELECT sum(size_bytes)::BIGINT FROM items JOIN groups USING (group_id) WHERE status = 'pending' AND file_id <> recommended_file_id) AS reclaimable_bytes FROM groups")
def summary(spark, sf_dir):
    return results.summary(*A.stored(spark, sf_dir))


@query("group_detail", f"WITH {A.STORED}, f AS (SELECT doc_id AS file_id, (n_chars * 2654435761) % 4294967296 AS phash FROM documents) SELECT i.group_id, i.file_id, bit_count(xor(f.phash, b.phash))::INTEGER AS distance FROM items i JOIN groups g USING (group_id) JOIN f ON f.file_id = i.file_id JOIN f b ON b.file_id = g.recommended_file_id")
def group_detail(spark, sf_dir):
    g, i = A.stored(spark, sf_dir)
    facts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), (F.col("n_chars") * 2654435761 % 4294967296).alias("phash"))
    return results.group_detail(g, i, facts).select("group_id", "file_id", "distance")


@query("delete_guard", f"WITH {A.STORED} SELECT group_id, 0::BIGINT AS \"left\" FROM items GROUP BY group_id HAVING count(*) FILTER (WHERE group_id % 3 <> 0 AND file_id <> group_id) = 0")
def delete_guard(spark, sf_dir):
    _, i = A.stored(spark, sf_dir)
    return store.delete_guard(i, i.where("group_id % 3 = 0 OR file_id = group_id").select("file_id"))


@query("report_totals", f"WITH {A.STORED} SELECT count(*) FILTER (WHERE action = 'keep_recommended') AS keep, count(*) FILTER (WHERE action = 'cleanup_candidate') AS cleanup, sum(size_bytes) FILTER (WHERE action = 'cleanup_candidate')::BIGINT AS cleanup_bytes FROM items")
def report_totals(spark, sf_dir):
    return results.report_totals(A.stored(spark, sf_dir)[1])


@query("report_lines", f"""WITH {A.STORED} SELECT group_id, file_id, CASE WHEN action = 'keep_recommended' THEN '+' ELSE '-' END || ' ' || path || ' sim=' || CASE WHEN similarity < 0 THEN '—' ELSE '1.00' END || ' ' || CASE WHEN size_bytes >= 1024 THEN format('{{:.1f}} KiB', size_bytes / 1024.0) ELSE size_bytes || ' B' END AS line FROM items""")
def report_lines(spark, sf_dir):
    return results.report_lines(*A.stored(spark, sf_dir))


@query("human_bytes", "SELECT o_orderkey, CASE WHEN b >= 1048576 THEN format('{:.1f} MiB', b / 1048576.0::DOUBLE) WHEN b >= 1024 THEN format('{:.1f} KiB', b / 1024.0::DOUBLE) ELSE b || ' B' END AS shown FROM (SELECT o_orderkey, floor(o_totalprice)::BIGINT * (o_orderkey % 9) AS b FROM orders)")
def human_bytes(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", S.human_bytes(F.floor("o_totalprice").cast("long") * (F.col("o_orderkey") % 9)).alias("shown"))


@query("parse_frame_rate", "SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN (p_partkey % 60000) / (p_size % 3)::DOUBLE END AS rate FROM part")
def parse_frame_rate(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.parse_frame_rate(F.concat((F.col("p_partkey") % 60000).cast("string"), F.lit("/"), (F.col("p_size") % 3).cast("string"))).alias("rate"))


def _fused(spark, sf_dir):
    """Exact groups of documents, of which a similarity group holds two representatives at a time."""
    m = A.members(spark, sf_dir)
    ex = m.select("group_id", F.col("recommended").alias("recommended_file_id")).distinct()
    reps = ex.select("group_id", F.col("recommended_file_id").alias("rep_id"))
    sim = F.floor(F.col("group_id") / 100).cast("long")
    held = m.where("file_id = recommended").select(sim.alias("sg"), "file_id", "path", "quality", "size_bytes").withColumn("n", F.count("*").over(Window.partitionBy("sg"))).where("n > 1")
    g = held.groupBy(F.col("sg").alias("group_id")).agg(F.min("file_id").alias("recommended_file_id")).withColumn("group_type", F.lit("similar_text")).withColumn("confidence", F.lit(0.5))
    items = held.select(F.col("sg").alias("group_id"), "file_id", "path", "quality", "size_bytes").join(g.select("group_id", F.col("recommended_file_id").alias("w")), "group_id")
    items = items.withColumn("action", F.when(F.col("file_id") == F.col("w"), "keep_recommended").otherwise("review_required")).withColumn("similarity", F.when(F.col("file_id") == F.col("w"), 1.0).otherwise(0.9)).drop("w")
    return groups.fuse_exact(g, items, ex, m, reps)


_FUSED = f"""{A.MEMBERS}, held AS (SELECT * FROM (SELECT group_id // 100 AS sg, file_id, count(*) OVER (PARTITION BY group_id // 100) AS n FROM mem WHERE file_id = recommended) WHERE n > 1), sim AS (SELECT sg, min(file_id) AS w FROM held GROUP BY sg)"""


@query("fuse_exact", f"""WITH {_FUSED} SELECT sg AS group_id, m.file_id, CASE WHEN m.file_id = w THEN 'keep_recommended' WHEN m.recommended = w THEN 'cleanup_candidate' ELSE 'review_required' END AS action, CASE WHEN m.recommended = w THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END AS similarity
FROM held h JOIN sim USING (sg) JOIN mem m ON m.recommended = h.file_id""")
def fuse_exact(spark, sf_dir):
    return _fused(spark, sf_dir)[1].select("group_id", "file_id", "action", "similarity")


@query("fused_exact_groups", f"WITH {_FUSED} SELECT DISTINCT m.group_id FROM held h JOIN mem m ON m.recommended = h.file_id")
def fused_exact_groups(spark, sf_dir):
    return _fused(spark, sf_dir)[2]


@query("path_unique_copies", f"WITH {A.STORED} SELECT group_id, file_id FROM items")
def path_unique_copies(spark, sf_dir):
    """A second set of groups, all of whose members the first ones hold, is dissolved."""
    g, i = A.stored(spark, sf_dir)
    g = g.select("group_id", "group_type")
    again = i.select((F.col("group_id") + 10**9).alias("group_id"), "file_id", F.concat(F.lit(""), "path").alias("path"))
    more = g.select((F.col("group_id") + 10**9).alias("group_id"), F.lit("similar_text").alias("group_type"))
    return groups.path_unique(g.unionByName(more), i.select("group_id", "file_id", "path").unionByName(again))[1].select("group_id", "file_id")


#: Groups that overlap: of file ids near a document's, by type.
_OVERLAPS = (("exact", 5, 0, (0, 1)), ("similar_image", 3, 0, (0, 2, 4)), ("similar_text", 4, 5, (1, 3, 5)))
_CLAIMS = " UNION ALL ".join(f"SELECT {k} AS rank, doc_id AS d, [{', '.join(f'doc_id + {x}' for x in at)}] AS ids FROM documents WHERE doc_id % {by} = 0" + (f" AND (doc_id // {by}) % {skip} <> 0" if skip else "") for k, (_, by, skip, at) in enumerate(_OVERLAPS, 1))


@query("path_unique", f"""WITH RECURSIVE g AS (SELECT *, row_number() OVER (ORDER BY rank, d) AS rn FROM ({_CLAIMS})),
walk(rn, claimed, kept) AS (SELECT 0::BIGINT, []::BIGINT[], []::BIGINT[] UNION ALL SELECT rn, CASE WHEN len(f) > 1 THEN list_concat(claimed, f) ELSE claimed END, CASE WHEN len(f) > 1 THEN f ELSE [] END
 FROM (SELECT g.rn, w.claimed, list_filter(g.ids, lambda x: NOT list_contains(w.claimed, x)) AS f FROM walk w JOIN g ON g.rn = w.rn + 1))
SELECT rank * 1000000000 + d AS group_id, unnest(kept) AS file_id FROM walk JOIN g USING (rn)""")
def path_unique(spark, sf_dir):
    """Each file in the first of the overlapping groups that stands."""
    d, made = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("d")), None
    for k, (kind, by, skip, at) in enumerate(_OVERLAPS, 1):
        own = d.where(F.col("d") % by == 0)
        own = own.where(F.floor(F.col("d") / by) % skip != 0) if skip else own
        one = own.select((F.col("d") + k * 10**9).alias("group_id"), F.lit(kind).alias("group_type"), F.explode(F.array(*(F.col("d") + x for x in at))).alias("file_id"))
        made = one if made is None else made.unionByName(one)
    items = materialise(made.withColumn("path", F.concat(F.lit("/p/./"), "file_id")), "overlaps")
    return groups.path_unique(items.select("group_id", "group_type").distinct(), items.select("group_id", "file_id", "path"))[1].select("group_id", "file_id")


@query("clean_path", "SELECT page_id, '/a/' || split_part(url, '/', 3) || '/' || page_id AS path, '/' || page_id || '/../..' || '/' || split_part(url, '/', 3) AS dedupe, CASE WHEN page_id % 2 = 0 THEN '/x' ELSE '/w/x' END AS absolute FROM pages")
def clean_path(spark, sf_dir):
    host = F.get(F.split("url", "/"), F.lit(2))
    messy = F.concat(F.lit("/a//b/.././"), host, F.lit("/c/../"), "page_id", F.lit("/"))
    link = F.concat(F.lit("//"), "page_id", F.lit("/.././../"), host, F.lit("/"))
    relative = F.when(F.col("page_id") % 2 == 0, "/x").otherwise("x")
    return table(spark, sf_dir, "pages").select("page_id", S.clean_path(messy).alias("path"), S.dedupe_key(link).alias("dedupe"), S.absolute_path(relative, F.lit("/w")).alias("absolute"))


@query("version_compare", """WITH v AS (SELECT p_partkey, p_size // 10 AS a, p_size % 10 AS b, p_partkey % 3 AS c, p_partkey % 4 AS d FROM part)
SELECT p_partkey, CASE WHEN a <> c THEN sign(a - c) WHEN b <> d THEN sign(b - d) WHEN p_partkey % 2 = 1 THEN -1 ELSE 0 END::INTEGER AS sign FROM v""")
def version_compare(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("v"), F.floor(F.col("p_size") / 10), F.lit("."), F.col("p_size") % 10, F.when(F.col("p_partkey") % 2 == 1, "-rc1").otherwise("")).alias("a"), F.concat(F.col("p_partkey") % 3, F.lit("."), F.col("p_partkey") % 4, F.lit(".0")).alias("b"))
    return p.select("p_partkey", S.version_compare("a", "b").alias("sign"))


@query("quality_by_type", f"WITH {A.FILES} SELECT file_id, round(CASE file_id % 4 WHEN 0 THEN quality WHEN 1 THEN 0.25::DOUBLE WHEN 2 THEN 0.5::DOUBLE ELSE 0 END, 6) AS quality FROM files")
def quality_by_type(spark, sf_dir):
    kind = F.get(F.array(*(F.lit(x) for x in ("text", "image", "video", "other"))), (F.col("file_id") % 4).cast("int"))
    return A.files(spark, sf_dir).select("file_id", F.round(S.quality(kind, "size_bytes", F.lit(0.25), F.lit(0.5)), 6).alias("quality"))


@query("touch", "SELECT 'o/' || o_orderkey AS path, CASE WHEN o_orderkey % 3 = 0 THEN 'active' ELSE 'missing' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN TIMESTAMP '2024-05-01' ELSE TIMESTAMP '2024-01-01' END AS last_seen FROM orders")
def touch(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("o/"), "o_orderkey").alias("path"), F.lit("missing").alias("status"), F.lit("2024-01-01").cast("timestamp").alias("last_seen"), "o_orderkey")
    seen = o.where("o_orderkey % 3 = 0").select("path")
    out = store.touch(o.drop("o_orderkey"), seen.unionByName(seen), F.lit("2024-05-01").cast("timestamp"))
    return out.withColumn("last_seen", F.col("last_seen").cast("timestamp_ntz"))


@query("save_hashes", """SELECT path, size_bytes, CASE WHEN k % 2 = 0 THEN 'f' || k WHEN k % 3 = 0 THEN 'old' ELSE NULL END AS full_hash, CASE WHEN k % 5 = 0 THEN 'v1:s' || k WHEN k % 3 = 0 THEN 'v0:x' END AS sampled_hash, CASE WHEN k % 2 = 0 OR k % 3 = 0 THEN 'sha256' ELSE 'sha256-sampled' END AS algorithm
FROM (SELECT o_orderkey AS k, 'o/' || o_orderkey AS path, CASE WHEN o_orderkey % 5 = 0 THEN 5 WHEN o_orderkey % 2 = 0 THEN 2 ELSE 3 END::BIGINT AS size_bytes FROM orders) WHERE k % 2 = 0 OR k % 3 = 0 OR k % 5 = 0""")
def save_hashes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("o/"), "o_orderkey").alias("path"))
    size = lambda n: F.lit(n).cast("long").alias("size_bytes")
    old = o.where("k % 3 = 0").select("path", size(3), F.lit("old").alias("full_hash"), F.lit("v0:x").alias("sampled_hash"), F.lit("sha256").alias("algorithm"))
    return store.save_hashes(old, o.where("k % 2 = 0").select("path", size(2), F.concat(F.lit("f"), "k").alias("digest")), o.where("k % 5 = 0").select("path", size(5), F.concat(F.lit("s"), "k").alias("digest")))


@query("carry_features", "SELECT 'o/' || o_orderkey AS path, o_custkey AS width FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 13 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 11 <> 0")
def carry_features(spark, sf_dir):
    """Features of a first scan that a second may use again."""
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("o/"), "o_orderkey").alias("path"), F.col("o_custkey").alias("width"))
    return store.carry_features(rows, store.incremental_status(*_manifests(spark, sf_dir)))


@query("upsert_features", "SELECT 'o/' || o_orderkey AS path, unnest(CASE WHEN o_orderkey % 2 = 0 THEN [10] ELSE [1, 2] END)::INTEGER AS idx FROM orders")
def upsert_features(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("o/"), "o_orderkey").alias("path"), "o_orderkey")
    old = rows.select("path", F.explode(F.array(F.lit(1), F.lit(2))).alias("idx"))
    return store.upsert(old, rows.where("o_orderkey % 2 = 0").select("path", F.lit(10).alias("idx")))


@query("group_members", f"WITH {A.STORED} SELECT group_id, file_id, path FROM items JOIN groups USING (group_id) WHERE group_id % 2 = 0 AND file_id <> recommended_file_id")
def group_members(spark, sf_dir):
    g, i = A.stored(spark, sf_dir)
    return store.group_members(g, i, g.where("group_id % 2 = 0"))


_GONE = f"{A.STORED}, o AS (SELECT *, file_id % 3 = 0 AS ok, file_id % 3 = 1 AS failed, file_id % 5 <> 0 AS there FROM items)"


@query("delete_effects", f"WITH {_GONE} SELECT group_id FROM o GROUP BY group_id HAVING count(*) FILTER (WHERE ok) > 0 AND count(*) FILTER (WHERE NOT ok AND there) BETWEEN 1 AND count(*) - 1")
def delete_effects(spark, sf_dir):
    return _deleted(spark, sf_dir)[1]


@query("delete_audit", f"WITH {_GONE} SELECT 'trash' AS mode, group_id, file_id, path, ok, CASE WHEN ok THEN '' ELSE 'in use' END AS message FROM o WHERE ok OR failed")
def delete_audit(spark, sf_dir):
    return _deleted(spark, sf_dir)[0]


def _deleted(spark, sf_dir):
    g, i = A.stored(spark, sf_dir)
    outcome = i.where("file_id % 3 < 2").select("path", (F.col("file_id") % 3 == 0).alias("ok"), F.lit("in use").alias("message"))
    return store.delete_effects(g, i, outcome, i.where("file_id % 5 <> 0").select("path"), "trash")


@query("final_counters", f"WITH {A.STORED} SELECT count(*) FILTER (WHERE group_type = 'exact') AS exact, count(*) FILTER (WHERE group_type <> 'exact') AS similar FROM groups")
def final_counters(spark, sf_dir):
    return results.final_counters(A.stored(spark, sf_dir)[0])


def _errors(spark, sf_dir):
    kind = F.when(F.col("l_linenumber") == 1, "aux").when(F.col("l_linenumber") == 2, "").when(F.col("l_linenumber") == 3, "skipped")
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("error_id"), (F.col("l_orderkey") % 9).alias("scan_run_id"), F.concat(F.lit("f/"), "l_partkey").alias("path"), F.lit("file_hash").alias("stage"), kind.alias("kind"), F.col("l_returnflag").alias("message")).distinct()


@query("split_errors", "SELECT l_linenumber = 1 AS aux, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_returnflag FROM lineitem) GROUP BY 1")
def split_errors(spark, sf_dir):
    skipped, aux = results.split_errors(_errors(spark, sf_dir))
    return skipped.withColumn("aux", F.lit(False)).unionByName(aux.withColumn("aux", F.lit(True))).groupBy("aux").agg(F.count("*").alias("n"))


@query("load_errors", "SELECT path, stage, kind, message FROM (SELECT DISTINCT l_orderkey, l_linenumber, 'f/' || l_partkey AS path, 'file_hash' AS stage, CASE l_linenumber WHEN 1 THEN 'aux' WHEN 2 THEN '' ELSE 'skipped' END AS kind, l_returnflag AS message FROM lineitem WHERE l_orderkey % 9 = 4)")
def load_errors(spark, sf_dir):
    return results.load_errors(_errors(spark, sf_dir), 4)


@query("latest_run", "SELECT max(l_orderkey % 9) AS scan_run_id FROM lineitem")
def latest_run(spark, sf_dir):
    return results.latest_run(_errors(spark, sf_dir).select("scan_run_id").distinct())


@query("list_groups_by_size", f"WITH {A.STORED} SELECT group_id, row_number() OVER (ORDER BY bytes DESC, group_id)::INTEGER AS place FROM (SELECT group_id, sum(CASE WHEN file_id <> recommended_file_id THEN size_bytes ELSE 0 END) AS bytes FROM groups JOIN items USING (group_id) GROUP BY group_id)")
def list_groups_by_size(spark, sf_dir):
    """A client's order of the list, told by places."""
    shown = results.list_groups(*A.stored(spark, sf_dir), status="all", sort="size").select("group_id").limit(100_000)
    return shown.select("group_id", (F.row_number().over(Window.orderBy(F.monotonically_increasing_id()))).alias("place"))


@query("order_projects", "SELECT c_custkey, row_number() OVER (ORDER BY c_nationkey % 4 = 0, CASE WHEN c_nationkey % 4 <> 0 THEN c_acctbal END DESC, CASE WHEN c_nationkey % 4 = 0 THEN c_acctbal END DESC)::INTEGER AS place FROM customer")
def order_projects(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 4 != 0, F.col("c_acctbal")).alias("last_scan_at"), F.col("c_acctbal").alias("created_at"))
    return results.order_projects(rows).select("c_custkey").select("c_custkey", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())).alias("place"))


@query("recent_folders", "SELECT c_name AS path FROM customer ORDER BY c_acctbal DESC, c_name LIMIT 30")
def recent_folders(spark, sf_dir):
    return results.recent_folders(table(spark, sf_dir, "customer").select(F.col("c_name").alias("path"), F.col("c_acctbal").alias("last_used_at")), 30).select("path")


@query("feature_blobs", "SELECT doc_id, strlen(text)::BIGINT AS n FROM documents")
def feature_blobs(spark, sf_dir):
    """Features through the form of a store without arrays, and back."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for b in batches:
            back = [T.decode_features(T.encode_features(np.array([n, 2**64 - 1], np.uint64))) for n in b["n"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([int(x[0]) if int(x[1]) == 2**64 - 1 else -1 for x in back], pa.int64())], ["doc_id", "n"])

    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n")).mapInArrow(run, "doc_id long, n long")
