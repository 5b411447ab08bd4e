"""Column expressions: digests, distances, names, qualities and texts of a report."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def le64(x) -> Column:
    """A long as eight bytes, lowest first."""
    return F.unhex(F.regexp_replace(F.lpad(F.hex(col(x)), 16, "0"), "(..)" * 8, "".join(f"${k}" for k in range(8, 0, -1))))


def sha256_full(content) -> Column:
    return F.sha2(col(content), 256)


def sha256_sampled(content, segment: int) -> Column:
    """Digest of the size and of three segments with their offsets; of all if three would cover it."""
    c = col(content)
    size = F.octet_length(c).cast("long")
    part = lambda at: F.concat(le64(at), F.substring(c, at.cast("int") + 1, F.lit(segment)))
    three = F.concat(le64(size), part(F.lit(0).cast("long")), part(F.floor((size - segment) / 2).cast("long")), part(size - segment))
    return F.when(size <= 3 * segment, F.sha2(F.concat(le64(size), c), 256)).otherwise(F.sha2(three, 256))


def hamming(a, b) -> Column:
    return F.bit_count(col(a).bitwiseXOR(col(b)))


def hash_similarity(a, b, bits: int = 64) -> Column:
    return F.greatest(F.lit(0.0), 1 - hamming(a, b) / bits)


def max_hamming(threshold: float, bits: int = 64) -> int:
    return int(bits * (1 - min(1.0, max(0.0, threshold))))


def extension(path) -> Column:
    return F.lower(F.regexp_extract(F.regexp_extract(col(path), r"([^/]*)$", 1), r"(\.[^.]*)$", 1))


def media_type(path) -> Column:
    e = extension(path)
    return F.when(e.isin(*config.IMAGE_EXTENSIONS), "image").when(e.isin(*config.VIDEO_EXTENSIONS), "video").when(e.isin(*config.TEXT_EXTENSIONS), "text")


def supports_phash(path) -> Column:
    return ~extension(path).isin(*config.NO_PHASH)


def image_bucket(pixels) -> Column:
    return F.greatest(F.expr("1") * F.floor((col(pixels) + 4) / 8) * 8, F.lit(8)).cast("long")


def normalise_text(text) -> Column:
    """White space runs as one space, trimmed, lower-cased; text_facts() also applies NFKC."""
    bare = F.regexp_replace(col(text), "[\\x{FEFF}\\x{200B}]", "")
    return F.lower(F.regexp_replace(F.regexp_replace(bare, r"[\s\x{85}\x{A0}\p{Z}]+", " "), r"^ | $", ""))


def normalise_name(name) -> Column:
    base = F.regexp_replace(col(name), r"\.[^.]*$", "")
    return F.regexp_replace(F.regexp_replace(F.lower(base), r"[^\p{L}\p{Nd}]+", " "), r"^ | $", "")


def name_grams(name) -> Column:
    """The tokens of a normalised name, and the character pairs of those with Han characters."""
    tokens = F.filter(F.split(col(name), " "), lambda t: t != "")
    han = F.filter(tokens, lambda t: F.rlike(t, F.lit(r"\p{IsHan}")) & (F.char_length(t) > 1))
    pairs = F.flatten(F.transform(han, lambda t: F.transform(F.sequence(F.lit(1), F.char_length(t) - 1), lambda i: F.substr(t, i, F.lit(2)))))
    return F.array_distinct(F.concat(tokens, pairs))


def overlap_of_grams(a, b) -> Column:
    """Shared grams over the smaller set; Jaccard is never greater."""
    least = F.least(F.size(col(a)), F.size(col(b)))
    return F.when(least > 0, F.size(F.array_intersect(col(a), col(b))) / least).otherwise(0.0)


def dice(a, b) -> Column:
    both = F.size(col(a)) + F.size(col(b))
    return F.when((F.size(col(a)) > 0) & (F.size(col(b)) > 0), 2 * F.size(F.array_intersect(col(a), col(b))) / both).otherwise(0.0)


def length_close(a, b) -> Column:
    return (col(a) > 0) & (col(b) > 0) & (F.least(col(a), col(b)) / F.greatest(col(a), col(b)) >= config.LENGTH_RATIO)


def text_floor(threshold: float, name_similarity) -> Column:
    return F.when(col(name_similarity) >= config.NAME_MATCH, threshold - config.NAME_DELTA).otherwise(threshold - config.PLAIN_DELTA)


def _share(value, full: float, weight: float) -> Column:
    return F.least(F.lit(weight), F.log1p(value) / math.log1p(full) * weight)


def image_quality(width, height, format_name, size, readable=None) -> Column:
    f = F.upper(col(format_name))
    kind = F.when(f.isin("TIFF", "PNG", "HEIC", "HEIF"), 0.10).when(f.isin("JPEG", "JPG", "WEBP"), 0.07).otherwise(0.03)
    total = _share(col(width) * col(height) / 1e6, 12, 0.70) + kind + _share(F.greatest(col(size), F.lit(0)), 1e7, 0.10) + 0.10
    score = F.least(F.lit(1.0), total)
    return score if readable is None else F.when(col(readable), score).otherwise(0.0)


def video_quality(width, height, bit_rate, codec, audio, duration, readable=None) -> Column:
    rate = F.when(col(bit_rate) > 0, _share(col(bit_rate), 2e7, 0.20)).otherwise(0.0)
    total = _share(col(width) * col(height), 3840 * 2160, 0.55) + rate + F.when(F.lower(col(codec)).isin("h264", "hevc", "h265"), 0.10).otherwise(0.05) + F.when(col(audio), 0.05).otherwise(0.0) + F.when(col(duration) > 0, 0.10).otherwise(0.0)
    score = F.least(F.lit(1.0), total)
    return score if readable is None else F.when(col(readable), score).otherwise(0.0)


def text_quality(size) -> Column:
    return F.when(col(size) > 0, F.least(F.lit(1.0), 0.5 + F.log1p(col(size)) / math.log1p(3e7) * 0.5)).otherwise(0.0)


def stable_key(group_type, paths) -> Column:
    """Sorted paths, then lower-cased, hashed with the type."""
    joined = F.array_join(F.transform(F.array_sort(col(paths)), F.lower), "|")
    return F.substring(F.sha2(F.concat(col(group_type), F.lit("|"), joined), 256), 1, 32)


def human_bytes(n) -> Column:
    x = col(n)  # ties of the last digit go to the even one
    out = F.concat(x.cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KiB", "MiB", "GiB", "TiB", "PiB", "EiB"), 1):
        out = F.when(x >= 1024**k, F.format_string(f"%.1f {unit}", F.bround(x / float(1024**k), 1))).otherwise(out)
    return out


def similarity_text(x) -> Column:
    return F.when(col(x) < 0, "—").otherwise(F.format_string("%.2f", F.bround(col(x), 2)))


def parse_frame_rate(text) -> Column:
    p = F.split(col(text), "/")
    num, den = F.expr("1") * F.try_to_number(F.get(p, F.lit(0)), F.lit("999999999")), F.try_to_number(F.get(p, F.lit(1)), F.lit("999999999"))
    return F.when(F.size(p) == 2, F.try_divide(num.cast("double"), den.cast("double"))).otherwise(num.cast("double"))


def clean_path(path) -> Column:
    """A path without empty and "." segments, and with each ".." and the segment before it taken away."""
    rooted = F.startswith(col(path), F.lit("/"))
    none = F.array().cast("array<string>")

    def step(kept: Column, part: Column) -> Column:
        climbs = (F.size(kept) > 0) & (F.element_at(kept, -1) != "..")
        up = F.when(climbs, F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).when(rooted, kept).otherwise(F.array_append(kept, part))
        return F.when(part.isin("", "."), kept).when(part == "..", up).otherwise(F.array_append(kept, part))

    kept = F.aggregate(F.split(col(path), "/"), none, step)
    return F.when(rooted, F.concat(F.lit("/"), F.array_join(kept, "/"))).when(F.size(kept) == 0, ".").otherwise(F.array_join(kept, "/"))


def dedupe_key(path) -> Column:
    """One spelling of a folder entry for deletions: "." and empty segments go, but ".." stays, since a link may stand before it."""
    kept = F.filter(F.split(col(path), "/"), lambda p: ~p.isin("", "."))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def absolute_path(path, folder) -> Column:
    """The path under a working folder unless it is absolute; nothing else is changed."""
    return F.when(F.startswith(col(path), F.lit("/")), col(path)).otherwise(F.concat(col(folder), F.lit("/"), col(path)))


def version_key(version) -> tuple[Column, Column]:
    """(numbers, pre-release) of a version like v1.2.3-beta; a segment that is no number counts as 0."""
    bare = F.regexp_replace(F.trim(col(version)), "^[vV]", "")
    parts = F.split(bare, "-", 2)
    numbers = F.transform(F.split(F.get(parts, F.lit(0)), r"\."), lambda x: F.coalesce(F.when(F.rlike(x, F.lit(r"^[+-]?\d{1,18}$")), x.try_cast("long")), F.lit(0).cast("long")))
    return numbers, F.coalesce(F.get(parts, F.lit(1)), F.lit(""))


def version_compare(a, b) -> Column:
    """1, 0 or -1; missing segments are 0, and a release is later than its pre-releases."""
    (x, p), (y, q) = version_key(a), version_key(b)
    signs = F.transform(F.arrays_zip(x.alias("x"), y.alias("y")), lambda z: F.signum(F.coalesce(z["x"], F.lit(0)) - F.coalesce(z["y"], F.lit(0))).cast("int"))
    first = F.coalesce(F.get(F.filter(signs, lambda s: s != 0), F.lit(0)), F.lit(0))
    return F.when(first != 0, first).when(p == q, 0).when(p == "", 1).when(q == "", -1).when(p > q, 1).otherwise(-1).cast("int")


def quality(kind, size, image=None, video=None) -> Column:
    """The quality of a file by its type; what isn't known of it scores 0."""
    zero = F.lit(0.0)
    return F.when(col(kind) == "text", text_quality(size)).when(col(kind) == "image", zero if image is None else F.coalesce(image, zero)).when(col(kind) == "video", zero if video is None else F.coalesce(video, zero)).otherwise(0.0)
