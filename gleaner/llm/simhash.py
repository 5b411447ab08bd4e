"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints at distance r or less have a common variant: one of the
first's within half of r, rounded up, and one of the second's within half of r,
rounded down. Variants meet by value in a shuffle. Since a variant that differs
from its fingerprint only below the first `t` bits has the fingerprint's own
prefix, a message carries a prefix and stands for all variants under it; the
receiving task enumerates them. Colliding pairs are verified, and of each task's
links a spanning forest goes on to the connected components.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..storage import materialise, partitions, table
from .common import get_arrays, lean, put_arrays, utf8

SEED = 42
GROUP = 255
#: LUT[b] holds the bits of byte b in eight lanes of a byte, lowest bit first.
LUT = np.zeros(256, np.uint64)
for _b in range(8):
    LUT = LUT + (((np.arange(256, dtype=np.uint64) >> np.uint64(_b)) & np.uint64(1)) << np.uint64(8 * _b))


def shingle_hashes(text: bytes, width: int) -> list[int]:
    """XXH64 of the word shingles of a text, repeats included."""
    words = text.lower().split()
    if not words:
        return []
    joined = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    h, s = xxhash.xxh64_intdigest, SEED
    return [h(x, s) for x in joined]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of documents whose hashes follow each other, counts[i] of them each."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n = counts[full].astype(np.int64)
    begins = np.cumsum(n) - n
    groups = -(-n // GROUP)
    of = np.repeat(np.arange(len(full)), groups)
    first = np.cumsum(groups) - groups
    starts = begins[of] + (np.arange(len(of)) - first[of]) * GROUP
    lanes = hashes.view(np.uint8).reshape(-1, 8)
    result = np.zeros(len(full), np.uint64)
    for byte in range(8):
        sums = np.add.reduceat(LUT[lanes[:, byte]], starts).view(np.uint8).reshape(-1, 8).astype(np.int64)
        ones = np.add.reduceat(sums, first, axis=0)
        bits = (2 * ones > n[:, None]).astype(np.uint64)
        for b in range(8):
            result |= bits[:, b] << np.uint64(8 * byte + b)
    out[full] = result
    return out


def fingerprint_batch(texts: list[bytes], width: int) -> np.ndarray:
    out, held, counts = [], [], []
    for i, t in enumerate(texts):
        h = shingle_hashes(t, width)
        held += h
        counts.append(len(h))
        if len(held) > 1 << 19 or i + 1 == len(texts):
            out.append(majority(np.array(held, np.uint64), np.array(counts, np.int64)))
            held, counts = [], []
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint of each row; null or wordless text gives 0."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(fingerprint_batch(utf8(b["text"]), width).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, fp long")


def _masks(bits: range, most: int) -> dict[int, np.ndarray]:
    """By number of flips: the XOR masks over these bit positions."""
    return {k: np.array([sum(1 << b for b in c) for c in combinations(bits, k)], np.uint64) for k in range(most + 1)}


def _messages(tag: np.ndarray, used: np.ndarray, value: np.ndarray, bits: range, most: int):
    """Variants that flip only these bits, each with the flips left to spend below."""
    masks = _masks(bits, most)
    for k, m in masks.items():
        keep = used + k <= most
        if not keep.any():
            continue
        yield (np.repeat(tag[keep], len(m)), np.repeat(used[keep] + np.uint8(k), len(m)), (value[keep][:, None] ^ m[None, :]).ravel())


def _gather(parts):
    parts = list(parts)
    return [np.concatenate([p[i] for p in parts]) for i in range(3)] if parts else [np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(0, np.uint64)]


class Points:
    """The points that one task has been told of; close() verifies links between them."""

    def __init__(self, ids, fp, radius: int):
        self.ids, at = np.unique(ids, return_index=True)
        self.fp, self.radius = fp[at], radius

    def close(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.fp[a] ^ self.fp[b]) <= self.radius


class Forest:
    """Union-find over the ids of one task; link() says whether two trees met."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up, top = self.up, x
        while (y := up.get(top, top)) != top:
            top = y
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def link(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _meet(tag, used, value, low: int, near: int, far: int, limit: int, points: Points, forest: Forest, links: list) -> None:
    """Enumerate the variants below bit `low` and link what meets; `far` >= `near` flips a side."""
    if len(np.unique(tag)) < 2:
        return
    per = [0] * (far + 1)
    for u in range(far + 1):
        c, x = 1, 1
        for k in range(1, far - u + 1):
            c = c * (low - k + 1) // k
            x += c
        per[u] = x
    if low > 4 and sum(int((used == u).sum()) * per[u] for u in range(far + 1)) > limit:
        step = 4
        tag, used, value = _gather(_messages(tag, used, value, range(low - step, low), far))
        at = (value >> np.uint64(low - step)) & np.uint64((1 << step) - 1)
        for x in range(1 << step):
            if (pick := at == x).sum() > 1:
                _meet(tag[pick], used[pick], value[pick], low - step, near, far, limit, points, forest, links)
        return
    tag, used, value = _gather(_messages(tag, used, value, range(low), far))
    ordered = np.sort(value)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return
    place = np.minimum(np.searchsorted(twice, value), len(twice) - 1)
    hit = twice[place] == value
    tag, used, value = tag[hit], used[hit], value[hit]
    order = np.lexsort((tag, used, value))
    tag, used, value = tag[order], used[order], value[order]
    while len(tag):
        first = np.r_[True, value[1:] != value[:-1]]
        heads = np.flatnonzero(first)[np.cumsum(first) - 1]
        fine = used[heads] <= near
        ok = fine & ~first & points.close(tag[heads], tag)
        for a, b in np.unique(np.stack([tag[heads][ok], tag[ok]], axis=1), axis=0).tolist():
            if forest.link(a, b):
                links.append((int(points.ids[a]), int(points.ids[b])))
        rest = fine & ~first & ~ok  # what isn't close to the head may be close to each other
        tag, used, value = tag[rest], used[rest], value[rest]


def ball_links(points: DataFrame, radius: int = 3, limit: int = 1 << 20) -> DataFrame:
    """(src, dst): links that connect whatever lies within `radius` bits.

    points: (fp long, doc_id long), distinct doc_ids. Every row is a real link
    between two ids; paths over them reach exactly what paths over all links within
    the radius reach. At a meeting variant all are linked to one member that is
    within the smaller half, so no pairs within a group are listed.
    """
    spark = points.sparkSession
    near, far = radius // 2, radius - radius // 2
    n = points.count()
    t = min(28, max(4, (max(1, n) // 64).bit_length()))
    parts = partitions(spark)

    def send(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                fp, ids = (b[c].slice(lo, 4096).to_numpy(zero_copy_only=False) for c in ("fp", "doc_id"))
                fp = fp.view(np.uint64)
                tag, used, value = _gather(_messages(np.arange(len(fp)), np.zeros(len(fp), np.uint8), fp, range(64 - t, 64), far))
                r = ((value >> np.uint64(64 - t)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(parts)
                order = np.argsort(r, kind="stable")
                cuts = np.searchsorted(r[order], np.arange(parts + 1))
                rows = []
                for k in range(parts):
                    if cuts[k] < cuts[k + 1]:
                        i = order[cuts[k] : cuts[k + 1]]
                        own, at = np.unique(tag[i], return_inverse=True)
                        rows.append((k, put_arrays(at.astype(np.uint16), used[i], value[i] >> np.uint64(64 - t), ids[own], fp[own])))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["r", "blob"])

    def receive(batches):
        got = []
        for b in batches:
            got += [get_arrays(x.as_py()) for x in b["blob"]]
        if not got:
            return
        held = Points(np.concatenate([g[3] for g in got]), np.concatenate([g[4] for g in got]), radius)
        tag = np.concatenate([np.searchsorted(held.ids, g[3])[g[0]] for g in got])
        used, top = np.concatenate([g[1] for g in got]), np.concatenate([g[2] for g in got])
        order = np.argsort(top, kind="stable")
        tag, used, top = tag[order], used[order], top[order]
        value = (top << np.uint64(64 - t)) | (held.fp[tag] & np.uint64((1 << (64 - t)) - 1))
        forest, links = Forest(), []
        cuts = np.r_[np.flatnonzero(np.r_[True, top[1:] != top[:-1]]), len(top)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi - lo > 1:
                _meet(tag[lo:hi], used[lo:hi], value[lo:hi], 64 - t, near, far, limit, held, forest, links)
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["src", "dst"])

    return points.select("fp", "doc_id").repartition(parts, "doc_id").mapInArrow(send, "r int, blob binary").repartition(parts, "r").select("blob").mapInArrow(receive, "src long, dst long")


def simhash_components(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs.

    Null and wordless texts have fingerprint zero and are linked like any other;
    rows with a null doc_id keep their fingerprint and the component of their
    equals, and null where they stand alone. Repeated rows stay repeated. An
    empty table gives an empty result; other columns are ignored.
    """
    marked = materialise(fingerprints(docs, width), "fingerprints")
    points = materialise(marked.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "points")
    parts = connected_components(materialise(ball_links(points, radius), "links"))
    classes = points.join(parts, points["doc_id"] == parts["id"], "left").select(F.col("fp").alias("f"), F.coalesce("component", "doc_id").alias("component_id"))
    return marked.join(classes, marked["fp"] == classes["f"], "left").select("doc_id", "fp", "component_id")


def op4(spark, sf_dir):
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: near_duplicates(): bins of the sketch of a text's 5-word shingles, and the similarity of near copies.
BINS, WIDTH, SIMILAR = 2048, 5, 0.8
#: A pair is ruled out by its sketch only where it differs by so many standard errors more than similar ones do.
SLACK = 5.0
#: The most that a SimHash bit of two texts of similarity SIMILAR differs: 4 shingles of 5. Of larger sets 0.15 do.
FLIP = 0.1875
#: Share of similar pairs that may agree in no band.
MISSED = 0.002
#: Words of a SimHash that travel with each band, and the bits of them in which candidates may differ.
CLOSE_WORDS, CLOSE_BITS = 3, 55
#: Bins that travel with them, in words; the bins of the sketch, folded.
FOLD = 4
#: Members of a band's bucket that are compared with each other; those of a larger one are all candidates.
WHOLE = 4096
#: Rounds in which the members of a clump are compared with PIVOTS of them each, before all that are still apart are.
ROUNDS, PIVOTS = 1, 32
_mix = np.random.Generator(np.random.PCG64(4))
#: One for each word of the longest SimHash.
WORD_ODD = _mix.integers(1, 2**62, 80, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PIVOT_SALTS = _mix.integers(1, 2**62, (ROUNDS, PIVOTS)).tolist()
#: Texts that are signed at a time: so many at most, of so many bytes.
SIGN_TEXTS, SIGN_BYTES = 1024, 1 << 21


def _stir(h: np.ndarray, odd: np.uint64) -> np.ndarray:
    x = (h ^ (h >> np.uint64(31))) * odd
    return x ^ (x >> np.uint64(29))


def shingle_set(text: bytes) -> np.ndarray:
    """The distinct 64-bit hashes of the 5-word shingles of a text, ascending."""
    return np.unique(np.array(shingle_hashes(text, WIDTH), np.uint64))


class Bands:
    """The bands of a SimHash by which n texts meet: `count` of them, of `width` bits each.

    A band of unrelated texts agrees by chance, so its width grows with the logarithm
    of n: a bucket has some 128 to 256 of them, up to 2^26 texts. Two similar
    texts differ in a bit with probability FLIP at most, and agree in none of the
    bands with probability MISSED at most.
    """

    def __init__(self, n: int):
        self.width = min(18, max(4, n.bit_length() - 8))
        self.count = math.ceil(math.log(MISSED) / math.log1p(-((1 - FLIP) ** self.width)))
        self.words = max(CLOSE_WORDS, -(-self.count * self.width // 64))

    def of(self, prints: np.ndarray) -> np.ndarray:
        """n x count: the bands of SimHashes, n x words, each with its number in the bits above it."""
        bits = np.unpackbits(prints.view(np.uint8).reshape(len(prints), -1), axis=1, bitorder="little")[:, : self.count * self.width]
        values = bits.reshape(len(prints), self.count, self.width) @ (np.int64(1) << np.arange(self.width))
        return values | np.arange(self.count) << self.width


def simhash_words(sets: list[np.ndarray], words: int) -> np.ndarray:
    """n x words: SimHashes of 64 * words bits of sets of 64-bit hashes; zero for empty ones."""
    flat, counts = np.concatenate([np.zeros(0, np.uint64), *sets]), np.array([len(x) for x in sets], np.int64)
    return np.stack([majority(_stir(flat, odd), counts) for odd in WORD_ODD[:words]], axis=1)


def _signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sketches and filled bins, n x (BINS / 64) each, of sets that aren't empty.

    The sketch has one bit of the least hash of each bin; where a bin is filled in
    either of two texts, these bits differ with probability (1 - s) / 2.
    """
    flat = np.concatenate(sets)
    n = np.array([len(x) for x in sets], np.int64)
    none = np.uint64(2**64 - 1)
    least = np.full(len(sets) * BINS, none, np.uint64)
    mixed = _stir(flat, np.uint64(0xD6E8FEB86659FD93))
    np.minimum.at(least, np.repeat(np.arange(len(sets)) * BINS, n) + (mixed % np.uint64(BINS)).astype(np.int64), mixed)
    filled = least != none
    ones = filled & ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(63)).astype(bool)
    return tuple(np.packbits(x.reshape(len(sets), BINS), axis=1, bitorder="little").view(np.int64) for x in (ones, filled))


def _sign(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, h, n, spare, sketch, filled, print, fold, z): the hash, size, sketch and SimHash of each text's set of shingles, and the text itself, compressed.

    spare is how many shingles more the set has than filled bins; fold has the filled bins in fewer words.
    """
    longs = pa.list_(pa.int64())
    kinds = [("doc_id", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("spare", pa.int64()), ("sketch", longs), ("filled", longs), ("print", longs), ("fold", longs), ("z", pa.binary())]

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for b in batches:
            texts, lo = utf8(b["text"]), 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and hi < lo + SIGN_TEXTS and (hi == lo or size + len(texts[hi]) < SIGN_BYTES):
                    size += len(texts[hi])
                    hi += 1
                sets = [shingle_set(t) for t in texts[lo:hi]]
                some = [k for k, x in enumerate(sets) if len(x)]
                sketch, filled = np.zeros((2, len(sets), BINS // 64), np.int64)
                if some:
                    sketch[some], filled[some] = _signatures([sets[k] for k in some])
                prints = simhash_words(sets, words).view(np.int64)
                h = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
                n = np.array([len(x) for x in sets], np.int64)
                values = [b["doc_id"].slice(lo, hi - lo), h, n, n - np.bitwise_count(filled.view(np.uint64)).sum(axis=1, dtype=np.int64), list(sketch), list(filled), list(prints), list(np.bitwise_or.reduce(filled.reshape(len(sets), -1, FOLD), axis=1)), [squeeze.compress(t) for t in texts[lo:hi]]]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, kind) for x, (_, kind) in zip(values, kinds, strict=True)], [name for name, _ in kinds])
                lo = hi

    return docs.mapInArrow(lean(run), "doc_id long, h long, n long, spare long, sketch array<long>, filled array<long>, print array<long>, fold array<long>, z binary")


def _clusters(prints: np.ndarray, folds: np.ndarray, sizes: np.ndarray, similarity: float) -> tuple[list[np.ndarray], np.ndarray]:
    """Places of those that are joined by chains of close pairs, all where they are more than WHOLE; the closest other of each.

    Close are pairs within CLOSE_BITS of which sizes and folded bins don't say that
    they can't be similar: they share no more than the bins filled in both and what
    either has beyond its bins.
    """
    m = len(prints)
    if m > WHOLE:
        return [np.arange(m)], np.zeros(m, np.int64)
    spare = sizes - np.bitwise_count(folds).sum(axis=1, dtype=np.int32)
    close, nearest = np.empty((m, m), bool), np.empty(m, np.int64)
    for lo in range(0, m, 512):
        apart = np.zeros((len(prints[lo : lo + 512]), m), np.uint8)
        for word in prints.T:
            apart += np.bitwise_count(word[lo : lo + 512, None] ^ word[None, :])
        rows = np.arange(len(apart))
        apart[rows, lo + rows] = 255
        x, y = np.nonzero(apart <= CLOSE_BITS)
        i = lo + x
        shared = np.bitwise_count(folds[i] & folds[y]).sum(axis=1, dtype=np.int32) + np.minimum(spare[i], spare[y])
        total = sizes[i] + sizes[y]
        can = (shared * (1 + similarity) >= similarity * total - 1e-6) & (np.minimum(sizes[i], sizes[y]) >= similarity * np.maximum(sizes[i], sizes[y]) - 1e-6)
        mine = np.zeros(apart.shape, bool)
        mine[x[can], y[can]] = True
        close[lo : lo + 512], nearest[lo : lo + 512] = mine, np.where(mine, apart, 255).argmin(axis=1)
    left = close.any(axis=1)
    out = []
    while left.any():
        new = np.zeros(m, bool)
        new[np.argmax(left)] = True
        found = new
        while new.any():
            left &= ~new
            new = close[new].any(axis=0) & left
            found = found | new
        out.append(np.flatnonzero(found))
    return out, nearest


def band_members(points: DataFrame, bands: Bands, similarity: float = SIMILAR) -> DataFrame:
    """(key, h, lo, near) of points (h, n, print, fold), distinct h: whose SimHashes agree in a band and are close.

    The members of a key agree in one band, and each differs in CLOSE_BITS of the
    first CLOSE_WORDS words or fewer from another, with which it can be similar by
    its n shingles and their folded bins; lo is the least of them. Every pair of
    points that agree in a band and are as close shares a key. near is the closest
    member by these words, or, of a bucket of over WHOLE, any one.
    """
    parts = partitions(points.sparkSession)

    def send(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                ids = part["h"].to_numpy(zero_copy_only=False)
                prints = part["print"].flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(ids), bands.words)
                folds = part["fold"].flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(ids), FOLD)
                sizes = part["n"].to_numpy(zero_copy_only=False).astype(np.int32)
                band = bands.of(prints).ravel()
                tag = np.repeat(np.arange(len(ids)), bands.count)
                r = _stir(band.astype(np.uint64), WORD_ODD[0]) % np.uint64(parts)
                order = np.lexsort((band, r))
                cuts = np.searchsorted(r[order], np.arange(parts + 1))
                rows = []
                for k in range(parts):
                    if cuts[k] < cuts[k + 1]:
                        i = order[cuts[k] : cuts[k + 1]]
                        own, where = np.unique(tag[i], return_inverse=True)
                        rows.append((k, put_arrays(where.astype(np.uint16), np.diff(band[i], prepend=0).astype(np.uint32), ids[own], sizes[own], *(prints[own, w] for w in range(CLOSE_WORDS)), *(folds[own, w] for w in range(FOLD)))))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["r", "blob"])

    def receive(batches):
        got = [get_arrays(x.as_py()) for b in batches for x in b["blob"]]
        if not got:
            return
        starts = np.cumsum([0, *(len(g[2]) for g in got)])
        tag = np.concatenate([g[0].astype(np.int64) + lo for g, lo in zip(got, starts, strict=False)])
        band = np.concatenate([np.cumsum(g[1], dtype=np.int64) for g in got])
        ids = np.concatenate([g[2] for g in got])
        sizes = np.concatenate([g[3] for g in got])
        words = np.stack([np.concatenate([g[4 + w] for g in got]) for w in range(CLOSE_WORDS + FOLD)], axis=1)
        prints, folds = words[:, :CLOSE_WORDS], words[:, CLOSE_WORDS:]
        del got
        order = np.argsort(band, kind="stable")
        tag, band = tag[order], band[order]
        cuts = np.r_[np.flatnonzero(np.r_[True, band[1:] != band[:-1]]), len(band)]
        found, held = [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["key", "h", "lo", "near"])

        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if hi - lo < 2:
                continue
            own = tag[lo:hi]
            clusters, nearest = _clusters(prints[own], folds[own], sizes[own], similarity)
            for c in clusters:
                h = ids[own[c]]
                key = _stir(_stir(h.min(keepdims=True).view(np.uint64), WORD_ODD[1]) + np.uint64(band[lo]), WORD_ODD[2]).view(np.int64)
                found.append((np.repeat(key, len(h)), h, np.repeat(h.min(keepdims=True), len(h)), ids[own[nearest[c]]]))
                held += len(h)
            if held >= 1 << 16:
                yield flush()
                found, held = [], 0
        if held:
            yield flush()

    return points.select("h", F.col("n").cast("int").alias("n"), "print", "fold").mapInArrow(lean(send), "r int, blob binary").repartition(parts, "r").select("blob").mapInArrow(lean(receive), "key long, h long, lo long, near long")


def _likely(similarity: float):
    """Whether rows a and b can be similar: by their sizes and bins surely, by their sketches but for SLACK standard errors.

    What two sets share fills bins of both, so they share no more than these and
    what either has beyond its bins.
    """
    total = lambda x, y, f: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(f(p, q))), F.lit(0), lambda s, k: s + k)
    shared = total("a.filled", "b.filled", lambda p, q: p.bitwiseAND(q)) + F.least("a.spare", "b.spare")
    apart = total("a.sketch", "b.sketch", lambda p, q: p.bitwiseXOR(q))
    bins = total("a.filled", "b.filled", lambda p, q: p.bitwiseOR(q))
    share = (1 - similarity) / 2
    near = apart <= share * bins + SLACK * F.sqrt(share * (1 - share) * bins) + 1
    sizes = F.least("a.n", "b.n") / F.greatest("a.n", "b.n") >= similarity
    return sizes & (shared * (1 + similarity) >= similarity * (F.col("a.n") + F.col("b.n")) - 1e-6) & near


def _across(rest: DataFrame, similarity: float) -> DataFrame:
    """(src, dst): pairs of rest (key, h, c, n, spare, sketch, filled) within a key and across components c, that pass what _likely() tests.

    No key has more than WHOLE rows; all but its largest component are compared with all.
    """
    share = (1 - similarity) / 2

    def run(batches):
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        key, h, c, n, spare = (np.concatenate([b[x].to_numpy() for b in rows]) for x in ("key", "h", "c", "n", "spare"))
        sketch, filled = (np.concatenate([b[x].flatten().to_numpy().reshape(b.num_rows, -1) for b in rows]).view(np.uint64) for x in ("sketch", "filled"))
        del rows
        fold = np.bitwise_or.reduce(filled.reshape(len(key), -1, FOLD), axis=1)
        folded = n - np.bitwise_count(fold).sum(axis=1, dtype=np.int64)

        def likely(i, j):
            """Of pairs, those that are; the cheapest test first."""
            fine = c[i] != c[j]
            for what in (lambda i, j: np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-6, lambda i, j: bound(fold, folded, i, j), lambda i, j: bound(filled, spare, i, j), near):
                i, j = i[fine], j[fine]
                fine = what(i, j)
            return i[fine], j[fine]

        def bound(bins, beyond, i, j):
            shared = np.bitwise_count(bins[i] & bins[j]).sum(axis=1, dtype=np.int64) + np.minimum(beyond[i], beyond[j])
            return shared * (1 + similarity) >= similarity * (n[i] + n[j]) - 1e-6

        def near(i, j):
            bins = np.bitwise_count(filled[i] | filled[j]).sum(axis=1, dtype=np.int64)
            return np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1, dtype=np.int64) <= share * bins + SLACK * np.sqrt(share * (1 - share) * bins) + 1

        order = np.argsort(key, kind="stable")
        cuts = np.r_[np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]]), len(order)]
        held, many, found = [], 0, set()
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own = order[lo:hi]
            _, back, per = np.unique(c[own], return_inverse=True, return_counts=True)
            own = own[np.argsort(per[back] * len(per) + back, kind="stable")]  # the largest component last
            first = hi - lo - int(per.max())
            for at in range(0, first, 64):
                x = np.arange(at, min(first, at + 64))
                i, j = np.repeat(x, hi - lo), np.tile(np.arange(hi - lo), len(x))
                held.append((own[i[i < j]], own[j[i < j]]))
                many += len(held[-1][0])
                if many >= 1 << 17:
                    i, j = likely(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    found |= set(zip(np.minimum(h[i], h[j]).tolist(), np.maximum(h[i], h[j]).tolist(), strict=True))
                    held, many = [], 0
        if held:
            i, j = likely(*(np.concatenate(x) for x in zip(*held, strict=True)))
            found |= set(zip(np.minimum(h[i], h[j]).tolist(), np.maximum(h[i], h[j]).tolist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(2)], ["src", "dst"])

    return rest.repartition(partitions(rest.sparkSession), "key").mapInArrow(lean(run), "src long, dst long")


def _similar(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (src, dst) whose texts (h, z) have sets of shingles of this similarity or more."""

    def run(batches):
        held: dict[int, np.ndarray] = {}
        expand = zstandard.ZstdDecompressor()

        def of(h, z):
            if h not in held:
                if len(held) >= 32:
                    held.clear()
                held[h] = shingle_set(expand.decompress(z.as_py()))
            return held[h]

        for b in batches:
            ok = []
            for src, dst, x, y in zip(b["src"].to_pylist(), b["dst"].to_pylist(), b["x"], b["y"], strict=True):
                p, q = of(src, x), of(dst, y)
                common = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(common / (len(p) + len(q) - common) >= similarity)
            yield b.select(["src", "dst"]).filter(pa.array(ok, pa.bool_()))

    rows = pairs.join(texts.select(F.col("h").alias("src"), F.col("z").alias("x")), "src").join(texts.select(F.col("h").alias("dst"), F.col("z").alias("y")), "dst")
    return rows.select("src", "dst", "x", "y").mapInArrow(lean(run), "src long, dst long")


def _components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes with their component c, over links between them."""
    found = connected_components(links)
    return nodes.join(found, nodes["h"] == found["id"], "left").select(*nodes.columns, F.coalesce("component", "h").alias("c"))


def _pivot_pairs(now: DataFrame, salts: list[int], similarity: float) -> DataFrame:
    """(src, dst): members of a clump g that can be similar to one of its pivots, in another component c.

    A clump of one component has no pivots; of others those that are least by each of the salts.
    """
    least = now.groupBy("g").agg(*(F.min(F.col("h").bitwiseXOR(F.lit(x))).alias(f"x{k}") for k, x in enumerate(salts)), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi")
    heads = least.select(F.explode(F.array_distinct(F.array(*(F.col(f"x{k}").bitwiseXOR(F.lit(x)) for k, x in enumerate(salts))))).alias("head"))
    pivots = now.join(heads, F.col("h") == F.col("head"), "left_semi")
    met = now.alias("a").join(pivots.alias("b"), (F.col("a.g") == F.col("b.g")) & (F.col("a.c") != F.col("b.c")) & _likely(similarity))
    return met.select(F.least("a.h", "b.h").alias("src"), F.greatest("a.h", "b.h").alias("dst")).distinct()


def _spanning_links(marked: DataFrame, links: DataFrame, similarity: float, bands: Bands) -> DataFrame:
    """links and more between sets, which connect what links of all similar pairs that share a key of band_members() would.

    A link that would close a ring isn't needed, so most of a large group is settled
    by comparing each member with the closest of each of its keys, and the members of
    a clump, all that keys hold together, with a few pivots where that left several
    components. What is then still apart is compared pair by pair across components,
    key by key.
    """
    points = marked.where("n > 0").groupBy("h").agg(*(F.min(c).alias(c) for c in ("n", "print", "fold")))
    members = materialise(band_members(points, bands, similarity), "members")
    clumps = materialise(connected_components(members.select(F.col("h").alias("src"), F.col("lo").alias("dst"))).select(F.col("id").alias("h"), F.col("component").alias("g")), "clumps")
    facts = ("doc_id", "n", "spare", "sketch", "filled")
    nodes = materialise(marked.join(clumps, "h").groupBy("h").agg(*(F.min(c).alias(c) for c in (*facts, "g"))), "nodes")
    texts = materialise(marked.select("h", "doc_id", "z").join(nodes.select("h", "doc_id"), ["h", "doc_id"]).groupBy("h").agg(F.min("z").alias("z")), "texts")
    now = tested = None
    for step in range(ROUNDS + 2):
        if now is None:
            now = materialise(_components(links, nodes), "nodes")
        if step == 0:
            met = members.where("h <> near").select(F.least("h", "near").alias("src"), F.greatest("h", "near").alias("dst")).distinct()
            pairs = met.join(now.alias("a"), F.col("src") == F.col("a.h")).join(now.alias("b"), F.col("dst") == F.col("b.h")).where(F.col("a.c") != F.col("b.c")).where(_likely(similarity)).select("src", "dst")
        elif step <= ROUNDS:
            pairs = _pivot_pairs(now, PIVOT_SALTS[step - 1], similarity)
        else:
            at = members.join(now.select("h", "c"), "h")
            apart = at.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size")).where("lo < hi").select("key", "size")
            rest = materialise(members.select("key", "h").join(apart, "key").join(now, "h").select("key", "size", "h", "c", "n", "spare", "sketch", "filled"), "rest")
            pairs = _across(rest.where(F.col("size") <= WHOLE), similarity)
            large = rest.where(F.col("size") > WHOLE)
            met = large.alias("a").join(large.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.c") < F.col("b.c")) & _likely(similarity))
            pairs = pairs.unionByName(met.select(F.least("a.h", "b.h").alias("src"), F.greatest("a.h", "b.h").alias("dst"))).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["src", "dst"], "left_anti")
        pairs = materialise(pairs, "pairs")
        if pairs.isEmpty():
            continue
        tested = pairs if tested is None else tested.unionByName(pairs)
        links, now = links.unionByName(materialise(_similar(pairs, texts, similarity), "links")), None
    return links


def near_duplicates(docs: DataFrame, similarity: float = SIMILAR) -> DataFrame:
    """(doc_id, component_id) of documents in groups of near copies; docs (doc_id, text).

    Two texts are linked if their sets of 5-word shingles have a Jaccard similarity
    of `similarity` or more, which is computed for each pair (on 64-bit hashes), and
    if their SimHashes agree in one of Bands and are close, as 0.998 of the pairs of
    similarity 0.8 do. component_id is the smallest doc_id of the group. Rows that share a doc_id
    are one document; null ids are in no group. Texts without words, null ones too,
    are equal to each other.
    """
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bands = Bands(rows.count())
    marked = materialise(_sign(rows, bands.words), "signatures")
    several = marked.groupBy("doc_id").agg(F.min("h").alias("src"), F.max("h").alias("hi")).where("src < hi").select("doc_id", "src")
    same = materialise(marked.select("doc_id", "h").join(several, "doc_id").where("src <> h").select("src", F.col("h").alias("dst")).distinct(), "links")
    parts = connected_components(_spanning_links(marked, same, similarity, bands))
    of = marked.select("doc_id", "h").distinct()
    placed = materialise(of.join(parts, of["h"] == parts["id"], "left").select("doc_id", F.coalesce("component", "h").alias("c")), "placed")
    groups = placed.groupBy("c").agg(F.min("doc_id").alias("component_id"), F.max("doc_id").alias("last")).where("component_id < last").select("c", "component_id")
    return placed.join(groups, "c").select("doc_id", "component_id").distinct()


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILAR) -> DataFrame:
    """docs without the members of a group of near copies but the one of smallest doc_id."""
    gone = materialise(near_duplicates(docs, similarity).where("doc_id <> component_id").select(F.col("doc_id").alias("gone")), "gone")
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")
