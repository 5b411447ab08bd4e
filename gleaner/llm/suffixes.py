"""Exact substring dedup by a distributed merge sort of sparse suffixes.

Every window of `least` bytes is owned by its anchor, the leftmost k-gram of least
hash inside it; equal windows have equal anchors at equal offsets. So it is enough
to sort the suffixes that begin at anchors, each with what its windows reach to the
left. Of these, suffixes whose anchor occurs once in the corpus are left out.

Parts of the documents sort their suffixes and exchange them as front-coded runs;
a task merges its runs with a loser tree that keeps, for each head, the length of
the prefix it shares with the last output, so known prefixes are never compared
again. Suffixes that share an anchor come out side by side with their common
prefix lengths, which bound the windows that can be equal; those are settled by
their bytes. A window is a repeat unless it is the first of its equals in the order
of (doc_id, start).

A suffix that repeats whole inside a part is exchanged once. Where very many
different suffixes share an anchor, their windows are dealt out by a longer common
stretch, in blocks of BLOCK offsets, and where still more do, one by one; a block
that a part has twice is exchanged once. So no task has to take what lies around a
stretch that a great share of all documents have.
"""

from __future__ import annotations

import functools
import hashlib
import pickle
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from ..storage import materialise, partitions, table
from .common import document_blocks, get_arrays, get_strings, id_array, put_arrays, put_strings, read_blocks, release_memory

LEAST = 100
CHUNK = 1 << 17
BLOCK = 8
#: From so many different suffixes of one anchor on, its windows are dealt out in blocks, or one by one.
CROWD, THRONG = 8192, 1 << 17
KINDS = "d int, r int, kind int, blob binary"
ASK, TELL, RUN, REPEATS = 0, 1, 2, 3
_rng = np.random.Generator(np.random.PCG64(20))
BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
LOW = np.uint64((1 << 24) - 1)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(BASE), n, 1 << 64))


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-grams of a byte array, built by doubling."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, h, size = None, 0, BYTE[data], 1
    left = k
    while left:
        if left & 1:
            piece = h[done : done + n]
            out = piece.copy() if out is None else out * _power(size) + piece
            done += size
        left >>= 1
        if left:
            h = h[:-size] * _power(size) + h[size:]
            size *= 2
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours."""
    n, size, m = len(x) - w + 1, 1, x
    while 2 * size <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[:n], m[w - size : w - size + n])


@functools.cache
def _powers(n: int, base: int) -> np.ndarray:
    steps = np.full(n, np.uint64(base), np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def segments(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, least: int, k: int):
    """(anchor, first window, last window, anchor's hash, content's hash) of every maximal run of windows with one anchor.

    Works through the bytes in chunks; a run that a chunk's end cuts is two runs.
    """
    w = least - k + 1
    found = [[] for _ in range(5)]
    barred = np.zeros(len(data), bool)  # no window begins here: it would leave its document
    for b, e in zip(begins.tolist(), ends.tolist(), strict=True):
        barred[max(b, e - least + 1) : e] = True
    powers, inverse = _powers(CHUNK + least, int(BASE)), _powers(CHUNK + least, pow(int(BASE), -1, 1 << 64))
    for lo in range(0, max(0, len(data) - least + 1), CHUNK):
        piece = data[lo : lo + CHUNK + least - 1]
        h = gram_hashes(piece, k)
        mixed = (h & ~LOW) | np.arange(len(h), dtype=np.uint64)
        anchor = (sliding_least(mixed, w) & LOW).astype(np.int32)
        fine = ~barred[lo : lo + len(anchor)]
        cut = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (fine[1:] != fine[:-1])])
        stop = np.r_[cut[1:], len(anchor)] - 1
        keep = fine[cut]
        cut, stop = cut[keep], stop[keep]
        at = anchor[cut].astype(np.int64)
        prefix = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(BYTE[piece] * powers[: len(piece)], out=prefix[1:])
        content = (prefix[stop + least] - prefix[cut]) * inverse[cut]
        content ^= ((at - cut) * 257 + (stop - cut)).astype(np.uint64) * np.uint64(0x94D049BB133111EB)
        for f, x in zip(found, (at + lo, cut + lo, stop + lo, h[at], content), strict=True):
            f.append(x)
    return [np.concatenate(f) if f else np.zeros(0, np.uint64 if i > 2 else np.int64) for i, f in enumerate(found)]


class Part:
    """The documents of a part as one byte array, and its suffixes."""

    def __init__(self, blocks: pa.Table, least: int, sorted_suffixes: bool = True):
        self.ids, self.nulls, texts, self.rest = read_blocks(blocks)
        self.raw = b"".join(texts)
        self.data = np.frombuffer(self.raw, np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        self.least, self.k = least, max(1, least // 4)
        if sorted_suffixes:
            self._group()

    def _group(self) -> None:
        """Order suffixes by anchor hash and content; `first` marks those that no equal one precedes."""
        self.anchor, self.lo, self.hi, self.hash, content = segments(self.data, self.begins, self.ends, self.least, self.k)
        order = np.lexsort((self.lo, content, self.hash))
        self.anchor, self.lo, self.hi, self.hash, content = (x[order] for x in (self.anchor, self.lo, self.hi, self.hash, content))
        same = np.r_[False, (content[1:] == content[:-1]) & (self.hash[1:] == self.hash[:-1])] if len(content) else np.zeros(0, bool)
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(same)))) if len(same) else np.zeros(0, np.int64)
        raw = self.raw
        for i in np.flatnonzero(same).tolist():  # equal hashes are held to be equal only if the bytes are
            j = head[i]
            if raw[self.lo[i] : self.hi[i] + self.least] != raw[self.lo[j] : self.hi[j] + self.least]:
                same[i] = False
        self.first = ~same
        self.keys, at = np.unique(self.hash, return_inverse=True)
        self.at = at
        self.kinds = np.bincount(at[self.first], minlength=len(self.keys)).astype(np.uint32)
        self.total = np.bincount(at, minlength=len(self.keys)).astype(np.uint32)

    def doc_key(self, positions: np.ndarray) -> np.ndarray:
        doc = np.searchsorted(self.ends, positions, side="right")
        return np.where(self.nulls[doc] == 1, np.iinfo(np.int64).min, self.ids[doc])


def _rows(rows) -> pa.Table:
    return pa.table({"d": pa.array([x[0] for x in rows], pa.int32()), "r": pa.array([x[1] for x in rows], pa.int32()), "kind": pa.array([x[2] for x in rows], pa.int32()), "blob": pa.array([x[3] for x in rows], pa.binary())})


def _dealt(keys: np.ndarray, parts: int):
    """(r, positions) of keys, in key order."""
    r = (keys >> np.uint64(20)) % np.uint64(parts)
    order = np.argsort(r, kind="stable")
    cuts = np.searchsorted(r[order], np.arange(parts + 1))
    return [(k, order[cuts[k] : cuts[k + 1]]) for k in range(parts) if cuts[k] < cuts[k + 1]]


def _count(requests: pa.Table, crowd: int, throng: int) -> pa.Table:
    """For each asked anchor: 0 if it occurs once, 1 if more often, 2 and 3 if in a crowd or a throng of different suffixes."""
    asked = [get_arrays(x) for x in requests["blob"].to_pylist()]
    keys, back = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
    total = np.bincount(back, np.concatenate([a[1] for a in asked]), len(keys))
    kinds = np.bincount(back, np.concatenate([a[2] for a in asked]), len(keys))
    code = ((total > 1).astype(np.uint8) + (kinds > crowd) + (kinds > throng)).astype(np.uint8)
    rows, at, r = [], 0, requests["r"][0].as_py()
    for d, a in zip(requests["d"].to_pylist(), asked, strict=True):
        rows.append((d, r, TELL, put_arrays(code[back[at : at + len(a[0])]])))
        at += len(a[0])
    return _rows(rows)


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which `known` bytes need no comparison."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8 if x else n


def encode_run(entries: list[tuple[bytes, bytes, int, int, int]]) -> bytes:
    """Front-code sorted (right, left, doc key, first window, windows)."""
    shared, tails, last = [], [], b""
    for e in entries:
        n = common(last, e[0], 0)
        shared.append(n)
        tails.append(e[0][n:])
        last = e[0]
    left = put_strings([e[1] for e in entries])
    tail = put_strings(tails)
    head = put_arrays(np.array(shared, np.uint16), np.array([e[2] for e in entries], np.int64), np.array([e[3] for e in entries], np.int64), np.array([e[4] for e in entries], np.uint16))
    return put_arrays(np.array([len(left), len(tail)], np.int64), np.frombuffer(left + tail + head, np.uint8))


def decode_run(blob: bytes):
    """Yields (right, left, doc key, first window, windows, shared with the one before)."""
    sizes, data = get_arrays(blob)
    raw = data.tobytes()
    a, b = int(sizes[0]), int(sizes[0] + sizes[1])
    left, tails = get_strings(raw[:a]), get_strings(raw[a:b])
    shared, docs, firsts, counts = (x.tolist() for x in get_arrays(raw[b:]))
    last = b""
    for n, t, x, d, s, c in zip(shared, tails, left, docs, firsts, counts, strict=True):
        last = last[:n] + t
        yield last, x, d, s, c, n


def merge(runs: list):
    """Merge decoded runs into (entry, run, shared with the last output) by a loser tree.

    A head that shares more with the last output than another is the smaller of
    the two, and they share what the other does; only equal lengths are compared,
    from there on.
    """
    size = 1
    while size < len(runs):
        size *= 2
    heads = [next(r, None) for r in runs] + [None] * (size - len(runs))
    shared = [0] * size
    lost = [0] * size

    def duel(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's `shared` becomes what it shares with the winner."""
        x, y = heads[a], heads[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        p, q = shared[a], shared[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        s, t = x[0], y[0]
        n = common(s, t, p)
        if s[n : n + 1] <= t[n : n + 1] and (n < len(t) or len(s) <= n):
            shared[b] = n
            return a, b
        shared[a] = n
        return b, a

    def build(node: int) -> int:
        if node >= size:
            return node - size
        won, lost[node] = duel(build(2 * node), build(2 * node + 1))
        return won

    top = build(1) if size > 1 else 0
    while (head := heads[top]) is not None:
        yield head, top, shared[top]
        heads[top] = new = next(runs[top], None)
        if new is not None:
            shared[top] = new[5]
        node, won = (top + size) >> 1, top
        while node:
            won, lost[node] = duel(won, lost[node])
            node >>= 1
        top = won


def settle_group(group: list, least: int, repeat) -> None:
    """Tell repeat(run, first, last) the windows of a group that aren't the first of their equals.

    group: (entry, run, shared with the entry before), in merged order.
    """
    whole: dict[tuple, tuple] = {}
    reach: dict[tuple, int] = {}
    for i, (e, run, n) in enumerate(group):
        right, left, doc, at, count = e[:5]
        after = group[i + 1][2] if i + 1 < len(group) else 0
        key = (right, left, count)
        best = whole.get(key)
        if best is None:
            whole[key] = (doc, at, run)
            reach[key] = max(n if i else 0, after)
        else:
            reach[key] = max(reach[key], after)
            if (doc, at) < best[:2]:
                whole[key] = (doc, at, run)
                doc, at, run = best
            repeat(run, at, at + count - 1)
    if len(whole) < 2:
        return
    seen: dict[bytes, tuple[int, int]] = {}
    todo = []
    for (right, left, count), (doc, at, run) in whole.items():
        text, stop = left + right, min(count, len(left) - (least - reach[(right, left, count)]) + 1)
        if stop > 0:
            todo.append((text, stop, doc, at, run))
            for j in range(stop):
                w = text[j : j + least]
                own = (doc, at + j)
                if seen.setdefault(w, own) > own:
                    seen[w] = own
    for text, stop, doc, at, run in todo:
        begin = None
        for j in range(stop):
            if seen[text[j : j + least]] != (doc, at + j):
                if begin is None:
                    begin = j
            elif begin is not None:
                repeat(run, at + begin, at + j - 1)
                begin = None
        if begin is not None:
            repeat(run, at + begin, at + stop - 1)


def _merged(requests: pa.Table, least: int, k: int) -> pa.Table:
    """Merge a task's runs; (d, REPEATS) rows of window ranges that repeat earlier ones."""
    r = requests["r"][0].as_py()
    kinds, ds, blobs = (requests[c].to_pylist() for c in ("kind", "d", "blob"))
    rows = [(d, r, REPEATS, x) for kind, d, x in zip(kinds, ds, blobs, strict=True) if kind == REPEATS]
    runs = [(d, x) for kind, d, x in zip(kinds, ds, blobs, strict=True) if kind == RUN]
    out: dict[int, tuple[list, list]] = {}

    def repeat(run: int, first: int, last: int) -> None:
        a, b = out.setdefault(runs[run][0], ([], []))
        a.append(first)
        b.append(last)

    group: list = []
    for item in merge([decode_run(x) for _, x in runs]) if runs else ():
        if item[2] < k and group:
            if len(group) > 1:
                settle_group(group, least, repeat)
            group = []
        group.append(item)
    if len(group) > 1:
        settle_group(group, least, repeat)
    rows += [(d, r, REPEATS, put_arrays(np.array(a, np.int64), np.array(b, np.int64))) for d, (a, b) in out.items()]
    return _rows(rows)


def _runs(part: Part, d: int, told: pa.Table, parts: int) -> pa.Table:
    code = np.zeros(len(part.keys), np.uint8)
    answers = dict(zip(told["r"].to_pylist(), told["blob"].to_pylist(), strict=True))
    for r, at in _dealt(part.keys, parts):
        code[at] = get_arrays(answers[r])[0]
    code = code[part.at]
    local = ~part.first
    again = [part.lo[local]], [part.hi[local]]
    raw, least = part.raw, part.least
    pick = np.flatnonzero(part.first & (code > 0))
    docs = part.doc_key(part.lo[pick])
    held: dict[int, list] = {}
    blocks: dict[tuple[bytes, bytes, int], tuple[int, int, int]] = {}
    goal = ((part.hash[pick] >> np.uint64(20)) % np.uint64(parts)).tolist()
    for a, lo, hi, doc, r, kind in zip(part.anchor[pick].tolist(), part.lo[pick].tolist(), part.hi[pick].tolist(), docs.tolist(), goal, code[pick].tolist(), strict=True):
        if kind < 2:
            held.setdefault(r, []).append((raw[a : hi + least], raw[lo:a], doc, lo, hi - lo + 1))
            continue
        size = BLOCK if kind == 2 else 1
        for block in range((a - hi) // size, (a - lo) // size + 1):
            pivot = a - block * size
            s, e = max(lo, pivot - size + 1), min(hi, pivot)
            key, own = (raw[pivot : e + least], raw[s:pivot], size), (doc, s, e)
            first = blocks.setdefault(key, own)
            if first != own:  # what a part has twice goes once, as its first
                blocks[key] = min(first, own)
                late = max(first, own)
                again[0].append(np.array(late[1:2]))
                again[1].append(np.array(late[2:]))
    for (right, left, size), (doc, s, e) in blocks.items():
        held.setdefault(zlib.crc32(right[: least - size + 1]) % parts, []).append((right, left, doc, s, e - s + 1))
    lows, highs = (np.concatenate(x).astype(np.int64) for x in again)
    rows = [(d, d % parts, REPEATS, put_arrays(lows, highs))] if len(lows) else []
    rows += [(d, r, RUN, encode_run(sorted(x))) for r, x in held.items()]
    return _rows(rows)


RESULT_NAMES = ("n_bytes", "n_removed", "n_spans", "starts", "ends", "kept")
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, starts array<long>, ends array<long>, kept binary"


def _cleaned(part: Part, repeats: pa.Table) -> pa.Table:
    depth = np.zeros(len(part.data) + 1, np.int32)
    for x in repeats["blob"].to_pylist():
        lo, hi = get_arrays(x)
        np.add.at(depth, lo, 1)
        np.add.at(depth, hi + part.least, -1)
    gone = np.cumsum(depth, out=depth)[:-1] > 0
    del depth
    cols = [[] for _ in range(6)]
    for b, e in zip(part.begins.tolist(), part.ends.tolist(), strict=True):
        own = gone[b:e]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], own, [False])).astype(np.int8))) if own.any() else np.zeros(0, np.int64)
        for c, v in zip(cols, (e - b, int(own.sum()), len(edge) // 2, edge[::2], edge[1::2], part.data[b:e][~own].tobytes() if len(edge) else part.raw[b:e]), strict=True):
            c.append(v)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
    return pa.table([id_array(part.ids, part.nulls), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=[x.split()[0] for x in RESULT.split(", ")])


def _digest(cleaned: pa.Table) -> pa.Table:
    """The kept bytes and spans as a digest, so that no text leaves the task."""
    kept = [hashlib.sha256(x).hexdigest() for x in cleaned["kept"].to_pylist()]
    return cleaned.select(["doc_id", "n_bytes", "n_removed", "n_spans"]).append_column("kept_sha256", pa.array(kept, pa.string()))


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def dedup_substrings(docs: DataFrame, least: int = LEAST, digest: bool = False, columns: bool = False, crowd: int = CROWD, throng: int = THRONG) -> DataFrame:
    """Remove from each text every byte of a `least`-byte string that also starts earlier.

    Earlier: in a smaller doc_id (null ids first), or in the same document before;
    rows that share a doc_id are in the order of their texts. Strings are judged
    on the input and never cross documents. Result: doc_id, n_bytes, n_removed,
    n_spans, starts and ends of the removed runs, and the kept bytes (or their
    SHA-256); with `columns`, docs' other columns too. Null and shorter texts keep all they have; an empty table gives no
    rows; other columns are ignored unless asked for, and dropped where they bear a
    result's name. crowd and throng change how the work is dealt, not the result.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    k = max(1, least // 4)
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", *RESULT_NAMES)) if columns else ()
    blocks = document_blocks(docs, 2 * parts, others)  # a task holds one of its groups at a time
    kinds = to_arrow_schema(docs.select(*others).schema)

    def ask(group: pa.Table) -> pa.Table:
        part, d = Part(group, least), group["d"][0].as_py()
        release_memory()
        return _rows([(d, r, ASK, put_arrays(part.keys[at], part.total[at], part.kinds[at])) for r, at in _dealt(part.keys, parts)])

    told = materialise(blocks.groupBy("d").applyInArrow(ask, KINDS).groupBy("r").applyInArrow(lambda x: _count(x, crowd, throng), KINDS), "anchors")

    def sort(left: pa.Table, right: pa.Table) -> pa.Table:
        return _runs(Part(left, least), left["d"][0].as_py(), right, parts) if left.num_rows else _rows([])

    repeats = materialise(blocks.groupBy("d").cogroup(told.groupBy("d")).applyInArrow(sort, KINDS).groupBy("r").applyInArrow(lambda x: _merged(x, least, k), KINDS), "repeats")

    def clean(left: pa.Table, right: pa.Table) -> pa.Table:
        part = Part(left, least, False)
        release_memory()
        found = _cleaned(part, right)
        if digest:
            return _digest(found)
        rows = [pickle.loads(x) for x in part.rest] if others else []
        for k, c in enumerate(others):
            found = found.append_column(c, pa.array([r[k] for r in rows], kinds.field(c).type))
        return found

    schema = DIGEST if digest else RESULT + "".join(f", `{c}` {t}" for c, t in docs.select(*others).dtypes)
    return blocks.groupBy("d").cogroup(repeats.groupBy("d")).applyInArrow(clean, schema)


def op2(spark, sf_dir):
    return dedup_substrings(table(spark, sf_dir, "documents"), digest=True)
