"""Benchmark decontamination with a generalised suffix automaton of words.

The automaton holds every normalised test item. A document's words stream
through it; the state tells the longest match that ends at each word, and so
whether a window (ten words of an item, or a whole shorter item) ends there.
Spans of hit words are removed; documents of which too much is hit go.

The automaton is built from the test items alone. They are split by word count
into shards of about SHARD_WORDS words (some 400 bytes of automaton a word), and
the documents stream through one shard after another: between two shards they are
a table in the shared folder with the hits so far. So the driver, a broadcast and
a worker hold one shard at a time, at any size of the test set.
"""

from __future__ import annotations

import hashlib
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise, table
from .common import lean, utf8

WINDOW = 10
SHARD_WORDS = 400_000
#: Lower-cases A-Z; bytes 00-2F, 3A-60 and 7B-7F are no part of a word.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else 32 if c <= 0x2F or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F else c for c in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


class Automaton:
    """Suffix automaton of several word sequences; after finish(), what ends where.

    hit_len[state, via length] is answered by `ends`: for a state, the window
    length and items of the longest window that is a suffix of its strings.
    """

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items: list[str] = []
        self.sequences: list[list[int]] = []

    def add(self, item, words: list[bytes]) -> None:
        if not words:
            return
        seq = [self.ids.setdefault(w, len(self.ids)) for w in words]
        self.items.append(item)
        self.sequences.append(seq)
        last = 0
        for c in seq:
            last = self._extend(last, c)

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = self._state(length[last] + 1, {})
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p == -1:
            link[cur] = 0
        else:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _state(self, n: int, arcs: dict[int, int]) -> int:
        self.next.append(arcs)
        self.link.append(0)
        self.length.append(n)
        return len(self.link) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        twin = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[twin], self.link[q] = self.link[q], twin
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        return twin

    def finish(self) -> None:
        """Mark, for each state, the items whose windows end there."""
        owners: dict[int, set[int]] = {}
        marks: dict[int, tuple[int, set[int]]] = {}
        for k, seq in enumerate(self.sequences):
            w = min(self.window, len(seq))
            state = matched = 0
            for c in seq:
                state = self.next[state][c]
                matched += 1
                while self.length[self.link[state]] >= w and state:
                    state = self.link[state]
                    matched = self.length[state]
                if matched >= w:
                    marks.setdefault((state, w), set()).add(k)
                    matched = max(matched, w)
        for (state, w), who in marks.items():
            owners.setdefault(state, {})[w] = who
        self.owners = owners
        #: A state's own marks and those of the states its suffixes reach.
        order = sorted(range(len(self.link)), key=self.length.__getitem__)
        self.outs: list[tuple] = [()] * len(order)
        for s in order:
            up = self.outs[self.link[s]] if s else ()
            own = tuple(sorted(((w, tuple(sorted(x))) for w, x in owners.get(s, {}).items()), reverse=True))
            self.outs[s] = own + up if own else up
        self.shortest = min((min(self.window, len(s)) for s in self.sequences), default=self.window)
        self.sequences = []

    def scan(self, ids: list[int], at: int, hits: np.ndarray, found: set[int]) -> None:
        """Stream ids (a run of words that items have) that begins at word `at`."""
        nxt, link, length, outs, short = self.next, self.link, self.length, self.outs, self.shortest
        state = n = 0
        for k, c in enumerate(ids, at + 1):
            arcs = nxt[state]
            while c not in arcs and state:
                state = link[state]
                n = length[state]
                arcs = nxt[state]
            if c in arcs:
                state = arcs[c]
                n += 1
                if n >= short:
                    for w, who in outs[state]:
                        if w <= n:
                            hits[k - w : k] = True
                            found.update(who)


def _match(auto: Automaton, words: list[bytes], hits: np.ndarray) -> set[int]:
    ids = np.fromiter(map(auto.ids.get, words, repeat(-1)), dtype=np.int64, count=len(words))
    found: set[int] = set()
    known = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False])).astype(np.int8)))
    for lo, hi in zip(known[::2].tolist(), known[1::2].tolist(), strict=True):
        if hi - lo >= auto.shortest:
            auto.scan(ids[lo:hi].tolist(), lo, hits, found)
    return found


def build(rows, window: int = WINDOW) -> Automaton:
    auto = Automaton(window)
    for item, text in rows:
        auto.add(item, words_of((text or "").encode()))
    auto.finish()
    return auto


def _shards(benchmark: DataFrame, limit: int):
    """Lists of (item_id, text) of at most `limit` characters and one item more, in turn."""
    held, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text IS NOT NULL").toLocalIterator():
        held.append((r["item_id"], r["text"]))
        size += len(r["text"]) // 2 + 1
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def _removed(text: bytes, hits: np.ndarray) -> bytes:
    """The text without runs of hit words; what lies between two words of a run goes too."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], hits, [False])).astype(np.int8)))
    if not len(edges):
        return text
    spans = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        out.append(text[at : spans[lo][0]])
        at = spans[hi - 1][1]
    return b"".join([*out, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5, shard_words: int = SHARD_WORDS, keep_text: bool = True) -> DataFrame:
    """docs' columns, then n_words, n_hit, items (sorted array), coverage, rejected[, clean_text].

    Null and empty texts have no words and are never hit; items without words
    match nothing; items of null item_id are one item, null in `items` and before
    all others; repeated rows count each by itself. An empty benchmark hits
    nothing, an empty docs gives no rows. Columns of docs that bear a result's
    name are dropped.
    """
    spark = docs.sparkSession
    made = ["n_words", "n_hit", "items", "coverage", "rejected"] + ["clean_text"] * keep_text
    docs = docs.drop(*made)
    kept = docs.schema
    kinds = {"n_words": pa.int64(), "n_hit": pa.int64(), "items": pa.list_(pa.string()), "coverage": pa.float64(), "rejected": pa.bool_(), "clean_text": pa.string()}
    between = {"hits so far": pa.binary(), "items so far": pa.list_(pa.string())}

    def through(now: DataFrame, shard: list, first: bool, last: bool) -> DataFrame:
        """now with the hits of a shard: the results after the last, the hits so far before."""
        held = spark.sparkContext.broadcast(shard)
        names = made if last else list(between)

        def run(batches):
            auto = build(held.value, window)
            for b in batches:
                out = {k: [] for k in names}
                done = [(None, None)] * b.num_rows if first else zip(*(b[k].to_pylist() for k in between), strict=True)
                for raw, null, (bits, before) in zip(utf8(b["text"]), b["text"].is_null().to_pylist(), done, strict=True):
                    words = words_of(raw)
                    hits = np.zeros(len(words), bool) if first else np.unpackbits(np.frombuffer(bits, np.uint8), count=len(words)).astype(bool)
                    items = {auto.items[k] for k in _match(auto, words, hits)}.union(before or ())
                    told = sorted(items, key=lambda x: (x is not None, x))
                    if last:
                        n = int(hits.sum())
                        share = n / len(words) if words else 0.0
                        row = (len(words), n, told, share, share > max_coverage, None if null else _removed(raw, hits).decode() if keep_text else None)
                    else:
                        row = (np.packbits(hits).tobytes(), told)
                    for k, v in zip(names, row, strict=False):
                        out[k].append(v)
                yield pa.RecordBatch.from_arrays([*(b[c] for c in kept.names), *(pa.array(out[k], (kinds | between)[k]) for k in names)], [*kept.names, *names])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields)
        more = "n_words long, n_hit long, items array<string>, coverage double, rejected boolean" + ", clean_text string" * keep_text if last else "`hits so far` binary, `items so far` array<string>"
        found = now.mapInArrow(lean(run), f"{schema}, {more}")
        if not last:
            found = materialise(found, "hits")
            held.destroy()
        return found

    shards = _shards(benchmark, shard_words)
    shard, now, first = next(shards, []), docs, True
    while (after := next(shards, None)) is not None:
        now, shard, first = through(now, shard, first, False), after, False
    return through(now, shard, first, True)


def op7(spark, sf_dir):
    found = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep_text=False)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: Windows of items as word lists, met by position with the documents' own.
SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, k, n, array_to_string(w[k : k + n - 1], ' ') AS s FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT r, k, n, item_id FROM dw JOIN bw USING (n, s)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM m) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT r, item_id::VARCHAR AS i FROM m) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)"""


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
