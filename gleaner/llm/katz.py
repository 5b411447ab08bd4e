"""Katz backoff language model of word triples, learned from and applied to a corpus.

Counts are Good-Turing discounted up to CUTOFF. A token is scored by the triple it
ends; where that was not seen often enough (LEAST_TRIPLE times), by the backoff
weight of its two words of history times the same rule for pairs, and so on down to
the single word. What the discounts free at a history goes to its unseen
continuations in proportion to their probability one order down, so every history's
distribution sums to one exactly (over the known words, the end, and one event for
all unknown words). A text's first token has the end as its only history, its
second that and the first.

Documents are dealt into parts by doc_id and become word numbers once. A part asks
for each of its distinct words, then pairs, then triples once; requests and replies
travel as sorted arrays, and words as the numbers that the first replies give them.
The tokens lie in buckets and aren't exchanged again. A table of counts is partitioned by the hash of the
history, and a history with more than a part's share of all tokens by that of the
next word too; what such shards say of it is added up. Triples that occur once in
the corpus are told apart first, by short hashes, and not asked for. No task or
driver holds a whole table.
"""

from __future__ import annotations

import math
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import bucketed, materialise, partitions, release, table
from .common import document_blocks, get_arrays, id_array, put_arrays, read_blocks, release_memory

CUTOFF = 5
#: Triples seen less often in learning give way to pairs, as is usual for Katz models.
LEAST_TRIPLE = 2
HOLD_OUT = 10
END = b" "
#: All white space as one byte, so that a space can be the end's.
SPACES = bytes(10 if 9 <= c <= 13 or c == 32 else c for c in range(256))
KINDS = "d int, r int, kind int, blob binary"
WORDS, MAYBE, PAIRS, TRIPLES, STATS, TOKENS = range(6)
SHORT = np.uint64(40)  # bits of a triple's short hash, besides the part that it goes to


def held_out(doc_id: int, is_null: int) -> bool:
    return not is_null and zlib.crc32(str(int(doc_id)).encode()) % HOLD_OUT == 0


def numbered(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(the numbers of all words, an end after each text; the hashes of the distinct words by number, the end first)."""
    raw = np.frombuffer(b"\n".join([b"", END, *(x for t in texts for x in (t.lower().translate(SPACES), END)), b""]), np.uint8)
    inner = raw != 10
    edges = np.flatnonzero(inner[1:] != inner[:-1])
    ends = np.cumsum(edges[1::2] - edges[::2])
    words = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.r_[0, ends]), pa.py_buffer(raw[inner])]).dictionary_encode()
    _, cuts, letters = words.dictionary.buffers()
    letters, cuts = letters.to_pybytes(), np.frombuffer(cuts, np.int64, len(words.dictionary) + 1).tolist()
    hashes = np.fromiter((xxhash.xxh64_intdigest(letters[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)), np.uint64, len(cuts) - 1)
    return words.indices.to_numpy()[1:], hashes


def runs(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, how often each) of a sorted array."""
    at = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
    return a[at], np.diff(at, append=len(a))


def grouped(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places by value, distinct values, how often each)."""
    order = np.argsort(a).astype(np.int32)
    return order, *runs(a[order])


def narrow(a: np.ndarray) -> np.ndarray:
    """Numbers from 0 in the smallest type that holds them all."""
    top = int(a.max(initial=0))
    return a.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max))


def planes(a: np.ndarray) -> list[np.ndarray]:
    """Whole numbers from 0 as their low and high bits, which pack better apart."""
    a = a.astype(np.uint64)
    return [(a & np.uint64(0xFF)).astype(np.uint8), narrow(a >> np.uint64(8) & np.uint64(0xFFFFFF)), narrow(a >> np.uint64(32))]


def joined(low: np.ndarray, mid: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(np.int64) | mid.astype(np.int64) << 8 | high.astype(np.int64) << 32


def _stir(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Part:
    """A part's documents as word numbers, with its distinct words by the part they ask and by hash."""

    def __init__(self, ids, nulls, held, lengths, hashes, place, tokens, parts: int):
        self.ids, self.nulls, self.held, self.lengths, self.hashes, self.place, self.parts = ids, nulls, held.astype(bool), lengths.astype(np.int64), hashes, place, parts
        self.cuts = np.searchsorted(hashes % np.uint64(parts), np.arange(parts + 1))
        self.raw = tokens
        self.tokens = place[tokens]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.end = int(place[0]) if len(place) else 0
        self.learn = np.repeat(~self.held, self.lengths)
        self.before = np.empty(len(self.tokens), np.int32)
        self.before[1:] = self.tokens[:-1]
        self.before[self.starts] = self.end

    @classmethod
    def of_texts(cls, blocks: pa.Table, parts: int) -> Part:
        ids, nulls, texts, _ = read_blocks(blocks)
        tokens, hashes = numbered(texts)
        del texts
        lengths = np.diff(np.flatnonzero(tokens == 0), prepend=-1)
        held = np.array([held_out(i, z) for i, z in zip(ids, nulls, strict=True)], bool)
        order = np.lexsort((hashes, hashes % np.uint64(parts)))
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        return cls(ids, nulls, held, lengths, hashes[order], place, tokens, parts)

    def pack(self) -> bytes:
        low, mid, _ = planes(self.raw)
        return put_arrays(self.ids, self.nulls, self.held.astype(np.uint8), narrow(self.lengths), self.hashes, narrow(self.place), low, mid)

    @classmethod
    def unpack(cls, blob: bytes, parts: int) -> Part:
        ids, nulls, held, lengths, hashes, place, low, mid = get_arrays(blob)
        return cls(ids, nulls, held, lengths, hashes, place.astype(np.int32), low.astype(np.int32) | mid.astype(np.int32) << 8, parts)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(distinct codes history * words + word, code number of each token)."""
        codes, at = np.unique(self.before.astype(np.int64) * len(self.hashes) + self.tokens, return_inverse=True)
        return codes, at.astype(np.int32)

    def short(self) -> tuple[np.ndarray, np.ndarray]:
        """(positions of tokens that end a triple, short hashes of these triples, the part asked in the high bits)."""
        inner = np.ones(len(self.tokens), bool)
        inner[self.starts] = False
        at = np.flatnonzero(inner)
        h = self.hashes
        x = _stir(_stir(h[self.before[at - 1]] * np.uint64(3) + h[self.tokens[at - 1]]) + h[self.tokens[at]])
        return at, (x % np.uint64(self.parts)) << SHORT | x >> (np.uint64(64) - SHORT)


def discounts(n: np.ndarray) -> np.ndarray:
    """Good-Turing ratios for counts 1..CUTOFF from n[k] = number of things seen k times; absolute ones where those fail."""
    k = np.arange(1, CUTOFF + 1)
    plain = 1 - 0.5 / k
    if (n[1 : CUTOFF + 2] <= 0).any():
        return plain
    top = (CUTOFF + 1) * n[CUTOFF + 1] / n[1]
    d = ((k + 1) * n[k + 1] / (k * n[k]) - top) / (1 - top) if top != 1 else np.full(CUTOFF, -1.0)
    return np.where((d > 0) & (d < 1), d, plain)


class Unigrams:
    """Probability of a word from its count; count 0 is the one event for unknown words."""

    def __init__(self, total: int, distinct: int, n: np.ndarray):
        self.total, self.distinct = total, distinct
        self.ratio = np.ones(CUTOFF + 2)
        self.ratio[1 : CUTOFF + 1] = discounts(n)
        self.whole = total
        freed = float(sum((1 - self.ratio[k]) * k * n[k] for k in range(1, CUTOFF + 1)))
        if not freed:
            self.whole, freed = total + 0.5, 0.5
        self.unknown = freed / self.whole if total else 1.0

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        c = counts.astype(np.float64)
        return np.where(counts == 0, self.unknown, self.ratio[np.minimum(counts, CUTOFF + 1)] * c / max(self.whole, 0.5))

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.total + 0.1 * (self.distinct + 1)))


def _rows(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    return pa.table({"d": pa.array([x[0] for x in rows], pa.int32()), "r": pa.array([x[1] for x in rows], pa.int32()), "kind": pa.array([x[2] for x in rows], pa.int32()), "blob": pa.array([x[3] for x in rows], pa.binary())})


def _of(rows: pa.Table, kind: int) -> dict[int, bytes]:
    """Blobs of a kind by r."""
    rows = rows.filter(pc.equal(rows["kind"], kind))
    return dict(zip(rows["r"].to_pylist(), rows["blob"].to_pylist(), strict=True))


def _summary(totals: np.ndarray) -> bytes:
    return put_arrays(np.array([totals.sum(), (totals > 0).sum(), *np.bincount(np.minimum(totals, CUTOFF + 2), minlength=CUTOFF + 3)], np.int64))


def _ask_words(group: pa.Table, parts: int) -> pa.Table:
    """A part's words with their learned counts, its triples' short hashes with theirs, up to 2, and its tokens."""
    part, d = Part.of_texts(group, parts), group["d"][0].as_py()
    counts = np.bincount(part.tokens[part.learn], minlength=len(part.hashes))
    rows = [(d, r, WORDS, put_arrays(part.hashes[lo:hi], narrow(counts[lo:hi]))) for r, (lo, hi) in enumerate(zip(part.cuts[:-1], part.cuts[1:], strict=True)) if lo < hi]
    at, keys = part.short()
    order, keys, per = grouped(keys)
    often = np.minimum(np.add.reduceat(part.learn[at[order]], np.cumsum(per) - per, dtype=np.int64), 2).astype(np.uint8) if len(keys) else np.zeros(0, np.uint8)
    cuts = np.searchsorted(keys, np.arange(parts + 1, dtype=np.uint64) << SHORT)
    for r, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if lo < hi:
            rows.append((d, r, MAYBE, put_arrays(narrow(np.diff(keys[lo:hi], prepend=np.uint64(r) << SHORT)), often[lo:hi])))
    return _rows([*rows, (d, -1, TOKENS, part.pack())])


def _tell_words(requests: pa.Table) -> pa.Table:
    """Totals and numbers of a partition's words, and which of its short hashes were learned often enough; in the order of the requests."""
    rows, r = [], requests["r"][0].as_py()
    kinds = requests["kind"].to_numpy()
    asked = [(d, get_arrays(x)) for d, k, x in zip(requests["d"].to_pylist(), kinds, requests["blob"].to_pylist(), strict=True) if k == WORDS]
    hashes, back = np.unique(np.concatenate([np.zeros(0, np.uint64), *(a[0] for _, a in asked)]), return_inverse=True)
    totals = np.bincount(back, np.concatenate([np.zeros(0), *(a[1] for _, a in asked)]), len(hashes)).astype(np.int64)
    at = 0
    for d, a in asked:
        own = back[at : at + len(a[0])]
        rows.append((d, r, WORDS, put_arrays(narrow(totals[own]), narrow(np.diff(own, prepend=0)))))
        at += len(a[0])
    rows.append((-1, r, STATS, _summary(totals)))
    asked = [(d, get_arrays(x)) for d, k, x in zip(requests["d"].to_pylist(), kinds, requests["blob"].to_pylist(), strict=True) if k == MAYBE]
    if asked:
        keys, back = np.unique(np.concatenate([np.cumsum(a[0], dtype=np.uint64) for _, a in asked]), return_inverse=True)
        often = np.bincount(back, np.concatenate([a[1] for _, a in asked]), len(keys)) >= LEAST_TRIPLE
        at = 0
        for d, a in asked:
            rows.append((d, r, MAYBE, put_arrays(np.packbits(often[back[at : at + len(a[0])]]))))
            at += len(a[0])
    return _rows(rows)


def freed(found: pa.Table) -> pa.Table:
    """What a worker found for a group, when it has given back the memory that this took."""
    release_memory()
    return found


def tell_words(requests: pa.Table) -> pa.Table:
    return freed(_tell_words(requests))


class Deal:
    """Who is asked for the continuations of a part's histories.

    A history of `splits` shards asks each of them, whether or not one of its words
    belongs there, as each knows a share of what is to be known of the history; so
    does one without words.
    """

    def __init__(self, histories: np.ndarray, splits: np.ndarray, owner: np.ndarray, words: np.ndarray, parts: int):
        n = len(histories)
        base = histories % np.uint64(parts)
        r = ((base[owner] + _stir(words) % splits[owner].astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
        self.order = np.argsort(narrow(r), kind="stable").astype(np.int32)  # owners ascend, and still do for each r
        own, per = runs((r * n + owner)[self.order])
        hot = np.flatnonzero((splits > 1) | (np.bincount(owner, minlength=n) == 0))
        times = splits[hot]
        shard = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        extra = (np.repeat(base[hot].astype(np.int64), times) + shard) % parts * n + np.repeat(hot, times)
        self.keys = runs(np.sort(np.concatenate([own, extra]), kind="stable"))[0]
        self.per = np.zeros(len(self.keys), np.int64)
        self.per[np.searchsorted(self.keys, own)] = per
        self.owner = self.keys % n if n else self.keys
        self.cuts = np.searchsorted(self.keys, np.arange(parts + 1) * n)
        self.at = np.searchsorted(r[self.order], np.arange(parts + 1))
        self.histories, self.words = histories, words

    def ask(self, d: int, kind: int, counts: np.ndarray, *more: np.ndarray, of: tuple[np.ndarray, ...] = ()) -> list[tuple[int, int, int, bytes]]:
        """more: by continuation; of: by history."""
        rows = []
        for r, (a, b) in enumerate(zip(self.cuts[:-1], self.cuts[1:], strict=True)):
            if a < b:
                i = self.order[self.at[r] : self.at[r + 1]]
                rows.append((d, r, kind, put_arrays(narrow(self.histories[self.owner[a:b]]), narrow(self.per[a:b]), narrow(self.words[i]), narrow(counts[i]), *(x[i] for x in more), *(x[self.owner[a:b]] for x in of))))
        return rows

    def told(self, replies: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """(total of each continuation; by history: mass, sum of counts, and continuations seen 1..CUTOFF times)."""
        n = len(self.histories)
        totals = np.zeros(len(self.order), np.int64)
        mass, held, few = np.zeros(n), np.zeros(n, np.int64), [np.zeros(n, np.int64) for _ in range(CUTOFF)]
        for r, (a, b) in enumerate(zip(self.cuts[:-1], self.cuts[1:], strict=True)):
            if a < b:
                t, m, h, *f = get_arrays(replies[r])
                totals[self.order[self.at[r] : self.at[r + 1]]] = t
                own = self.owner[a:b]  # once each
                mass[own] += m
                held[own] += h.astype(np.int64)
                for total, x in zip(few, f, strict=True):
                    total[own] += x
        return totals, mass, held, few


def _count(requests: pa.Table, kind: int, least: int, weights) -> pa.Table:
    """Per request: each continuation's total; per history, over those seen `least` times: their weights, counts, and how many were seen 1..CUTOFF times."""
    asked = [get_arrays(x) for x in requests["blob"].to_pylist()]
    hist, hback = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
    owner = np.repeat(hback, np.concatenate([a[1] for a in asked]).astype(np.int64))
    word = np.concatenate([a[2] for a in asked])
    bits = int(word.max(initial=0)).bit_length()
    if len(hist).bit_length() + bits <= 64:
        key = owner.astype(np.uint64) << np.uint64(bits) | word
        order = np.argsort(key).astype(np.int32)
        key = key[order]
        first = key[1:] != key[:-1]
    else:
        order = np.lexsort((word, owner))
        first = (owner[order[1:]] != owner[order[:-1]]) | (word[order[1:]] != word[order[:-1]])
    first = np.r_[True, first] if len(order) else np.zeros(0, bool)
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(first) - 1
    heads = order[first]
    totals = np.bincount(back, np.concatenate([a[3] for a in asked]), len(heads)).astype(np.int64)
    of, seen = owner[heads], totals >= least
    mass = np.bincount(of[seen], weights(asked)[heads][seen], len(hist))
    held = np.bincount(of[seen], totals[seen], len(hist)).astype(np.int64)
    few = [np.bincount(of[seen & (totals == k)], minlength=len(hist)) for k in range(1, CUTOFF + 1)]
    rows, at, hat, r = [], 0, 0, requests["r"][0].as_py()
    for d, a in zip(requests["d"].to_pylist(), asked, strict=True):
        n, own = len(a[2]), hback[hat : hat + len(a[0])]
        rows.append((d, r, kind, put_arrays(narrow(totals[back[at : at + n]]), mass[own], narrow(held[own]), *(narrow(f[own]) for f in few))))
        at, hat = at + n, hat + len(a[0])
    rows.append((-1, r, STATS, _summary(totals[seen])))
    return _rows(rows)


def _stats(replies: DataFrame) -> np.ndarray:
    """Sum of the few numbers that each partition tells."""

    def add(batches):
        total = None
        for b in batches:
            for x in b["blob"].to_pylist():
                a = get_arrays(x)[0]
                total = a if total is None else total + a
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(total, pa.int64()), pa.array(np.arange(len(total)), pa.int32())], ["n", "k"])

    found = replies.where(F.col("kind") == STATS).select("blob").mapInArrow(add, "n long, k int").groupBy("k").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(CUTOFF + 5, np.int64)
    for x in found:
        out[x["k"]] = x["n"]
    return out


def ratios(n: np.ndarray) -> np.ndarray:
    """By count, from 0 to CUTOFF + 1 and more: what a discount leaves of it."""
    out = np.ones(CUTOFF + 2)
    out[1 : CUTOFF + 1] = discounts(n)
    return out


class Order:
    """Probabilities of continuations that a part asked for, by one order of the model."""

    def __init__(self, seen: np.ndarray, mass: np.ndarray, held: np.ndarray, few: list[np.ndarray], total: np.ndarray, ratio: np.ndarray, least: int):
        """By history: seen mass and counts, few, and its own learned count; `seen` is by continuation."""
        freed = (total - held) + sum((1 - ratio[k]) * k * few[k - 1] for k in range(1, CUTOFF + 1))
        extra = np.where((freed == 0) & (total > 0), 0.5, 0.0)
        self.whole = np.maximum(total + extra, 0.5)
        self.alpha = np.where(total > 0, (freed + extra) / self.whole / np.maximum(1 - mass, 1e-300), 1.0)
        self.seen, self.ratio, self.least = seen, ratio, least

    def __call__(self, owner: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """For each continuation, of the history `owner`: its probability, given that of one order less."""
        c = self.seen
        return np.where(c >= self.least, self.ratio[np.minimum(c, CUTOFF + 1)] * c / self.whole[owner], self.alpha[owner] * lower)


class Model:
    """What all parts know of the corpus: totals, discounts, and the shards of a history."""

    def __init__(self, parts: int, words: np.ndarray):
        self.parts = parts
        total, distinct, *n = words.tolist()
        self.unigrams = Unigrams(total, distinct, np.array(n))
        self.pairs = self.triples = np.ones(CUTOFF + 2)

    def learn_pairs(self, stats: np.ndarray) -> None:
        self.pairs = ratios(stats[2:])

    def learn_triples(self, stats: np.ndarray, learned: int) -> None:
        n = stats[2:].copy()
        n[1] = learned - stats[0]  # those seen once aren't told
        self.triples = ratios(n)

    def lower(self, asked: list[list[np.ndarray]]) -> np.ndarray:
        """The probability by the model of pairs of what ends each requested triple, from its pair's count and twice the weight of the pair's first word."""
        count = np.concatenate([a[4] for a in asked])
        whole = np.concatenate([np.repeat(a[5], a[1]) for a in asked]) / 2
        return self.pairs[np.minimum(count, CUTOFF + 1)] * count / np.maximum(whole, 0.5)

    def splits(self, counts: np.ndarray) -> np.ndarray:
        return 1 + counts * self.parts // max(1, self.unigrams.total)


class View:
    """A part and what it has been told so far; made anew in each pass."""

    def __init__(self, known: pa.Table, model: Model):
        """known: the part's tokens and the replies to it."""
        self.part = part = Part.unpack(_of(known, TOKENS)[-1], model.parts)
        self.replies, self.model = known, model
        self.unigram = np.zeros(len(part.hashes), np.int64)
        self.word = np.zeros(len(part.hashes), np.uint64)  # a word's number in the whole corpus
        for r, x in _of(known, WORDS).items():
            own = slice(part.cuts[r], part.cuts[r + 1])
            self.unigram[own], number = get_arrays(x)
            self.word[own] = np.cumsum(number, dtype=np.uint64) * np.uint64(model.parts) + np.uint64(r)
        self.codes, self.at = part.pairs()
        width = len(part.hashes)
        self.v, self.w = (self.codes // width).astype(np.int32), (self.codes % width).astype(np.int32)
        # histories are all of the part's words: those that precede none ask for nothing
        self.used, per = runs(self.v)
        self.owner = np.repeat(np.arange(len(per), dtype=np.int32), per)
        self.deal = Deal(self.word[self.used], model.splits(self.unigram[self.used]), self.owner, self.word[self.w], model.parts)

    def ask_pairs(self, d: int) -> list:
        counts = np.bincount(self.at[self.part.learn], minlength=len(self.codes))
        return self.deal.ask(d, PAIRS, counts, *planes(self.unigram[self.w]))

    def learn_pairs(self) -> Order:
        self.seen, mass, held, few = self.deal.told(_of(self.replies, PAIRS))
        return Order(self.seen, mass, held, few, self.unigram[self.used], self.model.pairs, 1)

    def score_pairs(self) -> np.ndarray:
        """The probability of each pair by the model of pairs."""
        return self.learn_pairs()(self.owner, self.model.unigrams(self.unigram)[self.w])

    def find_triples(self) -> None:
        """Triples that may have been learned often enough, as continuations of their pairs."""
        part = self.part
        at, keys = part.short()
        order, keys, per = grouped(keys)
        cuts = np.searchsorted(keys, np.arange(part.parts + 1, dtype=np.uint64) << SHORT)
        often = np.zeros(len(keys), bool)
        for r, x in _of(self.replies, MAYBE).items():
            often[cuts[r] : cuts[r + 1]] = np.unpackbits(get_arrays(x)[0], count=cuts[r + 1] - cuts[r]).astype(bool)
        # a pair learned less often has no such triple, and all of its backoff weight: only the others are asked about
        before = np.ones(len(part.tokens), bool)
        before[part.starts + part.lengths - 1] = False
        asks = np.zeros(len(self.codes), bool)
        asks[self.at[before]] = True
        self.histories = np.flatnonzero(asks & (self.seen >= LEAST_TRIPLE))
        places = np.sort(at[order[np.repeat(often, per)]])
        self.places = places[self.seen[self.at[places - 1]] >= LEAST_TRIPLE]
        width = len(part.hashes)
        codes, self.triple = np.unique(self.at[self.places - 1].astype(np.int64) * width + part.tokens[self.places], return_inverse=True)
        self.history, self.next = codes // width, codes % width
        self.own = np.searchsorted(self.histories, self.history)
        h = part.hashes
        pair_hash = _stir(h[self.v[self.histories]] * np.uint64(5) + h[self.w[self.histories]])
        self.deal3 = Deal(pair_hash, self.model.splits(self.seen[self.histories]), self.own, self.word[self.next], part.parts)

    def ask_triples(self, d: int) -> list:
        pairs = self.learn_pairs()
        self.find_triples()
        counts = np.bincount(self.triple[self.part.learn[self.places]], minlength=len(self.history))
        # a triple that was learned often enough ends in a pair that was learned: its probability is that of a seen one
        count = self.seen[np.searchsorted(self.codes, self.w[self.history].astype(np.int64) * len(self.part.hashes) + self.next)]
        asks = np.zeros(len(self.histories), bool)
        asks[self.own] = True
        twice = np.zeros(len(self.histories), np.uint64)
        twice[asks] = pairs.whole[np.searchsorted(self.used, self.w[self.histories[asks]])] * 2
        return self.deal3.ask(d, TRIPLES, counts, narrow(count), of=(narrow(twice),))

    def scores(self) -> pa.Table:
        part, model = self.part, self.model
        p = self.score_pairs()[self.at]
        self.find_triples()
        seen, mass, held, few = self.deal3.told(_of(self.replies, TRIPLES))
        order = Order(seen, mass, held, few, self.seen[self.histories], model.triples, LEAST_TRIPLE)
        alpha = np.ones(len(self.codes))
        alpha[self.histories] = order.alpha
        inner = np.ones(len(part.tokens), bool)
        inner[part.starts] = False
        at = np.flatnonzero(inner)
        p[at] *= alpha[self.at[at - 1]]
        fine = seen[self.triple] >= LEAST_TRIPLE
        p[self.places[fine]] = order(self.own, seen * 0.0)[self.triple[fine]]
        c = self.unigram[part.tokens]
        fold = lambda x: np.add.reduceat(x, part.starts) if len(part.starts) else x[:0]
        return pa.table({"doc_id": id_array(part.ids, part.nulls), "held_out": pa.array(part.held), "n_tokens": pa.array(part.lengths), "n_known": pa.array(fold((c > 0).astype(np.int64))), "train_tokens": pa.array(np.full(len(part.ids), model.unigrams.total), pa.int64()), "base_score": pa.array(fold(model.unigrams.base(c))), "score": pa.array(fold(np.log10(p)))})


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def katz_scores(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text), with the log10 probability of its text.

    Learns from the rows whose crc32 of doc_id as text isn't 0 modulo HOLD_OUT
    (null ids learn too). Null and empty texts are one end token. Repeated rows
    count and score each. Without rows to learn from, all tokens are the unknown
    event, of probability one. An empty table gives none; other columns are ignored.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    # half as many parts again as an exchange has, since a task holds one of them at a time
    asked = materialise(document_blocks(docs, parts + parts // 2).groupBy("d").applyInArrow(lambda x: freed(_ask_words(x, parts)), KINDS), "asked")
    words = materialise(asked.where("r >= 0").groupBy("r").applyInArrow(tell_words, KINDS), "words")
    own = f"katz_{uuid.uuid4().hex}"
    tokens = bucketed(asked.where("r < 0"), "d", parts, into=own)
    release(spark, asked)
    model = Model(parts, _stats(words))
    told = words.where("d >= 0")

    def each(left: DataFrame, replies: DataFrame, ask, schema: str) -> DataFrame:
        """What `ask` makes of each part's view."""

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            return freed(ask(View(pa.concat_tables([left, right]), model), left["d"][0].as_py()))

        return left.groupBy("d").cogroup(replies.groupBy("d")).applyInArrow(run, schema)

    def ask_triples(known: pa.Table) -> pa.Table:
        return freed(_rows(View(known, model).ask_triples(known["d"][0].as_py())))

    unigrams = model.unigrams
    counted = each(tokens, told, lambda v, d: _rows(v.ask_pairs(d)), KINDS).groupBy("r")
    pairs = counted.applyInArrow(lambda x: freed(_count(x, PAIRS, 1, lambda asked: unigrams(joined(*(np.concatenate([a[k] for a in asked]) for k in (4, 5, 6)))))), KINDS)
    # what is known of words and pairs joins the tokens in their buckets, so that the largest requests and replies share the disk with no exchange of it
    known = bucketed(pairs.unionByName(told).repartition(parts, "d"), "d", parts, into=own)
    release(spark, words)
    model.learn_pairs(_stats(known))
    known = known.where("d >= 0")
    counted = known.groupBy("d").applyInArrow(ask_triples, KINDS).groupBy("r")
    triples = materialise(counted.applyInArrow(lambda x: freed(_count(x, TRIPLES, LEAST_TRIPLE, model.lower)), KINDS), "triples")
    learned = asked_triples(docs, unigrams.total)
    model.learn_triples(_stats(triples), learned)
    return each(known, triples.where("d >= 0"), lambda v, d: v.scores(), RESULT)


def asked_triples(docs: DataFrame, total: int) -> int:
    """Tokens that end a triple in learning: all but a first one of each learned row."""
    rest = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % HOLD_OUT
    return total - docs.where(rest.isNull() | (rest != 0)).count()


def op5(spark, sf_dir):
    return katz_scores(table(spark, sf_dir, "documents"))


def perplexity(scores: DataFrame) -> float:
    r = scores.where("held_out").agg(F.sum("score"), F.sum("n_tokens")).first()
    return math.pow(10, -r[0] / r[1])
