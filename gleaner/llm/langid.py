"""Language identification: words first, then ever shorter character n-grams.

A known word adds its log frequency in each language. An unseen word is scored by
its n-grams of the greatest length of which any is known, from NGRAM down to 1.

The model learns from a bounded, documented sample of the labelled documents and
keeps a bounded number of words and n-grams: SAMPLE_ROWS documents are shared
evenly by the languages, but none gets fewer than LEAST_ROWS; TOTAL_WORDS words are
shared likewise, and none gets more than MAX_WORDS; of each length of n-grams the
MAX_NGRAMS most frequent stay. Every text is scored whole.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise, table
from .common import lean, slices, utf8
from .toxicity import remainder

SAMPLE_ROWS, LEAST_ROWS = 12_000, 1_000
TOTAL_WORDS, MAX_WORDS = 240_000, 60_000
MAX_NGRAMS = 40_000
NGRAM = 5
SMOOTH = 0.5
MEMO_WORDS = 300_000
UNKNOWN = "und"
LETTERS = bytes(c if 97 <= c <= 122 or c >= 0x80 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def letters_of(text: bytes) -> bytes:
    """Lower-cased, with a space for each ASCII character that is no letter."""
    return text.decode("utf-8", "replace").lower().encode().translate(LETTERS)


def words_of(text: bytes) -> list[bytes]:
    """Runs of letters, lower-cased; ASCII letters and whatever isn't ASCII."""
    return letters_of(text).split()


def has_letter(word: bytes) -> bool:
    return any(c.isalpha() for c in word.decode("utf-8", "replace"))


def ngrams(word: bytes, n: int) -> list[str]:
    x = f"^{word.decode('utf-8', 'replace')}$"
    return [x[i : i + n] for i in range(len(x) - n + 1)]


class Model:
    """Log frequencies by language of words and n-grams: numbers of rows, and the rows, one column a language."""

    def __init__(self, counts: dict[str, dict[bytes, int]]):
        self.langs = sorted(counts)
        self.words = {w: k for k, w in enumerate(sorted({w for held in counts.values() for w in held}))}
        c = np.zeros((len(self.words), len(self.langs)))
        for k, lang in enumerate(self.langs):
            for w, n in counts[lang].items():
                c[self.words[w], k] += n
        self.word_logs = self._logs(c)
        self.grams: dict[int, dict[str, int]] = {}
        self.gram_logs: dict[int, np.ndarray] = {}
        for n in range(1, NGRAM + 1):
            found = [ngrams(w, n) for w in self.words]
            own = np.repeat(np.arange(len(found)), [len(x) for x in found])
            names, at = np.unique(np.array([g for x in found for g in x], dtype=f"U{n}"), return_inverse=True)
            held = np.stack([np.bincount(at, c[own, k], len(names)) for k in range(len(self.langs))], axis=1) if len(names) else np.zeros((0, len(self.langs)))
            best = np.argsort(-held.sum(axis=1), kind="stable")[:MAX_NGRAMS]
            self.grams[n] = {str(names[i]): k for k, i in enumerate(best.tolist())}
            self.gram_logs[n] = self._logs(held[best])

    def _logs(self, m: np.ndarray) -> np.ndarray:
        m = m + SMOOTH
        return np.log(m) - np.log(m.sum(axis=0)) if len(m) else m

    def word(self, word: bytes) -> np.ndarray:
        """The log frequencies of a word, or what its n-grams say."""
        if (k := self.words.get(word)) is not None:
            return self.word_logs[k]
        for n in range(NGRAM, 0, -1):
            held = self.grams[n]
            if found := [held[g] for g in ngrams(word, n) if g in held]:
                return self.gram_logs[n][found].mean(axis=0)
        return np.zeros(len(self.langs))


class Scorer:
    """Scores texts by a model; keeps the rows of words it has met, and forgets them at MEMO_WORDS."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.place: dict[bytes, int] = {}  # 0 is whatever has no letter
        self.rows = np.zeros((1024, len(self.model.langs)))
        self.used = 1

    def _learn(self, words: set[bytes]) -> None:
        for w in words:
            if not has_letter(w):
                self.place[w] = 0
                continue
            if self.used == len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[self.used] = self.model.word(w)
            self.place[w] = self.used
            self.used += 1

    def predict(self, text: bytes) -> tuple[str, float]:
        langs = self.model.langs
        total, n = np.zeros(len(langs)), 0
        for piece in slices(letters_of(text)):
            words = piece.split()
            if self.used > MEMO_WORDS:
                self._forget()
            ids = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
            if len(ids) and ids.min() < 0:
                self._learn({words[k] for k in np.flatnonzero(ids < 0).tolist()})
                ids = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
            n += int(np.count_nonzero(ids))
            if len(ids) > 2048:
                some, times = np.unique(ids, return_counts=True)
                total += times @ self.rows[some]
            else:
                total += self.rows[ids].sum(axis=0)
        if not n or not langs:
            return UNKNOWN, 0.0
        best = int(total.argmax())
        return langs[best], float(1 / np.exp(total - total[best]).sum())


def train(docs: DataFrame, sample: int = SAMPLE_ROWS, words: int = MAX_WORDS) -> Model:
    """Learn from docs (doc_id, text, lang); rows without text or lang are left out.

    The sample is dealt by a hash of id and text, in each language the share that
    makes up its number of documents (nearly: the hash decides for each document by
    itself). It is counted where it lies, and never gathered. Of a language, the
    words stay that are more frequent than any count which more than its number of
    words have or exceed; so of equally frequent words all stay or none does.
    """
    usable = docs.where("text IS NOT NULL AND lang IS NOT NULL").select(F.xxhash64("doc_id", "text").alias("h"), "text", "lang")
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model({})
    each = max(LEAST_ROWS, sample // len(sizes))
    most = min(words, max(1, TOTAL_WORDS // len(sizes)))
    bars = docs.sparkSession.createDataFrame([(lang, (2**64 - 1) * min(each, n) // n - 2**63) for lang, n in sizes.items()], "of string, bar long")

    def count(batches):
        seen: dict[str, Counter] = defaultdict(Counter)
        held = 0

        def told():
            for lang, found in seen.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["lang", "word", "n"])

        for b in batches:
            for t, lang in zip(utf8(b["text"]), b["lang"].to_pylist(), strict=True):
                for piece in slices(letters_of(t)):
                    seen[lang].update(w for w in piece.split() if has_letter(w))
                    held += len(piece)
                    if held > 64 << 20:
                        yield from told()
                        seen.clear()
                        held = 0
        yield from told()

    picked = usable.join(F.broadcast(bars), F.col("lang") == F.col("of")).where(F.col("h") <= F.col("bar")).select("text", "lang")
    counts = materialise(picked.mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    steps: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for r in counts.groupBy("lang", "n").agg(F.count("*").alias("words")).collect():  # the numbers of different counts, which are few
        steps[r["lang"]].append((r["n"], r["words"]))
    least = []
    for lang, found in steps.items():
        bar, held = 2**62, 0
        for n, more in sorted(found, reverse=True):
            held += more
            if held > most:
                break
            bar = n
        least.append((lang, bar))
    bars = docs.sparkSession.createDataFrame(least, "of string, bar long")
    best = counts.join(F.broadcast(bars), F.col("lang") == F.col("of")).where(F.col("n") >= F.col("bar")).select("lang", "word", "n")
    held: dict[str, dict[bytes, int]] = {lang: {} for lang in sizes}
    for r in best.collect():
        held[r["lang"]][bytes(r["word"])] = r["n"]
    return Model(held)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs' columns, lang_pred and lang_score, from the text alone.

    Null, empty and letterless texts give ("und", 0.0); so do all if nothing was
    learned. The score is the posterior of the prediction under equal priors; ties
    go to the first language by name. Repeated rows get equal results; columns of
    the results' names are replaced.
    """
    docs = docs.drop("lang_pred", "lang_score")
    held = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.schema

    def run(batches):
        score = Scorer(held.value)
        for b in batches:
            found = [score.predict(t) for t in utf8(b["text"])]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in kept.names), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], [*kept.names, "lang_pred", "lang_score"])

    return docs.mapInArrow(lean(run), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields) + ", lang_pred string, lang_score double")


def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = train(docs.select("doc_id", "text", "lang").where(remainder("doc_id", 3) != 1))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
