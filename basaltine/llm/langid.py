"""Language identification that scores words first and backs off to shorter character n-grams.

A word that training has seen is scored, for each language, by the log frequency of the word
there, or a penalty where the language lacks it. An unseen word is scored by its character n-grams
of the highest order of which any is known, on average. A document's score is the mean of its words'.

Words are runs of ASCII letters and characters beyond ASCII; A-Z count as a-z. Models hold hashes
and, for each, the languages that have it with their log frequencies: all words and n-grams of a sample of
labelled texts, which is bounded in rows and bytes for each language, so that a rare language is learned, too.

Edge cases: texts that are null or have no letter are ``und`` with score 0; without any training
row all are ``und``; equal scores go to the first language by name; repeated rows stay; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LETTERS, blocks, chosen, map_arrow, mix, ragged, seeds, utf8, words

#: Labelled rows that a model is fitted on and bytes of their texts, at most, shared evenly by the languages, and
#: rows of a language that it may have in any case (all by expectation of a hash).
FIT_ROWS, FIT_BYTES, FIT_LEAST = 12_000, 32 << 20, 200
ORDERS = (5, 4, 3, 2, 1)


def grams(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the character n-grams of words padded with a space on both sides, and each one's word."""
    points = np.frombuffer((" " + " ".join(texts) + " ").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    gap = points == 32
    n = len(points) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = np.cumsum(gap) - 1
    inner = np.concatenate([[0], np.cumsum(gap)])
    # No space within, other than as first or last character of a longer n-gram.
    good = inner[order - 1 : order - 1 + n] - inner[1 : 1 + n] <= 0 if order > 1 else ~gap[:n]
    if order == 2:
        good = ~(gap[:n] & gap[1 : 1 + n])
    at = np.flatnonzero(good)
    h = np.zeros(len(at), np.uint64)
    for j, k in enumerate(seeds(order, 23 + order)):
        h += points[at + j].astype(np.uint64) * k
    owner = word[at]
    return mix(h), np.minimum(owner, len(texts) - 1)


class _Seen:
    """Distinct words of a block of rows, with one place of each in the text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        self.h, self.starts, self.ends, self.first = words(data, offsets, LETTERS)
        self.words, self.place, self.word = np.unique(self.h, return_index=True, return_inverse=True)

    def texts(self, which: np.ndarray) -> list[str]:
        raw = self.data.tobytes()
        at = self.place[which]
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(self.starts[at].tolist(), self.ends[at].tolist(), strict=True)]


def lettered(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts have any letter."""
    has = lambda kind: np.diff(np.concatenate([[0], np.cumsum(kind)])[offsets]) > 0
    out = has(((data | 32) >= 97) & ((data | 32) <= 122))
    for i in np.flatnonzero(~out & has(data >= 128)):
        out[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


@dataclass
class Level:
    """Words or n-grams of an order: sorted hashes, for each the languages that have it, and how far their score is above that of lacking it."""

    hashes: np.ndarray
    first: np.ndarray
    lang: np.ndarray
    gain: np.ndarray
    base: float

    def entries(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``at``, language, gain) of all entries of some hashes."""
        many = self.first[at + 1] - self.first[at]
        k = ragged(self.first[at], many)
        return np.repeat(np.arange(len(at)), many), self.lang[k].astype(np.int64), self.gain[k]


#: Entries that are summed at once.
_ENTRIES = 1_000_000


@dataclass
class Model:
    """Level 0 is of words, the others of n-grams."""

    languages: list[str]
    levels: dict[int, Level]

    def find(self, order: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = self.levels[order].hashes
        if not len(known):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        return at, known[at] == h

    def word_scores(self, seen: _Seen) -> tuple[Level, np.ndarray, np.ndarray]:
        """For distinct words: their entries, their score in a language without one, and which have any score."""
        words_, langs, gains = [], [], []
        base = np.zeros(len(seen.words))
        at, done = self.find(0, seen.words)
        known = np.flatnonzero(done)
        place, lang, gain = self.levels[0].entries(at[known])
        words_.append(known[place]), langs.append(lang), gains.append(gain)
        base[known] = self.levels[0].base
        todo = np.flatnonzero(~done)
        for order in ORDERS:
            if not len(todo):
                break
            h, owner = grams(seen.texts(todo), order)
            at, found = self.find(order, h)
            n = np.bincount(owner[found], minlength=len(todo))
            place, lang, gain = self.levels[order].entries(at[found])
            mine = owner[found][place]
            key, which = np.unique(mine * len(self.languages) + lang, return_inverse=True)
            words_.append(todo[key // len(self.languages)])
            langs.append(key % len(self.languages))
            gains.append(np.bincount(which, gain / n[mine], minlength=len(key)))
            base[todo[n > 0]] = self.levels[order].base
            done[todo[n > 0]] = True
            todo = todo[n == 0]
        words_, langs, gains = (np.concatenate(x) for x in (words_, langs, gains))
        order = np.argsort(words_, kind="stable")
        first = np.searchsorted(words_[order], np.arange(len(seen.words) + 1))
        return Level(seen.words, first, langs[order], gains[order], 0.0), base, done

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(offsets) - 1
        out, score = ["und"] * n, np.zeros(n)
        seen = _Seen(data, offsets)
        if not self.languages or not len(seen.h):
            return out, score
        by_word, base, some = self.word_scores(seen)
        many_langs = len(self.languages)
        doc = np.repeat(np.arange(n), np.diff(seen.first))
        use = some[seen.word]
        doc, word = doc[use], seen.word[use]
        many = np.bincount(doc, minlength=n)
        total = np.repeat(np.bincount(doc, base[word], minlength=n)[:, None], many_langs, 1).ravel()
        step = np.cumsum(by_word.first[word + 1] - by_word.first[word])
        a = 0
        while a < len(word):
            z = max(a + 1, int(np.searchsorted(step, (step[a - 1] if a else 0) + _ENTRIES, "right")))
            place, lang, gain = by_word.entries(word[a:z])
            total += np.bincount(doc[a:z][place] * many_langs + lang, gain, minlength=len(total))
            a = z
        mean = total.reshape(n, many_langs) / np.maximum(many, 1)[:, None]
        best = mean.argmax(1)
        # Posterior of the best, as if of at most 20 independent words.
        edge = (mean - mean.max(1, keepdims=True)) * np.log(10) * np.clip(many, 1, 20)[:, None]
        sure = 1 / np.exp(edge).sum(1)
        for i in np.flatnonzero(lettered(data, offsets)):
            out[i], score[i] = self.languages[best[i]], sure[i]
        return out, score


def fit(labelled: DataFrame, rows: int = FIT_ROWS, size: int = FIT_BYTES, least: int = FIT_LEAST) -> Model:
    """A model from (doc_id, text, lang): of each of L languages at most ``rows`` / L rows (or ``least``) and ``size`` / L bytes, whole texts, by a hash of doc_id."""
    labelled = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    found = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size")).collect()  # a row for each language
    languages = sorted(r.lang for r in found)
    if not languages:
        return Model([], {})
    share = {r.lang: min(1.0, max(least, rows / len(found)) / r.n, size / len(found) / max(1, r.size)) for r in found}
    shares = F.create_map(*(F.lit(x) for pair in share.items() for x in pair))
    sample = labelled.where(chosen("doc_id", F.element_at(shares, F.col("lang"))))

    def count(batches):
        def merged(parts):
            h, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            keys, at = np.unique(h, return_inverse=True)
            return keys, np.bincount(at, n, minlength=len(keys)).astype(np.int64)

        total: dict[tuple[str, int], list] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for lang in sorted(set(langs)):
                own = batch.filter(pa.array(langs == lang))
                data, offsets = utf8(own.column(0))
                for a, b in blocks(offsets):
                    seen = _Seen(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    n = np.bincount(seen.word, minlength=len(seen.words))
                    found = {0: (seen.words, n)}
                    texts = seen.texts(np.arange(len(seen.words)))
                    for order in ORDERS if texts else ():
                        h, owner = grams(texts, order)
                        found[order] = (h, n[owner])
                    for order, x in found.items():
                        held = total.setdefault((lang, order), [])
                        held.append(merged([x]))
                        if len(held) > 8:
                            held[:] = [merged(held)]
        for (lang, order), parts in total.items():
            h, n = merged(parts)
            for a in range(0, len(h), 50_000):
                m = len(h[a : a + 50_000])
                yield pa.record_batch([pa.array([lang] * m), pa.array(np.full(m, order, np.int32)), pa.array(h[a : a + m].view(np.int64)), pa.array(n[a : a + m])], ["lang", "level", "h", "n"])

    counts = map_arrow(sample.select("text", "lang"), count, "lang string, level int, h long, n long")
    kept = counts.groupBy("lang", "level", "h").agg(F.sum("n").alias("n")).toArrow()  # bounded by the sample
    lang = np.searchsorted(languages, kept.column(0).to_numpy().astype(str)) if kept.num_rows else np.zeros(0, np.int64)
    level, h, n = (kept.column(i).to_numpy() for i in (1, 2, 3))
    model = Model(languages, {})
    for order in (0, *ORDERS):
        mine = np.flatnonzero(level == order)
        mine = mine[np.lexsort((lang[mine], h[mine].astype(np.int64).view(np.uint64)))]
        keys, own = h[mine].astype(np.int64).view(np.uint64), lang[mine]
        total = np.maximum(np.bincount(own, n[mine], minlength=len(languages)), 1)
        base = float(np.log10(0.5 / total.max()))
        distinct, first = np.unique(keys, return_index=True)
        gain = (np.log10(n[mine] / total[own]) - base).astype(np.float32)
        model.levels[order] = Level(distinct, np.append(first, len(keys)), own.astype(np.int32), gain, base)
    return model


def identify(documents: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The kept columns, lang_pred, score and whether there is any letter, from whole texts."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            data, offsets = utf8(batch.column(len(keep)))
            for a, b in blocks(offsets):
                part = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                names, score = model.predict(*part)
                yield pa.record_batch([*(c[a:b] for c in batch.columns[: len(keep)]), pa.array(names), pa.array(score), pa.array(lettered(*part))], [*keep, "lang_pred", "score", "letters"])

    schema = T.StructType([documents.schema[c] for c in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("letters", T.BooleanType())])
    return map_arrow(documents.select(*keep, F.col(text).alias("__text")), run, schema)


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def op4_word_backoff_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from those that aren't held out."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(documents.where(~F.coalesce(held_out(), F.lit(False))))
    rows = identify(documents.withColumn("held_out", F.coalesce(held_out(), F.lit(False))), model, ("doc_id", "held_out"))
    return rows.select("doc_id", "held_out", "lang_pred", "score")
