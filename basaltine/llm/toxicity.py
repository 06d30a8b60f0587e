"""Toxicity by a chain of linear classifiers.

Categories are predicted one after another; each model sees the document's words and the
probabilities of all earlier categories. While a chain is fitted, those probabilities are out of
fold: every row's come from models that haven't seen it, so later models meet in training what
they'll meet in use. Word features are present or not, scaled by a smoothed log ratio of
the category's rates; a logistic model is fitted on them.

A chain is fitted on a bounded sample of labelled rows and applied to all documents.

Edge cases: null and empty texts have no words, their probabilities are the models' intercepts;
rows with a null label aren't fitted on; of several labels of a doc_id the largest counts; without labelled rows, or with one class only, a
category's probability is its smoothed rate; repeated rows stay; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, blocks, chosen, map_arrow, ragged, utf8, words

#: Labelled rows that a chain is fitted on, at most (by expectation of a hash of doc_id).
FIT_ROWS = 8000
BITS = 20
FOLDS = 5


def buckets(data: np.ndarray, offsets: np.ndarray, useful: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed words of rows of bytes, and where each row's begin (n + 1)."""
    h, _, _, first = words(data, offsets, ALNUM)
    at = (h >> np.uint64(64 - BITS)).astype(np.int64)
    key = (np.repeat(np.arange(len(offsets) - 1), np.diff(first)) << BITS) + at
    if useful is not None:
        key = key[useful[at]]
    key = np.unique(key)
    return key & ((1 << BITS) - 1), np.searchsorted(key >> BITS, np.arange(len(offsets)))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Linear:
    """Weights of words, of earlier categories' log odds, and an intercept."""

    words: np.ndarray
    chain: np.ndarray
    bias: float

    @classmethod
    def fit(cls, ids: np.ndarray, first: np.ndarray, chain: np.ndarray, y: np.ndarray, turns: int = 60, ridge: float = 0.3, least: int = 5) -> Linear:
        """Full-batch adaptive gradient steps on words that at least ``least`` rows have."""
        n, rate = len(y), (y.sum() + 0.5) / (len(y) + 1)
        out = cls(np.zeros(1 << BITS, np.float32), np.zeros(chain.shape[1]), float(np.log(rate / (1 - rate))))
        if n == 0 or y.min() == y.max():
            return out
        row = np.repeat(np.arange(n), np.diff(first))
        many = np.bincount(ids, minlength=1 << BITS)
        vocabulary = np.flatnonzero(many >= least)
        place = np.full(1 << BITS, -1)
        place[vocabulary] = np.arange(len(vocabulary))
        use = place[ids] >= 0
        col, row = place[ids[use]], row[use]
        pos = np.bincount(col, y[row], minlength=len(vocabulary))
        neg = many[vocabulary] - pos
        ratio = np.log((pos + 0.5) / (y.sum() + 1)) - np.log((neg + 0.5) / (n - y.sum() + 1))
        # Words whose rates differ no more than by chance are left out.
        spread = np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
        ratio[np.abs(ratio) < 2.5 * spread] = 0
        keep = ratio[col] != 0
        col, row = col[keep], row[keep]
        value = ratio[col]
        w, c, b = np.zeros(len(vocabulary)), np.zeros(chain.shape[1]), out.bias
        gw, gc, gb = np.full(len(w), 1e-8), np.full(len(c), 1e-8), 1e-8
        for _ in range(turns):
            p = _sigmoid(np.bincount(row, value * w[col], minlength=n) + chain @ c + b)
            e = p - y
            dw = np.bincount(col, value * e[row], minlength=len(w)) + ridge * w
            dc, db = chain.T @ e + ridge * c, e.sum()
            gw, gc, gb = gw + dw**2, gc + dc**2, gb + db**2
            w -= 0.5 * dw / np.sqrt(gw)
            c -= 0.5 * dc / np.sqrt(gc)
            b -= 0.5 * db / np.sqrt(gb)
        out.words[vocabulary] = w * ratio
        out.chain, out.bias = c, float(b)
        return out

    def odds(self, ids: np.ndarray, first: np.ndarray, chain: np.ndarray) -> np.ndarray:
        return _sums(self.words[ids], first) + chain @ self.chain + self.bias


@dataclass
class Chain:
    categories: tuple[str, ...]
    models: list[Linear]
    thresholds: list[float]

    def predict(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Probabilities, rows x categories."""
        n = len(first) - 1
        odds = np.zeros((n, 0))
        for m in self.models:
            odds = np.concatenate([odds, np.clip(m.odds(ids, first, odds), -8, 8)[:, None]], 1)
        return _sigmoid(odds)

    @property
    def useful(self) -> np.ndarray:
        return np.any([m.words != 0 for m in self.models], axis=0)


def _take(ids: np.ndarray, first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = (first[1:] - first[:-1])[rows]
    return ids[ragged(first[:-1][rows], size)], np.concatenate([[0], np.cumsum(size)])


def fit_chain(ids: np.ndarray, first: np.ndarray, labels: np.ndarray, folds: np.ndarray, categories: tuple[str, ...]) -> Chain:
    """Fit models in turn; each row's earlier probabilities are those of models fitted without its fold."""
    n = len(labels)
    odds, models, thresholds = np.zeros((n, 0)), [], []
    for k in range(len(categories)):
        y, fresh = labels[:, k].astype(float), np.zeros(n)
        for f in range(FOLDS):
            out, inside = np.flatnonzero(folds == f), np.flatnonzero(folds != f)
            if len(out):
                m = Linear.fit(*_take(ids, first, inside), odds[inside], y[inside])
                fresh[out] = np.clip(m.odds(*_take(ids, first, out), odds[out]), -8, 8)
        models.append(Linear.fit(ids, first, odds, y))
        odds = np.concatenate([odds, fresh[:, None]], 1)
        # The threshold with the best F1 out of fold; of equal ones the middle.
        p = _sigmoid(fresh)
        cuts = np.linspace(0.05, 0.95, 91)
        f1 = np.array([2 * ((p >= c) & (y > 0)).sum() / max(1, (p >= c).sum() + (y > 0).sum()) for c in cuts])
        best = np.flatnonzero(f1 >= f1.max() - 1e-12)
        thresholds.append(float(cuts[best[len(best) // 2]]) if y.any() else 0.5)
    return Chain(categories, models, thresholds)


def fit(documents: DataFrame, labels: DataFrame, categories: tuple[str, ...], rows: int = FIT_ROWS) -> Chain:
    """A chain from documents (doc_id, text) and 0/1 labels (doc_id, one column for each category)."""
    known = labels.select("doc_id", *categories).dropna()
    # Bounded by ``rows``, so it may be sent to all tasks.
    sample = known.where(chosen("doc_id", min(1.0, rows / max(1, known.count())))).groupBy("doc_id").agg(*(F.max(c).alias(c) for c in categories))
    taken = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)).cast("int").alias("fold"), F.col("doc_id"), F.array(*(F.col(c).cast("int") for c in categories)).alias("y"))

    def hashed(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for a, b in blocks(offsets):
                ids, first = buckets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.record_batch([lists, *(c[a:b] for c in batch.columns[1:])], ["ids", "fold", "doc_id", "y"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    got = map_arrow(taken, hashed, f"ids array<int>, fold int, doc_id {kind}, y array<int>").toArrow().sort_by("doc_id").combine_chunks()
    if not got.num_rows:
        return fit_chain(np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros((0, len(categories))), np.zeros(0), categories)
    lists = got.column("ids").combine_chunks()
    first = np.concatenate([[0], np.cumsum(np.diff(np.asarray(lists.offsets)))])
    y = np.asarray(got.column("y").combine_chunks().flatten()).reshape(-1, len(categories))
    return fit_chain(np.asarray(lists.flatten()).astype(np.int64), first, y, got.column("fold").to_numpy(), categories)


def classify(documents: DataFrame, chain: Chain) -> DataFrame:
    """(doc_id, text) to doc_id and p_<category> for each category, from whole texts."""
    names = [f"p_{c}" for c in chain.categories]
    shared = documents.sparkSession.sparkContext.broadcast(chain)

    def run(batches):
        chain = shared.value
        useful = chain.useful
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in blocks(offsets):
                p = chain.predict(*buckets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], useful))
                yield pa.record_batch([batch.column(0)[a:b], *(pa.array(np.ascontiguousarray(x)) for x in p.T)], ["doc_id", *names])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return map_arrow(documents.select("doc_id", "text"), run, f"doc_id {kind}, " + ", ".join(f"{n} double" for n in names))


def op1_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Low quality, then toxicity, of all documents."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    chain = fit(documents, labels, ("low_quality", "toxic"))
    rows = classify(documents, chain)
    return rows.withColumn("toxic", F.col("p_toxic") >= chain.thresholds[1])
