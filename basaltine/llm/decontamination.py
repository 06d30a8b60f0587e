"""Benchmark decontamination by an FM-index for each shard of the training documents.

A shard is a run of documents of one task, as word ids of the benchmark's vocabulary; any other
word, and a document's end, separates. Test phrases (windows of consecutive item words), where the shard
has all their pairs of neighbouring words, are searched backward through its wavelet ranks, occurrences are located by sampled suffix positions,
and their spans merged per document.

The test side is the only thing sent to the tasks. It goes in blocks of at most ``BLOCK`` bytes of
benchmark text, each a pass over the documents; spans of several passes are merged again.

Edge cases: null and empty texts have no words; items without words or without an id are ignored;
an item shorter than a window is one window; repeated rows stay; an empty benchmark hits nothing; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, blocks, map_arrow, mix, ragged, seeds, utf8, words
from .fm_index import FMIndex

#: Bytes of benchmark text in one pass.
BLOCK = 6 << 20
#: Words of a shard, apart from a longer document.
SHARD = 1_000_000

_SPANS = "array<struct<start:long,end:long>>"


def _first_of(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each phrase (a run of ids) the number of its distinct phrase, numbered from 0."""
    first, second = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
    for j, (k, m) in enumerate(zip(seeds(int(lengths.max(initial=0)), 41), seeds(int(lengths.max(initial=0)), 43), strict=True)):
        word = np.where(lengths > j, ids[np.minimum(starts + j, len(ids) - 1)], 0).astype(np.uint64)
        first += mix(word) * k
        second += mix(word ^ np.uint64(0xABCDEF)) * m
    order = np.lexsort((second, first))
    new = np.ones(len(order), bool)
    new[1:] = (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


class Phrases:
    """Test phrases over the benchmark's own vocabulary: runs of the items' word ids, each distinct run once."""

    def __init__(self, item_ids: np.ndarray, texts: pa.Array, window: int):
        h, _, _, first = words(*utf8(texts), ALNUM)
        self.vocabulary, ids = np.unique(h, return_inverse=True)
        self.text = ids.astype(np.int32) + 1
        n = np.diff(first)
        many = np.where(n > 0, np.maximum(n - window + 1, 1), 0)
        starts, owner = ragged(first[:-1], many), np.repeat(np.arange(len(n)), many)
        lengths = np.minimum(n[owner], window)
        which = _first_of(self.text, starts, lengths) if len(starts) else starts
        _, at = np.unique(which, return_index=True)
        self.starts, self.lengths = starts[at], lengths[at]
        item = np.asarray(item_ids, np.int64)[owner]
        order = np.lexsort((item, which))
        which, item = which[order], item[order]
        new = np.ones(len(order), bool)
        new[1:] = (which[1:] != which[:-1]) | (item[1:] != item[:-1])
        self.items = item[new]
        self.first_item = np.searchsorted(which[new], np.arange(len(at) + 1))
        self.shortest = int(self.lengths.min(initial=window))

    def patterns(self, some: np.ndarray) -> np.ndarray:
        """Left-aligned rows of the ids of some phrases."""
        width = int(self.lengths[some].max(initial=0))
        at = self.starts[some, None] + np.arange(width)
        return np.where(np.arange(width) < self.lengths[some, None], self.text[np.minimum(at, len(self.text) - 1)], 0).astype(np.int64)

    def possible(self, text: np.ndarray) -> np.ndarray:
        """Phrases all of whose neighbouring words (or single words) are neighbours in a text, too: only they can occur there."""
        wide = np.int64(len(self.vocabulary) + 1)

        def missing(of: np.ndarray, known: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(known, of), max(len(known) - 1, 0))
            gone = known[at] != of if len(known) else np.ones(len(of), bool)
            return np.concatenate([[0], np.cumsum(gone)])

        one = missing(self.text.astype(np.int64), np.unique(text))
        two = missing(self.text[:-1] * wide + self.text[1:], np.unique(text[:-1] * wide + text[1:]))
        end = self.starts + self.lengths
        return np.flatnonzero((one[end] == one[self.starts]) & (two[np.maximum(end - 1, self.starts)] == two[self.starts]))

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Word ids of hashes, 0 for words that no item has."""
        if not len(self.vocabulary):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at + 1, 0)

    def hits(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which words are hit, and (document, item) of all occurrences, over documents that begin at ``first``."""
        n = len(h)
        hit, none = np.zeros(n + 1, np.int64), np.zeros(0, np.int64)
        ids = self.ids(h)
        # Runs of known words within a document that are long enough for a phrase.
        edge = np.zeros(n + 1, bool)
        edge[first] = True
        known = ids > 0
        begins = np.flatnonzero(known & (edge[:-1] | ~np.concatenate([[False], known[:-1]])))
        ends = np.flatnonzero(known & (edge[1:] | ~np.concatenate([known[1:], [False]]))) + 1
        keep = ends - begins >= self.shortest
        begins, sizes = begins[keep], (ends - begins)[keep]
        if not len(begins):
            return hit[:n] > 0, none, none
        place = ragged(begins, sizes + 1)  # a separator after each run
        stops = np.cumsum(sizes + 1) - 1
        text = ids[np.minimum(place, n - 1)]
        text[stops] = 0
        some = self.possible(text)
        if not len(some):
            return hit[:n] > 0, none, none
        index = FMIndex(text, len(self.vocabulary))
        low, high = index.search(self.patterns(some), self.lengths[some])
        many = high - low
        phrase = np.repeat(some, many)
        at = place[index.locate(ragged(low, many))]
        np.add.at(hit, at, 1)
        np.add.at(hit, at + self.lengths[phrase], -1)
        doc = np.searchsorted(first, at, "right") - 1
        pair = np.unique(np.stack([doc, phrase], 1), axis=0) if len(doc) else np.zeros((0, 2), np.int64)
        n_items = self.first_item[pair[:, 1] + 1] - self.first_item[pair[:, 1]]
        docs = np.repeat(pair[:, 0], n_items)
        return np.cumsum(hit[:n]) > 0, docs, self.items[ragged(self.first_item[pair[:, 1]], n_items)]


def _pass(documents: DataFrame, phrases: Phrases, keep: bool) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(phrases)
    names = ["row", "doc_id", "n_words", "spans", "bytes", "items"] + ["text", "rest"] * keep

    def scan(batches):
        phrases = shared.value
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

        def out(rows, held):
            h = np.concatenate([x[0] for x in held])
            sizes = np.concatenate([np.diff(x[3]) for x in held])
            first = np.concatenate([[0], np.cumsum(sizes)])
            starts, ends = (np.concatenate([x[j] for x in held]) for j in (1, 2))
            hit, docs, items = phrases.hits(h, first)
            at = np.unique(np.stack([docs, items], 1), axis=0) if len(docs) else np.zeros((0, 2), np.int64)
            edge = np.zeros(len(h) + 1, bool)
            edge[first] = True
            a = np.flatnonzero(hit & (edge[:-1] | ~np.concatenate([[False], hit[:-1]])))
            b = np.flatnonzero(hit & (edge[1:] | ~np.concatenate([hit[1:], [False]]))) + 1
            owner = np.searchsorted(first, a, "right") - 1
            cuts = np.searchsorted(owner, np.arange(len(sizes) + 1)).astype(np.int32)

            def spans(x, y):
                return pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays([pa.array(x), pa.array(y)], fields=list(span)))

            base = first[owner] if len(owner) else a
            listed = pa.ListArray.from_arrays(pa.array(np.searchsorted(at[:, 0], np.arange(len(sizes) + 1)).astype(np.int32)), pa.array(at[:, 1]))
            joined = pa.Table.from_batches(rows).combine_chunks().to_batches()[0] if len(rows) > 1 else rows[0]
            cols = [joined.column(0), joined.column(1), pa.array(sizes), spans(a - base, b - base), spans(starts[a], ends[b - 1]), listed]
            return pa.record_batch(cols + [joined.column(2), joined.column(3)][: 2 * keep], names)

        rows, held, many = [], [], 0
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for a, b in blocks(offsets):
                h, s, e, first = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ALNUM)
                begin = np.repeat(offsets[a:b] - offsets[a], np.diff(first))
                held.append((h, s - begin, e - begin, first))
                rows.append(batch.slice(a, b - a))
                many += len(h)
                if many >= SHARD:
                    yield out(rows, held)
                    rows, held, many = [], [], 0
        if rows:
            yield out(rows, held)

    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = [T.StructField("row", T.LongType()), documents.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("spans", spans), T.StructField("bytes", spans), T.StructField("items", T.ArrayType(T.LongType()))]
    return map_arrow(documents, scan, T.StructType(schema + [T.StructField("text", T.StringType()), documents.schema["rest"]] * keep))


def _merge(column: str) -> F.Column:
    """Sorted spans of several passes, overlapping or touching ones joined."""
    step = "case when size(a) > 0 and a[size(a) - 1].end >= x.start then concat(slice(a, 1, size(a) - 1), array(named_struct('start', a[size(a) - 1].start, 'end', greatest(a[size(a) - 1].end, x.end)))) else concat(a, array(x)) end"
    return F.expr(f"aggregate(array_sort(flatten(collect_list({column}))), cast(array() as {_SPANS}), (a, x) -> {step})")


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = 10, keep: tuple[str, ...] | None = None) -> DataFrame:
    """(doc_id, text) and (item_id, text) to (row, doc_id, n_words, spans, bytes, items), with ``keep`` to (doc_id, ..., items, text, kept columns).

    spans are merged hit words [start, end) of the document, bytes the same in UTF-8 bytes of its
    text; items are the ids of all items with an occurring window. A kept column mustn't have a
    result's name: put it in a struct.
    """
    rest = F.struct(*(keep or ()), F.lit(0).alias("__none")).alias("rest")
    documents = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", rest)
    benchmark = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // BLOCK))
    found = []
    for k in range(parts):
        block = benchmark if parts == 1 else benchmark.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k)
        items = block.toArrow()  # at most about ``BLOCK`` bytes of text
        found.append(_pass(documents, Phrases(items.column(0).to_numpy(), pa.concat_arrays([pa.array([], pa.string()), *items.column(1).chunks]), window), keep is not None and k == 0))
    out = found[0]
    if parts > 1:
        for x in found[1:]:
            out = out.unionByName(x, allowMissingColumns=True)
        more = [F.first(c, ignorenulls=True).alias(c) for c in ("text", "rest")] if keep is not None else []
        out = out.groupBy("row").agg(F.first("doc_id", ignorenulls=True).alias("doc_id"), F.max("n_words").alias("n_words"), _merge("spans").alias("spans"), _merge("bytes").alias("bytes"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), *more)
    return out if keep is None else out.select("doc_id", "n_words", "spans", "bytes", "items", "text", *(F.col("rest")[c].alias(c) for c in keep))


def n_hit() -> F.Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])


def cut(found: DataFrame) -> DataFrame:
    """The rows of ``contamination(keep=...)`` with all removal spans taken out of their texts."""
    text, spans = found.columns.index("text"), found.columns.index("bytes")

    def clean(batches):
        for batch in batches:
            texts = []
            for whole, cuts in zip(batch.column(text), batch.column(spans).to_pylist(), strict=True):
                whole = whole.as_py()
                if cuts:
                    raw, at, kept = whole.encode(), 0, []
                    for s in cuts:
                        kept.append(raw[at : s["start"]])
                        at = s["end"]
                    whole = b"".join([*kept, raw[at:]]).decode()
                texts.append(whole)
            cols = list(batch.columns)
            cols[text] = pa.array(texts, pa.string())
            yield pa.record_batch(cols, batch.schema.names)

    return map_arrow(found, clean, found.schema)


def op3_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    rows = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = n_hit()
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return rows.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (hit > 0).alias("contaminated"))
