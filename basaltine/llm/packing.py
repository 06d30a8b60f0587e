"""Packing by cutting-stock column generation.

Documents longer than a sequence are cut at whole sequences; what is left of each, and every
shorter document, is a piece. Pieces of less than a 64th of a sequence are bundled, up to an eighth
of a sequence, and placed as one. Lengths of bundles and other pieces, rounded up to a grain, form a histogram of at
most capacity / grain classes; less than a grain for each of them is padding that the plan doesn't see. A linear program over patterns (how many pieces of each class
share a sequence) is solved by column generation: the duals price classes and a knapsack
dynamic program finds the best new pattern. Patterns are rounded down, the remainder is
filled greedily, and the pieces of each class, ranked, take the patterns' places in turn.

Only the histogram and the patterns, both bounded by the number of classes, come to the driver.

Edge cases: a null or empty text is a piece of the end id alone; repeated documents are
separate pieces; an empty table gives no pieces; further columns are ignored.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, shared_dir
from .tokens import BATCH, Layout, digests, encoder, id_lists

# ---------------------------------------------------------------- the plan, on the histogram


def best_pattern(width: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable multiset of classes within the capacity. Widths ascend."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(width, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := fits[c]:
            gain = best[c - width[:k]] + value[:k]
            j = int(gain.argmax())
            if gain[j] > best[c] + 1e-12:
                best[c], pick[c] = gain[j], j
    out, c = np.zeros(len(width), np.int64), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            out[pick[c]] += 1
            c -= int(width[pick[c]])
    return float(best[capacity]), out


def relaxed(width: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-3, most: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and their fractional counts, with patterns @ counts = demand.

    Revised simplex; ends when no pattern prices out, within ``gap`` of a lower bound (the total
    width, or what the duals prove), or after ``most`` pivots (any state is a valid packing).
    """
    m = len(width)
    basis = np.diag(capacity // width).astype(float)
    inverse = np.diag(1.0 / (capacity // width))
    counts, least = inverse @ demand, demand @ width / capacity
    for turn in range(most):
        dual = inverse.sum(axis=0)
        price, column = best_pattern(width, np.maximum(dual, 0), capacity)
        if price <= 1 + 1e-9 or counts.sum() <= max(least, (demand @ np.maximum(dual, 0)) / price) * (1 + gap):
            break
        move = inverse @ column
        usable = move > 1e-10
        if not usable.any():
            break
        ratio = np.full(m, np.inf)
        ratio[usable] = np.maximum(counts[usable], 0) / move[usable]
        out = int(ratio.argmin())
        counts -= ratio[out] * move
        counts[out] = ratio[out]
        inverse[out] /= move[out]
        move[out] = 0
        inverse -= np.outer(move, inverse[out])
        basis[:, out] = column
        if turn % 100 == 99:  # rounding errors go by a step of Newton's; LAPACK's threads may hang beside a JVM
            inverse = 2 * inverse - inverse @ (basis @ inverse)
            counts = inverse @ demand
    return basis.round().astype(np.int64), np.maximum(counts, 0)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Whole patterns for a histogram of class widths: (sequences, widths, how many of each)."""
    if not histogram:
        return []
    width = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[w] for w in width.tolist()], np.int64)
    patterns, counts = relaxed(width, demand.astype(float), capacity)
    out, left = [], demand.copy()
    for j in np.argsort(-counts):
        times = int(counts[j] + 1e-7)
        used = patterns[:, j] > 0
        if used.any():
            times = min(times, int((left[used] // patterns[used, j]).min()))
        if times > 0:
            left -= times * patterns[:, j]
            out.append((times, width[used], patterns[used, j]))
    while left.any():  # at most one pattern's worth for each class: the widest first, then what still fits
        room, here = capacity, np.zeros(len(width), np.int64)
        for i in range(len(width) - 1, -1, -1):
            if left[i] and width[i] <= room:
                here[i] = min(left[i], room // width[i])
                room -= int(here[i] * width[i])
        times = int((left[here > 0] // here[here > 0]).min())
        left -= times * here
        out.append((times, width[here > 0], here[here > 0]))
    return out


def places(patterns: list[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Rows (class, first rank, first sequence, slot): the piece of rank r in a class takes the last place with first rank <= r."""
    rows, taken, sequence = [], {}, 0
    for times, widths, many in patterns:
        slot = 0
        for w, k in zip(widths.tolist()[::-1], many.tolist()[::-1], strict=True):
            for _ in range(k):
                rows.append((w, taken.get(w, 0), sequence, slot))
                taken[w] = taken.get(w, 0) + times
                slot += 1
        sequence += times
    out = np.array(rows, np.int64).reshape(-1, 4)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


# ---------------------------------------------------------------- the operator


@dataclass
class Packed:
    """pieces: piece_id, doc_id, start, length, doc_tokens, ids. assigned: piece_id, sequence_id, offset."""

    pieces: DataFrame
    assigned: DataFrame
    capacity: int

    def sequences(self) -> DataFrame:
        """The packed sequences themselves: sequence_id, ids, doc_ids, offsets. A group has a sequence's tokens at most."""
        rows = self.pieces.join(self.assigned, "piece_id").groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
        return rows.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("offsets"))


def pack(documents: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2, grain: int = 8) -> Packed:
    """Pack documents (doc_id, text) into sequences of at most ``capacity`` tokens.

    One pass encodes, cuts and numbers the pieces of each task and class; written to the shared
    folder, the numbers hold. A class's rank is the count of earlier tasks plus that number, so no
    class, however many pieces it has, meets in one task.
    """
    spark = documents.sparkSession
    wide = -(-capacity // grain)

    def cut(batches):
        enc, end, part = encoder(tokenizer), struct.pack("<I", end_id), TaskContext.get().partitionId()
        seen, at, step = np.zeros(wide + 1, np.int64), 0, 4 * capacity
        rows, ids, size = [], [], 0
        short, tokens = [], 0  # the open bundle, and its tokens

        def placed(items, n):
            """Rows of pieces that share a place of n tokens."""
            nonlocal size
            c = -(-n // grain)
            for lead, (doc, a, piece, total) in enumerate(items):
                rows.append(((part << 40) + doc[0], c, int(seen[c]), int(lead == 0), doc[1], a, len(piece) // 4, total))
                ids.append(piece)
                size += len(piece)
            seen[c] += 1

        def out(kind):
            cols = list(zip(*rows, strict=True))
            return pa.record_batch([pa.array(cols[0], pa.int64()), pa.array([part] * len(rows), pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int32()), pa.array(cols[4], kind), *(pa.array(c, pa.int64()) for c in cols[5:]), id_lists(ids)], ["piece_id", "part", "cls", "nth", "lead", "doc_id", "start", "length", "doc_tokens", "ids"])

        for batch in batches:
            kind, texts = batch.schema.field(0).type, batch.column(1)
            for i, doc in enumerate(batch.column(0).to_pylist()):
                whole = enc(texts[i].as_py() or "") + end
                for a in range(0, len(whole), step):
                    piece = whole[a : a + step]
                    n, item = len(piece) // 4, ((at, doc), a // 4, piece, len(whole) // 4)
                    at += 1
                    if 64 * n >= capacity:
                        placed([item], n)
                    else:
                        if 8 * (tokens + n) > capacity and short:
                            placed(short, tokens)
                            short, tokens = [], 0
                        short.append(item)
                        tokens += n
                    if size >= BATCH:
                        yield out(kind)
                        rows, ids, size = [], [], 0
            if rows:
                yield out(kind)
                rows, ids, size = [], [], 0
        if short:
            placed(short, tokens)
            yield out(kind)

    kind = documents.schema["doc_id"].dataType.simpleString()
    path = shared_dir(spark)
    layout = Layout(page=1 << 20).options()
    map_arrow(documents.select("doc_id", "text"), cut, f"piece_id long, part int, cls int, nth long, lead int, doc_id {kind}, start long, length long, doc_tokens long, ids array<int>", keep=True).write.options(**layout).parquet(path)
    pieces = spark.read.parquet(path)

    by_part = pieces.where("lead = 1").groupBy("cls", "part").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r.cls: r.n for r in by_part.groupBy("cls").agg(F.sum("n").alias("n")).collect()}  # a row for each class
    at = places(plan(histogram, capacity // grain))
    keys, first = (at[:, 0] << 44) + at[:, 1], at

    before = Window.partitionBy("cls").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = by_part.select("cls", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    ranked = pieces.select("piece_id", "cls", "part", "nth", "length").join(ahead, ["cls", "part"]).select("piece_id", "cls", (F.col("ahead") + F.col("nth")).alias("nth"), "length")

    def place(batches):
        for b in batches:
            cls, rank = (b.column(i).to_numpy().astype(np.int64) for i in (1, 2))
            j = np.searchsorted(keys, (cls << 44) + rank, "right") - 1
            yield pa.record_batch([b.column(0), b.column(3), pa.array(first[j, 2] + rank - first[j, 1]), pa.array(first[j, 3])], ["piece_id", "length", "sequence_id", "slot"])

    placed = map_arrow(ranked, place, "piece_id long, length long, sequence_id long, slot long")
    earlier = Window.partitionBy("sequence_id").orderBy("slot", "piece_id").rowsBetween(Window.unboundedPreceding, -1)
    assigned = placed.select("piece_id", "sequence_id", F.coalesce(F.sum("length").over(earlier), F.lit(0)).alias("offset"))
    return Packed(pieces.drop("part", "cls", "nth", "lead"), assigned, capacity)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens; a row for each piece."""
    import public_tokenizers

    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    return digests(packed.pieces).join(packed.assigned, "piece_id").drop("piece_id")
