"""Near-duplicate documents by min-max hashing.

A document's set is its distinct word shingles. Each permutation of the 64-bit shingle hashes
gives two signature values, its minimum and its maximum, so a signature takes half as many hash
evaluations as values. Bands of signature values bring candidates together; candidates are
confirmed on full sets, links joined to components.

Documents with equal sets are one class from the start. Pairs are never listed. Within a band's
bucket, tasks compare short signatures and return only a spanning forest of the likely pairs; a
bucket beyond ``LARGE`` members is taken as connected, which only makes more to confirm. The components
of those forests are families, and every link lies within one. A family's sets are measured exactly in
blocks of bounded size: first each block with itself and with a few documents of the family (pivots) that
come to all its blocks, which joins what is alike; then, of families of several blocks, what isn't in the
largest component so far with all other components, where sizes allow a link at all. Sets that are
joined already are never compared, so a family of copies costs about as much as its documents. Again only a
spanning forest of the links is returned.

Edge cases: null, empty or blank texts have an empty set and no links; texts with fewer words than
a shingle are one shingle; repeated rows are copies; an empty table gives no rows; further
columns are ignored, or kept on demand.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ROW_BITS, SPACED, blocks, dropped, looked_up, map_arrow, mix, partitions, ragged, seeds, utf8, words, written
from .graph import components


#: Members of a bucket, and documents and shingles of a block of a family, that meet in one task at most.
LARGE, DOCS, SHINGLES = 2048, 128, 1_000_000
#: Documents of a family of several blocks that come to each of them, at most.
PIVOTS = 8


@dataclass(frozen=True)
class Settings:
    """Links are pairs with 100 * intersection >= percent * union.

    bands of rows values, from bands * rows / 2 permutations: a pair at similarity s is missed with
    probability (1 - s ** rows) ** bands, 1e-10 at 0.85 and 5e-7 at 0.8. Pairs of a bucket that agree
    in less than percent / 100 - slack of the first ``values`` values aren't likely: at 0.85 and
    128 values, six standard deviations.
    """

    percent: int = 85
    shingle: int = 5
    bands: int = 48
    rows: int = 6
    values: int = 128
    slack: float = 0.19

    @property
    def permutations(self) -> int:
        return self.bands * self.rows // 2


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of rows of bytes, and where each row's begin (n + 1)."""
    h, _, _, first = words(data, offsets, SPACED)
    n = np.diff(first)
    k = seeds(width, 5)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(int(at[-1]), np.uint64)
    if len(h) >= width:
        rolled = np.zeros(len(h) - width + 1, np.uint64)
        for j in range(width):
            rolled += h[j : j + len(rolled)] * k[j]
        full = n >= width
        src = np.repeat(first[:-1][full] - at[:-1][full], count[full])
        dst = np.flatnonzero(np.repeat(full, count))
        out[dst] = mix(rolled[dst + src])
    for i in np.flatnonzero((n > 0) & (n < width)):
        w = h[first[i] : first[i + 1]]
        out[at[i]] = mix((w * k[: len(w)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(w)))[0]
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[at[:-1][count > 0]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return out[new], kept[at]


def signatures(sets: np.ndarray, at: np.ndarray, settings: Settings) -> np.ndarray:
    """Minimum and maximum of each permutation for each non-empty set: rows x values."""
    starts = at[:-1][np.diff(at) > 0]
    out = np.empty((len(starts), 2 * settings.permutations), np.uint64)
    if len(starts):
        for p, a in enumerate(seeds(settings.permutations, 11)):
            permuted = sets * a
            permuted ^= permuted >> np.uint64(32)
            out[:, 2 * p] = np.minimum.reduceat(permuted, starts)
            out[:, 2 * p + 1] = np.maximum.reduceat(permuted, starts)
    return out


def _signed(documents: DataFrame, settings: Settings, keep: tuple[str, ...]) -> DataFrame:
    """Row number, doc_id, set size, digest of the set, band keys, short signature, text and kept columns of each document."""
    k = seeds(settings.rows, 17)
    names = ["row", "doc_id", "n", "digest", "bands", "sketch", "text", "rest"]
    documents = documents.select("doc_id", "text", F.struct(*keep, F.lit(0).alias("__none")).alias("rest"))

    def sign(batches):
        part, row = TaskContext.get().partitionId() << ROW_BITS, 0
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in blocks(offsets):
                sets, at = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], settings.shingle)
                n = np.diff(at)
                some = np.flatnonzero(n)
                sig = signatures(sets, at, settings)
                digest, bands, sketch = [None] * (b - a), [None] * (b - a), [None] * (b - a)
                if len(some):
                    starts = at[:-1][some]
                    sums = np.stack([np.add.reduceat(mix(sets ^ np.uint64(s)), starts) for s in (0x51ED27, 0xA24BAED)], 1)
                    keys = np.zeros((len(some), settings.bands), np.uint64)
                    for j in range(settings.rows):
                        keys += sig[:, j :: settings.rows] * k[j]
                    keys = mix(keys + np.arange(settings.bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                    short = (mix(sig[:, : settings.values]) >> np.uint64(48)).astype("<u2")
                    for j, i in enumerate(some.tolist()):
                        digest[i], bands[i], sketch[i] = sums[j].tobytes(), keys[j], short[j].tobytes()
                rows = part + row + np.arange(b - a)
                row += b - a
                yield pa.record_batch([pa.array(rows), batch.column(0)[a:b], pa.array(n), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary()), batch.column(1)[a:b], batch.column(2)[a:b]], names)

    schema = T.StructType([T.StructField("row", T.LongType()), documents.schema["doc_id"], T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType()), T.StructField("text", T.StringType()), documents.schema["rest"]])
    return written(map_arrow(documents, sign, schema), compression="zstd")


def _joined(n: int, root: np.ndarray, candidates, linked):
    """Pairs (j, i), j < i, that join what was apart: a spanning forest of the links among n things.

    ``root`` names what is joined from the start. ``candidates(i)`` are those before i that it may be linked
    with, ``linked(i, js)`` tells which of some it is. One of each component is asked first, then
    only the others of components that i is still apart from.
    """
    out = []
    for i in range(1, n):
        js = candidates(i)
        js = js[root[js] != root[i]]
        if len(js) > 1:
            heads = js[np.unique(root[js], return_index=True)[1]]
            js = js[~np.isin(js, heads)]
        else:
            heads, js = js, js[:0]
        for part in (heads, js):
            part = part[root[part] != root[i]]
            if not len(part):
                continue
            for j in part[linked(i, part)].tolist():
                if root[j] != root[i]:
                    out.append((j, i))
                    root[root == root[j]] = root[i]
    return out


def _runs(batches, process):
    """Hand whole runs of equal first columns (sorted input) to ``process``, a table of several runs at a time."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1]))  # the last run may go on
        if cut or (held and held[-1].column(0)[0].as_py() != key[0]):
            held.append(batch.slice(0, cut))
            yield from process(pa.Table.from_batches(held).combine_chunks())
            held = []
        held.append(batch.slice(cut))
    if held:
        yield from process(pa.Table.from_batches(held).combine_chunks())


def _families(members: DataFrame, settings: Settings) -> DataFrame:
    """(key, row, n, sketch) by key to edges (a, b): a spanning forest of each bucket's likely pairs, whose pairs are never held together."""
    least = (settings.percent / 100 - settings.slack) * settings.values

    def process(t):
        if not t.num_rows:
            return
        key, row, n = (t.column(i).to_numpy() for i in range(3))
        sketch = np.frombuffer(b"".join(t.column(3).to_pylist()), "<u2").reshape(len(key), -1)
        cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        starts, sizes = cuts[:-1], np.diff(cuts)

        def likely(x, y):
            good = 100 * np.minimum(n[x], n[y]) >= settings.percent * np.maximum(n[x], n[y])
            return good & ((sketch[x] == sketch[y]).view(np.uint8).sum(1, dtype=np.uint8 if settings.values < 256 else np.int64) >= least)

        pairs = []
        for size in np.unique(sizes[(sizes > 1) & (sizes <= 8)]).tolist():  # small ones of a size together
            at = starts[sizes == size]
            for i in range(size):
                for j in range(i):
                    good = at[likely(at + j, at + i)]
                    pairs.append(np.stack([good + j, good + i], 1))
        for at, size in zip(starts[sizes > 8].tolist(), sizes[sizes > 8].tolist(), strict=True):
            found = _joined(size, np.arange(size), np.arange, lambda i, js, at=at: likely(at + js, at + i))
            pairs.append(np.array(found, np.int64).reshape(-1, 2) + at)
        pairs = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
        if len(pairs):
            ends = np.unique(np.sort(row[pairs], 1), axis=0)
            yield pa.record_batch([pa.array(np.ascontiguousarray(ends[:, i])) for i in range(2)], ["a", "b"])

    return map_arrow(members.repartition(partitions(members.sparkSession), "key").sortWithinPartitions("key"), lambda batches: _runs(batches, process), "a long, b long")


def _linked(groups: DataFrame, settings: Settings) -> DataFrame:
    """(gid, side, label, row, text) by gid to links (a, b) of labels: a spanning forest of each group's exact links.

    Rows of one label are joined from the start. Sides below 1 are compared with each other, else side 2 with side 1.
    """

    def process(t):
        gid, side, label = (t.column(i).to_numpy() for i in range(3))
        text = t.column(4)
        data, offsets = utf8(text.chunk(0) if isinstance(text, pa.ChunkedArray) else text)
        sets, at = [], [0]
        for a, b in blocks(offsets):
            s, first = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], settings.shingle)
            sets.append(s)
            at += (first[1:] + at[-1]).tolist()
        sets, at = np.concatenate(sets), np.array(at)
        cuts = np.flatnonzero(np.concatenate([[True], gid[1:] != gid[:-1], [True]]))
        out = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            ids = np.unique(sets[at[a] : at[b]], return_inverse=True)[1]
            first, n = at[a:b] - at[a], np.diff(at[a : b + 1])
            flag, split = np.zeros(int(ids.max(initial=0)) + 1, bool), int(np.searchsorted(side[a:b], 2))

            def candidates(i, n=n, split=split, mixed=side[a] < 1):
                js = np.arange(i if mixed else split if i >= split else 0)
                return js[100 * np.minimum(n[js], n[i]) >= settings.percent * np.maximum(n[js], n[i])]

            def linked(i, js, ids=ids, first=first, n=n, flag=flag):
                mine = ids[first[i] : first[i] + n[i]]
                flag[mine] = True
                edges = np.cumsum(n[js]) - n[js]
                common = np.add.reduceat(flag[ids[ragged(first[js], n[js])]], edges, dtype=np.int64)
                flag[mine] = False
                return 100 * common >= settings.percent * (n[i] + n[js] - common)

            root = np.unique(label[a:b], return_inverse=True)[1]
            out += [(label[a + j], label[a + i]) for j, i in _joined(b - a, root, candidates, linked)]
        if out:
            x, y = np.array(out).T
            yield pa.record_batch([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    many = partitions(groups.sparkSession)
    return map_arrow(groups.repartition(many, "gid").sortWithinPartitions("gid", "side", "row"), lambda batches: _runs(batches, process), "a long, b long")


def _parts() -> F.Column:
    """How many blocks the rows (n) of a group make."""
    return F.greatest(F.ceil(F.count(F.lit(1)) / DOCS), F.ceil(F.sum("n") / SHINGLES)).cast("int")


def _block(parts: str) -> F.Column:
    return F.pmod(F.xxhash64("row"), F.col(parts)).cast("int")


#: What tells a group of blocks that meet; of one of the blocks there may be none: it is each of the first ``many``.
_GROUP = ("comp", "cls", "block", "cls2", "block2")
_NONE = "cast(null as int)"


def _grouped(rows: DataFrame) -> DataFrame:
    """(comp, row, n, parts) to groups: each block of a family, with the family's pivots."""
    few = F.least(F.lit(PIVOTS), F.greatest(F.lit(1), F.floor(SHINGLES / 4 / F.col("n"))))
    nth = F.row_number().over(Window.partitionBy("comp").orderBy(F.xxhash64("row", F.lit(3)), "row"))
    ranked = rows.where("parts > 1").withColumn("nth", nth).where(F.col("nth") <= PIVOTS)
    pivots = ranked.where(F.col("nth") <= few).withColumns({"side": F.lit(-1), "block": F.expr(_NONE), "many": F.col("parts")})
    own = rows.withColumns({"side": F.lit(0), "block": _block("parts"), "many": F.lit(1)})
    zero = {"cls": F.lit(0).cast("long"), "cls2": F.lit(0).cast("long"), "block2": F.lit(0), "label": F.col("row")}
    return pivots.drop("nth").unionByName(own).withColumns(zero).select("row", "label", "side", *_GROUP, "many")


def _regrouped(rows: DataFrame, settings: Settings) -> DataFrame:
    """(comp, row, n, label) of families of several blocks to groups: what isn't in its family's largest component, with all else.

    Sizes are dealt into classes; linked sets are of one class or of neighbours.
    """
    sizes = rows.groupBy("comp", "label").agg(F.count(F.lit(1)).alias("size"))
    main = sizes.groupBy("comp").agg(F.max(F.struct("size", "label"))["label"].alias("main"))
    wide = float(np.log(100 / settings.percent) * (1 + 1e-9)) if settings.percent < 100 else 1e-9
    rows = rows.join(main, "comp").withColumn("cls", F.floor(F.log("n") / wide))

    def dealt(x: DataFrame) -> tuple[DataFrame, DataFrame]:
        blocks = x.groupBy("comp", "cls").agg(_parts().alias("parts"))
        return x.join(blocks, ["comp", "cls"]).withColumn("own", _block("parts")).drop("parts"), blocks.select("comp", F.col("cls").alias("other"), F.col("parts").alias("many"))

    (few, few_blocks), (every, every_blocks) = dealt(rows.where("label <> main")), dealt(rows)
    near = F.abs(F.col("cls") - F.col("other")) <= 1
    few = few.join(every_blocks, "comp").where(near).select("row", "label", F.lit(1).alias("side"), "comp", "cls", F.col("own").alias("block"), F.col("other").alias("cls2"), F.expr(_NONE).alias("block2"), "many")
    every = every.join(few_blocks, "comp").where(near).select("row", "label", F.lit(2).alias("side"), "comp", F.col("other").alias("cls"), F.expr(_NONE).alias("block"), F.col("cls").alias("cls2"), F.col("own").alias("block2"), "many")
    return few.unionByName(every)


def _measured(signed: DataFrame, groups: DataFrame, settings: Settings) -> DataFrame:
    """Groups to (node, comp) of labels by exact links within them."""
    texts = looked_up(signed.select("row", "text"), groups).withColumn("nth", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
    whole = {c: F.coalesce(c, "nth") for c in ("block", "block2")}
    return components(_linked(texts.withColumns(whole).select(F.xxhash64(*_GROUP).alias("gid"), "side", "label", "row", "text"), settings))


def _confirmed(signed: DataFrame, families: DataFrame, sizes: DataFrame, settings: Settings) -> DataFrame:
    """(node, comp) of families and (row, n) to (node, comp) of exact components."""
    rows = families.select(F.col("node").alias("row"), "comp").hint("merge").join(sizes, "row")
    rows = written(rows.join(rows.groupBy("comp").agg(_parts().alias("parts")), "comp"))
    labels = _measured(signed, _grouped(rows), settings)
    large = rows.where("parts > 1").select("comp", "row", "n").hint("merge").join(labels.select(F.col("node").alias("row"), F.col("comp").alias("label")), "row", "left")
    large = written(large.withColumn("label", F.coalesce("label", "row")))
    if not large.isEmpty():
        more = _measured(signed, _regrouped(large, settings), settings).select(F.col("node").alias("comp"), F.col("comp").alias("top"))
        single = more.join(labels.select("comp"), "comp", "left_anti").select(F.col("comp").alias("node"), F.col("top").alias("comp"))
        labels = written(labels.join(more, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp")).unionByName(single))
    dropped(rows, large)
    return labels


def near_duplicates(documents: DataFrame, settings: Settings = Settings(), keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text) to (doc_id, n_shingles, component_id, first[, text and kept columns]): a row for each document.

    component_id is the smallest doc_id reachable over links. ``first`` is true for one row of each
    component, also where doc_ids repeat, and for rows with an empty set.

    Joins of sides that both grow with the documents are hinted to sort-merge, which splits hot keys. Texts
    are never joined: narrow tables of what to do with them come to where they lie.
    """
    signed = _signed(documents, settings, keep)
    classes = written(signed.where("n > 0").groupBy("digest").agg(F.min("row").alias("rep"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least")))
    reps = signed.select("row", "n", "sketch", "bands").hint("merge").join(classes.select(F.col("rep").alias("row")), "row", "left_semi")
    reps = written(reps, compression="none")

    banded = reps.select("row", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("row").alias("lowest")).where("size > 1")
    members = written(banded.hint("merge").join(shared, "key"))
    few = members.where(F.col("size") <= LARGE).select("key", "row").hint("merge").join(reps.select("row", "n", "sketch"), "row").select("key", "row", "n", "sketch")
    many = members.where((F.col("size") > LARGE) & (F.col("row") != F.col("lowest"))).select(F.col("lowest").alias("a"), F.col("row").alias("b"))
    families = components(_families(few, settings).union(many))
    dropped(members)
    labels = _confirmed(signed, families, reps.select("row", "n"), settings)
    dropped(reps, families)

    named = classes.select(F.col("rep").alias("node"), "least").join(labels, "node")
    named = named.join(named.groupBy("comp").agg(F.min("least").alias("lowest")), "comp").select(F.col("node").alias("rep"), "lowest")
    named = written(classes.join(named, "rep", "left").select("digest", F.coalesce("lowest", "least").alias("lowest")))
    dropped(classes, labels)
    rows = signed.select("row", "doc_id", "n", "digest").hint("merge").join(named, "digest", "left")
    rows = rows.select("row", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("lowest.doc_id", "doc_id").alias("component_id"), F.coalesce(F.col("lowest.row") == F.col("row"), F.lit(True)).alias("first"))
    if not keep:
        return rows.drop("row")
    whole = looked_up(signed.select("row", "text", "rest"), rows)
    return whole.select("doc_id", "n_shingles", "component_id", "first", "text", *(F.col("rest")[c].alias(c) for c in keep))


def op5_minmax_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at a similarity of 0.85."""
    rows = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
