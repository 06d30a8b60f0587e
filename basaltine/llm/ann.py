"""Approximate nearest neighbours by additive quantisation.

A vector is approximated by the sum of one code from each of several full-dimensional
codebooks. Codebooks start as residual k-means and are then solved together by least squares on
beam-search encodings of a bounded sample. The index stores the codes, the squared norm of the
approximation and the vector, dealt into buckets of a bounded number of rows by a hash of the id. A search
scores all distinct vectors by lookup tables (norm minus twice the sum of a query's products with the codes),
and measures the best of every bucket exactly, or all vectors on demand. Equal vectors of a bucket are
one candidate, which stands for its smallest ids, and all vectors that score as the last
candidate does are candidates too, so no tie is cut.

Queries are a table of blocks in the shared folder. The index is read once: a task holds a bounded number of
its rows, reads block after block of queries, and returns at most k rows for a query. Neither
vectors nor queries come to the driver, apart from the sample.

Edge cases: vectors that are null, zero, hold null or non-finite components, or don't have the most
frequent length take no part; a query doesn't find rows of its own id; equal distances go to the
smaller id; with fewer candidates than k all are returned; components beyond 1e15 count as that in codes and
tables, never in distances; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chosen, map_arrow, shared_dir, written

#: Vectors that codebooks are fitted on, queries of a block and rows of a bucket, at most (by expectation of a hash).
SAMPLE, BLOCK, BUCKET = 8192, 1024, 8192
#: Bytes of index rows that a task holds.
HOLD = 64 << 20


def _single(x: np.ndarray) -> np.ndarray:
    """Single precision, within what squares and sums of it can hold."""
    return np.clip(x, -1e15, 1e15).astype(np.float32)


def solved_near(a: np.ndarray, b: np.ndarray, x: np.ndarray, turns: int = 200, gap: float = 1e-5) -> np.ndarray:
    """a @ x = b for symmetric positive definite a by conjugate gradients from a start, scaled by the diagonal.

    In products alone: LAPACK's threads may hang beside a JVM.
    """
    scale = 1 / np.diag(a)[:, None]
    x = x.astype(np.float64)
    rest = b - a @ x
    way = scale * rest
    size = (rest * way).sum(0)
    for _ in range(turns):
        if (rest**2).sum() <= gap**2 * (b**2).sum():
            break
        along = a @ way
        step = size / np.maximum((way * along).sum(0), 1e-300)
        x += step * way
        rest -= step * along
        new = (rest * (scale * rest)).sum(0)
        way = scale * rest + new / np.maximum(size, 1e-300) * way
        size = new
    return x


class Quantiser:
    """Codebooks (books x codes x dimension) and beam-search encoding."""

    def __init__(self, codebooks: np.ndarray):
        self.codebooks = codebooks.astype(np.float32)
        self.norms = (self.codebooks**2).sum(-1)

    @classmethod
    def fit(cls, x: np.ndarray, books: int = 8, codes: int = 256, turns: int = 6, refine: int = 2, beam: int = 4, seed: int = 7) -> Quantiser:
        x = _single(x)
        codes = max(1, min(codes, len(x)))
        rng, rest, out = np.random.default_rng(seed), x.copy(), []
        for _ in range(books):
            c = rest[rng.choice(len(rest), codes, replace=False)].copy()
            for _ in range(turns):
                near = ((c**2).sum(1) - 2 * rest @ c.T).argmin(1)
                size = np.bincount(near, minlength=codes)
                total = np.zeros_like(c)
                np.add.at(total, near, rest)
                c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
            near = ((c**2).sum(1) - 2 * rest @ c.T).argmin(1)
            rest -= c[near]
            out.append(c)
        q = cls(np.stack(out))
        for _ in range(refine):  # all codebooks at once, given the codes
            at = q.encode(x, beam).astype(np.int64) + np.arange(books) * codes
            size = books * codes
            gram, right = np.zeros((size, size)), np.zeros((size, x.shape[1]))
            for i in range(books):
                np.add.at(right, at[:, i], x)
                for j in range(books):
                    np.add.at(gram, (at[:, i], at[:, j]), 1)
            solved = solved_near(gram + 0.1 * np.eye(size), right + 0.1 * q.codebooks.reshape(size, -1), q.codebooks.reshape(size, -1))
            q = cls(solved.reshape(books, codes, -1))
        return q

    def encode(self, x: np.ndarray, beam: int = 8, block: int = 512) -> np.ndarray:
        """Codes by beam search: each step keeps the best sums of one more codebook."""
        out = np.zeros((len(x), len(self.codebooks)), np.uint8)
        for a in range(0, len(x), block):
            rest = _single(x[a : a + block, None, :])
            n = len(rest)
            error = (rest**2).sum(-1)
            path = np.zeros((n, 1, 0), np.uint8)
            for book, norm in zip(self.codebooks, self.norms, strict=True):
                score = (error[:, :, None] - 2 * rest @ book.T + norm).reshape(n, -1)
                keep = min(beam, score.shape[1])
                best = np.argpartition(score, keep - 1, axis=1)[:, :keep]
                error = np.take_along_axis(score, best, 1)
                before, code = best // len(book), best % len(book)
                rest = np.take_along_axis(rest, before[:, :, None], 1) - book[code]
                path = np.concatenate([np.take_along_axis(path, before[:, :, None], 1), code[:, :, None].astype(np.uint8)], 2)
            out[a : a + block] = path[np.arange(n), error.argmin(1)]
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(book[codes[:, j]] for j, book in enumerate(self.codebooks))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, embedding) that take part, and their length."""
    rows = vectors.select("vec_id", "embedding").where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    )
    common = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = common["n"] if common else 0
    return rows.where(F.size("embedding") == dim), dim


def build(vectors: DataFrame, books: int = 8, beam: int = 8) -> tuple[DataFrame, Quantiser | None, int]:
    """The index (bucket, vec_id, codes, norm, embedding) of all rows that take part, written to the shared folder."""
    rows, dim = usable(vectors)
    many = rows.count()
    sample = rows.where(chosen("vec_id", min(1.0, SAMPLE / max(1, many)))).orderBy("vec_id").select("embedding").toArrow()
    buckets = max(1, -(-many // BUCKET))
    bucket = F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(buckets)).cast("int").alias("bucket")
    if not sample.num_rows:
        return written(rows.select(bucket, "vec_id", F.lit(None).cast("binary").alias("codes"), F.lit(0.0).cast("float").alias("norm"), "embedding")), None, dim
    fitted = rows.sparkSession.sparkContext.broadcast(Quantiser.fit(_matrix(sample.column(0).combine_chunks(), dim), books, beam=beam))
    names = ["bucket", "vec_id", "codes", "norm", "embedding"]

    def encode(batches):
        q = fitted.value
        for batch in batches:
            codes = q.encode(_matrix(batch.column(2), dim), beam)
            norm = (q.decode(codes) ** 2).sum(1).astype(np.float32)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm), batch.column(2)], names)

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("vec_id", "embedding")}
    dealt = rows.select(bucket, "vec_id", "embedding").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    index = map_arrow(dealt, encode, f"bucket int, vec_id {kinds['vec_id']}, codes binary, norm float, embedding {kinds['embedding']}")
    return written(index), fitted.value, dim


def search(index: DataFrame, quantiser: Quantiser | None, dim: int, queries: DataFrame, k: int = 10, rerank: int | None = 768) -> DataFrame:
    """(vec_id, embedding) queries to (query_id, rank, vec_id, score): the k nearest found.

    Of every bucket of the index, each query's best ``rerank`` distinct vectors by lookup tables, and
    those that tie with the last, are measured exactly; all of them if ``rerank`` is None.
    """
    spark = index.sparkSession
    if quantiser is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    folder = shared_dir(spark)
    parts = max(1, -(-queries.count() // BLOCK))
    block = F.pmod(F.xxhash64("vec_id", F.lit(9)), F.lit(parts)).cast("int").alias("block")
    queries.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", block).repartition(parts, "block").sortWithinPartitions("block").write.partitionBy("block").parquet(folder)
    found = map_arrow(index.select("bucket", F.col("vec_id").cast("long").alias("vec_id"), "codes", "norm", "embedding"), _scan(spark.sparkContext.broadcast(quantiser), folder, dim, k, rerank), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _asked(folder: str, dim: int):
    """Blocks of queries (ids, vectors) from the shared folder, one at a time."""
    files, root = fs.FileSystem.from_uri(folder)
    found = files.get_file_info(fs.FileSelector(root, recursive=True))
    for path in sorted(f.path for f in found if f.path.endswith(".parquet")):
        t = pq.read_table(files.open_input_file(path), columns=["vec_id", "embedding"]).combine_chunks()
        if t.num_rows:
            yield t.column(0).to_numpy(), _matrix(t.column(1).chunk(0), dim)


def distances(vectors: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, also where squares overflow."""
    with np.errstate(over="ignore"):
        apart = vectors - x
        out = np.sqrt((apart**2).sum(1))
    for i in np.flatnonzero(np.isinf(out)):
        half = np.abs(vectors[i] / 2 - x / 2)
        out[i] = half.max() * np.sqrt(((half / half.max()) ** 2).sum()) * 2
    return out


def _classes(vectors: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows sorted by distinct vector and then id, the first of each vector (n + 1), and each row's vector."""
    whole = np.ascontiguousarray(vectors + 0.0)  # -0.0 equals 0.0
    _, kind = np.unique(whole.view(np.dtype((np.void, whole.itemsize * whole.shape[1]))).ravel(), return_inverse=True)
    rows = np.lexsort((ids, kind))
    return rows, np.searchsorted(kind[rows], np.arange(kind.max() + 2)), kind


class _Bucket:
    """Rows of one bucket, by distinct vector."""

    def __init__(self, rows: pa.RecordBatch | pa.Table, books: int, dim: int):
        self.own, self.vectors = rows.column(1).to_numpy(), _matrix(rows.column(4), dim)
        self.rows, self.first, self.kind = _classes(self.vectors, self.own)
        self.head, self.size = self.rows[self.first[:-1]], np.diff(self.first)
        self.code = np.frombuffer(b"".join(rows.column(2).to_pylist()), np.uint8).reshape(-1, books)[self.head]
        self.norm = rows.column(3).to_numpy()[self.head]

    def nearest(self, ids: np.ndarray, x: np.ndarray, lut: np.ndarray, k: int, rerank: int | None) -> tuple[np.ndarray, np.ndarray]:
        """For each query (a row) up to k ids and their distances; what is missing is at an infinite distance."""
        score = np.broadcast_to(self.norm, (len(ids), len(self.head))).copy()
        for m in range(len(lut)):
            score -= 2 * lut[m][:, self.code[:, m]]
        at, row = np.nonzero(ids[:, None] == self.own)
        same = np.zeros(score.shape, np.int32)  # rows of the query's own id among each vector's
        np.add.at(same, (at, self.kind[row]), 1)
        score[same == self.size] = np.inf
        keep = len(self.head) if rerank is None else min(rerank, len(self.head))
        last = np.partition(score, keep - 1, axis=1)[:, keep - 1]
        cand, dists = np.zeros((len(ids), k), np.int64), np.full((len(ids), k), np.inf)
        for i in range(len(ids)):
            best = np.flatnonzero((score[i] <= last[i]) & (score[i] < np.inf))
            dist = distances(self.vectors[self.head[best]], x[i])
            if len(best) > k + 1:  # beyond the k nearest other vectors, of which one may be the query's own
                near = dist <= np.partition(dist, k)[k]
                best, dist = best[near], dist[near]
            many = np.minimum(self.size[best], k + same[i, best])
            place = np.arange(many.sum()) + np.repeat(self.first[best] - np.cumsum(many) + many, many)
            found, dist = self.own[self.rows[place]], np.repeat(dist, many)
            other = found != ids[i]
            found, dist = found[other], dist[other]
            order = np.lexsort((found, dist))[:k]
            cand[i, : len(order)], dists[i, : len(order)] = found[order], dist[order]
        return cand, dists


def _scan(quantiser, folder: str, dim: int, k: int, rerank: int | None):
    def answers(held: list[pa.RecordBatch], q: Quantiser):
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        of = rows.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
        buckets = [_Bucket(rows.slice(a, b - a), len(q.codebooks), dim) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for ids, x in _asked(folder, dim):
            lut = np.einsum("qd,mkd->mqk", _single(x), q.codebooks, optimize=True)
            near, far = np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0))
            for bucket in buckets:
                found = [bucket.nearest(ids[b : b + 128], x[b : b + 128], lut[:, b : b + 128], k, rerank) for b in range(0, len(ids), 128)]
                near, far = (np.concatenate([old, np.concatenate(new)], 1) for old, new in zip((near, far), zip(*found, strict=True), strict=True))
                order = np.lexsort((near, far), axis=1)[:, :k]
                near, far = np.take_along_axis(near, order, 1), np.take_along_axis(far, order, 1)
            some = np.isfinite(far)
            if some.any():
                yield pa.record_batch([pa.array(np.repeat(ids, some.sum(1))), pa.array(near[some]), pa.array(far[some])], ["query_id", "vec_id", "score"])

    def scan(batches):
        q, held, size = quantiser.value, [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= HOLD:
                yield from answers(held, q)
                held, size = [], 0
        if held:
            yield from answers(held, q)

    return scan


def op10_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every hundredth vector, of all vectors."""
    index, quantiser, dim = build(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return search(index, quantiser, dim, index.where(F.col("vec_id") % 100 == 0))
