"""What the corpus operators share: the shared folder, Arrow passes, byte-level words."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

# ---------------------------------------------------------------- shared folder

#: Folders made within each open ``scope``, innermost last.
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent, a local folder is made in local mode; on a cluster that is an error.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not base:
        base = getattr(context, "_basaltine_shared", None)
        if base is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = "file://" + tempfile.mkdtemp(prefix="basaltine-")
            context._basaltine_shared = base
    path = f"{base.rstrip('/')}/basaltine-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextmanager
def scope(spark: SparkSession):
    """Shared folders made within are deleted at the end; nothing that reads them may go on."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove(spark, path)


def written(df: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends, the rows outlive executors."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.folder_written = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete the folders of tables that ``written`` returned and that nothing reads any more."""
    for t in tables:
        remove(t.sparkSession, t.folder_written)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


_kept: dict[str, object] = {}


def kept(name: str, make: Callable):
    """What a worker process keeps from task to task; one thing at a time."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


def _lean(fn: Callable, keep: bool) -> Callable:
    def run(batches):
        if not keep and _kept:  # an earlier task of another kind left it
            _kept.clear()
            pa.default_memory_pool().release_unused()
        return fn(batches)

    return run


def map_arrow(df: DataFrame, fn: Callable, schema, keep: bool = False) -> DataFrame:
    """mapInArrow whose workers have this package; with ``keep`` they keep what ``kept`` holds."""
    _ship(df.sparkSession.sparkContext)
    return df.mapInArrow(_lean(fn, keep), schema)


def _ship(context) -> None:
    """Send this package's modules to the workers, once for a context."""
    if getattr(context, "_basaltine_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="basaltine-modules-")  # the driver's own, from which it serves the file
    atexit.register(shutil.rmtree, folder, True)
    path, above = os.path.join(folder, "basaltine_modules.zip"), os.path.dirname(PACKAGE)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, names in sorted(os.walk(PACKAGE)):
            for name in sorted(names):
                if name.endswith(".py"):
                    z.write(os.path.join(at, name), os.path.relpath(os.path.join(at, name), above))
    context.addPyFile(path)
    context._basaltine_shipped = True


def chosen(key: str, share: float | Column) -> Column:
    """Whether a row is in a sample of a share of all rows, by a hash of its key; the sample is bounded by expectation."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 40)) < F.ceil(F.lit(share) * (1 << 40) if isinstance(share, float) else share * (1 << 40))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A row number is the task that wrote the row, shifted by these bits, and its place in the task's output.
ROW_BITS = 40
#: Bytes of rows that a lookup puts out at once.
_OUT = 8 << 20


def looked_up(table: DataFrame, side: DataFrame) -> DataFrame:
    """Inner join of a written ``table`` (row first) with a narrow ``side`` (row first, further columns), without a shuffle of the table.

    The side is dealt to the table's parts and written, a folder for each; each task of the table reads the
    folders of the parts it meets, one at a time, in the shared folder. So what travels is the side alone.
    """
    spark = table.sparkSession
    folder = shared_dir(spark)
    part = F.shiftright("row", ROW_BITS).alias("__part")
    side.select("*", part).repartition(partitions(spark), "__part").sortWithinPartitions("__part", "row").write.partitionBy("__part").parquet(folder)
    names = [*side.columns, *table.columns[1:]]

    def beside(root, files, k: int) -> pa.Table | None:
        found = files.get_file_info(fs.FileSelector(f"{root}/__part={k}", allow_not_found=True))
        parts = [pq.read_table(files.open_input_file(f.path)) for f in found if f.base_name[0] not in "._"]
        return pa.concat_tables(parts).sort_by("row").combine_chunks() if parts else None

    types = [f for f in side.schema] + [f for f in table.schema][1:]

    def run(batches):
        files, root = fs.FileSystem.from_uri(folder)
        at, here, rows = -1, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(0).to_numpy()
            of = own >> ROW_BITS
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if of[a] != at:
                    at = int(of[a])
                    here = beside(root, files, at)
                    rows = here and here.column(0).to_numpy()
                if here is None:
                    continue
                low = np.searchsorted(rows, own[a:b])
                many = np.searchsorted(rows, own[a:b], "right") - low
                left, right = ragged(low, many), a + np.repeat(np.arange(b - a), many)
                step = max(1, _OUT * batch.num_rows // max(1, batch.nbytes))
                for x in range(0, len(left), step):
                    mine, theirs = here.take(pa.array(left[x : x + step])).combine_chunks(), batch.take(pa.array(right[x : x + step]))
                    yield pa.record_batch([c.chunk(0) for c in mine.columns] + theirs.columns[1:], names)

    return map_arrow(table, run, T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, types, strict=True)]))


# ---------------------------------------------------------------- text as bytes


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets (n + 1) of a string column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n, at = len(column), column.offset
    _, off, data = column.buffers()
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(off, np.int64, n + 1, at * 8)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, size: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes; one long row is a range of its own."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, min(to, n)
        at = to


def table(word: Iterable[int]) -> np.ndarray:
    """For each byte 0, or a positive value where it belongs to words; A-Z count as a-z."""
    out = np.zeros(256, np.uint64)
    for b in word:
        out[b] = (b + 32 if 65 <= b <= 90 else b) + 1
    return out


#: Words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
ALNUM = table([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: Words of [^\x20\x09-\x0D]+ after lower-casing A-Z.
SPACED = table([b for b in range(256) if b != 0x20 and not 9 <= b <= 13])
#: Runs of ASCII letters and bytes beyond ASCII.
LETTERS = table([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, 1 << 20)
        _powers[:] = [np.cumprod(np.full(n, np.uint64(b), np.uint64)) for b in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, each bit depending on all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _segment(data: np.ndarray, edges: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    value = lut[data]
    inside = value != 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    first[edges] = inside[edges]
    before = edges[edges > 0] - 1
    last[before] = inside[before]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _power(len(data))
    value *= up[: len(data)]
    np.cumsum(value, out=value)
    h = value[ends - 1]
    later = starts > 0
    h[later] -= value[starts[later] - 1]
    h *= down[starts]
    return mix(h), starts, ends


def words(data: np.ndarray, offsets: np.ndarray, lut: np.ndarray, step: int = 4 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of rows of bytes: 64-bit hashes, first and end byte (in data), and for each row its first word (n + 1).

    Works in segments of about ``step`` bytes that end between words.
    """
    parts, at, n = [], 0, len(data)
    edges = offsets[:-1][offsets[1:] > offsets[:-1]]
    while at < n:
        to = min(n, at + step)
        if to < n:
            gaps = np.flatnonzero(lut[data[at:to]] == 0)
            while not len(gaps) and to < n:  # one word longer than a segment
                to = min(n, to + step)
                gaps = np.flatnonzero(lut[data[at:to]] == 0)
            if to < n:
                to = at + int(gaps[-1]) + 1
        h, a, b = _segment(data[at:to], edges[np.searchsorted(edges, at) : np.searchsorted(edges, to)] - at, lut)
        parts.append((h, a + at, b + at))
        at = to
    if not parts:
        e = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), e, e, np.zeros(len(offsets), np.int64)
    h, starts, ends = parts[0] if len(parts) == 1 else (np.concatenate(x) for x in zip(*parts, strict=True))
    return h, starts, ends, np.searchsorted(starts, offsets).astype(np.int64)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges start, start + 1, ... of given lengths."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    at = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - at, lengths)


def seeds(n: int, salt: int) -> np.ndarray:
    """n odd 64-bit constants."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)) | np.uint64(1)
