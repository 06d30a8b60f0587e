"""Token ids in sorted Parquet files with chosen encodings, row groups and page indexes.

``encode`` turns texts into ids, ``write_tokens`` lays them out by ascending document, and
``read_tokens`` reads them back, all of them or only chosen columns and id ranges.

Edge cases: a null or empty text has only the end id; a null doc_id sorts first; repeated
doc_ids stay separate rows, ordered by a hash of their text; an empty table gives an empty
file set; further columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, map_arrow, partitions, shared_dir

# The split of the word-level vocabulary, for texts within Latin-1.
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\\sa-zªµºß-öø-ÿ0-9²³¹¼-¾]+")
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN = re.compile("[\x21-\x7e\xa1-\xff]*")
_PLAIN_TEXT = re.compile("[\t-\r\x20-\x7e\x85\xa0-\xff]*")
# White space of the tokenizers' library, which lacks \x1c-\x1f of str.split().
_WHITE = re.compile("[\t-\r \x85\xa0  -     　]+")
_ODD = re.compile("[\x1c-\x1f]")
#: Length of a cached run, and cached runs and pre-tokens, at most. The caches are a worker's largest memory.
_LONGEST, _RUNS, _WORDS = 48, 100_000, 400_000


def _byte_chars() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies: bytes that print are themselves, the rest follow 255."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Pieces(dict):
    """Ids of a pre-token, from the library's BPE model; the cache stops growing at a bound."""

    def __init__(self, model):
        self.model, self.chars = model, _byte_chars()

    def __missing__(self, piece: str) -> bytes:
        word = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.chars)
        ids = [t.id for t in self.model.tokenize(word)]
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) < _WORDS and len(piece) <= _LONGEST:
            self[piece] = out
        return out


class _Chunks(dict):
    """Ids of a run without white space."""

    def __init__(self, tokenizer):
        self.tokenizer, self.pieces = tokenizer, _Pieces(tokenizer.model)
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def special(self, text: str) -> bool:
        return "<" in text and any(t in text for t in self.added)

    def plain(self, text: str) -> bytes:
        """Of a text within Latin-1 without added tokens; its pieces hold no white space, so it may have several runs."""
        return b"".join(map(self.pieces.__getitem__, _PIECES.findall(text.lower())))

    def __missing__(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk[:-1].isalpha() and chunk.isprintable():  # letters, and perhaps one mark or digit
            out = self.pieces[chunk.lower()] if chunk.isalpha() else self.pieces[chunk[:-1].lower()] + self.pieces[chunk[-1]]
        elif _PLAIN.fullmatch(chunk) and not self.special(chunk):
            out = self.plain(chunk)
        else:
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) < _RUNS and len(chunk) <= _LONGEST:
            self[chunk] = out
        return out


class Encoder:
    """Exactly the library's ids, as little-endian unsigned 32-bit bytes.

    A vocabulary that drops white space and splits words by the pattern above encodes each
    piece of a text within Latin-1 by itself, so pieces are looked up in a cache; of other texts
    each run without white space is. Any other vocabulary encodes whole texts.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        norm = spec.get("normalizer") or {}
        kinds = [x.get("type") for x in norm.get("normalizers", [])]
        split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        by_run = kinds == ["NFC", "Replace", "Lowercase"] and split.get("pattern", {}).get("Regex") == _SPLIT and split.get("behavior") == "Removed" and not spec.get("post_processor")
        # Runs are looked at for added tokens only where they hold a "<".
        by_run &= all("<" in t.content and not _WHITE.search(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.chunks = _Chunks(self.tokenizer) if by_run else None

    def __call__(self, text: str) -> bytes:
        if self.chunks is None:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        if _PLAIN_TEXT.fullmatch(text) and not self.chunks.special(text):
            return self.chunks.plain(text)
        runs = [x for x in _WHITE.split(text) if x] if _ODD.search(text) else text.split()
        return b"".join(map(self.chunks.__getitem__, runs))


def encoder(path: str) -> Encoder:
    """One per worker process, until it does other work."""
    return kept(f"encoder {path}", lambda: Encoder(path))


def id_lists(parts: list[bytes]) -> pa.ListArray:
    """A list column from little-endian 32-bit ids."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(x) // 4 for x in parts], out=offsets[1:])
    values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(parts))])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def list_bytes(column: pa.Array) -> list[memoryview]:
    """The ids of each row as bytes, without a copy."""
    offsets = np.asarray(column.offsets)
    values = column.values.fill_null(0) if column.values.null_count else column.values
    raw = memoryview(np.ascontiguousarray(np.asarray(values, dtype="<i4"))).cast("B") if len(values) else memoryview(b"")
    return [raw[4 * a : 4 * b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


#: Bytes of ids in one Arrow batch, and of a table that make one file, where that gives more files than shuffle partitions.
BATCH, FILE = 16 << 20, 64 << 20


@dataclass(frozen=True)
class Layout:
    """How the files are written.

    encoding: ``dictionary`` (dictionary pages, ids bit-packed) or ``delta`` (DELTA_BINARY_PACKED).
    row_group: bytes of a row group; page: bytes of a data page, the unit that the page index skips.
    """

    encoding: str = "dictionary"
    row_group: int = 32 << 20
    page: int = 128 << 10
    codec: str = "zstd"

    def options(self) -> dict[str, str]:
        if self.encoding not in ("dictionary", "delta"):
            raise ValueError(f"unknown encoding {self.encoding!r}")
        return {
            "parquet.enable.dictionary": str(self.encoding == "dictionary").lower(),
            "parquet.writer.version": "PARQUET_2_0",
            "parquet.block.size": str(self.row_group),
            "parquet.page.size": str(self.page),
            "parquet.dictionary.page.size": str(1 << 20),
            "parquet.page.row.count.limit": "2000",
            "compression": self.codec,
        }


def write_tokens(documents: DataFrame, path: str, tokenizer: str, end_id: int = 2, layout: Layout = Layout(), files: int | None = None) -> str:
    """Encode documents (doc_id, text) and write them in ascending doc_id order.

    The text is dealt out by doc_id range once; each task sorts, encodes and writes one file. Rows are
    (part, doc_id, local_start, n_tokens, ids); beside them ``manifest`` has each file's number of
    ids before it, a row for each file.
    """
    spark = documents.sparkSession
    if files is None:
        size = int(documents._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        files = max(partitions(spark), -(-size // FILE) if size < 1 << 60 else 1)  # beyond, it isn't known
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange(files, F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def encode(batches):
        enc, end, part, at = encoder(tokenizer), struct.pack("<I", end_id), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, docs, size, texts = [], [], 0, batch.column(1)
            for i, doc in enumerate(batch.column(0).to_pylist()):
                docs.append(doc)
                ids.append(enc(texts[i].as_py()) + end)
                size += len(ids[-1])
                if size >= BATCH or i + 1 == batch.num_rows:
                    n = np.array([len(x) // 4 for x in ids], np.int64)
                    starts = at + np.cumsum(n) - n
                    at += int(n.sum())
                    yield pa.record_batch([pa.array(np.full(len(n), part, np.int32)), pa.array(docs, batch.schema.field(0).type), pa.array(starts), pa.array(n), id_lists(ids)], ["part", "doc_id", "local_start", "n_tokens", "ids"])
                    ids, docs, size = [], [], 0

    kind = documents.schema["doc_id"].dataType.simpleString()
    map_arrow(rows, encode, f"part int, doc_id {kind}, local_start long, n_tokens long, ids array<int>", keep=True).write.options(**layout.options()).parquet(f"{path}/ids")
    # One row for each file, which the writer chose the number of.
    sums = sorted(spark.read.parquet(f"{path}/ids").groupBy("part").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("docs")).collect())
    before, at = [], 0
    for part, n, docs in sums:
        before.append((part, at, n, docs))
        at += n
    spark.createDataFrame(before, "part int, first_id long, n_ids long, n_docs long").coalesce(1).write.parquet(f"{path}/manifest")
    return path


def read_tokens(spark: SparkSession, path: str, columns: tuple[str, ...] = ("doc_id", "start", "n_tokens", "ids"), low=None, high=None) -> DataFrame:
    """Documents of written files; ``low`` and ``high`` bound doc_id and reach the page index.

    Without ``ids`` among the columns only metadata pages are read.
    """
    rows = spark.read.parquet(f"{path}/ids")
    if low is not None:
        rows = rows.where(F.col("doc_id") >= low)
    if high is not None:
        rows = rows.where(F.col("doc_id") <= high)
    if "start" in columns:
        rows = rows.join(spark.read.parquet(f"{path}/manifest").select("part", "first_id"), "part").withColumn("start", F.col("first_id") + F.col("local_start"))
    return rows.select(*columns)


def digests(rows: DataFrame) -> DataFrame:
    """(.., ids) to (.., ids_crc32): crc32 of the ids as little-endian unsigned 32-bit integers."""
    keep = [c for c in rows.columns if c != "ids"]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def crc(batches):
        for batch in batches:
            sums = pa.array([zlib.crc32(x) for x in list_bytes(batch.column(len(keep)))], pa.int64())
            yield pa.record_batch([*batch.columns[: len(keep)], sums], [*keep, "ids_crc32"])

    return map_arrow(rows.select(*keep, "ids"), crc, f"{kinds}, ids_crc32 long")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents' ids, read the files back."""
    import public_tokenizers

    path = write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_dir(spark), public_tokenizers.path("word_bpe_49k.json"))
    return digests(read_tokens(spark, path))
