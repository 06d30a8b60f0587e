"""WARC archives: writing, normalising a monolithic gzip stream, and reading by offset.

``write_archives`` writes WARC/1.1 records as one gzip stream per file (no record can be read
alone). ``normalise`` inflates each such stream once, rewrites every record as a gzip member of
its own and writes a sidecar index (file, offset, length, ...). ``read_archives`` reads members
at the offsets of the index.

Archive files lie in a folder of the shared file system, opened through pyarrow's file systems.
A file is written under a temporary name and then renamed, so a repeated task replaces it by a whole
file of the same records; members and offsets follow from that file alone, so repeating them gives the same bytes.

Edge cases: a null html is an empty payload; null urls become ``urn:page:<page_id>``; repeated
rows of the smallest page_id of a payload are all responses; a null page_id is left out of the
record, is read back as null and is never referred to; an empty table gives no archives and no
rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, partitions, remove, shared_dir, written

_END = b"\r\n\r\n"
_INDEX = "file string, offset long, length long, record_id string, record_type string, page_id long, payload_bytes long, payload_digest string"


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class _Sink:
    """A file that appears under its name only when it is whole."""

    def __init__(self, uri: str):
        self.fs, self.path = _opened(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.tmp = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out, self.size = self.fs.open_output_stream(self.tmp), 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.tmp, self.path)


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record. A revisit has the digest and length of its payload, not the payload."""
    uri = url or f"urn:page:{page}"
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{uri}')}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {''.join(uri.split())}",
        *([] if page is None else [f"X-Page-ID: {page}"]),
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + _END + block + _END


def parsed(raw: bytes) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload and the payload's full length, of one record."""
    head, _, rest = raw.partition(_END)
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(_END)
    full = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return fields, payload, full


def page_id(fields: dict[str, str]) -> int | None:
    return int(fields["X-Page-ID"]) if "X-Page-ID" in fields else None


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Split an inflated stream into records by their lengths."""
    held = bytearray()
    for chunk in chunks:
        held += chunk
        at = 0
        while (end := held.find(_END, at)) >= 0:
            head = bytes(held[at:end])
            n = next(int(x[15:]) for x in head.split(b"\r\n") if x.startswith(b"Content-Length:"))
            stop = end + 4 + n + 4
            if stop > len(held):
                break
            yield bytes(held[at:stop])
            at = stop
        del held[:at]
    if held.strip():
        raise ValueError("the archive ends within a record")


def inflated(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """Inflate a gzip stream of any number of members, at most ``size`` bytes at a time; a stream that ends within a member is an error."""
    d, begun = zlib.decompressobj(31), False
    while data := stream.read(size):
        while data:
            begun = True
            if out := d.decompress(data, size):
                yield out
            data = d.unconsumed_tail
            if d.eof:
                data, d, begun = d.unused_data, zlib.decompressobj(31), False
    while begun and not d.eof and (out := d.decompress(b"", size)):  # held back by the bound
        yield out
    if begun and not d.eof:
        raise ValueError("the gzip stream ends within a member")


def write_archives(pages: DataFrame, folder: str, smallest: int = 0, level: int = 1) -> DataFrame:
    """Write pages (page_id, url, html) as monolithic gzip WARC files; returns the files' names.

    Of payloads of at least ``smallest`` bytes that are equal, the smallest page_id's is the response.
    The digest is aggregated before it is dealt out, and only repeated digests are joined back.
    """
    data = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = pages.select("page_id", "url", data.alias("payload")).withColumn("sha", F.sha1("payload"))
    long = F.length("payload") >= smallest
    repeated = rows.where(long).groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "first")
    rows = rows.join(repeated, "sha", "left").select("page_id", "url", "payload", "sha", F.when(long, F.col("first")).alias("first"))

    def write(batches):
        sink, gz, part = None, None, TaskContext.get().partitionId()
        name = f"part-{part:06d}.warc.gz"
        for batch in batches:
            for page, url, payload, sha, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sink is None:
                    sink, gz = _Sink(f"{folder}/{name}"), zlib.compressobj(level, zlib.DEFLATED, 31)
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                sink.write(gz.compress(record(page, url, payload, digest, None if first is None or first == page else first)))
        if sink is not None:
            sink.write(gz.flush())
            sink.close()
            yield pa.record_batch([pa.array([name])], ["file"])

    return written(map_arrow(rows, write, "file string"), f"{folder}/files")


def normalise(files: DataFrame, source: str, target: str, level: int = 4) -> DataFrame:
    """Rewrite each monolithic file with a gzip member for every record; returns the offset index.

    A file is inflated once, as a stream; memory holds one record. Each task takes whole files.
    """
    spark = files.sparkSession

    def rewrite(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, sink = [], _Sink(f"{target}/{name}")
                f, path = _opened(f"{source}/{name}")
                with f.open_input_stream(path, compression=None) as stream:
                    for raw in records(inflated(stream)):
                        fields, payload, full = parsed(raw)
                        gz = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = gz.compress(raw) + gz.flush()
                        if payload and base64.b32encode(hashlib.sha1(payload).digest()).decode() != fields["WARC-Payload-Digest"][5:]:
                            raise ValueError(f"digest mismatch in {name} at record {fields['WARC-Record-ID']}")
                        rows.append((name, sink.size, len(member), fields["WARC-Record-ID"], fields["WARC-Type"], page_id(fields), full, fields["WARC-Payload-Digest"][5:]))
                        sink.write(member)
                sink.close()
                cols = list(zip(*rows, strict=True))
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [c.split()[0] for c in _INDEX.split(", ")])

    many = files.count()  # a row for each file
    return written(map_arrow(files.repartition(max(1, min(many, 4 * partitions(spark)))), rewrite, _INDEX), f"{target}/index")


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """Read the records that the index lists, each by its own member.

    Returns page_id, url, record_type, refers_to, payload_digest, payload_bytes and payload (null for revisits).
    """

    def read(batches):
        for batch in batches:
            names, f, path, opened = batch.column(0).to_pylist(), None, None, None
            for a in range(0, batch.num_rows, 256):
                rows = []
                for name, offset, length in zip(names[a : a + 256], batch.column(1)[a : a + 256].to_pylist(), batch.column(2)[a : a + 256].to_pylist(), strict=True):
                    if opened != name:
                        f, path = _opened(f"{folder}/{name}")
                        handle, opened = f.open_input_file(path), name
                    fields, payload, full = parsed(zlib.decompress(handle.read_at(length, offset), 31))
                    refers, revisit = fields.get("X-Refers-To-Page-ID"), fields["WARC-Type"] == "revisit"
                    rows.append((page_id(fields), fields["WARC-Target-URI"], fields["WARC-Type"], int(refers) if refers else None, fields["WARC-Payload-Digest"][5:], full, None if revisit else payload))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"])

    return map_arrow(index.select("file", "offset", "length"), read, "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages as archives, normalise them, read every record back."""
    base = shared_dir(spark)
    files = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), f"{base}/whole")
    index = normalise(files, f"{base}/whole", f"{base}/members")
    remove(spark, f"{base}/whole")
    return read_archives(index, f"{base}/members").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
