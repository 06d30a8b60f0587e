"""Validated options of tables, and sort keys."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codecs that tables accept, and the Parquet codec of each.
CODECS = {"none": "uncompressed", "pglz": "snappy", "lz4": "lz4_raw", "zstd": "zstd", "deflate": "gzip", "zxc": "lz4_raw"}


def _within(name: str, value: int, low: int, high: int) -> None:
    if not isinstance(value, int) or isinstance(value, bool) or not low <= value <= high:
        raise ValueError(f"{name} must be between {low} and {high}, not {value!r}")


@dataclass(frozen=True)
class SortKey:
    column: str
    descending: bool = False
    nulls_first: bool = False

    def order(self) -> Column:
        c = F.col(f"`{self.column}`")
        return {(False, False): c.asc_nulls_last(), (False, True): c.asc_nulls_first(), (True, False): c.desc_nulls_last(), (True, True): c.desc_nulls_first()}[self.descending, self.nulls_first]

    def text(self) -> str:
        return f'"{self.column}" {"DESC" if self.descending else "ASC"} NULLS {"FIRST" if self.nulls_first else "LAST"}'


_KEY = re.compile(r'\s*(?:"(?P<quoted>[^"]+)"|(?P<plain>\w+))(?:\s+(?P<dir>asc|desc))?(?:\s+nulls\s+(?P<nulls>first|last))?\s*', re.I)


def parse_orderby(text: str) -> tuple[SortKey, ...]:
    """``col [ASC|DESC] [NULLS FIRST|LAST], ...``: ascending keys have nulls last, descending ones first."""
    out = []
    for part in text.split(",") if text.strip() else ():
        m = _KEY.fullmatch(part)
        if not m:
            raise ValueError(f"not a sort key: {part.strip()!r}")
        down = (m["dir"] or "").lower() == "desc"
        out.append(SortKey(m["quoted"] or m["plain"], down, m["nulls"].lower() == "first" if m["nulls"] else down))
    return tuple(out)


class _Options:
    def changed(self, **values):
        """New options; None leaves a value as it is."""
        names = {f.name for f in fields(self)}
        if unknown := set(values) - names:
            raise ValueError(f"unknown options: {', '.join(sorted(unknown))}")
        return replace(self, **{k: v for k, v in values.items() if v is not None})

    def reset(self, *names: str):
        fresh = type(self)()
        return replace(self, **{n: getattr(fresh, n) for n in names})

    def _codec(self) -> None:
        if self.compression not in CODECS:
            raise ValueError(f"unknown compression {self.compression!r}; known: {', '.join(CODECS)}")
        _within("compression_level", self.compression_level, 1, 19)

    def writer(self, rows: int, group: int) -> dict[str, str]:
        out = {"compression": CODECS[self.compression], "maxRecordsPerFile": str(rows), "parquet.page.row.count.limit": str(group)}
        return out | ({"parquet.compression.codec.zstd.level": str(self.compression_level)} if self.compression == "zstd" else {})


@dataclass(frozen=True)
class ColOptions(_Options):
    chunk_group_row_limit: int = 10_000
    stripe_row_limit: int = 150_000
    compression: str = "zstd"
    compression_level: int = 3
    orderby: str = ""
    index_scan: bool = False

    def __post_init__(self):
        _within("chunk_group_row_limit", self.chunk_group_row_limit, 1000, 100_000_000)
        _within("stripe_row_limit", self.stripe_row_limit, 1000, 100_000_000)
        self._codec()
        parse_orderby(self.orderby)

    def write_options(self, file_rows: int) -> dict[str, str]:
        """A stripe is a file."""
        return self.writer(self.stripe_row_limit, self.chunk_group_row_limit)


@dataclass(frozen=True)
class RowOptions(_Options):
    batch_size: int = 10_000
    compression: str = "zstd"
    compression_level: int = 3
    pruning_column: str = ""
    index_scan: bool = False

    def __post_init__(self):
        _within("batch_size", self.batch_size, 100, 100_000_000)
        self._codec()

    def write_options(self, file_rows: int) -> dict[str, str]:
        """A file holds whole batches of about ``file_rows`` rows, or one."""
        return self.writer(self.batch_size * max(1, file_rows // self.batch_size), self.batch_size)
