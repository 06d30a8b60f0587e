"""Versioned table metadata, published by creating the next version's file."""

from __future__ import annotations

import datetime as dt
import json
import os
import uuid
from dataclasses import dataclass, field, fields
from decimal import Decimal
from typing import Any

from pyarrow import fs


@dataclass
class Stripe:
    """A data file, or a batch in it: its rows, its place in the row numbers, and ranges of its columns as written."""

    num: int
    file: str
    row_count: int
    first_row_number: int
    data_length: int
    schema_version: int
    ranges: dict[str, list] = field(default_factory=dict)
    nulls: dict[str, int] = field(default_factory=dict)
    deleted: int = 0
    #: Place in a file of several batches; None is a file of its own.
    batch: int | None = None


@dataclass
class Manifest:
    storage_id: str
    layout: str
    #: For each schema version the fields as JSON, in Spark's own form.
    schemas: list[str]
    options: dict[str, Any]
    #: Added columns: name to (first schema version with it, default as JSON).
    defaults: dict[str, list] = field(default_factory=dict)
    #: Renamed columns: (schema version from which, old name, new name).
    renames: list[list] = field(default_factory=list)
    stripes: list[Stripe] = field(default_factory=list)
    #: Folders of deletion vectors, and the bytes of their bitmaps.
    masks: list[str] = field(default_factory=list)
    mask_bytes: int = 0
    #: Stripes or batches that each folder was written with.
    folders: dict[str, int] = field(default_factory=dict)
    #: Rows of a batch in the files of each folder whose files hold several.
    steps: dict[str, int] = field(default_factory=dict)
    next_row_number: int = 1
    next_stripe: int = 1
    version: int = 0
    #: A bulk update in progress.
    progress: dict[str, Any] | None = None

    def unmask(self) -> None:
        self.masks, self.mask_bytes = [], 0


def _plain(x):
    for kind, name in ((Decimal, "decimal"), (dt.datetime, "timestamp"), (dt.date, "date"), (bytes, "bytes")):
        if isinstance(x, kind):
            return {name: x.hex() if kind is bytes else x.isoformat() if name in ("timestamp", "date") else str(x)}
    raise TypeError(f"not JSON: {type(x)}")


def _typed(x: dict):
    if len(x) == 1:
        (k, v), = x.items()
        read = {"decimal": Decimal, "timestamp": dt.datetime.fromisoformat, "date": dt.date.fromisoformat, "bytes": bytes.fromhex}.get(k)
        if read and isinstance(v, str):
            return read(v)
    return x


class Store:
    """The manifests of a table; a writer that lost the race for a version gets an error.

    On a local file system the creation is exclusive. On others it is a test and a rename, so two writers at the
    same moment need a lock of their own there.
    """

    def __init__(self, root: str):
        self.fs, self.root = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)

    def _versions(self) -> list[str]:
        found = self.fs.get_file_info(fs.FileSelector(f"{self.root}/manifest", allow_not_found=True))
        return sorted(f.path for f in found if f.path.endswith(".json"))

    def exists(self) -> bool:
        return bool(self._versions())

    def load(self) -> Manifest:
        paths = self._versions()
        if not paths:
            raise FileNotFoundError(f"no table at {self.root}")
        with self.fs.open_input_stream(paths[-1]) as f:
            data = json.loads(f.read(), object_hook=_typed)
        return Manifest(**data | {"stripes": [Stripe(**s) for s in data["stripes"]]})

    def publish(self, m: Manifest) -> Manifest:
        m.version += 1
        used = {s.file.rpartition("/")[0] for s in m.stripes}
        m.folders, m.steps = ({f: n for f, n in x.items() if f in used} for x in (m.folders, m.steps))
        path = f"{self.root}/manifest/{m.version:010d}.json"
        self.fs.create_dir(f"{self.root}/manifest", recursive=True)
        if self.fs.get_file_info(path).type != fs.FileType.NotFound:
            raise RuntimeError(f"another writer published version {m.version}")
        tmp = f"{self.root}/manifest/.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(tmp) as f:
            head = {x.name: getattr(m, x.name) for x in fields(m) if x.name != "stripes"}
            f.write((json.dumps(head, default=_plain)[:-1] + ', "stripes": [').encode())
            for i in range(0, len(m.stripes), 1000):  # no copy of them all
                f.write((", " * (i > 0) + json.dumps([vars(s) for s in m.stripes[i : i + 1000]], default=_plain)[1:-1]).encode())
            f.write(b"]}")
        if not isinstance(self.fs, fs.LocalFileSystem):
            self.fs.move(tmp, path)
            return m
        try:
            os.link(tmp, path)  # fails where the name is taken
        except FileExistsError:
            raise RuntimeError(f"another writer published version {m.version}") from None
        finally:
            os.unlink(tmp)
        return m

    def remove(self) -> None:
        self.fs.delete_dir(self.root)

    def remove_data(self, names: list[str]) -> None:
        for n in names:
            path = f"{self.root}/{n}"
            (self.fs.delete_dir if self.fs.get_file_info(path).type == fs.FileType.Directory else self.fs.delete_file)(path)
