"""Columnar and row-batch tables: Parquet files with ranges, row masks and maintenance.

A stripe is one Parquet file; batches of the row layout share files, each with the same number of rows but the
last of a file. The manifest lists stripes and batches with their row counts, row numbers and ranges; readers prune
by it, then filter. Deletes append bitmaps of row indexes to a row mask; updates delete and insert. Every change writes new files and then publishes one manifest,
so readers see a whole state and a failed writer leaves none.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid
from collections import Counter
from dataclasses import asdict, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.predicates import Pred, predicate
from .manifest import Manifest, Store, Stripe
from .options import ColOptions, RowOptions, parse_orderby

_FILE, _INDEX = "__file", "__row_index"

#: Row mask: for each file and block of rows the bits of deleted rows, as far as the last one.
_BLOCK = 8192
_BITS = "file string, block long, words array<bigint>"
#: A mask of more bytes is joined by a shuffle, a smaller one is sent to all tasks.
_SENT_MASK = 64 << 20

#: More files are read by their folders: Spark lists many single paths in a job with a task for each few.
_BY_PATH = 32

_NO_RANGE = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType, T.NullType)

#: A literal, which stays, or what names the given row.
_EXCLUDED = re.compile(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|\bexcluded\.", re.I)

#: Rows for one task of a merge or vacuum, which cuts them into files itself: a task for each file is too many.
_TASK_ROWS = 250_000

#: Rows, and bytes of Parquet, that one task of an insert sorts: what it is given may be a file's only row group.
#: Fewer rows are less memory and more stripes that aren't full, one for each task.
_SORT_ROWS, _SORT_BYTES = 1_000_000, 64 << 20

#: Rows of a file that batches share, as far as a batch isn't larger. Ranges are found by a sort of the rows that a
#: task reads, of about thirty such files, so more rows here are more memory there, and fewer are more files.
_FILE_ROWS = 25_000

#: Rounds of a bulk update, so that jobs and manifests don't grow with the table; a failure costs one of them.
_ROUNDS = 8

#: Task and file within it, in the names that Spark gives.
_PART = re.compile(r"part-(\d+)-.*-c(\d+)")

Where = Pred | Column | str | None
Sets = dict[str, Column | str]


def _instant(x: Any, field: T.StructField) -> Any:
    """A timestamp, which arrives in local time, in UTC; any other value as it is."""
    return x.astimezone(dt.timezone.utc) if isinstance(field.dataType, T.TimestampType) else x


def _folder(s: Stripe) -> str:
    return s.file.rpartition("/")[0]


def _name(s: Stripe) -> str:
    """The file's name, and a batch's place in it."""
    return s.file.rpartition("/")[2] + ("" if s.batch is None else f"#{s.batch}")


def _place(step: int) -> tuple[Column, Column]:
    """Of a row its stripe's or batch's name, and its index there, in files with a batch for each ``step`` rows, or none."""
    file, index = F.col("_metadata.file_name"), F.col("_metadata.row_index")
    return (F.concat(file, F.lit("#"), F.floor(index / step).cast("string")), index % step) if step else (file, index)


def _bits(rows: DataFrame) -> DataFrame:
    """A row mask of (file, row index)."""
    word = F.floor(F.col("row_index") % _BLOCK / 64).cast("int")
    words = rows.groupBy("file", F.floor(F.col("row_index") / _BLOCK).cast("long").alias("block"), word.alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(row_index % 64 as int)))").alias("bits"))
    found = words.groupBy("file", "block").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("by"), F.max("word").alias("last"))
    return found.select("file", "block", F.expr("transform(sequence(0, last), w -> coalesce(try_element_at(by, w), 0L))").alias("words"))


class Table:
    """What both layouts share."""

    layout, Options = "", ColOptions

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.store = spark, path.rstrip("/"), Store(path.rstrip("/"))

    # -------------------------------------------------------- making and describing

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType, **options) -> Table:
        t = cls(spark, path)
        if t.store.exists():
            raise ValueError(f"there is a table at {path}")
        checked = cls.Options().changed(**options)
        t._known_columns(checked, schema)
        t.store.publish(Manifest(uuid.uuid4().hex, cls.layout, [schema.json()], asdict(checked)))
        return t

    @classmethod
    def create_as(cls, df: DataFrame, path: str, **options) -> Table:
        t = cls.create(df.sparkSession, path, df.schema, **options)
        t.insert(df)
        return t

    @property
    def manifest(self) -> Manifest:
        m = self.store.load()
        if m.layout != self.layout:
            raise ValueError(f"{self.path} is a {m.layout} table")
        return m

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.manifest.schemas[-1]))

    def options(self, m: Manifest | None = None):
        return self.Options(**(m or self.manifest).options)

    def _known_columns(self, options, schema: T.StructType) -> None:
        for key in parse_orderby(getattr(options, "orderby", "")):
            if key.column not in schema.names:
                raise ValueError(f"no column {key.column!r}")
        column = getattr(options, "pruning_column", "")
        if column and (column not in schema.names or isinstance(schema[column].dataType, _NO_RANGE)):
            raise ValueError(f"no comparable column {column!r}")

    def set_options(self, **values) -> None:
        """None leaves an option as it is; '' clears a sort key or pruning column."""
        m = self.manifest
        changed = self.options(m).changed(**values)
        self._known_columns(changed, self.schema)
        m.options = asdict(changed)
        self.store.publish(m)

    def reset_options(self, *names: str) -> None:
        m = self.manifest
        m.options = asdict(self.options(m).reset(*names))
        self.store.publish(m)

    def options_view(self) -> DataFrame:
        rows = {"table_name": self.path.rpartition("/")[2], **self.manifest.options}
        return self.spark.createDataFrame([tuple(rows.values())], list(rows))

    def stripes_view(self) -> DataFrame:
        m = self.manifest
        o = m.options
        group = o.get("chunk_group_row_limit", o.get("batch_size"))
        columns = len(T.StructType.fromJson(json.loads(m.schemas[-1])))
        rows = [(self.path.rpartition("/")[2], m.storage_id, s.num, 0, s.data_length, columns, group, s.row_count, -(-s.row_count // group), s.first_row_number, s.deleted, s.file) for s in m.stripes]
        return self.spark.createDataFrame(rows, "table_name string, storage_id string, stripe_num long, file_offset long, data_length long, column_count int, chunk_row_count int, row_count long, chunk_group_count long, first_row_number long, deleted_rows long, file_path string")

    def storage_id(self) -> str:
        return self.manifest.storage_id

    def stats(self) -> DataFrame:
        m = self.manifest
        return self.spark.createDataFrame([(s.num, 0, s.row_count, s.deleted, s.data_length) for s in m.stripes], "stripe_id long, file_offset long, row_count long, deleted_rows long, data_length long")

    # -------------------------------------------------------- reading

    def _names_at(self, m: Manifest, version: int, name: str) -> str:
        """What a column of today was called in files of a schema version."""
        for since, old, new in reversed(m.renames):
            if version < since and name == new:
                name = old
        return name

    def _files(self, m: Manifest, stripes: list[Stripe], schema: T.StructType, mask: bool = True) -> DataFrame:
        """Live rows of stripes in today's schema, with the stripe's name and the row index in it."""
        parts = []
        for version in sorted({s.schema_version for s in stripes}):
            own = T.StructType.fromJson(json.loads(m.schemas[version]))
            columns = []
            for f in schema:
                old = self._names_at(m, version, f.name)
                since, default = m.defaults.get(f.name, (0, None))
                if version < since or old not in own.names:
                    columns.append(F.lit(default).cast(f.dataType).alias(f.name))
                else:
                    columns.append(F.col(f"`{old}`").cast(f.dataType).alias(f.name))
            for df, step in self._scans(m, [s for s in stripes if s.schema_version == version], own):
                name, index = _place(step)
                parts.append(df.select(*columns, name.alias(_FILE), index.alias(_INDEX)))
        if not parts:
            return self.spark.createDataFrame([], T.StructType([*schema.fields, T.StructField(_FILE, T.StringType()), T.StructField(_INDEX, T.LongType())]))
        df = parts[0]
        for p in parts[1:]:
            df = df.unionByName(p)
        return self._unmasked(m, df) if mask and m.masks and any(s.deleted for s in stripes) else df

    def _scans(self, m: Manifest, stripes: list[Stripe], own: T.StructType) -> list[tuple[DataFrame, int]]:
        """Files of one schema version, a few by their paths, many by their folders; and the rows of a batch in them."""
        read, out = self.spark.read.schema(own).parquet, []
        for step in sorted({m.steps.get(_folder(s), 0) for s in stripes}):
            by: dict[str, list[Stripe]] = {}
            for s in stripes:
                if m.steps.get(_folder(s), 0) == step:
                    by.setdefault(_folder(s), []).append(s)
            whole = [f for f, some in by.items() if m.folders.get(f) == len(some)]
            partly = sorted(by.keys() - set(whole))
            if len(stripes) <= _BY_PATH:
                some = [s for f in by for s in by[f]]
                df = read(*dict.fromkeys(f"{self.path}/{s.file}" for s in some))
                out.append((self._batches(df, some, step) if partly and step else df, step))
                continue
            if whole:
                out.append((read(*(f"{self.path}/{f}" for f in whole)), step))
            if partly:  # a filter on file names, by which Spark leaves out the others before it reads
                some = [s for f in partly for s in by[f]]
                names, how = list(dict.fromkeys(s.file.rpartition("/")[2] for s in some)), "IN"
                if len(some) * 2 > sum(m.folders.get(f, 0) for f in partly):  # most of them: the others are fewer to name
                    gone = self._others(partly, names)
                    names, how = (gone, "NOT IN") if len(gone) < len(names) else (names, how)
                df = read(*(f"{self.path}/{f}" for f in partly))
                if names:
                    df = df.where(f"_metadata.file_name {how} ({', '.join(repr(n) for n in names)})")
                out.append((self._batches(df, some, step) if step else df, step))
        return out

    def _others(self, folders: list[str], names: list[str]) -> list[str]:
        """Names of the data files that lie in folders beside these."""
        from pyarrow import fs

        kept = set(names)
        found = (self.store.fs.get_file_info(fs.FileSelector(f"{self.store.root}/{f}")) for f in folders)
        return [i.base_name for infos in found for i in infos if i.base_name.endswith(".parquet") and i.base_name not in kept]

    def _batches(self, df: DataFrame, some: list[Stripe], step: int) -> DataFrame:
        """Rows of some batches, of files that have more."""
        names = ", ".join(f"'{_name(s)}'" for s in some)
        return df.where(f"concat(_metadata.file_name, '#', floor(_metadata.row_index / {step})) IN ({names})")

    def _unmasked(self, m: Manifest, df: DataFrame) -> DataFrame:
        """Rows that the row mask leaves."""
        rows = [p for p in m.masks if p.startswith("masks/")]  # of earlier releases: (file, row index)
        bits = [p for p in m.masks if not p.startswith("masks/")]
        gone = self.spark.read.schema(_BITS).parquet(*(f"{self.path}/{p}" for p in bits)) if bits else None
        if rows:
            old = _bits(self.spark.read.schema("file string, row_index long").parquet(*(f"{self.path}/{p}" for p in rows)))
            gone = old if gone is None else gone.unionByName(old)
        if len(m.masks) > 1:
            merged = "reduce(collect_list(words), cast(array() as array<bigint>), (a, b) -> zip_with(a, b, (x, y) -> coalesce(x, 0L) | coalesce(y, 0L)))"
            gone = gone.groupBy("file", "block").agg(F.expr(merged).alias("words"))
        gone = gone.select(F.col("file").alias(_FILE), F.col("block").alias("__block"), F.col("words").alias("__words")).hint("merge" if rows or m.mask_bytes > _SENT_MASK else "broadcast")
        at = df.withColumn("__block", F.floor(F.col(_INDEX) / _BLOCK).cast("long")).join(gone, [_FILE, "__block"], "left")
        word = F.get("__words", F.floor(F.col(_INDEX) % _BLOCK / 64).cast("int"))
        return at.where(F.coalesce(F.getbit(word, (F.col(_INDEX) % 64).cast("int")), F.lit(0)) == 0).select(*(F.col(f"`{c}`") for c in df.columns))

    def _prunable(self, m: Manifest, name: str) -> bool:
        return True

    def _kept(self, m: Manifest, where: Pred | None, pushdown: bool = True) -> list[Stripe]:
        if where is None or not pushdown:
            return m.stripes

        def ranges(s: Stripe) -> dict[str, Any]:
            out = {}
            for name in where.columns():
                old = self._names_at(m, s.schema_version, name)
                if self._prunable(m, name) and s.schema_version >= m.defaults.get(name, (0,))[0] and old in s.ranges:
                    out[name] = tuple(s.ranges[old])
            return out

        return [s for s in m.stripes if where.may_match(ranges(s))]

    def read(self, where: Where = None, columns: list[str] | None = None, pushdown: bool = True) -> DataFrame:
        m, where = self.manifest, predicate(where)
        df = self._files(m, self._kept(m, where, pushdown), T.StructType.fromJson(json.loads(m.schemas[-1])))
        if where is not None:
            df = df.where(where.column())
        return df.select(*columns) if columns else df.drop(_FILE, _INDEX)

    def positions(self, where: Where = None) -> DataFrame:
        """Rows with the file (and the batch in it, after a #) and row index they lie at, the only system columns there are."""
        m, where = self.manifest, predicate(where)
        df = self._matched(m, where)
        return df.withColumnsRenamed({_FILE: "row_file", _INDEX: "row_index"})

    def cached(self, columns: list[str] | None = None) -> DataFrame:
        """Rows of some columns, decompressed once and kept by the executors."""
        return self.read(columns=columns).cache()

    def analyze(self, columns: list[str] | None = None) -> DataFrame:
        """For each column: rows, share of nulls, approximate distinct values, least and greatest as text."""
        fields = [f for f in self.schema if columns is None or f.name in columns]
        df, aggs = self.read(columns=[f"`{f.name}`" for f in fields]), [F.count(F.lit(1)).alias("n")]
        for i, f in enumerate(fields):
            c = F.col(f"`{f.name}`")
            some = not isinstance(f.dataType, _NO_RANGE)
            aggs += [F.avg(c.isNull().cast("double")).alias(f"u{i}"), F.approx_count_distinct(c.cast("string")).alias(f"d{i}")]
            aggs += [(x(c).cast("string") if some else F.first(F.lit(None).cast("string"))).alias(f"{k}{i}") for k, x in (("a", F.min), ("b", F.max))]
        one = df.agg(*aggs)
        rows = F.array(*(F.struct(F.lit(f.name).alias("column"), F.col("n").alias("rows"), F.col(f"u{i}").alias("null_share"), F.col(f"d{i}").alias("distinct"), F.col(f"a{i}").alias("least"), F.col(f"b{i}").alias("greatest")) for i, f in enumerate(fields)))
        return one.select(F.explode(rows).alias("r")).select("r.*")

    def sample(self, share: float, seed: int | None = None) -> DataFrame:
        """Columnar tables refuse; row-batch tables sample rows."""
        raise ValueError(f"{self.layout} tables can't be sampled")

    def check_unique(self, keys: list[str]) -> None:
        """Raise if live rows repeat a key; keys with a null don't count."""
        rows = self.read().dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
        if rows:
            raise ValueError(f"duplicate key: {rows[0].asDict()}")

    def prune_report(self, where: Where) -> dict[str, int]:
        m, where = self.manifest, predicate(where)
        kept = self._kept(m, where)
        return {"stripes": len(m.stripes), "stripes_removed": len(m.stripes) - len(kept), "rows": sum(s.row_count for s in m.stripes), "rows_kept": sum(s.row_count for s in kept)}

    def count(self) -> int:
        """Live rows, from metadata alone."""
        return sum(s.row_count - s.deleted for s in self.manifest.stripes)

    # -------------------------------------------------------- writing

    def _sorted(self, df: DataFrame, m: Manifest) -> DataFrame:
        keys = parse_orderby(m.options.get("orderby") or "")
        return df.sortWithinPartitions(*(k.order() for k in keys)) if keys else df

    def _by_range(self, df: DataFrame, m: Manifest, many: int, place: list[Column]) -> DataFrame:
        """Rows in ``many`` tasks by ranges of the sort key, in its order. Rows of one key are dealt by their place, a hash of it."""
        keys = [k.order() for k in parse_orderby(m.options["orderby"])]
        return self._sorted(df.withColumn("__place", F.xxhash64(*place)).drop(_FILE, _INDEX).repartitionByRange(many, *keys, "__place").drop("__place"), m)

    def _bounded(self, once: str, schema: T.StructType, m: Manifest) -> DataFrame:
        """Rows of files, sorted in tasks whose memory doesn't grow with them."""
        df, file = self.spark.read.schema(schema).parquet(once), F.col("_metadata.file_name")
        of_file = df.groupBy(file.alias("f")).agg(F.count(F.lit(1)).alias("n"), F.max("_metadata.file_size").alias("size"))
        n, size = of_file.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
        many = max(1, -(-n // _SORT_ROWS), -(-size // _SORT_BYTES))
        return self._by_range(df, m, many, [file, F.col("_metadata.row_index")]) if many > 1 else self._sorted(df, m)

    def _written(self, df: DataFrame, m: Manifest, ordered: bool = False) -> list[Stripe]:
        """New files of rows, with their ranges; not yet in the manifest.

        With a sort key, rows that don't come ordered are first written as they are: only then is it known how many tasks sort them.
        """
        folder = f"data/{uuid.uuid4().hex}"
        schema = T.StructType.fromJson(json.loads(m.schemas[-1]))
        df = df.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema))
        options, once = self.options(m), None
        if not ordered and parse_orderby(m.options.get("orderby") or ""):
            once = f"unsorted/{uuid.uuid4().hex}"
            df.write.parquet(f"{self.path}/{once}")
            df = self._bounded(f"{self.path}/{once}", schema, m)
        df.write.options(**options.write_options(_FILE_ROWS)).parquet(f"{self.path}/{folder}")
        if once:
            self.store.remove_data([once])
        if isinstance(options, RowOptions):
            m.steps[folder] = options.batch_size
        return self._measured(folder, schema, m)

    def _measured(self, folder: str, schema: T.StructType, m: Manifest) -> list[Stripe]:
        made, step = self.spark.read.schema(schema).parquet(f"{self.path}/{folder}"), m.steps.get(folder)
        ranged = [f for f in schema if not isinstance(f.dataType, _NO_RANGE)]
        aggs = [F.count(F.lit(1)).alias("n")]
        for i, f in enumerate(schema):
            aggs.append(F.sum(F.col(f"`{f.name}`").isNull().cast("long")).alias(f"u{i}"))
        for i, f in enumerate(ranged):
            c = F.col(f"`{f.name}`")
            aggs += [F.min(c).alias(f"a{i}"), F.max(c).alias(f"b{i}")]
            if isinstance(f.dataType, T.FloatType | T.DoubleType):
                aggs.append(F.max(F.isnan(c)).alias(f"nan{i}"))
        batch = F.floor(F.col("_metadata.row_index") / step) if step else F.lit(0)
        found = made.groupBy(F.col("_metadata.file_name").alias("f"), F.col("_metadata.file_size").alias("size"), batch.cast("long").alias("batch")).agg(*aggs).collect()  # a row for each stripe or batch
        out, total, before = [], Counter(), Counter()
        m.folders[folder] = len(found)
        for r in found:
            total[r.f] += r.n
        for r in sorted((x.asDict() for x in found), key=lambda x: [*(int(n) for n in _PART.match(x["f"]).groups()), x["batch"]]):
            ranges = {f.name: [_instant(r[f"a{i}"], f), _instant(r[f"b{i}"], f)] for i, f in enumerate(ranged) if r[f"a{i}"] is not None and not r.get(f"nan{i}")}
            nulls = {f.name: r[f"u{i}"] for i, f in enumerate(schema)}
            # Of a shared file's bytes each batch has its rows' share.
            bytes_to = [r["size"] * n // total[r["f"]] for n in (before[r["f"]], before[r["f"]] + r["n"])]
            before[r["f"]] += r["n"]
            out.append(Stripe(m.next_stripe, f"{folder}/{r['f']}", r["n"], m.next_row_number, bytes_to[1] - bytes_to[0], len(m.schemas) - 1, ranges, nulls, batch=r["batch"] if step else None))
            m.next_stripe += 1
            m.next_row_number += r["n"]
        return out

    def insert(self, df: DataFrame) -> int:
        """Append rows. The files that df reads are fixed by its plan, so a table may insert its own rows.

        A column that df lacks has its default, or null. A column that the table lacks is an error.
        """
        m, schema = self.manifest, self.schema
        if unknown := [c for c in df.columns if c not in schema.names]:
            raise ValueError(f"no columns: {', '.join(unknown)}")
        absent = {f.name: F.lit(m.defaults.get(f.name, (0, None))[1]).cast(f.dataType) for f in schema if f.name not in df.columns}
        new = self._written(df.withColumns(absent) if absent else df, m)
        m.stripes += new
        self.store.publish(m)
        return sum(s.row_count for s in new)

    def insert_csv(self, path: str, **options) -> int:
        return self.insert(self.spark.read.options(**options).schema(self.schema).csv(path))

    def export_csv(self, path: str, where: Where = None, **options) -> None:
        self.read(where).write.options(**options).csv(path)

    def _mask(self, m: Manifest, matched: DataFrame) -> int:
        """Add matched rows to the row mask."""
        folder = f"bits/{uuid.uuid4().hex}"
        _bits(matched.select(F.col(_FILE).alias("file"), F.col(_INDEX).alias("row_index"))).write.parquet(f"{self.path}/{folder}")
        rows = F.sum(F.expr("reduce(words, 0L, (a, w) -> a + bit_count(w))"))
        by_file = {r.file: r for r in self.spark.read.schema(_BITS).parquet(f"{self.path}/{folder}").groupBy("file").agg(rows.alias("n"), F.sum(F.size("words") * 8 + 150).alias("bytes")).collect()}
        for s in m.stripes:
            if r := by_file.get(_name(s)):
                s.deleted += r.n
        if by_file:
            m.masks.append(folder)
            m.mask_bytes += sum(r.bytes for r in by_file.values())
        return sum(r.n for r in by_file.values())

    def _matched(self, m: Manifest, where: Pred | None) -> DataFrame:
        df = self._files(m, self._kept(m, where), T.StructType.fromJson(json.loads(m.schemas[-1])))
        return df if where is None else df.where(where.column())

    def delete(self, where: Where = None) -> int:
        m = self.manifest
        n = self._mask(m, self._matched(m, predicate(where)))
        self.store.publish(m)
        return n

    def _set(self, df: DataFrame, sets: Sets, when: Column | None = None) -> DataFrame:
        """All expressions see the row as it was."""
        if unknown := set(sets) - set(df.columns):
            raise ValueError(f"no columns: {', '.join(sorted(unknown))}")

        def value(c: str) -> Column:
            new = F.expr(sets[c]) if isinstance(sets[c], str) else sets[c]
            new = new.cast(df.schema[c].dataType)
            return (new if when is None else F.when(when, new).otherwise(F.col(f"`{c}`"))).alias(c)

        return df.select(*(value(c) if c in sets else F.col(f"`{c}`") for c in df.columns))

    def update(self, sets: Sets, where: Where = None) -> int:
        """Delete and insert: updated rows get new row numbers."""
        m = self.manifest
        # Filter and expressions are evaluated once, also where they aren't deterministic.
        once = f"{self.path}/updates/{uuid.uuid4().hex}"
        found = self._set(self._matched(m, predicate(where)), sets)
        found.write.parquet(once)
        matched = self.spark.read.schema(found.schema).parquet(once)
        new = self._written(matched.drop(_FILE, _INDEX), m)
        n = self._mask(m, matched)
        m.stripes += new
        self.store.publish(m)
        self.store.remove_data([f"updates/{once.rpartition('/')[2]}"])
        return n

    def upsert(self, df: DataFrame, keys: list[str], update: Sets | None = None) -> tuple[int, int]:
        """INSERT .. ON CONFLICT (keys) DO NOTHING, or DO UPDATE with ``update`` over ``excluded.<column>`` and old columns.

        A key given twice by df is an error; null keys never conflict. Returns rows inserted and updated.
        """
        m = self.manifest
        schema = self.schema
        named = df.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema))
        some = F.lit(True)
        for k in keys:
            some = some & F.col(f"`{k}`").isNotNull()
        if update is not None and not named.where(some).groupBy(*keys).count().where("count > 1").isEmpty():
            raise ValueError("a key occurs twice among the rows to upsert")
        if update is None:
            keyed = named.where(some).dropDuplicates(keys)
            named = keyed.unionByName(named.where(~some))
        live = self._matched(m, None)
        fresh = named.join(live.select(*keys), keys, "left_anti").select(*schema.names)
        new = self._written(fresh, m)
        n = 0
        if update is not None:
            given = named.select(*(F.col(f"`{c}`").alias(f"excluded_{c}") for c in schema.names))
            on = None
            for k in keys:
                one = F.col(f"`{k}`") == F.col(f"`excluded_{k}`")
                on = one if on is None else on & one
            both = live.join(given, on)
            texts = {c: F.expr(_EXCLUDED.sub(lambda x: x[0] if x[0][0] in "'\"" else "excluded_", e)) if isinstance(e, str) else e for c, e in update.items()}
            new += self._written(self._set(both, texts).select(*schema.names), m)
            n = self._mask(m, both)
        inserted = sum(s.row_count for s in new) - n
        m.stripes += new
        self.store.publish(m)
        return inserted, n

    def truncate(self) -> None:
        m = self.manifest
        m.stripes = []
        m.unmask()
        self.store.publish(m)

    def drop(self) -> None:
        self.store.remove()

    # -------------------------------------------------------- schema

    def add_column(self, field: T.StructField, default: Any = None) -> None:
        """Rows of earlier files have the default; a null written later stays null."""
        m, schema = self.manifest, self.schema
        if field.name in schema.names:
            raise ValueError(f"there is a column {field.name!r}")
        if isinstance(default, Column):
            raise ValueError("a default must be a constant")
        m.schemas.append(T.StructType([*schema.fields, field]).json())
        m.defaults[field.name] = [len(m.schemas) - 1, default]
        self.store.publish(m)

    def _column(self, schema: T.StructType, name: str) -> None:
        if name not in schema.names:
            raise ValueError(f"no column {name!r}")

    def drop_column(self, name: str) -> None:
        """A column that rows are sorted or pruned by can't go; clear the option first."""
        m, schema = self.manifest, self.schema
        self._column(schema, name)
        if name in [k.column for k in parse_orderby(m.options.get("orderby") or "")] or m.options.get("pruning_column") == name:
            raise ValueError(f"rows are sorted or pruned by {name!r}")
        m.schemas.append(T.StructType([f for f in schema if f.name != name]).json())
        m.defaults.pop(name, None)
        self.store.publish(m)

    def rename_column(self, old: str, new: str) -> None:
        """The sort key and pruning column follow."""
        m, schema = self.manifest, self.schema
        self._column(schema, old)
        if new in schema.names:
            raise ValueError(f"there is a column {new!r}")
        m.schemas.append(T.StructType([T.StructField(new, f.dataType, f.nullable) if f.name == old else f for f in schema]).json())
        m.renames.append([len(m.schemas) - 1, old, new])
        if old in m.defaults:
            m.defaults[new] = m.defaults.pop(old)
        keys = parse_orderby(m.options.get("orderby") or "")
        if old in [k.column for k in keys]:
            m.options["orderby"] = ", ".join(replace(k, column=new).text() if k.column == old else k.text() for k in keys)
        if m.options.get("pruning_column") == old:
            m.options["pruning_column"] = new
        self.store.publish(m)

    def alter_type(self, name: str, kind: T.DataType, using: Column | str | None = None) -> None:
        """Rewrites the table with the column cast, or computed by ``using``."""
        m, schema = self.manifest, self.schema
        self._column(schema, name)
        df = self._files(m, m.stripes, schema).drop(_FILE, _INDEX)
        value = F.col(f"`{name}`") if using is None else F.expr(using) if isinstance(using, str) else using
        df = df.select(*(value.cast(kind).alias(name) if c == name else F.col(f"`{c}`") for c in schema.names))
        m.schemas.append(T.StructType([T.StructField(name, kind) if f.name == name else f for f in schema]).json())
        m.stripes = self._written(df, m)
        m.unmask()
        self.store.publish(m)

    # -------------------------------------------------------- maintenance

    def _live(self, m: Manifest, stripes: list[Stripe]) -> DataFrame:
        return self._files(m, stripes, T.StructType.fromJson(json.loads(m.schemas[-1]))).drop(_FILE, _INDEX)

    def repack(self, min_fill_ratio: float = 0.9) -> int:
        """Rewrite stripes whose share of live rows is below the ratio; empty ones go. Returns stripes rewritten."""
        if not 0 <= min_fill_ratio <= 1:
            raise ValueError("min_fill_ratio must be between 0 and 1")
        m = self.manifest
        thin = [s for s in m.stripes if s.deleted and (s.row_count == s.deleted or (s.row_count - s.deleted) / s.row_count < min_fill_ratio)]
        live = [s for s in thin if s.deleted < s.row_count]
        new = self._written(self._live(m, live), m, ordered=True) if live else []
        gone = {s.num for s in thin}
        m.stripes = [s for s in m.stripes if s.num not in gone] + new
        if not any(s.deleted for s in m.stripes):
            m.unmask()
        self.store.publish(m)
        return len(thin)

    def clean(self) -> int:
        """Delete data files that the current manifest doesn't list (no reader may use an older one)."""
        m = self.manifest
        keep = {s.file for s in m.stripes}
        from pyarrow import fs

        found = self.store.fs.get_file_info(fs.FileSelector(f"{self.store.root}/data", recursive=True, allow_not_found=True))
        gone = [f.path[len(self.store.root) + 1 :] for f in found if f.path.endswith(".parquet") and f.path[len(self.store.root) + 1 :] not in keep]
        self.store.remove_data(gone)
        return len(gone)


class ColTable(Table):
    """Columnar layout: stripes, a sort key, all columns prunable."""

    layout, Options = "columnar", ColOptions

    def _tasks(self, m: Manifest, stripes: list[Stripe]) -> int:
        """Tasks that rewrite stripes, each for whole stripes of about ``_TASK_ROWS`` rows, or for one."""
        limit = m.options["stripe_row_limit"]
        return max(1, -(-sum(s.row_count - s.deleted for s in stripes) // (limit * max(1, _TASK_ROWS // limit))))

    def merge(self) -> int:
        """Rewrite all live rows, globally ordered by the sort key if there is one."""
        m = self.manifest
        df = self._files(m, m.stripes, T.StructType.fromJson(json.loads(m.schemas[-1])))
        if parse_orderby(m.options["orderby"]):
            df = self._by_range(df, m, self._tasks(m, m.stripes), [F.col(_FILE), F.col(_INDEX)])
        m.stripes = self._written(df.drop(_FILE, _INDEX), m, ordered=True)
        m.unmask()
        self.store.publish(m)
        return sum(s.row_count for s in m.stripes)

    def smart_update(self, sets: Sets, where: Where = None) -> int:
        """Rewrite only the stripes that hold a match, whole; other rows of theirs are kept as they are."""
        m, pred = self.manifest, predicate(where)
        hits = {r[0] for r in self._matched(m, pred).select(_FILE).distinct().collect()}  # file names
        touched = [s for s in m.stripes if _name(s) in hits]
        if not touched:
            return 0
        when = None if pred is None else F.coalesce(pred.column(), F.lit(False))
        new = self._written(self._set(self._live(m, touched), sets, when), m)
        gone = {s.num for s in touched}
        m.stripes = [s for s in m.stripes if s.num not in gone] + new
        self.store.publish(m)
        return len(touched)

    def bulk_update(self, sets: Sets, where: Where = None, batch_size: int = 50_000, skip_columns: list[str] | None = None) -> int:
        """``smart_update`` in batches of stripes of about ``batch_size`` rows, in at most ``_ROUNDS`` rounds of as many
        batches, each published with its progress. Batches without a match stay as they are.

        After a failure the same call goes on behind the last published round.
        """
        if both := set(skip_columns or ()) & set(sets):
            raise ValueError(f"skipped columns are set: {', '.join(sorted(both))}")
        m, pred = self.manifest, predicate(where)
        schema = T.StructType.fromJson(json.loads(m.schemas[-1]))
        job = json.dumps([{k: str(v) for k, v in sets.items()}, str(where)])
        if not m.progress or m.progress["job"] != job:
            m.progress = {"job": job, "left": [s.num for s in m.stripes], "updated": 0}
            self.store.publish(m)
        when = F.lit(True) if pred is None else F.coalesce(pred.column(), F.lit(False))
        by_num, rows = {s.num: s for s in m.stripes}, batch_size
        batches: list[list[Stripe]] = []
        for s in (by_num[n] for n in m.progress["left"] if n in by_num):
            if rows >= batch_size:
                batches.append([])
                rows = 0
            batches[-1].append(s)
            rows += s.row_count
        many = -(-len(batches) // _ROUNDS)
        while batches:
            now, batches = batches[:many], batches[many:]
            m.progress["left"] = [s.num for b in batches for s in b]
            kept = self._kept(replace_stripes(m, [s for b in now for s in b]), pred)
            found = self._files(m, kept, schema).where(when).groupBy(_FILE).agg(F.count(F.lit(1)).alias("n")).collect() if kept else []
            if found:
                hits, nums = {r[0] for r in found}, {s.num for s in kept}
                touched = [s for b in now if any(_name(s) in hits for s in b) for s in b if s.num in nums]
                new = self._written(self._set(self._live(m, touched), sets, when), m)
                gone = {s.num for s in touched}
                m.stripes = [s for s in m.stripes if s.num not in gone] + new
                m.progress["updated"] += sum(r.n for r in found)
            self.store.publish(m)
        done = m.progress["updated"]
        m.progress = None
        self.store.publish(m)
        return done

    def vacuum(self, stripe_count: int | None = None) -> int:
        """Combine stripes that are at most half full, or more than a fifth deleted. Returns stripes combined."""
        m = self.manifest
        limit = m.options["stripe_row_limit"]
        small = [s for s in m.stripes if s.row_count * 2 <= limit or s.deleted * 5 > s.row_count][:stripe_count]
        if len(small) < 2 and not any(s.deleted * 5 > s.row_count for s in small):
            return 0
        live = self._live(m, small)
        many = self._tasks(m, small)
        # Tasks of many stripes fill all but their last; for few, rows are dealt evenly.
        dealt = live.repartition(many) if many > 1 and limit * 8 > _TASK_ROWS else live.coalesce(many)
        new = self._written(self._sorted(dealt, m), m, ordered=True)
        gone = {s.num for s in small}
        m.stripes = [s for s in m.stripes if s.num not in gone] + new
        if not any(s.deleted for s in m.stripes):
            m.unmask()
        self.store.publish(m)
        return len(small)


def replace_stripes(m: Manifest, stripes: list[Stripe]) -> Manifest:
    return replace(m, stripes=stripes)


class RowTable(Table):
    """Row-batch layout: batches, one optional pruning column."""

    layout, Options = "row", RowOptions

    def _prunable(self, m: Manifest, name: str) -> bool:
        return name == m.options["pruning_column"]

    def sample(self, share: float, seed: int | None = None) -> DataFrame:
        return self.read().sample(share, seed)

    def batches_view(self) -> DataFrame:
        return self.stripes_view().select("storage_id", F.col("stripe_num").alias("batch_num"), "file_offset", "data_length", "first_row_number", "row_count")

    def repack(self, min_fill_ratio: float = 1.0) -> int:
        """Rewrite all live rows with today's options."""
        m = self.manifest
        m.stripes = self._written(self._live(m, m.stripes), m)
        m.unmask()
        self.store.publish(m)
        return len(m.stripes)


def open_table(spark: SparkSession, path: str) -> Table:
    """The table at a path, in its layout."""
    m = Store(path.rstrip("/")).load()
    return {t.layout: t for t in (ColTable, RowTable)}[m.layout](spark, path)


def convert(table: Table, path: str, to: type[Table], **options) -> Table:
    """A copy of a table's live rows in another layout."""
    return to.create_as(table.read(), path, **options)
