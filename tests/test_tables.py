"""Tables: options, pruning, masks, upserts, maintenance and failures."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basaltine.operators.predicates import Field
from basaltine.functions.ranges import enum_ordinal, make_range, range_contains, range_order, range_overlaps
from basaltine.sources.manifest import Store
from basaltine.sources.options import ColOptions, RowOptions, parse_orderby
from basaltine.sources.session import Settings
from basaltine.sources.table import ColTable, RowTable, open_table

SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.DoubleType()), T.StructField("s", T.StringType())])


def make(spark, path, n=5000, kind=ColTable, **options):
    sizes = {"stripe_row_limit": 1000, "chunk_group_row_limit": 1000} if kind is ColTable else {"batch_size": 1000}
    df = spark.range(n).select(F.col("id").alias("k"), (F.col("id") * 0.5).alias("v"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("s"), F.col("id"))).alias("s")).coalesce(1)
    return kind.create_as(df, f"file://{path}/t", **sizes | options)


def test_options():
    assert ColOptions().changed(compression=None, stripe_row_limit=2000).stripe_row_limit == 2000
    for bad in ({"compression": "lzma"}, {"compression_level": 20}, {"stripe_row_limit": 10}, {"orderby": "a sideways"}, {"nope": 1}):
        with pytest.raises(ValueError):
            ColOptions().changed(**bad)
    with pytest.raises(ValueError):
        RowOptions().changed(batch_size=10)
    assert ColOptions(compression="lz4").reset("compression").compression == "zstd"
    keys = parse_orderby('a, "b c" DESC, d desc nulls last')
    assert [(k.column, k.descending, k.nulls_first) for k in keys] == [("a", False, False), ("b c", True, True), ("d", True, False)]


def test_pruning(spark, tmp_path):
    t = make(spark, tmp_path)
    assert t.count() == 5000 and len(t.manifest.stripes) == 5
    where = Field("k").between(1200, 1300)
    assert t.prune_report(where)["stripes_removed"] == 4
    assert t.read(where).count() == t.read(where, pushdown=False).count() == 101
    # OR needs every part refuted, <> and NOT never prune.
    assert t.prune_report((Field("k") < 10) | (Field("s") == "zzz"))["stripes_removed"] == 4
    assert t.prune_report((Field("k") < 10) | Field("s").is_null())["stripes_removed"] == 0
    assert t.prune_report(Field("k") != 5)["stripes_removed"] == 0
    assert t.prune_report(~(Field("k") < 10))["stripes_removed"] == 0
    assert t.prune_report((Field("k") < 10) & Field("s").is_null())["stripes_removed"] == 4


def test_nan_and_null_ranges(spark, tmp_path):
    t = ColTable.create(spark, f"file://{tmp_path}/t", SCHEMA)
    t.insert(spark.createDataFrame([(1, float("nan"), None), (2, 1.0, None)], SCHEMA).coalesce(1))
    ranges = t.manifest.stripes[0].ranges
    assert "v" not in ranges and "s" not in ranges
    assert t.read(Field("v") > 5.0).count() == 1  # NaN is greatest
    assert t.prune_report(Field("s") == "a")["stripes_removed"] == 0


def test_delete_is_null_aware(spark, tmp_path):
    t = make(spark, tmp_path)
    gone = t.delete(Field("s") == "s1")
    assert gone == 1 and t.count() == t.read().count() == 4999
    assert t.delete("s like 's%'") == 3332
    assert t.read().where("s is not null").count() == 0 and t.count() == 1667
    assert t.delete() == 1667 and t.count() == 0


def test_update_sees_old_values(spark, tmp_path):
    t = make(spark, tmp_path, 10)
    assert t.update({"k": "k + 1", "v": "cast(k as double)"}, Field("k") == 4) == 1
    assert sorted((r.k, r.v) for r in t.read().where("k = 5").collect()) == [(5, 2.5), (5, 4.0)]
    with pytest.raises(ValueError):
        t.update({"nope": "1"})


def test_upsert(spark, tmp_path):
    t = make(spark, tmp_path, 10)
    new = spark.createDataFrame([(3, 9.0, "x"), (20, 8.0, "y"), (None, 7.0, "z"), (None, 6.0, "z")], SCHEMA)
    assert t.upsert(new, ["k"]) == (3, 0)
    assert t.upsert(new.where("k is not null"), ["k"], {"v": "excluded.v + v"}) == (0, 2)
    assert {r.k: r.v for r in t.read().where("k in (3, 20)").collect()} == {3: 10.5, 20: 16.0}
    with pytest.raises(ValueError):
        t.upsert(new.union(new), ["k"], {"v": "excluded.v"})


def test_bulk_update_resumes(spark, tmp_path, monkeypatch):
    t = make(spark, tmp_path)
    publish, calls = Store.publish, []

    def failing(self, m):
        calls.append(1)
        if len(calls) == 3:
            raise OSError("lost")
        return publish(self, m)

    monkeypatch.setattr(Store, "publish", failing)
    with pytest.raises(OSError):
        t.bulk_update({"v": "v + 1"}, "k % 2 = 0", batch_size=1000)
    monkeypatch.setattr(Store, "publish", publish)
    assert t.bulk_update({"v": "v + 1"}, "k % 2 = 0", batch_size=1000) == 2500
    want = sum(k * 0.5 + (k % 2 == 0) for k in range(5000))
    assert t.read().agg(F.sum("v")).first()[0] == want
    with pytest.raises(ValueError):
        t.bulk_update({"v": "1"}, skip_columns=["v"])


def test_maintenance(spark, tmp_path):
    t = make(spark, tmp_path, orderby="k DESC")
    t.delete("k < 1500")
    assert t.repack(0.9) == 2 and t.read().count() == 3500
    with pytest.raises(ValueError):
        t.repack(2)
    t.insert(spark.createDataFrame([(1, 1.0, "a")], SCHEMA))
    t.insert(spark.createDataFrame([(2, 1.0, "a")], SCHEMA))
    assert t.vacuum() >= 2 and t.count() == t.read().count() == 3502
    t.merge()
    stripes = t.manifest.stripes
    assert all(a.ranges["k"][0] >= b.ranges["k"][1] for a, b in zip(stripes, stripes[1:], strict=False))
    assert t.clean() > 0 and t.read().count() == 3502
    assert t.smart_update({"s": "'z'"}, Field("k") == 4999) == 1 and t.read().where("s = 'z'").count() == 1


def test_schema_changes(spark, tmp_path):
    t = make(spark, tmp_path, 10)
    t.add_column(T.StructField("n", T.IntegerType()), 7)
    t.insert(spark.createDataFrame([(100, 1.0, "a", None)], T.StructType([*SCHEMA, T.StructField("n", T.IntegerType())])))
    assert {r.n for r in t.read().collect()} == {7, None}
    t.rename_column("n", "m")
    assert t.read("m = 7").count() == 10
    t.drop_column("v")
    t.alter_type("k", T.StringType())
    assert t.read().columns == ["k", "s", "m"] and t.read().where("k = '100'").first().m is None


def test_row_table(spark, tmp_path):
    t = make(spark, tmp_path, kind=RowTable, pruning_column="k")
    assert t.prune_report(Field("k") < 100)["stripes_removed"] == 4
    assert t.prune_report(Field("v") < 10.0)["stripes_removed"] == 0
    t.set_options(pruning_column="")
    assert t.prune_report(Field("k") < 100)["stripes_removed"] == 0
    with pytest.raises(ValueError):
        t.set_options(pruning_column="nope")
    assert isinstance(open_table(spark, t.path), RowTable)
    with pytest.raises(ValueError):
        ColTable(spark, t.path).count()


def test_lost_race(spark, tmp_path):
    t = make(spark, tmp_path, 10)
    a, b = t.manifest, t.manifest
    t.store.publish(a)
    with pytest.raises(RuntimeError):
        t.store.publish(b)


def test_empty(spark, tmp_path):
    t = ColTable.create(spark, f"file://{tmp_path}/t", SCHEMA)
    assert t.read().count() == 0 and t.delete("k = 1") == 0 and t.update({"v": "1"}) == 0
    assert t.merge() == 0 and t.vacuum() == 0 and t.insert(t.read()) == 0


def test_positions_statistics_and_keys(spark, tmp_path):
    t = make(spark, tmp_path, 30)
    assert t.positions(Field("k") == 4).select("k", "row_index").collect() == [(4, 4)]
    stats = {r.column: r for r in t.analyze().collect()}
    assert stats["k"].rows == 30 and stats["k"].greatest == "29" and abs(stats["s"].null_share - 1 / 3) < 1e-9
    assert t.cached(["k"]).count() == 30
    t.check_unique(["k"])
    t.insert(t.read().where("k = 3"))
    with pytest.raises(ValueError):
        t.check_unique(["k"])
    with pytest.raises(ValueError):
        t.sample(0.5)


def test_session_settings(spark):
    with pytest.raises(ValueError):
        Settings(compression_level=30)
    conf = Settings(compression="lz4", vectorization=False).conf()
    assert conf["spark.sql.parquet.compression.codec"] == "lz4_raw" and conf["spark.sql.codegen.wholeStage"] == "false"


def test_ranges_and_enums(spark):
    r = lambda *a: spark.range(1).select(make_range(*a).alias("r"))
    assert r(1, 5).select(range_contains(F.col("r"), 1), range_contains(F.col("r"), 5)).first() == (True, False)
    assert r(None, 5, "(]").select(range_contains(F.col("r"), 5), range_contains(F.col("r"), -100)).first() == (True, True)
    assert r(3, 3).select("r.empty", range_contains(F.col("r"), 3)).first() == (True, False)
    touch = spark.range(1).select(range_overlaps(make_range(1, 3), make_range(3, 5)), range_overlaps(make_range(1, 3, "[]"), make_range(3, 5)), range_overlaps(make_range(1, 3), make_range(2, None)))
    assert touch.first() == (False, True, True)
    ordered = spark.range(1).select(F.explode(F.array(make_range(2, 4), make_range(2, 3), make_range(F.lit(None).cast("int"), 9), make_range(7, 7))).alias("r")).orderBy(range_order(F.col("r")))
    assert [(x.r.lower, x.r.upper) for x in ordered.collect()] == [(None, None), (None, 9), (2, 3), (2, 4)]
    moods = spark.createDataFrame([("ok",), ("sad",), (None,)], "m string").select(enum_ordinal("m", ["sad", "ok"]).alias("o"))
    assert [x.o for x in moods.collect()] == [2, 1, None]


def test_two_writers_at_once(spark, tmp_path):
    """Of writers that start from one version exactly one publishes the next, however close they are."""
    import threading

    t = make(spark, tmp_path, 10)
    for _ in range(20):
        barrier, out = threading.Barrier(4), []

        def publish(m, barrier=barrier, out=out):
            barrier.wait()
            try:
                Store(t.store.root if "://" in t.store.root else t.store.root).publish(m)
                out.append(True)
            except RuntimeError:
                out.append(False)

        writers = [threading.Thread(target=publish, args=(t.manifest,)) for _ in range(4)]
        for w in writers:
            w.start()
        for w in writers:
            w.join()
        assert sorted(out) == [False, False, False, True]


def test_nan_and_instants_prune_safely(spark, tmp_path, monkeypatch):
    import datetime as dt
    import time

    t = make(spark, tmp_path, 2000)
    for op in ("__lt__", "__le__", "__gt__", "__ge__", "__eq__"):
        where = getattr(Field("v"), op)(float("nan"))
        assert t.read(where).count() == t.read(where, pushdown=False).count()
    when = dt.datetime(2024, 5, 1, 12)
    u = ColTable.create_as(spark.createDataFrame([(when,)], "w timestamp").coalesce(1), f"file://{tmp_path}/u")
    assert u.read(Field("w") == when).count() == 1 and u.prune_report(Field("w") > when)["stripes_removed"] == 1
    span = u.manifest.stripes[0].ranges["w"]
    assert span[0].tzinfo is not None and span[0].timestamp() == when.timestamp()
    monkeypatch.setenv("TZ", "America/New_York")
    time.tzset()
    try:
        here = dt.datetime.fromtimestamp(span[0].timestamp())
        assert u.prune_report(Field("w") == here)["stripes_removed"] == 0
    finally:
        monkeypatch.undo()
        time.tzset()


def test_schema_changes_are_checked(spark, tmp_path):
    t = make(spark, tmp_path, 10, orderby="k DESC, s")
    for bad in (lambda: t.rename_column("nope", "x"), lambda: t.drop_column("nope"), lambda: t.alter_type("nope", T.LongType()), lambda: t.drop_column("k"), lambda: t.insert(t.read().withColumn("more", F.lit(1)))):
        with pytest.raises(ValueError):
            bad()
    t.rename_column("k", "key")
    t.insert(t.read())
    assert t.manifest.options["orderby"].startswith('"key" DESC') and t.count() == 20
    t.insert(spark.createDataFrame([(7,)], "key long"))
    assert t.read("key = 7 and v is null and s is null").count() == 1
    r = make(spark, f"{tmp_path}/r", 10, RowTable, pruning_column="k")
    r.rename_column("k", "key")
    assert r.manifest.options["pruning_column"] == "key"


def test_update_evaluates_once(spark, tmp_path):
    t = make(spark, tmp_path, 3000)
    n = t.update({"s": "'hit'"}, "rand() < 0.5")
    assert 0 < n < 3000 and t.count() == t.read().count() == t.read().select("k").distinct().count() == 3000
    assert t.read("s = 'hit'").count() == n


def test_excluded_in_a_literal(spark, tmp_path):
    t = make(spark, tmp_path, 3)
    t.upsert(spark.createDataFrame([(1, 9.0, "x")], SCHEMA), ["k"], {"s": "concat('excluded.s ', excluded.s)"})
    assert t.read("k = 1").first().s == "excluded.s x"


def test_row_mask_is_a_bitmap_for_each_file(spark, tmp_path, monkeypatch):
    """What tasks are sent of a row mask doesn't grow with its rows: one entry for 8192 rows of a file."""
    from basaltine.sources import table

    t = make(spark, tmp_path, 20_000, stripe_row_limit=9000)
    assert t.delete("k % 2 = 0") == 10_000
    m = t.manifest
    assert spark.read.parquet(*(f"{t.path}/{p}" for p in m.masks)).count() == 5
    assert [s.deleted for s in m.stripes] == [4500, 4500, 1000]
    want = list(range(1, 20_000, 2))
    assert sorted(r.k for r in t.read().collect()) == want
    # A second mask, of which a file has fewer words, and one of an earlier release.
    assert t.delete("k % 4 = 1 and k < 9100") == 2275 and t.delete("k % 4 = 1 and k < 9100") == 0
    m = t.manifest
    spark.createDataFrame([(m.stripes[2].file.rpartition("/")[2], 1999)], "file string, row_index long").write.parquet(f"{t.path}/masks/old")
    m.masks.append("masks/old")
    t.store.publish(m)
    want = [k for k in want if not (k % 4 == 1 and k < 9100) and k != 19_999]
    assert sorted(r.k for r in t.read().collect()) == want
    monkeypatch.setattr(table, "_SENT_MASK", 0)
    t.set_options(compression="none")
    assert sorted(r.k for r in t.read().collect()) == want
    assert t.merge() == len(want) and t.manifest.mask_bytes == 0 and t.count() == t.read().count() == len(want)


def test_many_files_are_listed_by_folder_and_in_order(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrameReader

    t = make(spark, tmp_path, 100_550, RowTable, batch_size=100)
    stripes = t.manifest.stripes
    assert [s.ranges["k"][0] for s in stripes] == list(range(0, 100_550, 100)) and [s.row_count for s in stripes[-2:]] == [100, 50]
    given, parquet = [], DataFrameReader.parquet
    monkeypatch.setattr(DataFrameReader, "parquet", lambda self, *paths, **options: (given.append(paths), parquet(self, *paths, **options))[1])
    assert t.read().count() == 100_550 and len(given[-1]) == 1
    # A folder of which the table has only some files.
    m = t.manifest
    m.stripes = m.stripes[:5] + m.stripes[500:700]
    t.store.publish(m)
    assert t.read().agg(F.count("k"), F.min("k"), F.max("k")).first() == (20_500, 0, 69_999) and len(given[-1]) == 1
    assert t.read().where("k between 500 and 49999").count() == 0


def test_row_batches_masked_and_updated(spark, tmp_path):
    t = make(spark, tmp_path, 5000, RowTable)
    assert t.delete("k <= 100") == 101 and t.update({"v": "v + k"}, "k % 2 = 0") == 2449
    assert spark.read.parquet(*(f"{t.path}/{p}" for p in t.manifest.masks)).count() == 6  # by file, not by row
    assert sorted((r.k, r.v) for r in t.read().collect()) == [(k, k * 0.5 + k * (k % 2 == 0)) for k in range(101, 5000)]


def test_bulk_update_publishes_a_bounded_number_of_times(spark, tmp_path, monkeypatch):
    from basaltine.sources import table

    t = make(spark, tmp_path, 12_000)
    publish, calls = Store.publish, []
    monkeypatch.setattr(table, "_ROUNDS", 3)
    monkeypatch.setattr(Store, "publish", lambda self, m: (calls.append(list(m.progress["left"]) if m.progress else None), publish(self, m))[1])
    before = {s.file for s in t.manifest.stripes}
    assert t.bulk_update({"v": "-1"}, "k % 2 = 0 and k between 3500 and 4499", batch_size=1000) == 500
    assert [c if c is None else len(c) for c in calls] == [12, 8, 4, 0, None]
    assert len(before & {s.file for s in t.manifest.stripes}) == 10  # two batches of twelve hold a match
    assert t.count() == t.read().count() == 12_000 and t.read("v = -1 and k % 2 = 0 and k between 3500 and 4499").count() == t.read("v = -1").count() == 500


def test_merge_takes_a_task_for_many_stripes(spark, tmp_path, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    t = make(spark, tmp_path, 12_000, orderby="k DESC")
    t.insert(t.read())
    given, by_range = [], DataFrame.repartitionByRange
    monkeypatch.setattr(DataFrame, "repartitionByRange", lambda self, n, *keys: (given.append(n), by_range(self, n, *keys))[1])
    assert t.merge() == 24_000 and given == [1]
    stripes = t.manifest.stripes
    assert [s.row_count for s in stripes] == [1000] * 24
    assert all(a.ranges["k"][0] >= b.ranges["k"][1] for a, b in zip(stripes, stripes[1:], strict=False))


def test_vacuum_takes_a_task_for_many_stripes(spark, tmp_path):
    t = make(spark, tmp_path, 12_000)
    t.delete("k % 4 = 0")
    assert t.vacuum() == 12
    stripes = t.manifest.stripes
    assert [s.row_count for s in stripes] == [1000] * 9 and len({s.file.rpartition("/")[2].split("-")[1] for s in stripes}) == 1
    assert sorted(r.k for r in t.read().collect()) == [k for k in range(12_000) if k % 4]


@pytest.mark.parametrize("change", [lambda t: t.repack(0.9), lambda t: t.vacuum(2)])
def test_rewrites_read_a_small_mask(spark, tmp_path, change):
    """Also where stripes stay masked beside those rewritten, and entries of the mask are of files that went."""
    t = make(spark, tmp_path, 6000)
    t.delete("k < 2000 and k % 2 = 0 or k >= 2000 and k % 50 = 0")
    assert spark.read.parquet(*(f"{t.path}/{p}" for p in t.manifest.masks)).count() == 6
    assert change(t) == 2
    m = t.manifest
    assert sorted(s.deleted for s in m.stripes)[-4:] == [20] * 4 and m.masks
    want = [k for k in range(6000) if (k % 2 if k < 2000 else k % 50)]
    assert t.count() == len(want) and sorted(r.k for r in t.read().collect()) == want


def test_row_batches_share_files(spark, tmp_path, monkeypatch):
    """Files don't grow in number with batches; ranges, deleted rows and pruning are still of each batch."""
    import os

    from basaltine.sources import table

    monkeypatch.setattr(table, "_FILE_ROWS", 4300, raising=False)
    t = make(spark, tmp_path, 10_500, RowTable, pruning_column="k")
    stripes = t.manifest.stripes
    files = {s.file for s in stripes}
    assert len(stripes) == 11 and len(files) == 3 and [s.ranges["k"] for s in stripes[-2:]] == [[9000, 9999], [10_000, 10_499]]
    assert sum(s.data_length for s in stripes) == sum(os.path.getsize(f"{tmp_path}/t/{f}") for f in files)
    assert t.delete("k < 1500 or k = 4001") == 1501 and [s.deleted for s in t.manifest.stripes] == [1000, 500, 0, 0, 1] + [0] * 6
    assert t.prune_report(Field("k") > 8500)["stripes_removed"] == 8
    want = [k for k in range(1500, 10_500) if k != 4001]
    m = t.manifest
    for few in (32, 0):  # by their paths, by their folders
        monkeypatch.setattr(table, "_BY_PATH", few)
        assert sorted(r.k for r in t.read().collect()) == want
        assert t.read(Field("k").between(1400, 4002)).count() == 2502
        some = t._files(m, m.stripes[1:2] + m.stripes[10:], SCHEMA)  # not the other batches of their files
        assert sorted(r.k for r in some.collect()) == [*range(1500, 2000), *range(10_000, 10_500)]
    assert t.positions(Field("k") == 4002).select("k", "row_index").collect() == [(4002, 2)]
    assert t.update({"v": "-1"}, "k in (1500, 9999)") == 2 and t.read("v = -1").count() == 2
    t.set_options(batch_size=400)
    t.repack()
    assert {s.row_count for s in t.manifest.stripes[:-1]} <= {400, *range(1, 400)} and t.count() == len(want)
    assert sorted(r.k for r in t.read().collect()) == want and t.clean() > 0 and t.read().count() == len(want)


def test_repacked_batches_share_a_file_and_a_long_manifest_is_read_back(spark, tmp_path):
    t = make(spark, tmp_path, 20_000, RowTable)
    t.delete("k <= 300")
    t.set_options(batch_size=100)
    assert t.repack() == 197 and len({s.file for s in t.manifest.stripes}) == 1
    assert [s.row_count for s in t.manifest.stripes] == [100] * 196 + [99] and t.manifest.stripes[1].ranges["k"] == [401, 500]
    assert t.read().agg(F.count("k"), F.sum("k")).first() == (19_699, sum(range(301, 20_000)))
    m = t.manifest
    one = m.stripes[0]
    for n in (0, 1, 1000, 2500):
        m.stripes = [one] * n
        t.store.publish(m)
        assert t.manifest == m


def test_sorted_merge_reads_a_small_mask(spark, tmp_path):
    """What a merge's tasks are sent is an entry for each file with deleted rows, also of a table with a sort key."""
    t = make(spark, tmp_path, 6000, orderby="s DESC, k")
    t.delete("k % 3 = 0")
    files = len({s.file for s in t.manifest.stripes if s.deleted})
    assert spark.read.parquet(*(f"{t.path}/{p}" for p in t.manifest.masks)).count() == files
    assert t.merge() == 4000 and not t.manifest.masks
    want = sorted((k for k in range(6000) if k % 3), key=lambda k: f"s{k}", reverse=True)
    assert [r.k for r in t.read().orderBy(F.col("s").desc()).collect()] == want
    spans = [s.ranges["s"] for s in t.manifest.stripes]
    assert all(a[0] >= b[1] for a, b in zip(spans, spans[1:], strict=False))


def test_batches_of_several_sizes_and_of_earlier_releases(spark, tmp_path, monkeypatch):
    from basaltine.sources import table

    monkeypatch.setattr(table, "_FILE_ROWS", 2500)
    t = make(spark, tmp_path, 5000, RowTable, pruning_column="k")
    t.set_options(batch_size=700)
    t.insert(t.read().withColumn("k", F.col("k") + 5000).coalesce(1))
    m = t.manifest
    assert sorted(m.steps.values()) == [700, 1000]
    for few in (32, 0):
        monkeypatch.setattr(table, "_BY_PATH", few)
        assert t.read().count() == 10_000 and t.read().agg(F.sum("k")).first()[0] == sum(range(10_000))
        assert t.read(Field("k").between(4990, 5710)).count() == 721
    assert t.delete("k between 4500 and 5800") == 1301
    assert [s.deleted for s in t.manifest.stripes] == [0] * 4 + [500, 700, 101] + [0] * 6
    assert t.delete("k between 4400 and 5900") == 200 and t.read().count() == t.count() == 8499
    # file per batch, as an earlier release wrote it
    m = t.manifest
    folder = "data/old"
    spark.range(20_000, 20_300).select(F.col("id").alias("k"), F.lit(1.0).alias("v"), F.lit("x").alias("s")).coalesce(1).write.option("maxRecordsPerFile", 100).parquet(f"{t.path}/{folder}")
    m.stripes += t._measured(folder, SCHEMA, m)
    t.store.publish(m)
    assert t.delete("k >= 20050 and k < 20150") == 100 and [s.deleted for s in t.manifest.stripes[-3:]] == [50, 50, 0]
    assert t.read().count() == t.count() == 8699
    t.repack()
    assert t.read().count() == t.count() == 8699
    t.truncate()
    assert t.read().count() == 0 and not t.manifest.steps
    assert t.insert(t.read()) == 0 and t.repack() == 0


def test_a_folder_that_lost_few_files_is_read_without_naming_the_others(spark, tmp_path, monkeypatch):
    """What the driver plans with doesn't grow with the files that a vacuum left."""
    from pyspark.sql.classic.dataframe import DataFrame

    from basaltine.sources import table

    t = make(spark, tmp_path, 50_000)
    t.delete("k % 4 = 0")
    assert t.vacuum(2) == 2 and len(t.manifest.stripes) == 50
    given, where = [], DataFrame.where
    monkeypatch.setattr(DataFrame, "where", lambda self, c: (given.append(c), where(self, c))[1])
    named = lambda: [c.count(".parquet") for c in given if isinstance(c, str)]
    want = [k for k in range(50_000) if k % 4]
    assert sorted(r.k for r in t.read().collect()) == want and named() == [2]
    m = t.manifest
    assert t.clean() == 2
    given.clear()
    assert sorted(r.k for r in t.read().collect()) == want and named() == []
    given.clear()
    monkeypatch.setattr(table, "_BY_PATH", 3)
    assert t._files(m, m.stripes[:4], SCHEMA).count() == 3000 and named() == [4]  # of few, these


def test_sorted_insert_is_dealt_to_tasks_of_bounded_rows(spark, tmp_path, monkeypatch):
    """What one task sorts doesn't grow with what it is given, here all rows, nor with the rows of one key."""
    import os

    from basaltine.sources import table

    monkeypatch.setattr(table, "_SORT_ROWS", 2000, raising=False)
    t = make(spark, tmp_path, 10_000, orderby="s DESC, k")

    def check(n):
        stripes, tasks = t.manifest.stripes, {}
        for s in stripes:
            task = s.file.rpartition("-c")[0]
            tasks[task] = tasks.get(task, 0) + s.row_count
        assert sum(tasks.values()) == n and len(tasks) == n // 2000 and max(tasks.values()) < 4000
        return stripes

    stripes = check(10_000)
    spans = [s.ranges["s"] for s in stripes if "s" in s.ranges]  # nulls first, a third of the rows
    assert all(a[0] >= b[1] for a, b in zip(spans, spans[1:], strict=False)) and stripes[0].nulls["s"] == 1000
    assert sorted(r.k for r in t.read().collect()) == list(range(10_000)) and not os.listdir(f"{tmp_path}/t/unsorted")
    assert t.update({"s": "'one'"}) == 10_000 and t.read("s = 'one'").count() == 10_000
    monkeypatch.setattr(table, "_TASK_ROWS", 2000)
    t.set_options(orderby="s")
    assert t.merge() == 10_000
    check(10_000)
    assert sorted(r.k for r in t.read("s = 'one'").collect()) == list(range(10_000))
