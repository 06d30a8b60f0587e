"""Operations on tables: each makes one, changes it and returns its rows or a report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.predicates import Field
from ..sources.scratch import scratch
from ..sources.table import ColTable, RowTable, convert
from .registry import Query, tables

_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
_PLAIN = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir, "orders")[0].select(*_COLUMNS)


def _table(spark: SparkSession, sf_dir: str, kind=ColTable, **options):
    sizes = {"stripe_row_limit": 2000, "chunk_group_row_limit": 1000} if kind is ColTable else {"batch_size": 1000}
    return kind.create_as(_orders(spark, sf_dir), scratch(spark), **sizes | options)


def _on(change, kind=ColTable, **options):
    """A query that makes a table of orders, applies ``change`` and returns the rows."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = _table(spark, sf_dir, kind, **options)
        return change(t) or t.read()

    return run


def _do(*steps):
    def change(t):
        for s in steps:
            s(t)

    return change


def _prune_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, orderby="o_orderkey")
    t.merge()
    where = Field("o_orderkey").between(100, 900) & (Field("o_custkey") > 10)
    report = t.prune_report(where)
    assert report["stripes"] < 2 or report["stripes_removed"] > 0
    return t.read(where)


def _upserted(update):
    def change(t):
        new = t.read().withColumn("o_orderkey", F.col("o_orderkey") + 100).withColumn("o_orderstatus", F.lit("N")).dropDuplicates(["o_orderkey"])
        more = new.limit(0) if update is None else new
        t.upsert(new if update is None else more, ["o_orderkey"], update)

    return change


def _add_column(t) -> None:
    t.add_column(T.StructField("note", T.StringType()), "old")
    t.insert(t.read().where("o_orderkey <= 50").withColumn("note", F.lit(None).cast("string")))


def _alter(t) -> None:
    t.rename_column("o_custkey", "customer")
    t.drop_column("o_orderstatus")
    t.alter_type("o_totalprice", T.DecimalType(15, 2))


def _matview(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _orders(spark, sf_dir)
    view = ColTable.create_as(orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")), scratch(spark))
    view.truncate()
    view.insert(orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")))
    return view.read()


def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir)
    path = scratch(spark)
    t.export_csv(path)
    u = ColTable.create(spark, scratch(spark), t.schema)
    u.insert_csv(path)
    return u.read()


def _one_writer(kind, size: str, view):
    """A report on a table that one task wrote, so that its files are the same everywhere."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return view(kind.create_as(_orders(spark, sf_dir).coalesce(1), scratch(spark), **{size: 2000}))

    return run


_FILES = "(SELECT i, least(2000, n - 2000 * i) AS k FROM (SELECT CAST(unnest(range(CAST(ceil(n / 2000) AS BIGINT))) AS BIGINT) AS i, n FROM (SELECT count(*) AS n FROM orders)))"


def _rename_key(t) -> None:
    t.rename_column("o_custkey", "customer")
    t.insert(t.read())
    t.merge()


def _default(t) -> None:
    t.add_column(T.StructField("note", T.StringType()), "old")
    t.insert(t.read().drop("note"))


def _reset(t) -> DataFrame:
    t.set_options(compression="lz4", stripe_row_limit=3000, orderby="o_orderkey")
    t.reset_options("compression", "orderby")
    return t.options_view().drop("table_name")


_BIG = "o_totalprice > 200000"
_SET = {"o_totalprice": "o_totalprice + o_custkey", "o_orderstatus": "'U'"}
_UPDATED = f"SELECT o_orderkey, o_custkey, CASE WHEN {_BIG} THEN 'U' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN {_BIG} THEN o_totalprice + o_custkey ELSE o_totalprice END AS o_totalprice FROM orders"
_NEW = "(SELECT o_orderkey + 100 AS o_orderkey, o_custkey, 'N' AS o_orderstatus, o_totalprice FROM orders)"

QUERIES = {
    "tbl_roundtrip": Query(_on(_do()), _PLAIN),
    "tbl_projection": Query(_on(lambda t: t.read(columns=["o_orderkey", "o_orderstatus"])), "SELECT o_orderkey, o_orderstatus FROM orders"),
    "tbl_prune_range": Query(_prune_range, f"{_PLAIN} WHERE o_orderkey BETWEEN 100 AND 900 AND o_custkey > 10"),
    "tbl_prune_off": Query(_on(lambda t: t.read((Field("o_orderkey") < 300) | (Field("o_custkey") == 7), pushdown=False)), f"{_PLAIN} WHERE o_orderkey < 300 OR o_custkey = 7"),
    "tbl_merge_sorted": Query(_on(_do(lambda t: t.delete("o_orderkey % 3 = 0"), lambda t: t.merge()), orderby="o_custkey DESC, o_orderkey"), f"{_PLAIN} WHERE o_orderkey % 3 <> 0"),
    "tbl_insert_self": Query(_on(_do(lambda t: t.insert(t.read()))), f"{_PLAIN} UNION ALL {_PLAIN}"),
    "tbl_delete": Query(_on(_do(lambda t: t.delete((Field("o_totalprice") > 200000.0) & (Field("o_orderkey") < 5000)))), f"{_PLAIN} WHERE (o_totalprice > 200000 AND o_orderkey < 5000) IS NOT TRUE"),
    "tbl_delete_twice": Query(_on(_do(lambda t: t.delete("o_orderkey < 500"), lambda t: t.delete("o_orderkey < 1000"))), f"{_PLAIN} WHERE o_orderkey >= 1000"),
    "tbl_update": Query(_on(_do(lambda t: t.update(_SET, _BIG))), _UPDATED),
    "tbl_upsert_nothing": Query(_on(_upserted(None)), f"{_PLAIN} UNION ALL SELECT * FROM {_NEW} x WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)"),
    "tbl_upsert_update": Query(
        _on(_upserted({"o_orderstatus": "excluded.o_orderstatus", "o_totalprice": "o_totalprice + excluded.o_totalprice"})),
        f"SELECT o.o_orderkey, o.o_custkey, coalesce(x.o_orderstatus, o.o_orderstatus) AS o_orderstatus, o.o_totalprice + coalesce(x.o_totalprice, 0) AS o_totalprice FROM orders o LEFT JOIN {_NEW} x ON o.o_orderkey = x.o_orderkey UNION ALL SELECT * FROM {_NEW} x WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)",
    ),
    "tbl_smart_update": Query(_on(_do(lambda t: t.smart_update(_SET, _BIG))), _UPDATED),
    "tbl_bulk_update": Query(_on(_do(lambda t: t.bulk_update(_SET, _BIG, batch_size=3000))), _UPDATED),
    "tbl_repack": Query(_on(_do(lambda t: t.delete("o_orderkey % 2 = 0"), lambda t: t.repack(0.9))), f"{_PLAIN} WHERE o_orderkey % 2 <> 0"),
    "tbl_vacuum": Query(_on(_do(lambda t: t.insert(t.read().where("o_orderkey < 200")), lambda t: t.delete("o_orderkey % 4 = 0"), lambda t: t.vacuum())), f"SELECT * FROM ({_PLAIN} UNION ALL {_PLAIN} WHERE o_orderkey < 200) t WHERE o_orderkey % 4 <> 0"),
    "tbl_truncate": Query(_on(_do(lambda t: t.truncate(), lambda t: t.insert(t.read()))), f"{_PLAIN} WHERE o_orderkey < 0"),
    "tbl_add_column_default": Query(_on(_do(_add_column)), "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, 'old' AS note FROM orders UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, NULL AS note FROM orders WHERE o_orderkey <= 50"),
    "tbl_alter": Query(_on(_do(_alter)), "SELECT o_orderkey, o_custkey AS customer, CAST(o_totalprice AS DECIMAL(15,2)) AS o_totalprice FROM orders"),
    "tbl_matview": Query(_matview, "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey"),
    "tbl_csv": Query(_csv, _PLAIN),
    "tbl_convert": Query(_on(lambda t: convert(t, scratch(t.spark), RowTable).read()), _PLAIN),
    "row_roundtrip": Query(_on(_do(), RowTable), _PLAIN),
    "row_prune": Query(_on(lambda t: t.read(Field("o_orderkey") <= 700), RowTable, pruning_column="o_orderkey"), f"{_PLAIN} WHERE o_orderkey <= 700"),
    "row_delete_update": Query(_on(_do(lambda t: t.delete("o_orderkey <= 100"), lambda t: t.update(_SET, _BIG)), RowTable), f"{_UPDATED} WHERE o_orderkey > 100"),
    "row_repack": Query(_on(_do(lambda t: t.delete("o_orderkey <= 300"), lambda t: t.set_options(batch_size=500), lambda t: t.repack()), RowTable), f"{_PLAIN} WHERE o_orderkey > 300"),
    "cat_options": Query(_on(lambda t: t.options_view().drop("table_name")), "SELECT CAST(1000 AS BIGINT) AS chunk_group_row_limit, CAST(2000 AS BIGINT) AS stripe_row_limit, 'zstd' AS compression, CAST(3 AS BIGINT) AS compression_level, '' AS orderby, false AS index_scan"),
    "cat_stripes": Query(
        _one_writer(ColTable, "stripe_row_limit", lambda t: t.stripes_view().drop("table_name", "storage_id", "data_length", "file_path")),
        f"SELECT i + 1 AS stripe_num, CAST(0 AS BIGINT) AS file_offset, CAST(4 AS INTEGER) AS column_count, CAST(10000 AS INTEGER) AS chunk_row_count, k AS row_count, CAST(ceil(k / 10000) AS BIGINT) AS chunk_group_count, 2000 * i + 1 AS first_row_number, CAST(0 AS BIGINT) AS deleted_rows FROM {_FILES}",
    ),
    "cat_stripe_rows": Query(_on(lambda t: t.stripes_view().agg(F.sum("row_count").alias("n"), F.min("first_row_number").alias("first_row"))), "SELECT CAST(count(*) AS BIGINT) AS n, CAST(1 AS BIGINT) AS first_row FROM orders"),
    "cat_batches": Query(
        _one_writer(RowTable, "batch_size", lambda t: t.batches_view().drop("storage_id", "data_length")),
        f"SELECT i + 1 AS batch_num, CAST(0 AS BIGINT) AS file_offset, 2000 * i + 1 AS first_row_number, k AS row_count FROM {_FILES}",
    ),
    "cat_stats": Query(
        _one_writer(ColTable, "stripe_row_limit", lambda t: t.stats().drop("data_length")),
        f"SELECT i + 1 AS stripe_id, CAST(0 AS BIGINT) AS file_offset, k AS row_count, CAST(0 AS BIGINT) AS deleted_rows FROM {_FILES}",
    ),
    "cat_row_options": Query(_on(lambda t: t.options_view().drop("table_name"), RowTable), "SELECT CAST(1000 AS BIGINT) AS batch_size, 'zstd' AS compression, CAST(3 AS BIGINT) AS compression_level, '' AS pruning_column, false AS index_scan"),
    "tbl_set_reset_options": Query(_on(_reset), "SELECT CAST(1000 AS BIGINT) AS chunk_group_row_limit, CAST(3000 AS BIGINT) AS stripe_row_limit, 'zstd' AS compression, CAST(3 AS BIGINT) AS compression_level, '' AS orderby, false AS index_scan"),
    "tbl_prune_nan": Query(_on(lambda t: t.read(Field("o_totalprice") < float("nan"))), f"{_PLAIN} WHERE o_totalprice < CAST('NaN' AS DOUBLE)"),
    "tbl_rename_sort_key": Query(_on(_do(_rename_key), orderby="o_custkey DESC, o_orderkey"), "SELECT o_orderkey, o_custkey AS customer, o_orderstatus, o_totalprice FROM (SELECT * FROM orders UNION ALL SELECT * FROM orders) t"),
    "tbl_insert_default": Query(_on(_do(_default)), "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, 'old' AS note FROM (SELECT * FROM orders UNION ALL SELECT * FROM orders) t"),
    "tbl_point": Query(_on(lambda t: t.read(Field("o_orderkey") == 77), orderby="o_orderkey"), f"{_PLAIN} WHERE o_orderkey = 77"),
    "row_point": Query(_on(lambda t: t.read(Field("o_orderkey") == 77), RowTable, pruning_column="o_orderkey"), f"{_PLAIN} WHERE o_orderkey = 77"),
    "tbl_vacuum_count": Query(_on(_do(lambda t: t.insert(t.read().where("o_orderkey < 200")), lambda t: t.delete("o_orderkey % 4 = 0"), lambda t: t.vacuum(2))), f"SELECT * FROM ({_PLAIN} UNION ALL {_PLAIN} WHERE o_orderkey < 200) t WHERE o_orderkey % 4 <> 0"),
    "tbl_analyze": Query(_on(lambda t: t.analyze(["o_orderkey", "o_orderstatus"]).select("column", "rows", "null_share", "least", "greatest")), "SELECT 'o_orderkey' AS \"column\", count(*) AS rows, 0.0::DOUBLE AS null_share, CAST(min(o_orderkey) AS VARCHAR) AS least, CAST(max(o_orderkey) AS VARCHAR) AS greatest FROM orders UNION ALL SELECT 'o_orderstatus', count(*), 0.0::DOUBLE, min(o_orderstatus), max(o_orderstatus) FROM orders"),
    **{f"tbl_codec_{c}": Query(_on(lambda t: t.read(), compression=c), _PLAIN) for c in ("none", "pglz", "lz4", "deflate", "zxc")},
}
