"""Aggregates: widening sums, exact averages, extremes, distinct, filtered and grouped forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.semantics import UINT8, pg_avg, pg_sum, uint8_from_bigint
from .registry import Query, sql, tables


def _sum_bigint(spark: SparkSession, sf_dir: str) -> DataFrame:
    (orders,) = tables(spark, sf_dir, "orders")
    big = (F.col("o_orderkey") + F.lit(4_000_000_000_000_000_000)).alias("v")
    return orders.select(big).agg(pg_sum("v", T.LongType()).alias("total"))


def _avg_bigint(spark: SparkSession, sf_dir: str) -> DataFrame:
    (orders,) = tables(spark, sf_dir, "orders")
    return orders.agg(F.round(pg_avg("o_custkey", T.LongType()).cast("double"), 6).alias("avg_key"))


def _uint8_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    (events,) = tables(spark, sf_dir, "events")
    v = uint8_from_bigint(F.when(F.col("event_id") % 2 == 0, -F.col("event_id") - 1).otherwise(F.col("event_id"))).alias("v")
    return events.select(v).agg(F.min("v").cast("string").alias("lo"), F.max("v").cast("string").alias("hi"), F.sum(F.col("v").cast("decimal(38,0)")).cast("string").alias("total"))


def _money(spark: SparkSession, sf_dir: str) -> DataFrame:
    (customer,) = tables(spark, sf_dir, "customer")
    m = F.col("c_acctbal").cast("decimal(19,2)").alias("m")
    return customer.select("c_mktsegment", m).groupBy("c_mktsegment").agg(F.sum("m").cast("decimal(19,2)").alias("total"), F.min("m").alias("lo"), F.max("m").alias("hi"))


assert UINT8.precision == 20

QUERIES = {
    "agg_count_col": sql("SELECT count(*) AS n, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS n_f, count(o_orderpriority) AS n_p FROM orders"),
    "agg_sum_int": sql("SELECT CAST(sum(l_linenumber) AS BIGINT) AS s4, CAST(sum(CAST(l_linenumber AS SMALLINT)) AS BIGINT) AS s2 FROM lineitem"),
    "agg_sum_bigint": Query(_sum_bigint, "SELECT CAST(sum(CAST(o_orderkey AS HUGEINT) + 4000000000000000000) AS DECIMAL(38,0)) AS total FROM orders"),
    "agg_sum_double": sql("SELECT round(sum(l_tax), 4) AS s FROM lineitem"),
    "agg_sum_decimal": sql("SELECT sum(CAST(l_extendedprice AS DECIMAL(15,4))) AS s FROM lineitem"),
    "agg_sum_money": Query(_money, "SELECT c_mktsegment, CAST(sum(CAST(c_acctbal AS DECIMAL(19,2))) AS DECIMAL(19,2)) AS total, min(CAST(c_acctbal AS DECIMAL(19,2))) AS lo, max(CAST(c_acctbal AS DECIMAL(19,2))) AS hi FROM customer GROUP BY 1"),
    "agg_avg_int": sql("SELECT round(avg(l_linenumber), 6) AS a4, round(avg(CAST(l_linenumber AS SMALLINT)), 6) AS a2 FROM lineitem"),
    "agg_avg_bigint": Query(_avg_bigint, "SELECT round(avg(o_custkey), 6) AS avg_key FROM orders"),
    "agg_avg_double": sql("SELECT round(avg(l_discount), 6) AS a FROM lineitem"),
    "agg_avg_decimal": sql("SELECT round(CAST(avg(CAST(l_extendedprice AS DECIMAL(15,4))) AS DOUBLE), 4) AS a FROM lineitem"),
    "agg_minmax_int": sql("SELECT min(CAST(l_linenumber AS SMALLINT)) AS lo2, max(CAST(l_linenumber AS SMALLINT)) AS hi2, min(l_linenumber) AS lo4, max(l_linenumber) AS hi4, min(l_orderkey) AS lo8, max(l_orderkey) AS hi8 FROM lineitem"),
    "agg_minmax_double": sql("SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem"),
    "agg_minmax_decimal": sql("SELECT min(CAST(l_tax AS DECIMAL(12,4))) AS lo, max(CAST(l_tax AS DECIMAL(12,4))) AS hi FROM lineitem"),
    "agg_minmax_date": sql("SELECT CAST(min(CAST(o_orderdate AS DATE)) AS STRING) AS lo, CAST(max(CAST(o_orderdate AS DATE)) AS STRING) AS hi FROM orders"),
    "agg_minmax_text": sql("SELECT min(o_orderpriority) AS lo, max(o_orderpriority) AS hi FROM orders"),
    "agg_empty_null": sql("SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s, avg(l_tax) AS a, min(l_tax) AS lo, max(l_tax) AS hi FROM lineitem WHERE l_orderkey < 0"),
    "agg_all_null": sql("SELECT count(*) AS n, count(v) AS nv, CAST(sum(v) AS BIGINT) AS s, min(v) AS lo, max(v) AS hi FROM (SELECT CASE WHEN l_orderkey < 0 THEN l_linenumber END AS v FROM lineitem) t"),
    "agg_group_single_sorted": sql("SELECT l_linenumber, count(*) AS n, CAST(sum(l_suppkey) AS BIGINT) AS s, min(l_tax) AS lo, max(l_tax) AS hi FROM lineitem GROUP BY l_linenumber ORDER BY l_linenumber NULLS LAST"),
    "agg_group_many_keys": sql("SELECT l_orderkey, count(*) AS n, min(l_extendedprice) AS lo FROM lineitem GROUP BY l_orderkey"),
    "agg_group_multi": sql("SELECT o_orderstatus, o_orderpriority, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(15,2))) AS total FROM orders GROUP BY o_orderstatus, o_orderpriority"),
    "agg_group_null_key": sql("SELECT k, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END AS k FROM orders) t GROUP BY k"),
    "agg_having": sql("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 10"),
    "agg_distinct_count": sql("SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem"),
    "agg_distinct_row": sql("SELECT count(*) AS n FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem) t"),
    "agg_filter": sql("SELECT count(*) FILTER (WHERE l_quantity > 25) AS n_big, sum(CAST(l_extendedprice AS DECIMAL(15,2))) FILTER (WHERE l_discount < 0.03) AS s FROM lineitem"),
    "agg_stddev": sql("SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_samp(l_quantity), 4) AS va FROM lineitem GROUP BY l_returnflag"),
    "agg_percentile_cont": sql("SELECT o_orderstatus, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY o_totalprice), 4) AS med FROM orders GROUP BY o_orderstatus"),
    "agg_string": sql(
        "SELECT n_regionkey, array_join(array_sort(collect_list(n_name)), ',') AS names FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
    ),
    "agg_case": sql("SELECT o_orderpriority, sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(15,2)) END) AS f, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS n_o FROM orders GROUP BY o_orderpriority"),
    "agg_bool": sql("SELECT o_orderstatus, bool_and(o_totalprice > 1000) AS every_big, bool_or(o_totalprice > 400000) AS some_huge FROM orders GROUP BY o_orderstatus"),
    "agg_rollup": sql("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)"),
    "agg_cube": sql("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"),
    "agg_grouping_sets": sql("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())"),
    "uint8_order_minmax_sum": Query(
        _uint8_minmax,
        "SELECT CAST(min(v) AS VARCHAR) AS lo, CAST(max(v) AS VARCHAR) AS hi, CAST(sum(v) AS VARCHAR) AS total FROM (SELECT CASE WHEN event_id % 2 = 0 THEN CAST(18446744073709551616 AS HUGEINT) - event_id - 1 ELSE CAST(event_id AS HUGEINT) END AS v FROM events)",
    ),
}
