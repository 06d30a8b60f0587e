"""The ten benchmark shapes: count, sums, group-bys, date range, JSON, array and prefix predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.semantics import array_contains_all, jsonb_contains, jsonb_exists
from .registry import Query, sql, tables


def _json_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    (events,) = tables(spark, sf_dir, "events")
    return events.where(jsonb_contains("props", '{"k": 87}')).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("avg_value"))


def _json_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    (events,) = tables(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").alias("k")
    return events.where(jsonb_exists("props", "k")).groupBy(k).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,6)")).alias("sum_value"))


def _array_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    (events,) = tables(spark, sf_dir, "events")
    tags = F.array(F.concat(F.lit("tag_"), (F.col("event_id") % 20).cast("string")), F.concat(F.lit("cat_"), (F.col("event_id") % 8).cast("string")))
    return events.select(tags.alias("tags"), "value").where(array_contains_all("tags", ["tag_5", "cat_1"])).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("avg_value"))


QUERIES = {
    "q01_count_star": sql("SELECT count(*) AS n FROM lineitem"),
    "q02_sum_avg": sql(
        "SELECT sum(CAST(l_extendedprice AS DECIMAL(15,4))) AS sum_amount, round(avg(l_extendedprice), 6) AS avg_amount, sum(CAST(l_discount AS DECIMAL(15,4))) AS sum_discount, round(avg(l_discount), 6) AS avg_discount FROM lineitem"
    ),
    "q03_group_low_card": sql("SELECT event_type, count(*) AS n, round(avg(value), 6) AS avg_value FROM events GROUP BY event_type ORDER BY n DESC, event_type"),
    "q04_group_p95": sql(
        "SELECT l_shipmode_like AS grp, count(*) AS n, sum(CAST(l_extendedprice AS DECIMAL(15,4))) AS sum_amount, round(avg(l_quantity), 6) AS avg_qty, percentile_disc(0.95) WITHIN GROUP (ORDER BY l_quantity) AS p95 FROM (SELECT concat(l_returnflag, l_linestatus) AS l_shipmode_like, l_extendedprice, l_quantity FROM lineitem) t GROUP BY l_shipmode_like ORDER BY sum_amount DESC NULLS LAST"
    ),
    "q05_date_range": sql(
        "SELECT CAST(CAST(o_orderdate AS DATE) AS STRING) AS d, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(15,4))) AS total, round(avg(o_totalprice), 4) AS avg_price FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01 00:00:00' AND TIMESTAMP '1995-01-31 23:59:59' GROUP BY CAST(o_orderdate AS DATE) ORDER BY d"
    ),
    "q06_json_contains": Query(_json_contains, "SELECT count(*) AS n, round(avg(value), 6) AS avg_value FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) = 87"),
    "q07_json_key_group": Query(_json_key, "SELECT json_extract_string(props, '$.k') AS k, count(*) AS n, sum(CAST(value AS DECIMAL(18,6))) AS sum_value FROM events WHERE list_contains(json_keys(props), 'k') GROUP BY 1"),
    "q08_array_contains": Query(
        _array_contains,
        "SELECT count(*) AS n, round(avg(value), 6) AS avg_value FROM (SELECT ['tag_' || CAST(event_id % 20 AS VARCHAR), 'cat_' || CAST(event_id % 8 AS VARCHAR)] AS tags, value FROM events) WHERE list_has_all(tags, ['tag_5', 'cat_1'])",
    ),
    "q09_like_prefix": sql("SELECT count(*) AS n, sum(CAST(p_retailprice AS DECIMAL(15,4))) AS total FROM part WHERE p_type LIKE 'S%'"),
    "q10_multi_agg": sql(
        """SELECT l_returnflag, l_linestatus, count(*) AS n, sum(CAST(l_extendedprice AS DECIMAL(15,4))) AS sum_price, round(avg(l_extendedprice), 4) AS avg_price,
        min(l_extendedprice) AS min_price, max(l_extendedprice) AS max_price, sum(CAST(l_extendedprice AS DECIMAL(15,4)) * CAST(l_quantity AS DECIMAL(10,0))) AS sum_product,
        round(avg(l_tax), 6) AS avg_tax, count(DISTINCT l_suppkey) AS suppliers, sum(CASE WHEN l_discount > 0.05 THEN CAST(l_extendedprice AS DECIMAL(15,4)) END) AS sum_discounted
        FROM lineitem GROUP BY l_returnflag, l_linestatus ORDER BY n DESC, l_returnflag, l_linestatus"""
    ),
}
