"""Scalar functions and casts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranges import make_range, range_contains, range_overlaps
from ..functions.semantics import uint8, uint8_from_bigint, uint8_recv, uint8_send, uint8_to_bigint
from .registry import Query, sql, tables


def _uint8_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    (events,) = tables(spark, sf_dir, "events")
    u = uint8_from_bigint(-F.col("event_id") - 1)
    return events.select("event_id", u.cast("string").alias("u"), uint8_to_bigint(u).alias("back"), uint8(F.col("event_id").cast("string")).cast("string").alias("parsed"), F.hex(uint8_send(u)).alias("wire"), uint8_recv(uint8_send(u)).cast("string").alias("received"))


def _uint8_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    (events,) = tables(spark, sf_dir, "events")
    u = uint8_from_bigint(F.col("event_id") % 7 - 3).alias("u")
    rows = events.select(u).groupBy("u").agg(F.count(F.lit(1)).alias("n")).where(F.col("u") > uint8(F.lit("1")))
    return rows.orderBy(F.desc("u")).limit(4).select(F.col("u").cast("string").alias("u"), "n")


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    (orders,) = tables(spark, sf_dir, "orders")
    r, other = make_range(F.col("o_custkey"), F.col("o_custkey") + F.col("o_orderkey") % 50), make_range(100, 300, "[]")
    return orders.select(r.alias("r")).agg(F.count_if(range_contains(F.col("r"), 200)).alias("holds"), F.count_if(range_overlaps(F.col("r"), other)).alias("overlaps"), F.count_if("r.empty").alias("empties"))


QUERIES = {
    "uint8_group_order": Query(
        _uint8_grouped,
        "SELECT CAST(u AS VARCHAR) AS u, n FROM (SELECT CASE WHEN v < 0 THEN CAST(18446744073709551616 AS HUGEINT) + v ELSE v END AS u, count(*) AS n FROM (SELECT event_id % 7 - 3 AS v FROM events) GROUP BY 1) x WHERE x.u > 1 ORDER BY x.u DESC LIMIT 4",
    ),
    "fn_range": Query(
        _ranges,
        "SELECT count(*) FILTER (WHERE a <= 200 AND 200 < b) AS holds, count(*) FILTER (WHERE a < b AND a <= 300 AND b > 100) AS overlaps, count(*) FILTER (WHERE a = b) AS empties FROM (SELECT o_custkey AS a, o_custkey + o_orderkey % 50 AS b FROM orders)",
    ),
    "fn_to_char": sql("SELECT o_orderkey, date_format(o_orderdate, 'yyyy-MM-dd') AS d, date_format(o_orderdate, 'HH:mm') AS t, o_orderdate <= now() AS past FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate, '%H:%M') AS t, o_orderdate <= CAST(now() AS TIMESTAMP) AS past FROM orders"),
    "fn_json_build": sql("SELECT n_nationkey, to_json(named_struct('id', n_nationkey, 'name', n_name)) AS j FROM nation", "SELECT n_nationkey, CAST(to_json({'id': n_nationkey, 'name': n_name}) AS VARCHAR) AS j FROM nation"),
    "fn_round": sql("SELECT o_orderkey, round(CAST(o_totalprice AS DECIMAL(15,2)), 1) AS r1, CAST(round(o_totalprice) AS BIGINT) AS r0, rand(7) >= 0 AND rand(7) < 1 AS unit FROM orders", "SELECT o_orderkey, round(CAST(o_totalprice AS DECIMAL(15,2)), 1) AS r1, CAST(round(o_totalprice) AS BIGINT) AS r0, random() >= 0 AND random() < 1 AS unit FROM orders"),
    "uint8_casts": Query(
        _uint8_casts,
        "SELECT event_id, CAST(CAST(18446744073709551615 AS HUGEINT) - event_id AS VARCHAR) AS u, -event_id - 1 AS back, CAST(event_id AS VARCHAR) AS parsed, upper(printf('%016x', CAST(18446744073709551615 - event_id AS UBIGINT))) AS wire, CAST(CAST(18446744073709551615 AS HUGEINT) - event_id AS VARCHAR) AS received FROM events",
    ),
    "fn_string": sql("SELECT n_nationkey, concat(n_name, '-', CAST(n_nationkey AS STRING)) AS c, md5(n_name) AS m, CAST(length(n_name) AS BIGINT) AS l, repeat('ab', 2) AS r, upper(substr(n_name, 1, 2)) AS u FROM nation", "SELECT n_nationkey, concat(n_name, '-', CAST(n_nationkey AS VARCHAR)) AS c, md5(n_name) AS m, length(n_name) AS l, repeat('ab', 2) AS r, upper(substr(n_name, 1, 2)) AS u FROM nation"),
    "fn_math": sql("SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS f, CAST(ceil(o_totalprice) AS BIGINT) AS c, o_orderkey % 7 AS m, least(o_custkey, o_orderkey) AS lo, greatest(o_custkey, NULL, 5) AS hi, abs(-o_custkey) AS a FROM orders"),
    "fn_date": sql("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL 3 DAY AS STRING) AS plus3, year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders", "SELECT o_orderkey, CAST(CAST(CAST(o_orderdate AS DATE) + INTERVAL 3 DAY AS DATE) AS VARCHAR) AS plus3, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m FROM orders"),
    "fn_date_trunc": sql("SELECT date_trunc('MONTH', o_orderdate) AS m, count(*) AS n FROM orders GROUP BY 1", "SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, count(*) AS n FROM orders GROUP BY 1"),
    "fn_json": sql("SELECT event_id, get_json_object(props, '$.k') AS k FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events"),
    "fn_array": sql("SELECT vec_id, element_at(embedding, 1) AS first_value, CAST(size(embedding) AS BIGINT) AS n FROM embeddings", "SELECT vec_id, embedding[1] AS first_value, CAST(len(embedding) AS BIGINT) AS n FROM embeddings"),
    "fn_case": sql("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'small' END AS c, coalesce(nullif(o_orderstatus, 'F'), '-') AS s, CAST(o_totalprice AS INTEGER) >= 0 AS ok FROM orders"),
    "fn_series": sql("SELECT i, CAST(i * i AS BIGINT) AS sq FROM (SELECT explode(sequence(1, 100)) AS i) t", "SELECT CAST(i AS INTEGER) AS i, CAST(i * i AS BIGINT) AS sq FROM generate_series(1, 100) t(i)"),
}
