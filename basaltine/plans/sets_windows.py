"""Set operations, windows, sorting and limits."""

from __future__ import annotations

from .registry import sql

QUERIES = {
    "set_union_all": sql("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier"),
    "set_union": sql("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier"),
    "set_except": sql("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey AS k FROM orders"),
    "set_intersect": sql("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey AS k FROM orders WHERE o_totalprice > 300000"),
    "set_append_children": sql("SELECT part_no, count(*) AS n FROM (SELECT 0 AS part_no, o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01 00:00:00' UNION ALL SELECT 1 AS part_no, o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01 00:00:00') t GROUP BY part_no"),
    "win_row_number": sql("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS rn FROM orders"),
    "win_running_sum": sql("SELECT o_custkey, o_orderkey, CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS run FROM orders"),
    "win_rank_lag": sql("SELECT l_orderkey, l_linenumber, CAST(rank() OVER w AS BIGINT) AS r, CAST(dense_rank() OVER w AS BIGINT) AS d, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS p, lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS x FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_suppkey)"),
    "win_frame": sql("SELECT o_custkey, o_orderkey, CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS s FROM orders"),
    "sort_topk": sql("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25"),
    "sort_mixed_nulls": sql("SELECT k, o_orderkey FROM (SELECT CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS k, o_orderkey FROM orders) t ORDER BY k ASC NULLS LAST, o_orderkey DESC LIMIT 40"),
    "sort_desc_nulls_first": sql("SELECT k, o_orderkey FROM (SELECT CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS k, o_orderkey FROM orders) t ORDER BY k DESC NULLS FIRST, o_orderkey LIMIT 40"),
    "sort_offset": sql("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 20"),
    "distinct_rows": sql("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders"),
}
