"""Joins: inner, outer, theta, lateral, natural, semi, null-aware anti, scalar subqueries and CTEs."""

from __future__ import annotations

from .registry import sql

QUERIES = {
    "join_inner": sql("SELECT c_mktsegment, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(15,2))) AS total FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment"),
    "join_left": sql("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000 GROUP BY c_custkey"),
    "join_right_full": sql("SELECT coalesce(r_name, '-') AS r, coalesce(n_name, '-') AS n FROM (SELECT * FROM region WHERE r_regionkey < 3) a FULL OUTER JOIN (SELECT * FROM nation WHERE n_regionkey > 1) b ON r_regionkey = n_regionkey"),
    "join_theta": sql("SELECT count(*) AS n FROM nation a JOIN nation b ON a.n_nationkey > b.n_nationkey AND a.n_regionkey = b.n_regionkey"),
    "join_range": sql("SELECT r_regionkey, count(*) AS n FROM region JOIN nation ON n_nationkey BETWEEN r_regionkey * 5 AND r_regionkey * 5 + 6 GROUP BY r_regionkey"),
    "join_multi": sql(
        """SELECT n_name, sum(CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS revenue
        FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
        JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name"""
    ),
    "join_self": sql("SELECT count(*) AS n FROM orders a JOIN orders b ON a.o_orderkey = b.o_orderkey JOIN orders c ON b.o_orderkey = c.o_orderkey JOIN orders d ON c.o_orderkey = d.o_orderkey"),
    "join_lateral": sql("SELECT r_name, t.n_name FROM region, LATERAL (SELECT n_name FROM nation WHERE n_regionkey = r_regionkey ORDER BY n_name LIMIT 2) t"),
    "join_left_lateral": sql("SELECT n_name, t.n FROM nation LEFT JOIN LATERAL (SELECT count(*) AS n FROM supplier WHERE s_nationkey = n_nationkey) t ON true"),
    "join_cross": sql("SELECT count(*) AS n FROM region CROSS JOIN nation"),
    "join_natural": sql("SELECT count(*) AS n FROM (SELECT n_regionkey AS k, n_name AS a FROM nation) x NATURAL JOIN (SELECT r_regionkey AS k, r_name AS b FROM region) y NATURAL JOIN (SELECT s_nationkey AS k, s_name AS c FROM supplier) z"),
    "join_semi": sql("SELECT count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"),
    "join_exists": sql("SELECT count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)"),
    "join_not_exists": sql("SELECT count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"),
    "join_anti_null_aware": sql("SELECT count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT CASE WHEN o_orderstatus = 'X' THEN NULL ELSE o_custkey END FROM orders)"),
    "join_anti_with_null": sql("SELECT count(*) AS n FROM nation WHERE n_nationkey NOT IN (SELECT CASE WHEN r_regionkey > 3 THEN NULL ELSE r_regionkey END FROM region)"),
    "join_scalar_subquery": sql("SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top FROM customer"),
    "join_expr_key": sql("SELECT count(*) AS n FROM region JOIN (SELECT CAST(n_regionkey AS STRING) AS t FROM nation) x ON CAST(r_regionkey AS STRING) = t", "SELECT count(*) AS n FROM region JOIN (SELECT CAST(n_regionkey AS VARCHAR) AS t FROM nation) x ON CAST(r_regionkey AS VARCHAR) = t"),
    "join_null_keys": sql("SELECT count(*) AS n FROM (SELECT CASE WHEN n_nationkey > 5 THEN n_regionkey END AS k FROM nation) a JOIN region ON k = r_regionkey"),
    "join_null_safe": sql("SELECT count(*) AS n FROM (SELECT CASE WHEN n_nationkey > 5 THEN n_regionkey END AS k FROM nation) a JOIN (SELECT CASE WHEN r_regionkey > 0 THEN r_regionkey END AS j FROM region) b ON k IS NOT DISTINCT FROM j"),
    "cte_reuse": sql("WITH t AS (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(15,2))) AS s FROM orders GROUP BY o_custkey) SELECT count(*) AS n FROM t WHERE s > (SELECT avg(s) FROM t)"),
}
