"""Predicates and their pushdown shapes."""

from __future__ import annotations

from .registry import sql

QUERIES = {
    "flt_between_in": sql("SELECT count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_linenumber IN (1, 3, 5)"),
    "flt_or_and": sql("SELECT count(*) AS n, min(o_orderkey) AS lo FROM orders WHERE (o_custkey < 100 OR o_custkey > 1400) AND (o_orderstatus = 'F' OR o_totalprice > 300000)"),
    "flt_not": sql("SELECT count(*) AS n FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice < 100000)"),
    "flt_null": sql("SELECT count(*) AS n, count(v) AS nv FROM (SELECT CASE WHEN o_orderstatus = 'O' THEN o_custkey END AS v FROM orders) t WHERE v IS NULL OR v > 500"),
    "flt_null_three_valued": sql("SELECT count(*) AS n FROM (SELECT CASE WHEN o_orderstatus = 'O' THEN o_custkey END AS v FROM orders) t WHERE NOT (v > 500)"),
    "flt_stable_expr": sql("SELECT count(*) AS n FROM orders WHERE o_orderdate < DATE '1998-12-01' - INTERVAL 90 DAY AND o_orderdate >= DATE '1995-01-01'"),
    "flt_cast_literal": sql("SELECT count(*) AS n FROM lineitem WHERE l_orderkey < CAST('500' AS BIGINT) AND l_shipdate >= CAST('1995-06-01' AS TIMESTAMP)"),
    "flt_not_equal": sql("SELECT count(*) AS n FROM orders WHERE o_orderpriority <> '1-URGENT'"),
    "flt_like": sql("SELECT count(*) AS n FROM part WHERE p_name LIKE '%a%' AND p_brand LIKE 'Brand#1_'"),
    "flt_regex": sql("SELECT count(*) AS n FROM part WHERE p_type RLIKE '(?i)^s.*l$'", "SELECT count(*) AS n FROM part WHERE regexp_matches(p_type, '^s.*l$', 'i')"),
    "flt_point": sql("SELECT * FROM orders WHERE o_orderkey = 77"),
    "flt_projection": sql("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate < TIMESTAMP '1992-06-01 00:00:00'"),
    "flt_distinct_from": sql("SELECT count(*) AS n FROM (SELECT CASE WHEN o_orderstatus = 'O' THEN o_orderstatus END AS v FROM orders) t WHERE v IS DISTINCT FROM 'O'"),
}
