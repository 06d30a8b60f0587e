"""The queries that SQL expresses, against another engine on the same whole tables."""

from __future__ import annotations

import duckdb
import pytest

from basaltine.llm import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cursor = con.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    want = sorted(map(str, cursor.fetchall()))
    assert sorted(str(tuple(r)) for r in queries.queries()[name](spark, sf).select(*columns).collect()) == want
