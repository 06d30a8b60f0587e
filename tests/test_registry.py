"""Every registered query against the same query in another engine."""

from __future__ import annotations

from decimal import Decimal

import duckdb
import pytest

from basaltine.plans import registry

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in registry.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(x):
        if x is None or (isinstance(x, float) and x != x):
            return "NULL"
        return f"{float(x):.9g}" if isinstance(x, float | Decimal) else str(x)

    return sorted(columns), sorted(tuple(value(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    mine = plain([tuple(r) for r in df.collect()], df.columns)
    if name not in ORACLE:
        assert mine[1]
        return
    cursor = duck.execute(ORACLE[name])
    assert mine == plain(cursor.fetchall(), [d[0] for d in cursor.description])
