"""Named queries, each with an equivalent SQL text for an independent engine."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None


#: Schemas by path, as a catalog keeps them: inferring one is a job of its own.
_schemas: dict[str, StructType] = {}


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    out = []
    for path in (f"{sf_dir}/{n}.parquet" for n in names):
        if path not in _schemas:
            _schemas[path] = spark.read.parquet(path).schema
        out.append(spark.read.schema(_schemas[path]).parquet(path))
    return out


_NAMED = re.compile(rf"\b({'|'.join(TABLES)})\b")


def sql(text: str, oracle: str | None = None) -> Query:
    """A query in Spark SQL over the tables it names; ``oracle`` where the other engine spells it differently.

    The tables are given to this one query, so nothing is registered in the session.
    """
    used = [t for t in TABLES if t in _NAMED.findall(text)]
    given = _NAMED.sub(r"{\1}", text)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(given, **dict(zip(used, tables(spark, sf_dir, *used), strict=True)))

    return Query(run, oracle or text)


def _all() -> dict[str, Query]:
    from . import aggregates, bench_shapes, filters, joins, scalars, sets_windows, table_ops

    out: dict[str, Query] = {}
    for module in (bench_shapes, aggregates, filters, joins, sets_windows, scalars, table_ops):
        out |= module.QUERIES
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.run for name, q in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.oracle for name, q in _all().items() if q.oracle}
