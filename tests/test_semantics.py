"""Widening aggregates, containment, the unsigned type, and refutation by ranges."""

from __future__ import annotations

import json
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basaltine.functions.semantics import array_contains_all, jsonb_contains, jsonb_exists, pg_avg, pg_sum, uint8, uint8_from_bigint, uint8_recv, uint8_send, uint8_to_bigint
from basaltine.operators.predicates import All, Any_, Field


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_sums_widen(spark):
    big = spark.createDataFrame([(2**63 - 1,), (2**63 - 1,), (None,)], "v long")
    assert big.agg(pg_sum("v", T.LongType())).first()[0] == Decimal(2**64 - 2)
    assert big.where("v < 0").agg(pg_sum("v", T.LongType()), pg_avg("v", T.LongType())).first() == (None, None)
    assert spark.createDataFrame([(1,), (2,)], "v int").agg(pg_avg("v", T.IntegerType())).first()[0] == Decimal("1.5")
    with pytest.raises(TypeError):
        pg_avg("v", T.DecimalType(19, 2))


@pytest.mark.parametrize("text", ["0", "18446744073709551615", "9223372036854775808"])
def test_uint8(spark, text):
    u = uint8(F.lit(text))
    assert one(spark, u) == Decimal(text)
    assert one(spark, uint8_from_bigint(uint8_to_bigint(u))) == Decimal(text)
    assert one(spark, uint8_send(u)) == int(text).to_bytes(8, "big")
    assert one(spark, uint8_recv(uint8_send(u))) == Decimal(text)


@pytest.mark.parametrize("text", ["-1", "18446744073709551616", "1.5", "5.00000000001", "0.99999999999"])
def test_uint8_rejects(spark, text):
    with pytest.raises(Exception, match="out of range|OUT_OF_RANGE|RAISE"):
        one(spark, uint8(F.lit(text)))


@pytest.mark.parametrize(
    "doc, part, want",
    [
        ('{"a": 1, "b": {"c": [1, 2, {"d": "x"}]}}', '{"b": {"c": [2]}}', True),
        ('{"a": 1.0}', '{"a": 1}', True),
        ('{"a": "1"}', '{"a": 1}', False),
        ('{"a": null}', '{"a": null}', True),
        ("{}", '{"a": null}', False),
        ('{"a": true}', '{"a": false}', False),
        ('{"a": [1, 2]}', '{"a": [3]}', False),
        ('{"a": 1}', "{}", True),
        ('{"k": 1e30}', '{"k": 1e30}', True),
        ('{"k": 0.1}', '{"k": 0.10000000000001}', False),
        ('{"k": 0.5}', '{"k": 0.5}', True),
        ('{"it\'s": 1}', '{"it\'s": 1}', True),
        ("[1, 2]", "1", True),
        ("[1, 2]", "3", False),
        ('{"a": [1]}', '{"a": 1}', False),
        (None, "{}", None),
    ],
)
def test_jsonb_contains(spark, doc, part, want):
    df = spark.createDataFrame([(doc,)], "d string")
    assert df.select(jsonb_contains("d", json.loads(part))).first()[0] is want


def test_jsonb_exists_and_arrays(spark):
    df = spark.createDataFrame([('{"a": null}', ["x", "y"]), (None, None)], "d string, t array<string>")
    assert [r[0] for r in df.select(jsonb_exists("d", "a")).collect()] == [True, None]
    assert [r[0] for r in df.select(array_contains_all("t", ["y", "x"])).collect()] == [True, None]
    assert [r[0] for r in df.select(array_contains_all("t", ["y", None])).collect()] == [False, None]
    assert [r[0] for r in df.select(array_contains_all("t", [])).collect()] == [True, None]


preds = st.recursive(
    st.builds(lambda n, op, v: getattr(Field(n), op)(v), st.sampled_from("ab"), st.sampled_from(["__eq__", "__ne__", "__lt__", "__le__", "__gt__", "__ge__"]), st.integers(-3, 3)),
    lambda p: st.builds(lambda x, y, t: t((x, y)), p, p, st.sampled_from([All, Any_])),
    max_leaves=6,
)


def holds(p, row):
    if isinstance(p, All):
        return all(holds(x, row) for x in p.parts)
    if isinstance(p, Any_):
        return any(holds(x, row) for x in p.parts)
    a, b = row[p.name], p.value
    return {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[p.op]


@settings(max_examples=300, deadline=None)
@given(preds, st.lists(st.fixed_dictionaries({"a": st.integers(-4, 4), "b": st.integers(-4, 4)}), min_size=1, max_size=5))
def test_refutation_is_safe(p, rows):
    ranges = {c: (min(r[c] for r in rows), max(r[c] for r in rows)) for c in "ab"}
    if any(holds(p, r) for r in rows):
        assert p.may_match(ranges)
    assert p.may_match({})
