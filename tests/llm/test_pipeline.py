from __future__ import annotations

from basaltine.llm.common import written
from basaltine.llm.pii import base_spans

import corpus_pipeline


def test_stages(spark, sf):
    docs = source = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf))
        seen[name] = docs
        if name != "packed":
            assert docs.columns == source.columns
    assert 0 < seen["near_duplicates"].count() <= seen["language"].count() <= source.count()
    assert not any(base_spans(r.text) for r in seen["private"].collect())
    last = docs.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert all(r[1] <= 4096 for r in last)
    assert {r.doc_id for r in docs.select("doc_id").collect()} == {r.doc_id for r in seen["private"].select("doc_id").collect()}


def test_stages_take_odd_rows(spark, sf, odd, empty):
    """Clashing further columns, repeated rows, nulls and long texts pass every stage, with the results it defines."""
    for start in (odd, empty):
        df, before = start, {}
        for name, stage in corpus_pipeline.STAGES[:-1]:
            df = written(stage(spark, df, sf))
            assert df.columns == odd.columns
            before[name] = sorted(((r.doc_id, r.text, r.row, r.digest) for r in df.collect()), key=str)
        packed = written(corpus_pipeline.packed(spark, df, sf))
        assert packed.select("doc_id").distinct().count() == df.select("doc_id").distinct().count()
    df = odd
    got = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = written(stage(spark, df, sf))
        got[name] = sorted((r.doc_id or 0, r.row, r.digest, r.key, r["rest"]) for r in df.collect())
    ids = {name: [r[0] for r in rows] for name, rows in got.items()}
    assert all(r[1:] == ("clash", "d", 1, 2.0) for rows in got.values() for r in rows)
    assert ids["language"] == [0, 1, 2, 2, 3, 7, 8, 9, 10, 12, 13]
    assert ids["near_duplicates"] == ids["decontaminated"] == ids["private"] == [0, 1, 7, 9, 10, 12, 13]


def test_run_leaves_only_what_it_returns(spark, sf, tmp_path):
    from pyspark.sql import functions as F

    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(40).write.parquet(f"{tmp_path}/{name}.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path))
    sizes = rows.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert sizes and all(r.n <= 4096 for r in sizes)


def test_language_is_filled_and_no_lettered_row_is_lost(spark, sf):
    rows = [(i, ["the house and the garden", "das haus und der garten"][i % 2], [["en", "de"][i % 2], None][i > 20], "s", 1) for i in range(30)]
    rows += [(30, "12 —", "en", "s", 1), (31, "日本語", None, "s", 1), (32, None, "de", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.lang for r in corpus_pipeline.language(spark, docs, sf).collect()}
    assert set(got) == {*range(30), 31} and all(got[i] == ["en", "de"][i % 2] for i in range(30)) and got[31] in ("en", "de")
    unknown = docs.selectExpr("doc_id", "text", "cast(null as string) as lang", "source", "n_chars")
    got = {r.doc_id: r.lang for r in corpus_pipeline.language(spark, unknown, sf).collect()}
    assert set(got) == {*range(30), 31} and set(got.values()) == {None}
