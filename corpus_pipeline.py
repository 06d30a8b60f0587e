"""From documents to packed sequences: language ID, near duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
reread as the next stage's docs. All stages but the last return the columns of documents, and any
further columns that docs have, whatever their names.

Nulls, empty and very long texts, ties, repeated rows and empty tables are defined for each stage below; a
null in a column that a stage doesn't name passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basaltine.llm import decontamination, langid, near_dup, packing, pii
from basaltine.llm.common import dropped, scope, shared_dir, written
from basaltine.llm.tokens import digests


def _wrapped(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns in one, whose names can't clash with an operator's."""
    return docs.select("doc_id", "text", F.struct(*(c for c in docs.columns if c not in ("doc_id", "text")), F.lit(0).alias("__none")).alias("rest"))


def _columns(rows: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """docs' columns of wrapped rows; n_chars, where there is one, follows a new text."""
    new = {"doc_id": F.col("doc_id"), "text": F.col(text), "n_chars": F.length(text).cast("long") if text != "text" else F.col("rest.n_chars")}
    return rows.select(*((new[c] if c in new else F.col("rest")[c]).alias(c) for c in docs.columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter go; a null lang becomes the predicted one, or stays null where nothing was learned.

    A null or empty text has no letter. Equal scores go to the first language by name. Repeated rows all stay.
    """
    rows = langid.identify(_wrapped(docs), langid.fit(docs), ("doc_id", "text", "rest"))
    lang = F.coalesce("rest.lang", F.nullif("lang_pred", F.lit("und")))
    return _columns(rows.where("letters").withColumn("rest", F.col("rest").withField("lang", lang)), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group of near duplicates.

    Of repeated rows, and of rows that tie in doc_id, one stays; a null doc_id comes after all others. Null, empty
    and blank texts are in no group and stay.
    """
    rows = near_dup.near_duplicates(_wrapped(docs), near_dup.Settings(percent=80), keep=("rest",))
    return _columns(rows.where("first"), docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents of nothing else go.

    Null and empty texts hold no passage and stay. Repeated rows are treated alike. An empty benchmark changes nothing.
    """
    found = decontamination.contamination(_wrapped(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=("rest",))
    left = found.where((F.size("spans") == 0) | (decontamination.n_hit() < F.col("n_words")))
    # Written first: two Python operators in one task would double a worker's processes, and their memory.
    return _columns(decontamination.cut(written(left)).withColumn("__text", F.col("text")), docs, "__text")


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets.

    Null and empty texts stay as they are. Of overlapping spans the first one's kind stands for all. Repeated rows are treated alike.
    """
    return _columns(pii.find(_wrapped(docs), pii.fit(docs), ("doc_id", "rest"), redact=True), docs, "__text")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens: a row for each piece.

    A null or empty text is a piece of the end id alone; repeated rows are packed each; an empty table has no pieces.
    """
    import public_tokenizers

    out = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return digests(out.pieces).join(out.assigned, "piece_id").drop("piece_id")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("private", private),
    ("packed", packed),
]

#: The stages fit models, build graphs and solve a linear program, which SQL can't express; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage wrote on its way is deleted behind it."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        path = shared_dir(spark)
        with scope(spark):
            docs = written(stage(spark, docs, sf_dir), path)
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
