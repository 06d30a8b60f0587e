"""The queries of the corpus operators and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, decontamination, langid, licenses, near_dup, packing, pii, tokens, toxicity, warc


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_classifier_chain": toxicity.op1_classifier_chain,
        "op2_warc": warc.op2_warc,
        "op3_fm_decontamination": decontamination.op3_fm_decontamination,
        "op4_word_backoff_langid": langid.op4_word_backoff_langid,
        "op5_minmax_near_dup": near_dup.op5_minmax_near_dup,
        "op6_license_scan": licenses.op6_license_scan,
        "op7_skip_chain_pii": pii.op7_skip_chain_pii,
        "op8_packing": packing.op8_packing,
        "op9_token_files": tokens.op9_token_files,
        "op10_additive_ann": ann.op10_additive_ann,
        "pipeline": pipeline,
    }


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP2 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS lead FROM p)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(x, CAST((i // 4) * 5 + 1 AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN lead = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN lead <> page_id THEN lead END AS refers_to
FROM d
"""

_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_OP3 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, list_slice(w, i, i + 9) AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(g) AS n FROM wins),
grams AS (SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
found AS (SELECT doc_id, i, n, item_id FROM grams JOIN wins USING (g)),
hits AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS spot FROM (SELECT DISTINCT doc_id, i, n FROM found)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS t FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""

_SHINGLED = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + ", '[^\\x20\\x09-\\x0D]+')"

_OP5 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SHINGLED} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(w, i, i + 4) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL) JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM comp LEFT JOIN n USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that it can express; the others are tested by brute force, round trips or held-out rows."""
    return {"op2_warc": _OP2, "op3_fm_decontamination": _OP3, "op5_minmax_near_dup": _OP5}
