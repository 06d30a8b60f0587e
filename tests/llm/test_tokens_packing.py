from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from basaltine.llm import packing, tokens
from basaltine.llm.common import shared_dir

PATH = public_tokenizers.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)


def ids(text):
    return np.array(LIB.encode(text or "", add_special_tokens=False).ids, "<u4")


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="aé'sß² \x1c\x85\xa0\t<|endoftext|>ΣÀ.µ12", max_size=40))
def test_encoder_is_the_library(text):
    assert tokens.encoder(PATH)(text) == ids(text).tobytes()


@pytest.mark.parametrize("text", ["A\x08", "abc\x7f", "word\x00", "a\x1f b", "a\x1cb", "\x01", "x\x80", "abc\xad", "ab<", "don't", "it's\x00's", "a\u200bb"])
def test_encoder_on_control_characters(text):
    for t in (text, f"{text} {text}", f"x {text}\n{text}y"):
        assert tokens.encoder(PATH)(t) == ids(t).tobytes()


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_round_trip(spark, odd, encoding):
    path = tokens.write_tokens(odd, shared_dir(spark), PATH, layout=tokens.Layout(encoding))
    rows = sorted(tokens.digests(tokens.read_tokens(spark, path)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in odd.collect()), key=lambda x: (x is not None, x))
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1]]
    want = sorted((r.doc_id or 0, zlib.crc32(ids(r.text).tobytes() + b"\2\0\0\0")) for r in odd.collect())
    assert sorted((r.doc_id or 0, r.ids_crc32) for r in rows) == want
    part = tokens.read_tokens(spark, path, ("doc_id", "n_tokens"), 5, 8)
    assert part.columns == ["doc_id", "n_tokens"] and sorted(r.doc_id for r in part.collect()) == [5, 6, 7, 8]


def test_empty(spark, empty):
    path = tokens.write_tokens(empty, shared_dir(spark), PATH)
    assert tokens.digests(tokens.read_tokens(spark, path)).count() == 0
    packed = packing.pack(empty, PATH)
    assert packed.pieces.count() == packed.assigned.count() == 0


def test_layout_is_checked():
    with pytest.raises(ValueError):
        tokens.Layout("other").options()


def test_packing(odd):
    packed = packing.pack(odd, PATH, capacity=256, grain=4)
    rows = packed.pieces.join(packed.assigned, "piece_id").collect()
    assert sum(r.length for r in rows) == sum(len(ids(r.text)) + 1 for r in odd.collect())
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for pieces in by.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == [0, *np.cumsum([p.length for p in pieces])[:-1]]
        assert sum(p.length for p in pieces) <= 256
    assert sorted(by) == list(range(len(by)))
    whole = {r.doc_id: np.append(ids(r.text), 2) for r in odd.collect()}
    assert all((whole[r.doc_id][r.start : r.start + r.length] == r.ids).all() and r.doc_tokens == len(whole[r.doc_id]) for r in rows if r.doc_id != 2)
    sequences = packed.sequences().collect()
    assert len(sequences) == len(by) and all(len(s.ids) <= 256 for s in sequences)


def test_many_short_documents(spark):
    """Bundles leave little padding, every id lies in one piece, offsets have no gaps."""
    rows = [(i, " ".join(["cat"] * (i % 9))) for i in range(6000)]
    packed = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH)
    got = packed.pieces.join(packed.assigned, "piece_id").collect()
    assert sorted((r.doc_id, r.start, r.length) for r in got) == [(i, 0, len(ids(t)) + 1) for i, t in rows]
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    total = sum(r.length for r in got)
    assert len(by) <= -(-total // 4096) + 1
    for pieces in by.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [0, *np.cumsum([n for _, n in pieces])[:-1]] and sum(n for _, n in pieces) <= 4096


def test_packing_and_token_queries(spark, sf):
    """Both queries against the library, on whole tables."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    whole = {d: np.append(ids(t), 2).astype("<u4") for d, t in docs.items()}
    start = 0
    written = {r.doc_id: r for r in tokens.op9_token_files(spark, sf).collect()}
    assert sorted(written) == sorted(docs)
    for d in sorted(docs):
        r = written[d]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(whole[d]), zlib.crc32(whole[d].tobytes()))
        start += len(whole[d])
    pieces = packing.op8_packing(spark, sf).collect()
    covered, by = {}, {}
    for r in pieces:
        assert r.doc_tokens == len(whole[r.doc_id]) and r.ids_crc32 == zlib.crc32(whole[r.doc_id][r.start : r.start + r.length].tobytes())
        covered.setdefault(r.doc_id, []).append((r.start, r.length))
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, parts in covered.items():
        parts.sort()
        assert [a for a, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1]] and sum(n for _, n in parts) == len(whole[d])
    for parts in by.values():
        parts.sort()
        assert [a for a, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1]] and sum(n for _, n in parts) <= 4096
    assert sorted(covered) == sorted(docs) and len(by) <= 1.02 * start / 4096 + 1


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=12))
def test_plan_is_whole(histogram):
    left = dict(histogram)
    patterns = packing.plan(histogram, 64)
    for times, widths, many in patterns:
        assert times > 0 and (widths * many).sum() <= 64
        for w, k in zip(widths.tolist(), many.tolist(), strict=True):
            left[w] -= times * k
    assert not any(left.values())


def test_relaxation_is_optimal():
    # Halves and quarters fill sequences exactly.
    _, counts = packing.relaxed(np.array([16, 32, 48]), np.array([40.0, 10.0, 20.0]), 64)
    assert abs(counts.sum() - 30) < 0.1
