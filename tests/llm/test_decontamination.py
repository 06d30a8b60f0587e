from __future__ import annotations

import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from basaltine.llm import decontamination
from basaltine.llm.fm_index import FMIndex, suffix_array

from .conftest import prose


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, b in items:
            v = words(b)
            for j in range(max(1, len(v) - 9) if v and i is not None else 0):
                win = v[j : j + 10]
                for k in range(len(w) - len(win) + 1):
                    if w[k : k + len(win)] == win:
                        hit.update(range(k, k + len(win)))
                        found.add(i)
        out.append((d or 0, len(w), len(hit), sorted(found)))
    return sorted(out)


def items(odd):
    long = prose(2, 30_000).split()
    return [(1, prose(1, 60)), (2, " ".join(long[500:530])), (3, " ".join(long[505:514])), (4, "ONE two"), (5, None), (6, ""), (None, "one two"), (7, "two"), (8, " ".join(long[100:109] + ["no"] + long[110:125]))]


def found(df, bench):
    rows = decontamination.contamination(df, bench).collect()
    return sorted((r.doc_id or 0, r.n_words, sum(s.end - s.start for s in r.spans), sorted(r["items"])) for r in rows)


def test_against_brute_force(spark, odd):
    bench = spark.createDataFrame(items(odd), "item_id long, text string")
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    assert found(odd, bench) == brute(docs, items(odd))


def test_several_passes(spark, odd, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK", 200)
    bench = spark.createDataFrame(items(odd), "item_id long, text string")
    assert found(odd, bench) == brute([(r.doc_id, r.text) for r in odd.collect()], items(odd))


def test_shards_and_cut(spark, odd, monkeypatch):
    monkeypatch.setattr(decontamination, "SHARD", 50)
    bench = spark.createDataFrame([(1, prose(1, 60)), (2, "one two")], "item_id long, text string")
    rows = decontamination.cut(decontamination.contamination(odd, bench, keep=("lang",))).collect()
    text = {r.doc_id: r.text for r in rows}
    assert text[1] == "" and text[3] == " zulu" and text[7] == "" and text[4] is None and text[12].startswith("été")


def test_empty(spark, odd, empty):
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert found(empty, bench) == []
    assert all(n == 0 for _, _, n, _ in found(odd, bench.limit(0)))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=60), st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=4), min_size=1, max_size=6))
def test_index(text, patterns):
    text = np.array([*text, 0])
    order = suffix_array(text)
    assert sorted(order.tolist()) == list(range(len(text)))
    width = max(map(len, patterns))
    grid = np.array([p + [0] * (width - len(p)) for p in patterns])
    index = FMIndex(text, 4, sample=4)
    low, high = index.search(grid, np.array(list(map(len, patterns))))
    for p, a, b in zip(patterns, low.tolist(), high.tolist(), strict=True):
        want = [i for i in range(len(text) - len(p) + 1) if text[i : i + len(p)].tolist() == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want
