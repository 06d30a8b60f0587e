from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from basaltine.llm import near_dup
from basaltine.llm.graph import components

from .conftest import prose


def brute(rows, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), 1 << 60), d if d is not None else 1 << 60)
    return sorted((d or 0, len(sets[i]), least[root(i)] if least[root(i)] < 1 << 60 else None) for i, (d, _) in enumerate(rows))


def check(df, percent):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = near_dup.near_duplicates(df, near_dup.Settings(percent=percent)).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in got) == brute(rows, percent)
    return got


def test_odd_rows(odd):
    got = check(odd, 85)
    assert sum(r.first for r in got if r.component_id == 1) == 1
    assert all(r.first for r in got if r.n_shingles == 0)


@pytest.mark.parametrize("large, docs, pivots", [(2048, 400, 16), (3, 7, 2), (2048, 5, 1)])
def test_family_with_edits(spark, monkeypatch, large, docs, pivots):
    """A family around a template with 0 to 40 % of edits: also where buckets and families are large."""
    monkeypatch.setattr(near_dup, "LARGE", large)
    monkeypatch.setattr(near_dup, "DOCS", docs)
    monkeypatch.setattr(near_dup, "PIVOTS", pivots)
    rng = np.random.default_rng(3)
    base = prose(5, 120).split()
    rows = []
    for i in range(60):
        w = list(base)
        for at in rng.choice(120, int(rng.integers(0, 12)), replace=False):
            w[at] = f"edit{i}x{at}"
        rows.append((i, " ".join(w[: 120 - i // 4])))
    rows += [(100 + i, prose(50 + i, 80)) for i in range(20)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), 85)
    check(spark.createDataFrame(rows, "doc_id long, text string"), 80)


def test_chain_across_blocks(spark, monkeypatch):
    """Each text drops the front of the one before: links are between neighbours only, and blocks are small."""
    monkeypatch.setattr(near_dup, "DOCS", 4)
    monkeypatch.setattr(near_dup, "PIVOTS", 1)
    monkeypatch.setattr(near_dup, "LARGE", 2)
    words = prose(9, 200).split()
    words = [f"{w}{i}" for i, w in enumerate(words)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 60])) for i in range(30)] + [(50 + i, " ".join(words[10 * i : 10 * i + 60])) for i in range(12)]
    for percent in (85, 95):
        check(spark.createDataFrame(rows, "doc_id long, text string"), percent)


def test_forest_joins_what_is_linked():
    rng = np.random.default_rng(7)
    for _ in range(40):
        n = int(rng.integers(1, 30))
        grid = rng.random((n, n)) < 0.08
        grid |= grid.T
        label = rng.integers(0, n, n) if rng.random() < 0.5 else np.arange(n)
        start = np.unique(label, return_inverse=True)[1]
        pairs = near_dup._joined(n, start.copy(), np.arange, lambda i, js, grid=grid: grid[i, js])
        assert all(grid[i, j] for j, i in pairs) and len(pairs) < n

        def named(edges, start=start, n=n):
            up = start.copy()
            for j, i in edges:
                up[up == up[j]] = up[i]
            return {frozenset(np.flatnonzero(up == u).tolist()) for u in up}

        assert named(pairs) == named([(j, i) for i in range(n) for j in range(i) if grid[i, j]])


def test_empty_and_kept_columns(empty, odd):
    assert near_dup.near_duplicates(empty).count() == 0
    kept = near_dup.near_duplicates(odd, keep=("lang", "row", "digest"))
    assert kept.columns == ["doc_id", "n_shingles", "component_id", "first", "text", "lang", "row", "digest"] and kept.count() == odd.count()
    assert kept.where(F.col("row") == "clash").count() == odd.count()


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 105), (103, 105), (7, 7), (None, 3)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 103: 100, 105: 100}


def test_signature_agreement_is_unbiased():
    s = near_dup.Settings(bands=200, rows=4)
    a = np.sort(near_dup.mix(np.arange(1, 1001, dtype=np.uint64)))
    b = np.sort(near_dup.mix(np.arange(201, 1201, dtype=np.uint64)))
    sig = near_dup.signatures(np.concatenate([a, b]), np.array([0, 1000, 2000]), s)
    assert abs((sig[0] == sig[1]).mean() - 800 / 1200) < 0.06
