from __future__ import annotations

import pytest
from pyspark.sql import functions as F

WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "ter", "su", "vo") for b in ("ran", "del", "pix", "mu", "sto", "nel", "gar")]


def prose(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)])
    return " ".join(out)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and blank texts, ties, repeated rows, long texts, a word without end, and columns with clashing names."""
    base = prose(1, 60)
    texts = [
        (1, base), (2, base), (2, base), (3, base + " zulu"), (4, None), (5, ""), (6, " \n\t "), (7, "one two"), (8, "one two"), (None, "a null id has words too"),
        (9, prose(2, 30_000)), (10, "x" * 300_000), (11, "—– ★ 123"), (12, "été Über ΣΑΣ 日本語 <|endoftext|> ﬁn"), (13, "tail\x00nul \x1c odd"),
    ]
    df = spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, f"s{i}", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({"row": F.lit("clash"), "key": F.lit(1), "rest": F.lit(2.0), "part": F.lit(None).cast("int"), "digest": F.lit("d")})


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
