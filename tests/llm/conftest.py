"""Small tables with everything that operators must stand."""

from __future__ import annotations

import pytest

#: Names that operators use inside; as extra columns they must not disturb.
CLASHING = "key string, n int, size int, label int, host string, node int, sha string, maybe int, rid int, verdict int, __sha string, __host string, pattern int, group_size int, __gone int, __bits0 int, body int, `a.b` int, `c``d` string"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + CLASHING


@pytest.fixture(scope="session")
def make(spark):
    def rows(texts, sources=None, ids=None, langs=None):
        ids = ids if ids is not None else range(len(texts))
        out = []
        for k, (i, t) in enumerate(zip(ids, texts, strict=True)):
            out.append((i, t, (langs or ["en"] * len(texts))[k], (sources or ["s"] * len(texts))[k], None if t is None else len(t), *("x" if kind.endswith("string") else 1 for kind in CLASHING.split(", "))))
        return spark.createDataFrame(out, SCHEMA).repartition(3)

    return rows


@pytest.fixture(scope="session")
def prose():
    """Invented sentences, the same for each seed."""
    from random import Random

    def write(seed: int, n: int) -> str:
        r = Random(seed)
        parts = ["the", "and", "of", "er", "in", "th", "on", "re", "to", "ti", "ea", "ou", "st", "en"]
        words = ["".join(r.choice(parts) for _ in range(r.choice([1, 1, 2, 3]))) for _ in range(n)]
        return " ".join(w + ("." if k % 9 == 8 else "") for k, w in enumerate(words)) + "."

    return write
