"""Small documents with every edge: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

WORDS = "the of and shore river stone light under over morning paper walks seven quiet garden copper".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row long, h long, fp string, ids string, bench_words int, lang_pred string, key int, wanted string, score double"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def rows(texts: list[str | None], ids: list[int | None] | None = None) -> list[tuple]:
    ids = ids or list(range(len(texts)))
    return [(i, t, "en", "s", None if t is None else len(t), -1, -2, "x", "y", 3, "z", 4, "w", 0.5) for i, t in zip(ids, texts, strict=True)]


def documents(spark, texts, ids=None):
    """As a staged table, since operators read their input more than once."""
    from setloom.llm.common import stage

    return stage(spark.createDataFrame(rows(texts, ids), SCHEMA).repartition(3), "test-docs")


def edge_texts(seed: int = 1) -> list[str | None]:
    rng = random.Random(seed)
    base = [sentence(rng, rng.randint(1, 200)) for _ in range(12)]
    return [None, "", " ", "\n\n", "a", "?!", *base, *base[:3], base[0] + " " + base[1], sentence(rng, 6000), "é" * 700, "x" * 900, "日本 語 \U0001f600 " * 40, "A\x00B\x1f C\x7f"]
