"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, rows, schema=DOCS):
    return spark.createDataFrame([tuple(r) + (None,) * (5 - len(r)) for r in rows], schema)


def sentence(seed: int, n: int, words=None) -> str:
    import random

    rng = random.Random(seed)
    words = words or ["".join(rng.choice("abcdefghijklmnoprstuvwy") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    return " ".join(rng.choice(words) for _ in range(n))
