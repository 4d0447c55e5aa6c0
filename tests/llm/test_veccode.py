from collections import Counter
from hashlib import sha256

import numpy as np

from serialmill.llm import veccode

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows):
    """The contract by a full search: {row number: (code, error, label_error, digest)}."""
    kept = [(i, r) for i, r in enumerate(rows) if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[1][0] is None, r[1][0] or 0, r[1][1]))
    x = np.floor(1024 * np.array([r[1] for _, r in kept], np.float32).astype(np.float64)).astype(np.int64).reshape(len(kept), 4, -1)
    books = x[:256].copy()
    for k in range(5):
        d = ((x[:, None] - books[None]) ** 2).sum(-1)
        code = d.argmin(1)
        if k < 4:
            for p in range(4):
                for e in set(code[:, p]):
                    s = x[code[:, p] == e, p]
                    books[e, p] = s.sum(0) // len(s)
    error = d.min(1).sum(1)
    digest = sha256(",".join(map(str, books.swapaxes(0, 1).reshape(-1).tolist())).encode()).hexdigest()
    of_label = Counter()
    for (_, r), e in zip(kept, error, strict=True):
        of_label[r[2]] += int(e)
    return [(r[0], bytes(c.astype(np.uint8)).hex(), int(e), of_label[r[2]], digest) for (_, r), c, e in zip(kept, code, error, strict=True)]


def vectors(n, dim, seed=0, step=None):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(12, dim))
    x = centre[rng.integers(0, 12, n)] + 0.3 * rng.normal(size=(n, dim))
    if step:
        x = np.round(x / step) * step  # many equal parts and equal distances
    return [(int(i), v.astype(np.float32).tolist(), None if i % 7 == 0 else int(i) % 5) for i, v in enumerate(x)]


def check(spark, rows):
    got = sorted((tuple(r)[:5] for r in veccode.compress(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()), key=str)
    assert got == sorted(brute(rows), key=str)
    return got


def test_equals_full_search(spark):
    check(spark, vectors(900, 16))


def test_ties_nulls_repeats_and_few_vectors(spark):
    rows = vectors(500, 8, 1, step=0.5)
    inf, nan = float("inf"), float("nan")
    rows += [(3, None, 1), (None, rows[5][1], 2), (4, [nan] * 8, 1), (5, [inf] + [0.0] * 7, 1), (6, [None] + [0.0] * 7, 1), rows[17], rows[17]]
    check(spark, rows)
    assert len(check(spark, vectors(40, 8, 2))) == 40
    assert veccode.compress(spark.createDataFrame([], SCHEMA)).count() == 0
    assert veccode.compress(spark.createDataFrame([(1, None, 1)], SCHEMA)).count() == 0


def test_clashing_columns_and_other_lengths(spark):
    df = spark.createDataFrame([(1, [0.5] * 4, None, 3, "x"), (2, [0.5] * 8, None, 3, "x")], SCHEMA + ", error int, code string")
    assert [(r["vec_id"], r["code"], r["error"]) for r in veccode.compress(df).collect()] == [(1, "00000000", 0)]


def test_cold_labels_are_joined_too(spark, monkeypatch):
    monkeypatch.setattr(veccode, "HOT", 3)
    rows = [(i, [float(i % 9), 1.0, 2.0, float(i)], i % 2 if i < 80 else i) for i in range(200)] + [(900, [1.0] * 4, None)]
    check(spark, rows)


def test_bounds_leave_entries_out():
    x = np.array([v for _, v, _ in vectors(2000, 16, 3)])
    x = veccode.whole(x)
    pivot = veccode.pivots(x[:256])
    code, best, work = veccode.assign(x, veccode.to_pivots(x, pivot), x[:256], veccode.to_pivots(x[:256], pivot))
    d = veccode.squared(x[:, None], x[None, :256])
    assert (code == d.argmin(1)).all() and (best == d.min(1)).all() and work < 0.5 * d.size
