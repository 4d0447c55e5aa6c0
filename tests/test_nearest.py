"""The nearest references of words, against every pair."""

import random

from pyspark.sql import functions as F

from serialmill.operators import nearest


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(words, refs):
    out = {}
    for w in words:
        best = sorted((edits(w, r), r) for r in refs)[:2]
        d, r = best[0]
        out[w] = (r, d, best[1][0] - d if len(best) > 1 else None, round(1 - d / max(len(w), len(r), 1), 6))
    return out


def found(spark, words, refs):
    got = nearest.nearest_of(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(r,) for r in refs], "ref string"))
    rows = got.collect()
    assert len(rows) == len({r["word"] for r in rows})
    return {r["word"]: (r["nearest"], r["dist"], r["margin"], r["fit"]) for r in rows}


def test_against_every_pair(spark):
    rng = random.Random(3)
    some = lambda: "".join(rng.choice("etaonhxé") for _ in range(rng.randint(0, 9)))
    refs = sorted({some() for _ in range(60)} | {"a" * 40, "long" * 9})
    words = sorted({some() for _ in range(80)} | {"a" * 38, "longlong" * 4, "zzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzz", "q", ""})
    assert found(spark, [*words, None, words[5]], [*refs, None, refs[3]]) == brute(words, refs)


def test_vowels_that_differ_more_than_the_other_counts(spark):
    """Cells three edits apart by vowels and length: the pair must be met in the round of its cells."""
    refs = ["augeer", "beber", "gebe", "ster"]
    assert found(spark, ["stgeber"], refs) == brute(["stgeber"], refs)


def test_few_references(spark):
    assert found(spark, ["cat", ""], ["cart"]) == brute(["cat", ""], ["cart"])
    assert found(spark, ["cat"], []) == {} and found(spark, [], ["cat"]) == {}


def test_two_strings_within_two_edits_share_a_key(spark):
    rows = [("other", "mother"), ("abcd", "badc"), ("night", "nihgt"), ("aa", ""), ("abc", "axc")]
    df = spark.createDataFrame(rows, "a string, b string").select(F.arrays_overlap(nearest.deletion_keys(F.col("a")), nearest.deletion_keys(F.col("b"))).alias("met"), F.levenshtein("a", "b").alias("d"))
    assert all(r["met"] for r in df.collect() if r["d"] <= 2)


def test_few_references_are_walked_and_many_are_indexed(spark, monkeypatch):
    """Few references need no rounds over cells; with none allowed to be few, or with a longer one, the index gives the same rows."""
    rng = random.Random(5)
    some = lambda k: "".join(rng.choice("etaonhxé") for _ in range(k))
    refs = sorted({some(k % 12) for k in range(60)} | {some(64), some(63)})
    words = sorted({some(k % 13) for k in range(80)} | {some(70), "", refs[-1]})
    want, cells = brute(words, refs), nearest.cell_pairs
    monkeypatch.setattr(nearest, "cell_pairs", None)
    assert found(spark, words, refs) == want
    monkeypatch.setattr(nearest, "cell_pairs", cells)
    assert found(spark, words[:20], [*refs, "a" * 65]) == brute(words[:20], [*refs, "a" * 65])


def test_walk_in_any_order():
    words = ["cart", "carts", "car", "", "x" * 100, "x" * 100 + "y", "cart", "dog"]
    refs = sorted(["", "cat", "dog", "xx"])
    assert list(nearest.walk(words, refs)) == [sorted((edits(w, r), r) for r in refs)[:2] for w in words]
