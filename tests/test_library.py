"""Walks over listed pages, and names resolved, on literal rows."""

from serialmill.operators import library


def walk(spark, pages, known, total):
    listed = spark.createDataFrame([(1, c, o, p) for p, page in enumerate(pages) for c, o in page], "series int, source_id string, ord int, page int")
    have = spark.createDataFrame([(1, c, o) for c, o in known], "series int, source_id string, ord int")
    r = library.toc_walk(listed, have, spark.createDataFrame([(1, total)], "series int, total bigint")).first()
    return r["outcome"], r["pages_read"], r["n_chapters"]


def test_toc_walk(spark):
    ids = [(f"c{k}", k) for k in range(9)]
    pages = [ids[6:], ids[3:6], ids[:3]]
    assert walk(spark, pages, [], 9) == ("full", 3, 9)
    assert walk(spark, pages, ids[:7], 9) == ("early", 1, 9)
    assert walk(spark, pages, ids[:5], 9) == ("early", 2, 9)
    moved = [(c, o + (o > 3)) for c, o in ids[:8]]  # one chapter was dropped, and all after it moved up
    assert walk(spark, pages, moved, 9) == ("early", 3, 9)
    assert walk(spark, pages[:2], [], 9) == ("incomplete", 2, None)
    assert walk(spark, pages, ids[:7], 10) == ("incomplete", 3, None)
    assert walk(spark, [], ids, 9) == ("incomplete", 0, None)
    doubled = [*ids[:5], ("old", 4)]
    assert walk(spark, pages[:1], doubled, 9) == ("incomplete", 1, None)


def test_names_resolved(spark):
    known = spark.createDataFrame([(1, "sky-pride", "Sky Pride"), (2, "sky", "The Sky"), (3, "pride-of-kin", "Kin")], "series int, slug string, title string")
    alias = spark.createDataFrame([(3, "kin-pride"), (1, "sk")], "series int, slug string")
    keys = ["sky", "sk", "pride", "kin-pride", "The S", "xyz", "", "ky-p", "y P", "sky", "kin"]
    got = {(r["want"], r["key"]): (r["found"], r["match_rank"]) for r in library.resolve(spark.createDataFrame(list(enumerate(keys)), "want int, key string"), known, alias).collect()}
    want = {"sky": (2, 0), "sk": (1, 1), "pride": (3, 2), "kin-pride": (3, 1), "The S": (2, 4), "ky-p": (1, 3), "y P": (1, 4), "kin": (3, 3)}
    assert got == {(k, x): want[x] for k, x in enumerate(keys) if x in want}
