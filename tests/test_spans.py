"""Spans merged, clipped and re-based; sentences with places."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from serialmill.functions import spans


def rows(r):
    return [tuple(x) for x in r]


def test_spans(spark):
    df = spark.createDataFrame([([(5, 7), (0, 3), (3, 4), (6, 9), (2, 2)],), ([],)], f"s {spans.SPANS}")
    got = df.select(spans.merged(F.col("s")).alias("m")).select("m", spans.rebased(F.col("m"), F.lit(2), F.lit(6)).alias("r"), spans.covered(F.col("m")).alias("n")).collect()
    assert [(rows(r["m"]), rows(r["r"]), r["n"]) for r in got] == [([(0, 4), (5, 9)], [(0, 2), (3, 4)], 8), ([], [], 0)]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 8)), max_size=8), min_size=1, max_size=20))
def test_merged_spans_cover_the_same_places(spark, lists):
    data = [([(a, a + n) for a, n in x],) for x in lists]
    for r, (given_,) in zip(spark.createDataFrame(data, f"s {spans.SPANS}").select(spans.merged(F.col("s"))).collect(), data, strict=True):
        m = rows(r[0])
        assert {p for a, b in m for p in range(a, b)} == {p for a, b in given_ for p in range(a, b)}
        assert all(x[1] < y[0] for x, y in zip(m, m[1:]))  # noqa: B905


def test_sentences_keep_their_places(spark):
    text = '  He left. "No!"  She met Dr. Who…  Then?  end'
    r = spark.createDataFrame([(text,)], "t string").select(spans.sentences(F.col("t")).alias("s")).first()["s"]
    assert [text[x["start"] : x["start"] + len(x["body"])] for x in r] == [x["body"] for x in r] == ["He left.", '"No!"', "She met Dr. Who…", "Then?  end"]


def test_tagged_text(spark):
    r = spark.createDataFrame([("a <b>bc</b> d<b>e<i>f</i></b> < g",)], "h string").select(spans.tagged_text(F.col("h")).alias("t")).first()["t"]
    assert r["text"] == "a bc def < g" and rows(r["spans"]) == [(2, 4), (6, 7)]
