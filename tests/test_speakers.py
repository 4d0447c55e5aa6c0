"""Attribution, phonemes and tags on literal inputs."""

import pytest
from pyspark.sql import functions as F

from serialmill.functions import hooks
from serialmill.functions import speakers as S

# The cases of this file fix the behaviour of the rules.
CASES = [
    ('"Hi," said Mara. "Bye."', ["Mara", "Mara"], {}),  # a tag holds for both sides
    ('Then Mara drew her sword. "Run," she said.', ["Mara"], {}),
    ('Then Mara looked at him and Tom laughed at his luck. "Ha," he said.', ["Tom"], {}),
    ('"Who?" asked Resk.|"Me."', ["Resk", "Resk"], {}),  # the last speaker holds
    ('"Who?" asked Resk.|It rained.|It poured.|"Me."', ["Resk", "Ann"], {"protagonist": "Ann"}),
    ('"Who?" asked Resk.|It rained.|It poured.|"Me." "And me."', ["Resk", "Ann", "Ann"], {"protagonist": "Ann"}),
    ("The wrinkled crone smiled.|\"Well met.\"", ["crone"], {}),
    ('"Go," said Mara.|"No, Mara."', ["Mara", "Mara"], {}),
    ('"Go," said Resk.|"No, Mara!" said Mara.', ["Resk", "Resk"], {}),  # nobody calls themself
    ('"Unclosed and on', [""], {}),
    ("|no quote", [], {}),
    ('Then Bob said, "Go now."|The rain fell on.|"Are you sure?"', ["Bob", "Bob"], {}),
    ('Eve waved. "Hello."', ["Eve"], {"known": ("Eve",)}),
    ('"A," said Mara. "B," said Tom. "C."', ["Mara", "Tom", "Tom"], {}),
    ('Then Tom lost his hat. "Mine!" said Mara. "Really?" he asked.', ["Mara", "Tom"], {}),
]


def test_attribution(spark):
    for options in ({}, {"protagonist": "Ann"}, {"known": ("Eve",)}):
        cases = [(k, b, c) for k, c in enumerate(CASES) if c[2] == options for b in enumerate(c[0].split("|"))]
        df = spark.createDataFrame([(k, n, text) for k, (n, text), _ in cases], "doc_id int, block_no int, body string")
        rows = S.attribute(df, **options).collect()
        for k in {k for k, *_ in cases}:
            got = [r["speaker"] for r in sorted((r for r in rows if r["doc_id"] == k), key=lambda r: (r["block_no"], r["piece"])) if r["kind"] == "dialogue"]
            assert got == CASES[k][1], CASES[k][0]


@pytest.mark.parametrize(
    ("context", "want"),
    [(" said Mara.", ("Mara", "")), (" he muttered.", ("", "m")), ("Resk whispered", ("Resk", "")), (" the said thing", None), ("", None), (None, None), ("She asked", ("", "f"))],
)
def test_speech_tags(spark, context, want):
    got = spark.createDataFrame([(context,)], "c string").select(S.speech_tag(F.col("c"))).first()[0]
    assert (None if got is None else tuple(got)) == want


def test_phoneme_judgement(spark):
    say = {"skincare": "skɪŋkɛr", "skin": "skɪn", "care": "kɛr", "nightshade": "naɪtʃeɪd", "night": "naɪt", "shade": "ʃeɪd", "hoverbus": "hʌvɚbəs", "hover": "hʌvɚ", "bus": "bʌs", "bedpost": "bɛdpoʊst", "bed": "bɛd", "post": "poʊst"}
    splits = spark.createDataFrame([("skincare", "skin", "care"), ("nightshade", "night", "shade"), ("hoverbus", "hover", "bus"), ("bedpost", "bed", "post")], "word string, left_part string, right_part string")
    words = spark.createDataFrame([(w,) for w in [*say, "skin"]], "word string")
    got = {r["word"]: r["why"] for r in hooks.judged(splits, hooks.phoneme_table(words, say.get)).collect()}
    assert got == {"skincare": "n→ng", "nightshade": "joins", "hoverbus": "vowel", "bedpost": "ok"}


def test_differences(spark):
    cases = [("abc", "axc", "differs"), ("roz", "ros", "s/z"), ("rozs", "ro", "s/z"), ("bænk", "bæŋk", "n→ng"), ("bæŋk", "bænk", "differs"), ("nn", "ŋn", "n→ng"), ("tɪn", "tən", "vowel"), ("tn", "tən", "vowel"), ("a", "a", "differs")]
    df = spark.createDataFrame([c[:2] for c in cases], "p string, w string")
    assert [r[0] for r in df.select(hooks.difference(F.col("p"), F.col("w"))).collect()] == [c[2] for c in cases]


def test_tags(spark):
    df = spark.createDataFrame([("it's so: 12",), (None,)], "text string")
    assert [tuple(t) for t in hooks.tagged(df).first()["tokens"]] == [("it's", 0, "", "", ""), ("so", 5, "", "", ""), ("12", 9, "", "", "")]
    nlp = lambda t: [(w, t.index(w), "X", "T", w.lower()) for w in t.split()]
    rows = hooks.tagged(df, nlp=nlp).collect()
    assert rows[0]["tokens"][1]["start"] == 5 and rows[1]["tokens"] is None
