"""The lexicon pass on literal lines, with marks given by hand where a tagger would give them."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from serialmill.functions import lexicon

RULES = "surface string, pos string, lemma string, respell string, ord int"


def rules(spark, *rows):
    split = lambda s, pos, said: (s, pos.partition("+")[0], pos.partition("+")[2], said)
    return spark.createDataFrame([(*split(*r), k) for k, r in enumerate(rows)], RULES)


def said(spark, text, *rows, tags=lexicon.no_tags):
    lines = spark.createDataFrame([(1, text)], "id int, line string")
    return lexicon.respelled(lines, ["id"], "line", rules(spark, *rows), tags).first()["body"]


def marked(**marks):
    """A tagger that knows a few words: word -> "POS TAG lemma"."""

    def tags(words):
        out = F.struct(F.lit("X").alias("pos"), F.lit("XX").alias("tag"), F.lit("").alias("lemma"))
        for w, m in marks.items():
            pos, tag, lemma = m.split()
            out_of = F.struct(F.lit(pos).alias("pos"), F.lit(tag).alias("tag"), F.lit(lemma).alias("lemma"))
            out = (lambda word, mark, rest: lambda x: F.when(F.lower(x) == word, mark).otherwise(rest(x) if callable(rest) else rest))(w, out_of, out)
        return F.transform(words, out if callable(out) else lambda _: out)

    return tags


# These cases fix the behaviour of the rules.
@pytest.mark.parametrize(
    ("text", "rows", "want"),
    [
        ("Montgomery arrived.", [("Montgomery", "", "mahnt-gum-uh-ree")], "Mahnt-gum-uh-ree arrived."),
        ("montgomeryshire", [("Montgomery", "", "mahnt-gum-uh-ree")], "montgomeryshire"),
        ("the chi flows, CHI", [("chi", "", "chee")], "the chee flows, Chee"),
        ("Tian walked", [("Tian", "", "")], "Tian walked"),
        ("use his qi- a shield", [("qi", "", "chee")], "use his chee- a shield"),
        ("a tear in the cloth", [("tear", "", "tare"), ("a tear in", "", "a tair in")], "a tair in the cloth"),
        ("He would shed a tear.", [("tear", "", "tare"), ("a tear", "", "a tair"), ("shed a tear", "", "shed a teer")], "He would shed a teer."),
        ("A B c a b", [("a b", "", "x"), ("b c", "", "y")], "X c x"),
        ("b c d a b c d", [("b c", "", "y"), ("c d", "", "z"), ("a b c", "", "w")], "y d w d"),
        ("Lead-Out now", [("lead-out", "", "leed out"), ("lead", "", "led")], "Leed out now"),
        ("a  b", [("a b", "", "x")], "a  b"),
        ("don't, 'don't'", [("don't", "", "doan't"), ("don", "", "dawn")], "doan't, 'doan't'"),
        ("one", [("one", "", "won"), ("one", "", "wun")], "wun"),
        ("", [("one", "", "won")], ""),
        ("...", [("one", "", "won")], "..."),
    ],
)
def test_rules_without_marks(spark, text, rows, want):
    assert said(spark, text, *rows) == want


def test_the_most_specific_rule_holds(spark):
    live = [("live", "VERB", "liv"), ("live", "ADJ", "lyve")]
    assert said(spark, "Will he live?", *live, tags=marked(live="VERB VB live")) == "Will he liv?"
    assert said(spark, "a live branch", *live, tags=marked(live="ADJ JJ live")) == "a lyve branch"
    read = [("read", "VERB", "reed"), ("read", "VBD", "red")]
    assert said(spark, "He read it.", *read, tags=marked(read="VERB VBD read")) == "He red it."
    assert said(spark, "I read.", *read, tags=marked(read="VERB VBP read")) == "I reed."
    wound = [("wound", "VBD+wind", "wownd")]
    assert said(spark, "He wound it.", *wound, tags=marked(wound="VERB VBD wind")) == "He wownd it."
    assert said(spark, "The wound bled.", *wound, tags=marked(wound="NOUN NN wound")) == "The wound bled."
    plain = [("live", "", "liv"), ("live", "ADJ", "lyve")]
    assert said(spark, "live", *plain, tags=marked(live="VERB VB live")) == "liv" and said(spark, "live", *plain, tags=marked(live="ADJ JJ live")) == "lyve"


def test_lone_rule_for_a_noun(spark):
    one, two = [("estimate", "NOUN", "estimit")], [("estimate", "NOUN", "estimit"), ("estimate", "PROPN", "x")]
    assert said(spark, "estimate", *one, tags=marked(estimate="ADJ JJ estimate")) == "estimit"
    assert said(spark, "estimate", *one, tags=marked(estimate="VERB VB estimate")) == "estimate"
    assert said(spark, "estimate", *two, tags=marked(estimate="ADJ JJ estimate")) == "estimate"


def test_many_rules_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(lexicon, "FEW_RULES", 0)
    assert said(spark, "a tear in the tear", ("tear", "", "tare"), ("a tear in", "", "a tair in")) == "a tair in the tare"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_work_goes_with_the_words_of_a_line(spark):
    """No step copies a line for each of its words, and a long line is said right."""
    n = 20_000
    assert said(spark, "a tear in the tear. " * n, ("tear", "", "tare"), ("a tear in", "", "a tair in")) == "a tair in the tare. " * n
    lines = spark.createDataFrame([(1, "a b")], "id int, line string")
    plan = _plan(lexicon.respelled(lines, ["id"], "line", rules(spark, ("a b", "", "x"), ("a", "", "y")), lexicon.suffix_tags))
    assert "slice(" not in plan
    assert plan.count("regexp_extract_all(line") == 2  # for the matches, and to put the edits in


@pytest.mark.parametrize(("name", "scans"), [("joi1_rule_resolution", 1), ("joi2_phrase_rules", 1), ("joi2_lexicon_pass", 2)])
def test_texts_are_cut_once(spark, name, scans):
    plan = _plan(entry.queries()[name](spark, "/root/testdata/sf0.001"))
    assert plan.count("posexplode(split(text") == scans


def test_phrases_that_hold_and_words_beside_them(spark):
    """Overlapping phrases are chosen from the left; a word that only a phrase which does not hold would cover is said by its own rule."""
    found = [("b c", "", "Y"), ("a b", "", "X"), ("c", "", "see"), ("c d e", "", "Z"), ("e", "", "ee"), ("d", "", "dee")]
    assert said(spark, "a b c d e, b c d e d", *found) == "X Z, Y dee ee dee"
    assert said(spark, "a b c d. c", ("a b", "", "X"), ("b c d", "", "Y"), ("c", "", "see"), ("d", "", "dee")) == "X see dee. see"


def test_marks_of_endings_beyond_ascii(spark):
    words = ["Él", "Él", "été", "ÉTÉ", "Running", "12", "１２", "1a", "ǅ", "_x"]
    r = spark.createDataFrame([(words,)], "w array<string>").select(lexicon.suffix_tags(F.col("w")).alias("t")).first()["t"]
    assert [x["tag"] for x in r] == ["NN", "NNP", "NN", "NNP", "NNP", "CD", "NN", "NN", "NN", "NN"]


def test_found_is_gathered_where_its_line_lies(spark):
    """One walk along a line in place of windows, folds and lists of pieces; what is found is neither sorted by place nor shuffled on its own."""
    df = entry.queries()["joi2_lexicon_pass"](spark, "/root/testdata/sf0.001")
    plan = _plan(df)
    assert not [step for step in ("Window", "aggregate(", "array_except(", "sort_array(") if step in plan]
    assert plan.count("RepartitionByExpression [doc_id") == 1


def test_generated_methods_stay_compiled(spark):
    """A generated method of more than 8,000 bytes is not compiled by the JVM."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = entry.queries()["joi2_lexicon_pass"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan()
        stages = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenStringSeq(plan)
        assert max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())) < 8_000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_lines_of_one_batch(spark):
    """Lines with, without and with many edits, an empty and a null one, letters of more than one byte: each keeps its own text."""
    texts = ["a b c", "x", None, "", "é b, Ünï b ü", "b c a b", "... b", "ΟΔΟΣ α", "ΟΔΟΣ.α"]
    lines = spark.createDataFrame(list(enumerate(texts)), "id int, line string").coalesce(1)
    table = rules(spark, ("b", "", "bée"), ("b c", "", "Y"), ("a b", "", "X"), ("ünï b", "", "ö"), ("ΟΔΟΣ α", "", "way"), ("οδος", "", "road"))
    got = {r["id"]: r["body"] for r in lexicon.respelled(lines, ["id"], "line", table).collect()}
    assert [got[i] for i in range(len(texts))] == ["X c", "x", None, "", "é bée, Ö ü", "Y X", "... bée", "Way", "Road.α"]


def test_what_holds_by_brute_force():
    import random

    import numpy as np

    rng = random.Random(7)
    for _ in range(300):
        found = [(i, a, a + 2 * n, n > 0) for i in range(4) for a in range(0, 24, 2) for n in range(3) if rng.random() < 0.3]
        rng.shuffle(found)
        want, end = [], {}
        for x in sorted(found, key=lambda x: (x[0], x[1], not x[3], -x[2])):
            if x[1] > end.get(x[0], -1):
                want.append(x)
                end[x[0]] = x[2] if x[3] else end.get(x[0], -1)
        kept = lexicon._held(*(np.array([x[k] for x in found], dtype=bool if k == 3 else int) for k in range(4)))
        assert [found[k] for k in kept] == want
