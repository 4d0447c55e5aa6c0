"""Small literal inputs for the text functions and page blocks."""

import pytest
from pyspark.sql import functions as F

from serialmill.functions import text as T
from serialmill.operators.dialogue import parse_chat
from serialmill.operators.pages import page_blocks


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("Mr. Vane left. He ran!", ["Mr. Vane left.", "He ran!"]),
        ('"Go." She went.', ['"Go."', "She went."]),
        ("wait... what", ["wait... what"]),
        ("", []),
    ],
)
def test_sentences(spark, line, want):
    assert one(spark, line, T.sentences) == want


@pytest.mark.parametrize(("n", "want"), [(0, "zero"), (13, "thirteen"), (42, "forty-two"), (100, "one hundred"), (1999, "one thousand nine hundred ninety-nine"), (9000, "nine thousand")])
def test_number_words(spark, n, want):
    assert spark.range(1).select(T.number_words(F.lit(n))).first()[0] == want


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("[Noobkiller9000 (Earth): First Wick and now Bourne.]", ("Noobkiller9000", "Earth", "First Wick and now Bourne.")),
        ("[Target: the gate]", None),
        ("[HP: 577/577]", None),
        ("[NAME: Resk]", None),
        ("[a whole sentence here: yes]", None),
        ("no brackets", None),
    ],
)
def test_chat(spark, line, want):
    got = one(spark, line, parse_chat)
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(("title", "want"), [("Sky Pride [Vol. 1 Read Now!]", "Sky Pride"), ("[Only Brackets]", "[Only Brackets]")])
def test_short_title(spark, title, want):
    assert one(spark, title, T.short_title) == want


@pytest.mark.parametrize(("slug", "want"), [("drunken-monkey", None), ("", "empty"), ("Bad Slug", "bad characters"), ("a" * 61, "too long"), ("a--b", "bad characters")])
def test_slug_problem(spark, slug, want):
    assert one(spark, slug, T.slug_problem) == want


@pytest.mark.parametrize(("line", "want"), [("***", True), ("- - -", True), ("~~~~~", True), ("word", False), ("*" * 13, False)])
def test_scene_break(spark, line, want):
    assert one(spark, line, T.is_scene_break) is want


def test_page_blocks():
    html = (
        "<html><style>.gone{display:none}</style><nav><p>menu</p></nav><article><h1>One</h1><p>First <b>line</b>.</p>"
        '<p class="gone">decoy</p><div class="ad"><p>buy</p></div><hr><blockquote>HP: 5</blockquote><p hidden>no</p><p>Last</article>'
    )
    assert page_blocks(html) == [("heading", "One"), ("paragraph", "First line."), ("scene_break", ""), ("system", "HP: 5"), ("paragraph", "Last")]
    assert page_blocks(None) == page_blocks("") == []


@pytest.mark.parametrize(("token", "want"), [("IV", 4), ("XXXIX", 39), ("IIII", None), ("", None), ("L", None)])
def test_roman(spark, token, want):
    assert one(spark, token, T.roman_value) == want


@pytest.mark.parametrize(("handle", "want"), [("Forever1stCommenter", "Forever 1st Commenter"), ("???", "unknown"), ("dark_lord-9", "dark lord 9")])
def test_handle(spark, handle, want):
    assert one(spark, handle, T.spoken_handle) == want


def test_text_blocks(spark):
    from serialmill.operators.corpus import text_blocks

    raw = "Para one,\r\n  wrapped.\r\n\r\n***\n \t\nPara two.\n\n\n"
    assert [tuple(b) for b in one(spark, raw, text_blocks)] == [("paragraph", "Para one, wrapped."), ("scene_break", ""), ("paragraph", "Para two.")]
    assert one(spark, "", text_blocks) == []
    assert one(spark, None, text_blocks) is None


@pytest.mark.parametrize(("n", "want"), [(12_345, "twelve thousand three hundred forty-five"), (999_999, "nine hundred ninety-nine thousand nine hundred ninety-nine"), (20_000, "twenty thousand")])
def test_large_number_words(spark, n, want):
    assert spark.range(1).select(T.number_words(F.lit(n))).first()[0] == want


def test_names_in_mid_sentence(spark, tmp_path):
    from serialmill.operators import corpus

    rows = [(1, "Then Mara left. Resk ran to Bo-Li and  Egbert.", "s"), (2, 'He said "Stop." \' Then Vane came', "s"), (3, None, "s")]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "'en' AS lang", "0L AS n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(r["word"] for r in corpus.names(spark, str(tmp_path)).collect()) == ["Egbert", "Mara", "Vane"]


def test_compounds(spark, tmp_path):
    """An inflected word, a weak ending and a word of the dictionary are no compounds; a word used once is one."""
    from serialmill.operators import corpus

    text = "night shade hover bus less " * 40 + "nightshade hoverbus hoverbus shadeless nightings nightbus"
    docs = [(1, text, "a"), (2, "hoverbus hoverbus hoverbus", "b"), (3, "hoverbus", "c"), (4, "hoverbus", "d"), (5, "hoverbus", "e")]
    spark.createDataFrame(docs, "doc_id bigint, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "night shade hover bus less nightbus")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["word"]: tuple(r)[1:] for r in corpus.compounds(spark, str(tmp_path)).collect()}
    assert got == {"nightshade": (1, "night", "shade", "a"), "hoverbus": (8, "hover", "bus", "b,a,c,d")}
