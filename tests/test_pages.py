"""Literal pages: bot checks, fields, blocks."""

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from serialmill.operators import pages


def values(spark, htmls, columns):
    return [r.asDict() for r in spark.createDataFrame([(i, h) for i, h in enumerate(htmls)], "i int, html string").select("i", *columns).orderBy("i").collect()]


def test_bot_check(spark):
    anubis, cloud = '<script id="anubis_challenge">', "<title>Just a moment...</title>"
    htmls = ["x" * 10_000 + anubis, "x" * 20_001 + anubis, cloud, "x" * 6_000 + cloud, "track(1) captcha-delivery Just a moment...", None]
    assert [r["v"] for r in values(spark, htmls, [pages.bot_check_of(F.col("html")).alias("v")])] == ["Anubis", None, "Cloudflare", None, None, None]


def test_series_page(spark):
    html = (
        '<html lang="en"><meta property="og:title" content="Sky Pride"/><meta property="og:url" content="https://h/s/1"><span class="auth_name_fic" title="x">Ann B.</span>'
        '<span class="label label-default"> Ongoing </span><script>{"ratingValue":"4.567"}</script><li class="content-warning">Gore</li><li><a href="/t">Epic</a></li>'
    )
    full, empty, none = values(spark, [html, "<p>", None], pages.series_page(F.col("html")))
    assert (full["og_title"], full["og_url"], full["author"], full["status"], full["rating"]) == ("Sky Pride", "https://h/s/1", "Ann B.", "ONGOING", 4.57)
    assert (full["warnings"], full["tags"], full["lang"], full["og_image"]) == (["Gore"], ["Epic"], "en", "")
    assert empty == none | {"i": 1} and empty["rating"] == 0 and empty["tags"] == [] and empty["author"] == ""


def test_chapter_page(spark):
    htmls = [
        '<meta property="og:title" content="Chapter 17 - Plans (III) - Cultivation System"><h1>Chapter 17 - Plans (III)</h1><a class="b" href="/n/2"><i></i> Next Chapter</a>window.readingProgress = 12;',
        "<title>4. Deck Four - Salvage - Run</title>", "<h1>Only</h1>", "",
    ]
    got = [(r["chapter"], r["series"], r["next_url"], r["position"]) for r in values(spark, htmls, pages.chapter_page(F.col("html")))]
    assert got == [("Chapter 17 - Plans (III)", "Cultivation System", "/n/2", "12"), ("4. Deck Four - Salvage", "Run", "", None), ("Only", "", "", None), ("", "", "", None)]


def test_container_with_most_paragraphs():
    html = "<body><div><p>menu</p></div><div id=c><p>One</p><div><p>inner</p></div><p>Two</p><p style='visibility: hidden'>decoy</p><p style='speak:never'>no</p><hr></div><div><p>foot</p></div></body>"
    assert pages.page_blocks(html) == [("paragraph", "One"), ("paragraph", "inner"), ("paragraph", "Two"), ("scene_break", "")]


def test_lines_of_cells():
    assert pages.page_blocks("<article><table><tr><td>HP: 5<br>MP: 6</td><td>Level 2</td></tr></table></article>") == [("system", "HP: 5"), ("system", "MP: 6"), ("system", "Level 2")]


def test_title_echo_counts_edits_as_its_twin(spark, tmp_path):
    """A letter beyond ASCII is two edits in the twin: at the bound of 0.85 such titles are told apart."""
    base = "abcdefghijklmnopqrst"  # 3 edits of 20 letters are let pass, 4 are not
    said = [base, base[:17] + "xyz", base[:18] + "éü", base[:17] + "xyé", base[:19] + "é", base[:16] + "wxyz", "é" * 20, base + "é", base + "é" * 2, ""]
    rows = [(k, f"<h1>{h}</h1><p><b>{p}<br>") for k, (h, p) in enumerate([(base, p) for p in said] + [("é" * 20, p) for p in ("é" * 20, "è" * 3 + "é" * 17, "e" * 2 + "é" * 18, "")])] + [(99, None)]
    spark.createDataFrame(rows, "page_id bigint, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = dict(con.execute(entry.oracle_sql()["win15_title_echo"]).fetchall())
    assert dict(map(tuple, entry.queries()["win15_title_echo"](spark, str(tmp_path)).collect())) == want and set(want.values()) == {True, False, None}
