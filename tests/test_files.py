"""Readers of the library's own files."""

import json

from pyspark.sql import functions as F

from serialmill.sources import files


def test_rules(spark, tmp_path):
    (tmp_path / "r.csv").write_text("# comment\nsurface,pos,respell,notes\nlive,VERB,liv,\nread,VBD+read,red,past\n,X,y,z\n")
    rows = files.read_rules(spark, str(tmp_path / "r.csv")).orderBy("surface").collect()
    assert [tuple(r) for r in rows] == [("live", "VERB", "", "liv", ""), ("read", "VBD", "read", "red", "past")]


def test_embedded_chapters(spark):
    html = '<script>window.volumes = []; window.chapters = [{"id":12,"title":"One [x]","order":0},{"id":"n/a"},{"id":13,"order":1}]; var y = [1];</script>'
    rows = spark.createDataFrame([(html,), ("no list",), (None,)], "html string").select(files.embedded_chapters(F.col("html")).alias("c")).collect()
    assert [[x["id"] for x in r["c"]] for r in rows] == [["12", "13"], [], []]


def test_toc_pages(spark):
    got = spark.createDataFrame([(0,), (15,), (16,)], "n int").select(files.toc_page_count(F.col("n"), 15).alias("p")).collect()
    assert [r["p"] for r in got] == [1, 1, 2]


def test_state(spark, tmp_path):
    for i, doc in enumerate([{"schema": 2, "uuid": "u1", "rr_id": "77", "title": "A"}, {"schema": 9, "uuid": "u2", "source_id": "5"}, {"source_id": "6"}]):
        (tmp_path / f"{i}.json").write_text(json.dumps(doc))
    rows = {r["source_id"]: r["problem"] for r in files.read_state(spark, str(tmp_path)).collect()}
    assert rows == {"77": None, "5": "newer schema", "6": "no uuid"}


def test_toc_rows(spark):
    html = (
        '<ol><li class="toc_w" order="2"><a class="toc_a" href="https://h/read/9-x/chapter/77/">Two <b>Towers</b></a><span class="fic_date_pub" title="Mar 4, 2024 05:06 PM">x</span></li>'
        '<li class="toc_w" order="0"><a class="toc_a" href="/chapter/78/">none</a></li><li class="toc_w" order="3"><a class="toc_a" href="/other">no id</a></li></ol>'
    )
    r = spark.createDataFrame([(html,), (None,), ("",)], "h string").select(files.toc_rows(F.col("h")).alias("t")).collect()
    assert [(x["ord"], x["id"], x["title"], x["slug"], str(x["published"])) for x in r[0]["t"]] == [(1, "77", "Two Towers", "two-towers", "2024-03-04 17:06:00")]
    assert not r[1]["t"] and r[2]["t"] == []
