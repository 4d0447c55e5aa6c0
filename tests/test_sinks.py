"""What is written is read back; a run that fails leaves nothing behind; snapshots join without shuffling the stored side."""

import json

import pytest
from pyspark.sql import functions as F

from serialmill.sinks import files, snapshots
from serialmill.sources import files as readers

SCRIPT = "ch bigint, seg_no int, body string"


def test_a_failed_write_leaves_nothing_and_is_repeated(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "PIECE", 7)
    path = str(tmp_path / "segments")
    rows = [(c, n, f"text {c} {n}") for c in range(3) for n in range(20)]
    df = spark.createDataFrame(rows, SCRIPT).repartition(5)
    broken = df.withColumn("body", F.when(F.col("ch") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("body")))
    with pytest.raises(Exception, match="lost"):
        files.write_segments(broken, path, "ch")
    assert not list((tmp_path / "segments").glob("ch=*/*.json")) if (tmp_path / "segments").exists() else True
    for _ in range(2):  # written again, folders are replaced
        files.write_segments(df, path, "ch")
    assert sorted(map(tuple, files.read_segments(spark, path, df.schema).select("ch", "seg_no", "body").collect())) == rows
    assert len(list((tmp_path / "segments").glob("ch=0/*.json"))) > 1  # pieces of a long chapter are files of their own
    files.write_segments(df.where("ch = 1").withColumn("body", F.lit("new")), path, "ch")
    assert {(r["ch"], r["body"] == "new") for r in files.read_segments(spark, path, df.schema).collect()} == {(0, False), (1, True), (2, False)}


def test_texts(spark, tmp_path):
    rows = [(1, "---\ntitle: x\n---\n\n## One\n\nend"), (2, "a\n"), (3, "é\n\nü")]
    files.write_texts(spark.createDataFrame(rows, "ch bigint, md string"), str(tmp_path / "t"), "ch", "md")
    assert sorted((r["ch"], r["md"]) for r in files.read_texts(spark, str(tmp_path / "t"), "md").collect()) == rows


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "s")
    now = spark.range(1000).select(F.col("id").alias("k"), F.sha1(F.col("id").cast("string")).alias("mark"))
    assert snapshots.load(spark, path) is None and snapshots.changed(now, None, "k", "mark").count() == 1000
    assert snapshots.save(now.where("k % 10 <> 0"), path, "k", 8) == 1
    todo = snapshots.changed(now.withColumn("mark", F.when(F.col("k") % 7 == 0, "other").otherwise(F.col("mark"))), snapshots.load(spark, path), "k", "mark")
    plan = todo._jdf.queryExecution().executedPlan().toString()
    stored = plan[plan.index("SortMergeJoin") :].split("\n")
    assert sum("Exchange" in x for x in stored) == 1 and any("Bucketed: true" in x for x in stored)
    assert sorted(r["k"] for r in todo.collect()) == [k for k in range(1000) if k % 10 == 0 or k % 7 == 0]
    assert snapshots.save(now, path, "k", 8) == 2
    spark.sql(f"DROP TABLE {snapshots._table(path, 2)}")  # as in a new session, whose catalog does not know it
    assert snapshots.changed(now, snapshots.load(spark, path), "k", "mark").count() == 0
    assert snapshots.load(spark, path, 1).count() == 900


def test_shelves_hold_a_library_in_few_files(spark, tmp_path):
    """Many series make no more files than shelves and tasks; every row is read again, with its null and empty fields, and a store is not written over."""
    rows = [(c, f"text {c}\n\nend" if c % 3 else (None if c % 2 else "")) for c in range(500)]
    df, path = spark.createDataFrame(rows, "ch bigint, md string"), str(tmp_path / "t")
    files.write_texts(df, path, "ch", "md", shelves=8)
    assert sorted((r["ch"], r["md"]) for r in files.read_texts(spark, path, "md", df.schema).collect()) == rows
    stored = list((tmp_path / "t").glob("shelf=*/*.json"))
    assert 0 < len(stored) <= 8
    at = df.where("ch = 7").select(files.shelf(F.col("ch"), 8)).first()[0]
    assert any('"ch":7,' in f.read_text() for f in (tmp_path / "t" / f"shelf={at}").glob("*.json"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        files.write_texts(df, path, "ch", "md", shelves=8)


def test_states_and_feeds_on_shelves(spark, tmp_path):
    states = spark.range(300).select(F.col("id").alias("s"), F.to_json(F.struct(F.lit(3).alias("schema"), F.md5(F.col("id").cast("string")).alias("uuid"), F.col("id").cast("string").alias("source_id"))).alias("state"))
    files.write_states(states, str(tmp_path / "s"), "s", "state", shelves=8)
    assert sorted(int(r["source_id"]) for r in readers.read_state(spark, str(tmp_path / "s"), by_line=True).collect()) == list(range(300))
    feed = spark.range(300).select((F.col("id") % 100).alias("series"), F.when(F.col("id") < 100, "channel").otherwise("item").alias("kind"), F.current_date().alias("feed_date"), F.col("id").cast("string").alias("guid"))
    files.write_feeds(feed, str(tmp_path / "f"), "series", shelves=8)
    assert sorted(map(tuple, spark.read.schema(feed.schema).json(str(tmp_path / "f")).select(*feed.columns).collect())) == sorted(map(tuple, feed.collect()))
    assert all(len(list(tmp_path.glob(f"{x}/shelf=*/part-*"))) <= 8 for x in "sf")
    lines = [json.loads(x) for x in next(iter((tmp_path / "f").glob("shelf=*/*.json"))).read_text().splitlines()]
    assert [x["series"] for x in lines] == sorted(x["series"] for x in lines) and lines[0]["kind"] == "channel"
