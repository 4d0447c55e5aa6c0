"""Streams give what their batch twins give, over several micro-batches."""

import os
import time

import pytest
from pyspark.sql import functions as F

from serialmill.operators import listening
from serialmill.streaming import jobs

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    """The events in four files, one after another in time, so that a stream of one file a trigger has four batches."""
    folder = str(tmp_path_factory.mktemp("events") / "in")
    events = spark.read.parquet(f"{DATA}/events.parquet")
    ordered = events.selectExpr("*", "row_number() OVER (ORDER BY ts, event_id) AS place")
    n = ordered.count()
    for k in range(4):
        ordered.where(f"place > {n * k // 4} AND place <= {n * (k + 1) // 4}").drop("place").coalesce(1).write.mode("append").parquet(folder)
    return folder


def run(df, name, mode):
    """Runs until four batches had rows; a query with time-outs has batches without rows for as long as it runs."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    ends, full = time.time() + 60, set()
    while len(full) < 4 and time.time() < ends:
        full |= {p["batchId"] for p in q.recentProgress if p["numInputRows"]}
        time.sleep(0.1)
    q.stop()
    assert len(full) == 4
    return df.sparkSession.table(name)


def latest(rows, *fields):
    """The last row of each profile of an update stream."""
    return {r["profile"]: tuple(r[f] for f in fields) for r in rows}


def test_positions(spark, feed):
    out = run(jobs.positions(jobs.event_stream(spark, feed)), "positions", "complete")
    fields = ("chapter", "t", "furthest", "furthest_t")
    assert latest(out.collect(), *fields) == latest(listening.positions(spark, DATA).collect(), *fields)


def test_access_log(spark, feed):
    rows = run(jobs.access_log(jobs.event_stream(spark, feed)), "access", "append").collect()
    want = listening.access_log(spark, DATA).collect()
    assert sorted((r["profile"], r["event_type"], str(r["ts"])) for r in rows) == sorted((r["profile"], r["event_type"], str(r["ts"])) for r in want)


def test_furthest_listened(spark, feed):
    rows = run(jobs.furthest_listened(jobs.event_stream(spark, feed), least_ms=500), "listened", "update").collect()
    got = {k: (None if f < 0 else f, ms) for k, (f, ms) in latest(rows, "furthest", "listened_ms").items()}
    assert got == latest(listening.furthest_listened(spark, DATA, least_ms=500).collect(), "furthest", "listened_ms")


def test_half_a_minute_counts(spark, tmp_path):
    """29 s of listening are not enough, seeks add nothing, a change of chapter starts anew, finishing counts at once."""
    rows, k = [], 0

    def play(who, chapter, seconds, kind="view"):
        nonlocal k
        k += 1
        rows.append((k, who, kind, float(seconds), f'{{"k": {chapter}}}', f"2024-01-01 00:{k // 60:02d}:{k % 60:02d}"))

    for s in range(0, 30, 1):
        play(1, 1, s)
    for s in range(0, 31, 1):
        play(2, 4, s)
    for s in (0, 500, 1000):
        play(3, 2, s)
    for c in (1, 2, 1, 2):
        for s in range(0, 20):
            play(4, c, s)
    play(5, 6, 0, "purchase")
    df = spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string, value double, props string, t string").selectExpr("event_id", "CAST(t AS timestamp_ntz) AS ts", "user_id", "event_type", "value", "props")
    df.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    want = {1: (None, 29000), 2: (4, 30000), 3: (None, 0), 4: (None, 76000), 5: (6, 0)}
    assert latest(listening.furthest_listened(spark, str(tmp_path)).collect(), "furthest", "listened_ms") == want


def test_live_counters(spark, feed):
    rows = run(jobs.live_counters(jobs.event_stream(spark, feed)), "counters", "update").collect()
    assert latest(rows, "pending") == latest(listening.live_counters(spark, DATA).collect(), "pending")


def test_playback_log(spark, feed):
    rows = run(jobs.playback_log(jobs.event_stream(spark, feed), newest=5), "playback", "update").collect()
    want = {}
    for r in listening.playback_log(spark, DATA, newest=5).collect():
        want.setdefault(r["profile"], (set(), r["due"]))[0].add(r["event_id"])
    got = {k: (set(ids), due) for k, (ids, due) in latest(rows, "entries", "due").items()}
    assert {k: v for k, v in got.items() if v[0]} == want


def test_stages(spark, feed):
    rows = run(jobs.stages(jobs.event_stream(spark, feed)), "stages", "complete").collect()
    want = listening.stage_from_events(spark, DATA).collect()
    assert sorted((r["chapter"], r["furthest_rank"], r["n_errors"]) for r in rows) == sorted((r["chapter"], r["furthest_rank"], r["n_errors"]) for r in want)


def test_sessions(spark, feed):
    rows = run(jobs.run_sessions(jobs.event_stream(spark, feed)), "sessions", "complete").collect()
    assert sorted((r["profile"], r["n"]) for r in rows) == sorted((r["profile"], r["n"]) for r in listening.run_sessions(spark, DATA).collect())


def test_page_ingest(spark, tmp_path):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    src, held = str(tmp_path / "src"), str(tmp_path / "held")
    pages.write.parquet(src)
    for k in range(2):  # the second run brings the same pages again
        if k:
            pages.write.mode("append").parquet(src)
        q = jobs.ingest_pages(spark, src, held, str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
    n = pages.count()
    assert spark.read.parquet(held).count() == n == spark.read.parquet(held).select("page_id").distinct().count()
    assert {r["outcome"]: r["count"] for r in spark.read.parquet(held + "-log").groupBy("outcome").count().collect()} == {"ingested": n, "have": n}


def test_page_ingest_is_replayed_once(spark, tmp_path):
    """A micro-batch whose commit was lost is run again with the same number; the held pages and the log stay as they were."""
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    src, held, ck = (str(tmp_path / x) for x in ("src", "held", "ck"))

    def once():
        q = jobs.ingest_pages(spark, src, held, ck).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(map(str, spark.read.parquet(held).drop("html").collect())), sorted(map(str, spark.read.parquet(held + "-log").collect()))

    for k in (0, 1):
        (pages if k else pages.where("page_id % 2 = 0")).coalesce(1).write.mode("append").parquet(src)
        want = once()
    commits = sorted(p for p in (tmp_path / "ck" / "commits").iterdir() if p.name.isdigit())
    for p in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        p.unlink(missing_ok=True)
    assert once() == want and len(want[0]) == pages.count() and len(want[1]) == pages.count() + pages.where("page_id % 2 = 0").count()


def split_run(spark, make, feed, tmp_path, mode, halves=(2, 4)):
    """Two runs over one checkpoint: the second goes on where the first was stopped."""
    seen = []
    src, ck = tmp_path / "in", str(tmp_path / "ck")
    src.mkdir()
    files = sorted(__import__("pathlib").Path(feed).glob("part-*.parquet"), key=lambda f: f.stat().st_mtime_ns)
    done = 0
    for upto in halves:
        for k, f in enumerate(files[done:upto]):
            (src / f.name).write_bytes(f.read_bytes())
            os.utime(src / f.name, (time.time() - 60 + k,) * 2)  # the stream takes files by their times
        before, done = done, upto
        q = make(jobs.event_stream(spark, str(src))).writeStream.outputMode(mode).option("checkpointLocation", ck).foreachBatch(lambda df, _: seen.extend(df.collect())).start()
        ends, full = time.time() + 60, set()
        while len(full) < upto - before and time.time() < ends and q.isActive:  # a query with processing time has batches without rows for as long as it runs
            full |= {p["batchId"] for p in q.recentProgress if p["numInputRows"]}
            time.sleep(0.1)
        q.stop()
    return seen


def test_state_survives_a_restart(spark, feed, tmp_path):
    rows = split_run(spark, jobs.access_log, feed, tmp_path, "append")
    assert sorted((r["profile"], r["event_type"], str(r["ts"])) for r in rows) == sorted((r["profile"], r["event_type"], str(r["ts"])) for r in listening.access_log(spark, DATA).collect())


def test_state_expires(spark, tmp_path):
    """Without a time to live a listener's visit goes on from batch to batch; with one that has passed it starts anew."""
    steps = [(k, 1, "view", float(k), '{"k": 3}', f"2024-01-01 00:00:{k:02d}") for k in range(20)]
    for n in range(4):
        df = spark.createDataFrame(steps[5 * n : 5 * n + 5], "event_id bigint, user_id bigint, event_type string, value double, props string, t string")
        df.selectExpr("event_id", "CAST(t AS timestamp_ntz) AS ts", "user_id", "event_type", "value", "props").coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    for keep, want in ((jobs.KEEP_MS, [4000, 9000, 14000, 19000]), (1, [4000] * 4)):
        (tmp_path / str(keep)).mkdir()
        rows = split_run(spark, lambda e: jobs.furthest_listened(e, keep_ms=keep), str(tmp_path / "feed"), tmp_path / str(keep), "update")  # noqa: B023
        assert [r["listened_ms"] for r in rows] == want


def test_state_starts_from_the_batch_twin(spark, feed, tmp_path):
    """A stream that starts from entries logged after its events logs nothing for their clients, and all for others."""
    start = spark.createDataFrame([(k, "view", "2030-01-01 00:00:00") for k in range(3)], "profile bigint, event_type string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = split_run(spark, lambda e: jobs.access_log(e, logged=start), feed, tmp_path, "append", halves=(1,))
    first = spark.read.parquet(sorted(__import__("pathlib").Path(feed).glob("part-*.parquet"), key=lambda f: f.stat().st_mtime_ns)[0].as_uri())
    keys = {(r[0], r[1]) for r in first.select("user_id", "event_type").distinct().collect()}
    assert {(r["profile"], r["event_type"]) for r in rows} == {k for k in keys if not (k[0] < 3 and k[1] == "view")} != keys
