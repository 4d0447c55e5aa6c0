"""Events as listening: positions, runs, sessions, progress. The batch twins of the streams in ``serialmill.streaming``."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from serialmill.functions.order import placed
from serialmill.operators.registry import registry
from serialmill.session import ship_code
from serialmill.sources.bindings import PLAYS_SQL, chapters, plays, table

QUERIES, ORACLES, query = registry()

RUN_GAP = 900
NOW = "2024-02-01 00:00:00"


def _w():
    return Window.partitionBy("profile").orderBy("ts", "event_id")


def _with(sql: str) -> str:
    return f"WITH {PLAYS_SQL} {sql}"


WEEK = 604800.0


@query("flt14_position_writes", _with("""
, c AS (SELECT o_custkey AS series, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS ord FROM orders)
SELECT event_id, profile, least(greatest(seconds, 0), 604800)::DOUBLE AS t, CASE WHEN n.c_custkey IS NULL THEN 'unknown series' WHEN NOT regexp_matches(n.c_name, '^[A-Za-z0-9#][A-Za-z0-9 #._-]{0,39}$') THEN 'bad name'
  WHEN chapter IS NULL OR c.ord IS NULL THEN 'unknown chapter' ELSE 'ok' END AS verdict FROM plays LEFT JOIN customer n ON n.c_custkey = profile LEFT JOIN c ON c.series = profile AND c.ord = chapter"""))
def position_writes(spark, d):
    """Seconds are clamped to a week; writes are rejected without a known series, a proper profile name, or a chapter of that series."""
    named = table(spark, d, "customer").select(F.col("c_custkey").alias("profile"), F.col("c_name").alias("name"))
    known = chapters(spark, d).select(F.col("series").alias("profile"), F.col("ord").alias("chapter"), F.lit(True).alias("held"))
    j = plays(spark, d).join(named, "profile", "left").join(known, ["profile", "chapter"], "left")
    verdict = F.when(F.col("name").isNull(), "unknown series").when(~F.col("name").rlike("^[A-Za-z0-9#][A-Za-z0-9 #._-]{0,39}$"), "bad name").when(F.col("held").isNull(), "unknown chapter").otherwise("ok")
    return j.select("event_id", "profile", F.least(F.greatest("seconds", F.lit(0.0)), F.lit(WEEK)).alias("t"), verdict.alias("verdict"))


@query("stm1_positions", _with("""SELECT profile, arg_max(chapter, (ts, event_id)) AS chapter, arg_max(seconds, (ts, event_id)) AS t, max(chapter) AS furthest, arg_max(seconds, (chapter, ts, event_id)) AS furthest_t,
  max(ts) AS updated_at FROM plays WHERE chapter IS NOT NULL GROUP BY profile"""))
def positions(spark, d):
    """Current place: the last write; furthest chapter: only forward, its time that of the last write there."""
    last = F.max_by(F.struct("chapter", "seconds"), F.struct("ts", "event_id"))
    far = F.max_by("seconds", F.struct("chapter", "ts", "event_id"))
    p = plays(spark, d).where("chapter IS NOT NULL").groupBy("profile").agg(last.alias("l"), F.max("chapter").alias("furthest"), far.alias("furthest_t"), F.max("ts").alias("updated_at"))
    return p.select("profile", "l.chapter", F.col("l.seconds").alias("t"), "furthest", "furthest_t", "updated_at")


@query("stm2_furthest_listened", _with("""
, s AS (SELECT *, lag(seconds) OVER w AS was, lag(chapter) OVER w AS was_chapter FROM plays WINDOW w AS (PARTITION BY profile ORDER BY ts, event_id))
, g AS (SELECT *, sum((was_chapter IS DISTINCT FROM chapter)::INT) OVER (PARTITION BY profile ORDER BY ts, event_id) AS visit, CASE WHEN was_chapter = chapter AND seconds - was BETWEEN 0 AND 2 THEN seconds - was ELSE 0 END AS step FROM s)
, h AS (SELECT profile, visit, any_value(chapter) AS chapter, sum(round(step * 1000)::BIGINT) AS ms, bool_or(event_type = 'purchase') AS finished FROM g GROUP BY profile, visit)
SELECT profile, max(chapter) FILTER (ms >= 30000 OR finished) AS furthest, sum(ms)::BIGINT AS listened_ms FROM h GROUP BY profile"""))
def furthest_listened(spark, d, least_ms: int = 30_000):
    """Only steps of 0 to 2 s of the playhead count as listening; a change of chapter starts anew. A chapter counts once it was listened to for
    half a minute in one visit, or finished (a purchase event)."""
    s = plays(spark, d).select("*", F.lag("seconds").over(_w()).alias("was"), F.lag("chapter").over(_w()).alias("was_chapter"))
    same = F.col("was_chapter") == F.col("chapter")
    step = F.col("seconds") - F.col("was")
    visit = F.sum((~F.col("was_chapter").eqNullSafe(F.col("chapter"))).cast("int")).over(_w())
    g = s.select("profile", "chapter", "event_type", visit.alias("visit"), F.when(same & step.between(0, 2), step).otherwise(0.0).alias("step"))
    h = g.groupBy("profile", "visit").agg(F.any_value("chapter").alias("chapter"), F.sum(F.round(F.col("step") * 1000).cast("bigint")).alias("ms"), F.bool_or(F.col("event_type") == "purchase").alias("finished"))
    return h.groupBy("profile").agg(F.max(F.when((F.col("ms") >= least_ms) | F.col("finished"), F.col("chapter"))).alias("furthest"), F.sum("ms").alias("listened_ms"))


@query("stm3_access_log", f"""WITH RECURSIVE {PLAYS_SQL}, a AS (
  SELECT profile, event_type, ts, event_id, row_number() OVER (PARTITION BY profile, event_type ORDER BY ts, event_id) AS k FROM plays
), r AS (
  SELECT profile, event_type, k, ts, ts AS logged, true AS hit FROM a WHERE k = 1
  UNION ALL SELECT a.profile, a.event_type, a.k, a.ts, CASE WHEN a.ts - r.logged >= INTERVAL 600 SECOND THEN a.ts ELSE r.logged END, a.ts - r.logged >= INTERVAL 600 SECOND
  FROM r JOIN a ON a.profile = r.profile AND a.event_type = r.event_type AND a.k = r.k + 1
) SELECT profile, event_type, ts FROM r WHERE hit""")
def access_log(spark, d, quiet: int = 600):
    """One entry for a client and path in ``quiet`` seconds since the last entry that was logged.

    A suppressed hit does not extend the window, so the rule is a fold over a client's hits in order. Sorted hits stream past
    one held time, so a client of any size takes constant memory.
    """
    ship_code(spark)
    gap = quiet * 1_000_000

    def run(batches):
        now, last = None, 0
        for b in batches:
            keep = []
            for i, (who, kind, t) in enumerate(zip(*(c.to_pylist() for c in b.columns), strict=True)):
                if (who, kind) != now or t - last >= gap:
                    now, last = (who, kind), t
                    keep.append(i)
            yield b.take(pa.array(keep, pa.int64()))

    hits = plays(spark, d).select("profile", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    ordered = hits.repartition("profile", "event_type").sortWithinPartitions("profile", "event_type", "t")
    kept = ordered.mapInArrow(run, "profile bigint, event_type string, t bigint")
    return kept.select("profile", "event_type", F.timestamp_micros("t").cast("timestamp_ntz").alias("ts"))


@query("stm5_stage_from_events", _with("""SELECT chapter, max(CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE -1 END) AS furthest_rank,
  max(ts) FILTER (event_type <> 'error') AS updated_at, count(*) FILTER (event_type = 'error') AS n_errors FROM plays GROUP BY chapter"""))
def stage_from_events(spark, d):
    """The furthest stage a chapter reached; errors demote nothing."""
    e = F.col("event_type")
    rank = F.when(e == "view", 0).when(e == "click", 1).when(e == "signup", 2).when(e == "purchase", 3).otherwise(-1)
    return plays(spark, d).groupBy("chapter").agg(F.max(rank).alias("furthest_rank"), F.max(F.when(e != "error", F.col("ts"))).alias("updated_at"), F.count_if(e == "error").alias("n_errors"))


@query("stm6_live_counters", f"""WITH RECURSIVE {PLAYS_SQL}, a AS (SELECT profile, event_type, row_number() OVER (PARTITION BY profile ORDER BY ts, event_id) AS k FROM plays),
r AS (SELECT profile, k, CASE event_type WHEN 'purchase' THEN 1 ELSE 0 END AS pending FROM a WHERE k = 1
  UNION ALL SELECT a.profile, a.k, CASE a.event_type WHEN 'signup' THEN 0 WHEN 'purchase' THEN r.pending + 1 WHEN 'error' THEN greatest(0, r.pending - 1) ELSE r.pending END FROM r JOIN a ON a.profile = r.profile AND a.k = r.k + 1)
SELECT profile, arg_max(pending, k)::BIGINT AS pending FROM r GROUP BY profile""")
def live_counters(spark, d):
    """Deltas since the last resync (a signup event), floored at 0 after each. A floored sum is the sum less its least running value, if that is below 0."""
    x = plays(spark, d).select("*", F.sum((F.col("event_type") == "signup").cast("int")).over(_w()).alias("sync_no"))
    delta = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    run = x.select("profile", "sync_no", delta.alias("delta"), F.sum(delta).over(Window.partitionBy("profile", "sync_no").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)).alias("s"))
    last = run.groupBy("profile", "sync_no").agg((F.sum("delta") - F.least(F.lit(0), F.min("s"))).alias("pending"))
    return last.groupBy("profile").agg(F.max_by("pending", "sync_no").alias("pending"))


@query("stm7_run_sessions", _with("""
, b AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY profile ORDER BY ts, event_id) > INTERVAL 900 SECOND, true) AS brk FROM plays)
, s AS (SELECT *, sum(brk::INT) OVER (PARTITION BY profile ORDER BY ts, event_id) AS no FROM b)
SELECT profile, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM s GROUP BY profile, no"""))
def run_sessions(spark, d):
    g = plays(spark, d).select("profile", F.col("ts").cast("timestamp").alias("ts")).groupBy("profile", F.session_window("ts", f"{RUN_GAP} seconds"))
    s = g.agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n"))
    return s.select("profile", F.col("started").cast("timestamp_ntz").alias("started"), F.col("ended").cast("timestamp_ntz").alias("ended"), "n")


@query("stm8_run_report", _with("""SELECT date_trunc('day', ts) AS day, count(*) FILTER (event_type = 'purchase') AS done, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'view') AS skipped,
  sum(round(seconds * 100)::BIGINT)::BIGINT AS centiseconds FROM plays GROUP BY 1"""))
def run_report(spark, d):
    """Tumbling windows of a day with counts by kind."""
    e = plays(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    kind = lambda k, name: F.count_if(F.col("event_type") == k).alias(name)
    g = e.groupBy(F.window("ts", "1 day")).agg(kind("purchase", "done"), kind("error", "errors"), kind("view", "skipped"), F.sum(F.round(F.col("seconds") * 100).cast("bigint")).alias("centiseconds"))
    return g.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "done", "errors", "skipped", "centiseconds")


@query("stm9_playback_log", _with("""
, s AS (SELECT profile, max((ts, event_id)) FILTER (event_type = 'signup') AS sent FROM plays GROUP BY profile)
, d AS (SELECT p.profile, coalesce(bool_or(event_type IN ('error', 'view') AND (sent IS NULL OR (ts, event_id) > sent)), false) AS due FROM plays p JOIN s USING (profile) GROUP BY p.profile)
SELECT p.profile, event_id, ts, due FROM (SELECT * FROM plays WHERE event_type <> 'signup' QUALIFY row_number() OVER (PARTITION BY profile ORDER BY ts DESC, event_id DESC) <= 50) p JOIN d USING (profile)"""))
def playback_log(spark, d, newest: int = 50):
    """The newest entries of each client, and whether one worth sending (an error, a view) came after the last sending (a signup)."""
    e, kind = plays(spark, d), F.col("event_type")
    last = lambda on: F.max(F.when(on, F.struct("ts", "event_id")))
    due = e.groupBy("profile").agg(last(kind == "signup").alias("sent"), last(kind.isin("error", "view")).alias("news"))
    due = due.select("profile", F.coalesce(F.col("news").isNotNull() & (F.col("sent").isNull() | (F.col("news") > F.col("sent"))), F.lit(False)).alias("due"))
    w = Window.partitionBy("profile").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    kept = e.where(kind != "signup").withColumn("r", F.row_number().over(w)).where(F.col("r") <= newest)
    return kept.join(due, "profile").select("profile", "event_id", "ts", "due")


@query("win5_current_run", _with("""
, r AS (SELECT *, ts + INTERVAL 60 SECOND AS ended FROM plays WHERE event_type = 'purchase')
, c AS (SELECT *, coalesce(epoch(lag(ts) OVER (PARTITION BY profile ORDER BY ended DESC, event_id DESC)) - epoch(ended) > 864000, false) AS brk FROM r)
, s AS (SELECT *, sum(brk::INT) OVER (PARTITION BY profile ORDER BY ended DESC, event_id DESC) AS breaks FROM c)
SELECT profile, count(*) AS n_in_run, min(ts) AS run_started FROM s WHERE breaks = 0 GROUP BY profile"""))
def current_run(spark, d, gap: int = 864000):
    """The chain of renders from the newest back, broken where the newer one's start is more than ``gap`` seconds after this one's end."""
    r = plays(spark, d).where("event_type = 'purchase'").select("profile", "event_id", "ts", F.expr("ts + INTERVAL 60 SECOND").alias("ended"))
    w = Window.partitionBy("profile").orderBy(F.col("ended").desc(), F.col("event_id").desc())
    s = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    c = r.select("*", F.coalesce(F.lag(s("ts")).over(w) - s("ended") > gap * 1_000_000, F.lit(False)).alias("brk"))
    c = c.withColumn("breaks", F.sum(F.col("brk").cast("int")).over(w)).where("breaks = 0")
    return c.groupBy("profile").agg(F.count("*").alias("n_in_run"), F.min("ts").alias("run_started"))


@query("win6_in_flight", _with(f"""SELECT profile, chapter, epoch_us(TIMESTAMP '{NOW}') - epoch_us(max(ts)) AS elapsed_us FROM plays WHERE chapter IS NOT NULL GROUP BY profile, chapter
HAVING arg_max(event_type, (ts, event_id)) = 'view'"""))
def in_flight(spark, d, now: str = NOW):
    """Started (a view last) and not ended, with the time since, against a given now."""
    g = plays(spark, d).where("chapter IS NOT NULL").groupBy("profile", "chapter").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"), F.max("ts").alias("at"))
    elapsed = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp"))
    return g.where("last = 'view'").select("profile", "chapter", elapsed.alias("elapsed_us"))


@query("agg19_profile_summary", """SELECT c_custkey AS profile, count(e.event_id) AS places, max(e.ts) AS last_listened FROM customer LEFT JOIN events e ON e.user_id = c_custkey GROUP BY 1""")
def profile_summary(spark, d):
    e = plays(spark, d).groupBy("profile").agg(F.count("*").alias("places"), F.max("ts").alias("last_listened"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("profile"))
    return c.join(e, "profile", "left").select("profile", F.coalesce("places", F.lit(0).cast("bigint")).alias("places"), "last_listened")


@query("agg22_error_triage", _with("SELECT profile, count(*) AS n_errors, arg_max(left('chapter ' || chapter || ' failed', 120), (ts, event_id)) AS last_message FROM plays WHERE event_type = 'error' GROUP BY profile"))
def error_triage(spark, d):
    message = F.left(F.concat(F.lit("chapter "), F.col("chapter").cast("string"), F.lit(" failed")), F.lit(120))
    return plays(spark, d).where("event_type = 'error'").groupBy("profile").agg(F.count("*").alias("n_errors"), F.max_by(message, F.struct("ts", "event_id")).alias("last_message"))


@query("agg13_progress", _with("""
, r AS (SELECT *, ts + INTERVAL 60 SECOND AS ended FROM plays WHERE event_type = 'purchase')
, c AS (SELECT *, coalesce(epoch(lag(ts) OVER (PARTITION BY profile ORDER BY ended DESC, event_id DESC)) - epoch(ended) > 864000, false) AS brk FROM r)
, s AS (SELECT *, sum(brk::INT) OVER (PARTITION BY profile ORDER BY ended DESC, event_id DESC) AS breaks FROM c)
, g AS (SELECT p.profile, count(*) FILTER (event_type = 'view') AS outstanding, count(*) FILTER (event_type = 'purchase') AS done, (SELECT count(*) FROM s WHERE s.profile = p.profile AND breaks = 0) AS done_in_run,
  round(median(seconds) FILTER (event_type = 'purchase') * 1000)::BIGINT AS cost_ms FROM plays p GROUP BY p.profile)
SELECT profile, sum(outstanding)::BIGINT AS outstanding, sum(done)::BIGINT AS done, sum(done_in_run)::BIGINT AS done_in_run, CASE WHEN grouping(profile) = 0 THEN any_value(cost_ms) END AS cost_ms, sum(outstanding * cost_ms)::BIGINT AS eta_ms
FROM g GROUP BY ROLLUP (profile)"""))
def progress(spark, d):
    """Outstanding and done, of these in the current run, the median cost of a chapter and the time left, for each series and in all."""
    e, kind = plays(spark, d), F.col("event_type")
    cost = F.round(F.median(F.when(kind == "purchase", F.col("seconds"))) * 1000).cast("bigint")
    g = e.groupBy("profile").agg(F.count_if(kind == "view").alias("outstanding"), F.count_if(kind == "purchase").alias("done"), cost.alias("cost_ms"))
    g = g.join(current_run(spark, d).select("profile", F.col("n_in_run").alias("done_in_run")), "profile", "left").withColumn("done_in_run", F.coalesce("done_in_run", F.lit(0)))
    total = lambda c: F.sum(c).cast("bigint")
    sums = [total("outstanding").alias("outstanding"), total("done").alias("done"), total("done_in_run").alias("done_in_run"), F.when(F.grouping("profile") == 0, F.any_value("cost_ms")).alias("cost_ms"), total(F.col("outstanding") * F.col("cost_ms")).alias("eta_ms")]
    return g.rollup("profile").agg(*sums)


@query("srt3_newest_started", _with("SELECT profile, event_id, ts FROM (SELECT * FROM plays WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY profile ORDER BY ts DESC, event_id DESC) <= 400) ORDER BY ts DESC, event_id DESC LIMIT 25"))
def newest_started(spark, d):
    """The newest 400 of each series, then the newest 25 of all (a top-k report)."""
    w = Window.partitionBy("profile").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    r = plays(spark, d).where("event_type = 'purchase'").withColumn("r", F.row_number().over(w)).where("r <= 400")
    return r.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(25).select("profile", "event_id", "ts")


@query("srt6_continue_list", """WITH e AS (SELECT user_id, max(ts) AS updated FROM events GROUP BY user_id)
SELECT c_custkey AS profile, row_number() OVER (PARTITION BY c_nationkey ORDER BY updated DESC NULLS LAST, c_name) AS place, CASE WHEN updated IS NULL THEN 'never started' ELSE 'started' END AS state FROM customer LEFT JOIN e ON user_id = c_custkey""")
def continue_list(spark, d):
    e = plays(spark, d).groupBy("profile").agg(F.max("ts").alias("updated"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("profile"), "c_name", "c_nationkey")
    rows = c.join(e, "profile", "left").select("profile", "c_name", "c_nationkey", "updated")
    out = placed(rows, "c_nationkey", [F.desc_nulls_last("updated"), F.asc("c_name"), F.asc("profile")])
    return out.select("profile", "place", F.when(F.col("updated").isNull(), "never started").otherwise("started").alias("state"))


@query("jsn1_json_lists", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE len(json_keys(props)) END AS n_keys FROM events")
def json_lists(spark, d):
    """Bad JSON reads as an empty list."""
    text = F.when(F.col("event_id") % 3 == 0, F.lit("{broken")).otherwise(F.col("props"))
    keys = F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))
    return table(spark, d, "events").select("event_id", F.size(keys).cast("bigint").alias("n_keys"))


@query("win18_resume", _with("""
, p AS (SELECT profile, arg_max(chapter, (ts, event_id)) AS chapter, arg_max(seconds, (ts, event_id)) AS t, max(chapter) AS furthest FROM plays WHERE chapter IS NOT NULL GROUP BY profile)
SELECT profile, CASE WHEN t >= 100 - 8 THEN chapter + 1 ELSE chapter END AS resume_chapter, CASE WHEN t >= 100 - 8 THEN 0 ELSE t END::DOUBLE AS resume_t, greatest(0, 99 - furthest) AS n_new FROM p"""))
def resume(spark, d, length: float = 100.0, slack: float = 8.0):
    """A finished chapter (within ``slack`` of its end) resumes at the next one's start."""
    p = positions(spark, d)
    over = F.col("t") >= length - slack
    return p.select("profile", F.when(over, F.col("chapter") + 1).otherwise(F.col("chapter")).alias("resume_chapter"), F.when(over, 0.0).otherwise(F.col("t")).alias("resume_t"), F.greatest(F.lit(0), 99 - F.col("furthest")).alias("n_new"))


@query("snk5_progress_ndjson", _with("""SELECT event_id, to_json({'event_type': event_type, 'profile': profile, 'chapter': chapter, 'ms': round(seconds * 1000)::BIGINT})::VARCHAR AS value FROM plays"""))
def progress_ndjson(spark, d):
    """Events as lines of JSON, ready for a text or Kafka sink."""
    ms = F.round(F.col("seconds") * 1000).cast("bigint").alias("ms")
    return plays(spark, d).select("event_id", F.to_json(F.struct("event_type", "profile", "chapter", ms), {"ignoreNullFields": "false"}).alias("value"))


@query("win21_interval_union", _with("""
, i AS (SELECT profile, event_id, ts AS a, ts + INTERVAL 1 SECOND * (seconds * 60)::INT AS b FROM plays)
, m AS (SELECT *, max(b) OVER (PARTITION BY profile ORDER BY a, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM i)
, s AS (SELECT *, sum((before IS NULL OR a > before)::INT) OVER (PARTITION BY profile ORDER BY a, event_id) AS island FROM m)
SELECT profile, min(a) AS a, max(b) AS b, count(*) AS n FROM s GROUP BY profile, island"""))
def interval_union(spark, d):
    """Overlapping or touching spans merge."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    i = plays(spark, d).select("profile", "event_id", us.alias("a"), (us + F.bround(F.col("seconds") * 60).cast("int").cast("bigint") * 1_000_000).alias("b"))
    w = Window.partitionBy("profile").orderBy("a", "event_id")
    m = i.select("*", F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    s = m.select("*", F.sum((F.col("before").isNull() | (F.col("a") > F.col("before"))).cast("int")).over(w).alias("island"))
    back = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return s.groupBy("profile", "island").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.count("*").alias("n")).select("profile", back("a").alias("a"), back("b").alias("b"), "n")
