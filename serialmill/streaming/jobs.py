"""Structured Streaming jobs. Each takes a streaming DataFrame and returns one; sinks and triggers are the caller's.

``events`` streams have event_id, ts, user_id, event_type, value, props. Windows drop late rows by their watermark.
Jobs whose rule depends on the order of a key's rows keep one small state for each key; rows of one trigger are taken in
time order, and a key's state expires ``keep_ms`` of processing time after its last row. The state of ``stages`` and
``positions`` is a row for each chapter or profile, as is the table that they keep.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from serialmill.session import ship_code

WATERMARK = "10 minutes"
KEEP_MS = 30 * 24 * 3600 * 1000
BUCKETS = 64

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files of events as a stream."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return raw.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("profile"), "event_type", F.col("value").alias("seconds"), F.get_json_object("props", "$.k").cast("int").alias("chapter"))


def run_sessions(events: DataFrame, gap: str = "900 seconds", watermark: str = WATERMARK) -> DataFrame:
    """STM7: runs of a profile, closed by a gap."""
    s = events.withWatermark("ts", watermark).groupBy("profile", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return s.select("profile", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("closes"), "n")


def run_report(events: DataFrame, every: str = "1 day", watermark: str = WATERMARK) -> DataFrame:
    """STM8: counts by kind in tumbling windows."""
    kind = lambda k, name: F.count_if(F.col("event_type") == k).alias(name)
    g = events.withWatermark("ts", watermark).groupBy(F.window("ts", every)).agg(kind("purchase", "done"), kind("error", "errors"), kind("view", "skipped"))
    return g.select(F.col("window.start").alias("start"), "done", "errors", "skipped")


def stages(events: DataFrame) -> DataFrame:
    """STM5: the furthest stage of each chapter; errors demote nothing (update or complete mode)."""
    e = F.col("event_type")
    rank = F.when(e == "view", 0).when(e == "click", 1).when(e == "signup", 2).when(e == "purchase", 3).otherwise(-1)
    return events.groupBy("chapter").agg(F.max(rank).alias("furthest_rank"), F.count_if(e == "error").alias("n_errors"))


def positions(events: DataFrame) -> DataFrame:
    """STM1: the place of each profile. The latest write wins by (time, id); the furthest chapter only moves forward, and its
    time follows the writes there (update mode)."""
    e = events.where("chapter IS NOT NULL")
    last = F.max_by(F.struct("chapter", "seconds"), F.struct("ts", "event_id"))
    far = F.max_by(F.struct("chapter", "seconds"), F.struct("chapter", "ts", "event_id"))
    p = e.groupBy("profile").agg(last.alias("l"), far.alias("f"), F.max("ts").alias("updated_at"))
    return p.select("profile", "l.chapter", F.col("l.seconds").alias("t"), F.col("f.chapter").alias("furthest"), F.col("f.seconds").alias("furthest_t"), "updated_at")


class _Fold(StatefulProcessor):
    """Folds a key's rows, in time order, into a state that a subclass names. States live in RocksDB and expire ``keep_ms`` of processing time after
    their last write. Of the rows of one trigger only the columns in ``reads`` are held, as arrays; how many that are is bounded by the trigger."""

    reads: tuple[str, ...] = ()

    def __init__(self, keep_ms: int = KEEP_MS):
        self.keep_ms = keep_ms

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        parts: dict[str, list] = {c: [] for c in ("stamp", "event_id", *self.reads)}
        for frame in rows:
            for c, held in parts.items():
                held.append(frame[c].to_numpy())
        cols = {c: np.concatenate(held) for c, held in parts.items()}
        order = np.lexsort((cols["event_id"], cols["stamp"]))
        out = self.fold(key, {c: x[order] for c, x in cols.items()})
        if len(out):
            yield pd.DataFrame(out)

    def value(self, handle, name: str, schema: str):
        return handle.getValueState(name, schema, ttlDurationMs=self.keep_ms)

    def close(self) -> None:
        pass


class _AccessLog(_Fold):
    def __init__(self, quiet: int, keep_ms: int):
        super().__init__(keep_ms)
        self.quiet = quiet * 1_000_000

    def init(self, handle) -> None:
        self.last = self.value(handle, "last", "stamp bigint")

    def handleInitialState(self, key, initialState, timerValues):  # noqa: N802, N803
        self.last.update((int(initialState["stamp"].max()),))

    def fold(self, key, cols):
        last = self.last.get()[0] if self.last.exists() else None
        stamps, logged, at = cols["stamp"], [], 0
        while at < len(stamps):  # from one logged hit to the first that is late enough
            if last is None or stamps[at] - last >= self.quiet:
                last = int(stamps[at])
                logged.append({"profile": key[0], "event_type": key[1], "stamp": last})
            at = max(at + 1, int(np.searchsorted(stamps, last + self.quiet)))
        if logged:
            self.last.update((last,))
        return logged


class _Listened(_Fold):
    reads = ("chapter", "seconds", "event_type")

    def __init__(self, least_ms: int, keep_ms: int):
        super().__init__(keep_ms)
        self.least_ms = least_ms

    def init(self, handle) -> None:
        self.visit = self.value(handle, "visit", "chapter int, seconds double, ms bigint")
        self.total = self.value(handle, "total", "furthest int, ms bigint")

    def fold(self, key, cols):
        chapter, seconds, ms = self.visit.get() if self.visit.exists() else (-1, 0.0, 0)
        furthest, total = self.total.get() if self.total.exists() else (-1, 0)
        chapters = np.nan_to_num(cols["chapter"].astype(float), nan=-1).astype(int)
        for c, t, kind in zip(chapters.tolist(), cols["seconds"].tolist(), cols["event_type"], strict=True):
            if c != chapter:
                chapter, ms = c, 0
            elif c >= 0 and 0 <= t - seconds <= 2:
                step = round((t - seconds) * 1000)
                ms, total = ms + step, total + step
            seconds = t
            if c > furthest and (ms >= self.least_ms or kind == "purchase"):
                furthest = c
        self.visit.update((chapter, seconds, ms))
        self.total.update((furthest, total))
        return [{"profile": key[0], "furthest": furthest, "listened_ms": total}]


class _Counters(_Fold):
    reads = ("event_type",)

    def init(self, handle) -> None:
        self.pending = self.value(handle, "pending", "n bigint")

    def handleInitialState(self, key, initialState, timerValues):  # noqa: N802, N803
        self.pending.update((int(initialState["pending"].iloc[0]),))

    def fold(self, key, cols):
        pending = self.pending.get()[0] if self.pending.exists() else 0
        for kind in cols["event_type"]:
            pending = 0 if kind == "signup" else max(0, pending + (kind == "purchase") - (kind == "error"))
        self.pending.update((int(pending),))
        return [{"profile": key[0], "pending": int(pending)}]


class _Playback(_Fold):
    reads = ("event_type",)

    def __init__(self, newest: int, keep_ms: int):
        super().__init__(keep_ms)
        self.newest = newest

    def init(self, handle) -> None:
        self.entries = handle.getListState("entries", "event_id bigint", ttlDurationMs=self.keep_ms)
        self.due = self.value(handle, "due", "due boolean")

    def fold(self, key, cols):
        ids = [r[0] for r in self.entries.get()] if self.entries.exists() else []
        due = bool(self.due.get()[0]) if self.due.exists() else False
        kinds = cols["event_type"]
        sent = np.flatnonzero(kinds == "signup")
        after = kinds[sent[-1] + 1 :] if len(sent) else kinds
        due = (due and not len(sent)) or bool(np.isin(after, ["error", "view"]).any())
        ids = [*ids, *cols["event_id"][kinds != "signup"].tolist()][-self.newest :]
        if ids:
            self.entries.put([(i,) for i in ids])
        self.due.update((due,))
        return [{"profile": key[0], "entries": ids, "due": due}]


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _folded(events: DataFrame, keys: list[str], processor: _Fold, out: str, mode: str, initial: DataFrame | None = None) -> DataFrame:
    """``initial``: rows of the batch twin that the states start from; only keys that the stream's first batch may meet again are kept by their time to live."""
    spark = events.sparkSession
    ship_code(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = events.select("profile", "event_type", "event_id", F.unix_micros("ts").alias("stamp"), "chapter", "seconds")
    start = None if initial is None else initial.groupBy(*keys)
    return rows.groupBy(*keys).transformWithStateInPandas(processor, out, mode, "ProcessingTime", start)


def access_log(events: DataFrame, quiet: int = 600, keep_ms: int = KEEP_MS, logged: DataFrame | None = None) -> DataFrame:
    """STM3: one entry for a client and path in ``quiet`` seconds since the last entry logged; a suppressed hit does not extend it (append mode).
    ``logged``: entries of the batch twin (profile, event_type, ts) that the stream goes on from."""
    start = None if logged is None else logged.select("profile", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("stamp"))
    kept = _folded(events, ["profile", "event_type"], _AccessLog(quiet, keep_ms), "profile bigint, event_type string, stamp bigint", "append", start)
    return kept.select("profile", "event_type", F.timestamp_micros("stamp").alias("ts"))


def furthest_listened(events: DataFrame, least_ms: int = 30_000, keep_ms: int = KEEP_MS) -> DataFrame:
    """STM2: the furthest chapter that was listened to for ``least_ms`` in one visit, or finished; seeks do not count (update mode)."""
    return _folded(events, ["profile"], _Listened(least_ms, keep_ms), "profile bigint, furthest int, listened_ms bigint", "update")


def live_counters(events: DataFrame, keep_ms: int = KEEP_MS, counted: DataFrame | None = None) -> DataFrame:
    """STM6: deltas since the last resync, floored at 0 after each (update mode). ``counted``: rows of the batch twin (profile, pending) to go on from."""
    return _folded(events, ["profile"], _Counters(keep_ms), "profile bigint, pending bigint", "update", None if counted is None else counted.select("profile", "pending"))


def playback_log(events: DataFrame, newest: int = 50, keep_ms: int = KEEP_MS) -> DataFrame:
    """STM9: the newest entries of each client since ever, and whether one worth sending came after the last sending (update mode)."""
    return _folded(events, ["profile"], _Playback(newest, keep_ms), "profile bigint, entries array<bigint>, due boolean", "update")


def ingest_pages(spark: SparkSession, path: str, held: str, checkpoint: str):
    """STM4, SRC1: pages arriving as files are appended to ``held`` once by page id, and every arrival to ``<held>-log`` with its outcome and its file.

    ``held`` is parted by a bucket of the id and by micro-batch, ``<held>-log`` by micro-batch. A micro-batch reads the ids of its own buckets from
    earlier micro-batches only, and overwrites its own partitions, so one that is replayed after a crash writes the same rows again, once.
    The checkpoint remembers the files that were read; a run with ``trigger(availableNow=True)`` takes what is new and ends."""
    stream = spark.readStream.schema("page_id bigint, url string, html string").parquet(path).select("*", F.col("_metadata.file_path").alias("file"))

    def merge(batch: DataFrame, epoch: int) -> None:
        batch = batch.withColumn("bucket", F.pmod(F.xxhash64("page_id"), F.lit(BUCKETS)).cast("int")).withColumn("batch", F.lit(epoch).cast("bigint")).persist()
        buckets = [r[0] for r in batch.select("bucket").distinct().collect()]
        have = spark.createDataFrame([], "page_id bigint")
        try:
            before = spark.read.schema("page_id bigint, bucket int, batch bigint").parquet(held)
            have = before.where(F.col("bucket").isin(buckets) & (F.col("batch") < epoch)).select("page_id")
        except Exception as e:  # nothing is held yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        known = have.distinct().withColumn("known", F.lit(True))
        first = F.row_number().over(Window.partitionBy("page_id").orderBy("file", "url", "html")) == 1
        marked = batch.withColumn("first", first).join(known, "page_id", "left").persist()
        outcome = F.when(F.col("page_id").isNull(), "rejected").when(F.col("known") | ~F.col("first"), "have").otherwise("ingested")
        own = lambda df: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        own(marked.select("page_id", "file", outcome.alias("outcome"), "batch")).partitionBy("batch").parquet(f"{held}-log")
        own(marked.where("known IS NULL AND first AND page_id IS NOT NULL").drop("known", "first")).partitionBy("bucket", "batch").parquet(held)
        marked.unpersist()
        batch.unpersist()

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
