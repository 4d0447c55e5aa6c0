"""Sinks: a folder of files for each chapter or series, by Spark's own partitioned writers.

Rows are dealt by the folder they go to, and within it by pieces of PIECE rows, so that a chapter or series of any size is written by many tasks, each a sorted file.
A task that fails leaves nothing, and one that is repeated writes its files once: the writers commit a task's files when it ends and a job's when all have. Each
sink overwrites only the folders that it writes to.

A folder for each is for the few that a run touches. A whole library has more chapters and series than a file system lists or opens in good time, so it is written by
``shelves``: that many folders, to which chapters or series are dealt by their hash, as lines that hold their keys. The number of files then goes with the shelves
and the rows. Such a store is written whole, to a new path only, so nothing on a shelf is lost to a later run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one file.
PIECE = 100_000
#: Folders of a whole library.
SHELVES = 64


def shelf(key: Column, shelves: int = SHELVES) -> Column:
    """The shelf of a chapter or series: a reader of one looks only there."""
    return F.pmod(F.xxhash64(key), F.lit(shelves)).cast("int")


def _dealt(df: DataFrame, folder: str, order: list[str], place: Column | None = None) -> DataFrame:
    piece = F.floor(place / PIECE) if place is not None else F.lit(0)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.withColumn("_piece", piece).repartition(n, folder, "_piece").sortWithinPartitions(folder, "_piece", *order).drop("_piece")


def _own(df: DataFrame, folder: str):
    return df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(folder)


def _placed(df: DataFrame, key: str, order: list[str], shelves: int, place: Column | None = None, drop: tuple[str, ...] = ()):
    """The writer of ``df`` to the folders of its keys, or to shelves; columns of ``drop`` only order the rows."""
    if not shelves:
        return _own(_dealt(df, key, order, place).drop(*drop), key)
    return _dealt(df.withColumn("shelf", shelf(F.col(key), shelves)), "shelf", [key, *order], place).drop(*drop).write.partitionBy("shelf")


def write_segments(script: DataFrame, path: str, chapter: str, shelves: int = 0) -> None:
    """SNK1: the segments of each chapter in order, as lines of JSON in the chapter's folder or on its shelf."""
    _placed(script, chapter, ["seg_no"], shelves, F.col("seg_no")).json(path)


def read_segments(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_texts(texts: DataFrame, path: str, chapter: str, body: str, shelves: int = 0) -> None:
    """SNK2: one Markdown text for each chapter; on shelves, a line of JSON with the chapter and its text."""
    out = _placed(texts.select(chapter, body), chapter, [], shelves)
    out.json(path) if shelves else out.text(path)


def read_texts(spark: SparkSession, path: str, body: str, schema=None) -> DataFrame:
    """The texts with their chapters. Each file is a row, which ends with the line end that its writer added; from shelves (``schema`` of what was written), each line."""
    if schema is not None:
        return spark.read.schema(schema).json(path)
    return spark.read.text(path, wholetext=True).withColumn("value", F.regexp_replace("value", r"\n\z", "")).withColumnRenamed("value", body)


def write_states(states: DataFrame, path: str, series: str, state: str, shelves: int = 0) -> None:
    """SNK3: one state document for each series, as SRC7 reads it; on shelves, a document a line."""
    _placed(states.select(series, state), series, [], shelves, drop=(series,) if shelves else ()).text(path)


def write_feeds(feed: DataFrame, path: str, series: str, shelves: int = 0) -> None:
    """SNK4: the channel and the items of each series, newest first, as lines of JSON."""
    newest = feed.withColumn("_rank", F.when(F.col("kind") == "channel", 0).otherwise(1)).withColumn("_date", -F.unix_micros(F.col("feed_date").cast("timestamp")))
    _placed(newest, series, ["_rank", "_date", "guid"], shelves, drop=("_rank", "_date")).json(path)
