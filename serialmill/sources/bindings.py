"""The tables of a library, read from the star schema that stands in for them.

Each function returns a lazy DataFrame; the matching ``*_SQL`` text is the same table as a common
table expression, for SQL twins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Order of stages; error and skipped stand below all.
STAGES = {"new": 0, "fetched": 1, "parsed": 2, "rendered": 3}


def stage_rank(status):
    out = F.lit(-1)
    for name, rank in STAGES.items():
        out = F.when(status == name, rank).otherwise(out)
    return out


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as chapters: series, source_id, ord (from 0), n (from 1), status, unlocked, duration_s, volume, published."""
    o = table(spark, sf_dir, "orders")
    status = (
        F.when(F.col("o_orderpriority").startswith("4"), "skipped").when(F.col("o_orderstatus") == "F", "rendered")
        .when(F.col("o_orderstatus") == "P", "error").otherwise("new")
    )
    rows = o.select(
        F.col("o_custkey").alias("series"), F.col("o_orderkey").alias("source_id"), status.alias("status"), (F.col("o_orderkey") % 10 != 0).alias("unlocked"),
        (F.col("o_totalprice") / 100).alias("duration_s"), F.col("o_orderpriority").alias("volume"), F.col("o_orderdate").alias("published"),
    )
    in_order = Window.partitionBy("series").orderBy("published", "source_id")
    return rows.withColumn("n", F.row_number().over(in_order)).withColumn("ord", F.col("n") - 1)


CHAPTERS_SQL = """chapters AS (
  SELECT o_custkey AS series, o_orderkey AS source_id,
    CASE WHEN o_orderpriority LIKE '4%' THEN 'skipped' WHEN o_orderstatus = 'F' THEN 'rendered' WHEN o_orderstatus = 'P' THEN 'error' ELSE 'new' END AS status,
    o_orderkey % 10 <> 0 AS unlocked, o_totalprice / 100 AS duration_s, o_orderpriority AS volume, o_orderdate AS published,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS ord
  FROM orders
)"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer as series: series, title, slug, provider, priority, tag, enabled."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("series"), F.col("c_name").alias("title"), F.regexp_replace(F.lower("c_name"), "[^a-z0-9]+", "-").alias("slug"),
        F.col("c_nationkey").alias("provider"), F.col("c_acctbal").alias("priority"), F.col("c_mktsegment").alias("tag"), (F.col("c_custkey") % 7 != 0).alias("enabled"),
    )


SERIES_SQL = """series AS (
  SELECT c_custkey AS series, c_name AS title, regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g') AS slug, c_nationkey AS provider, c_acctbal AS priority,
    c_mktsegment AS tag, c_custkey % 7 <> 0 AS enabled FROM customer
)"""


def cache_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as cached segments: chapter, key, bytes, generation, backend, series owner from its order."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("source_id"), F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("key"),
        F.col("l_extendedprice").alias("bytes"), F.col("l_linestatus").alias("generation"), F.col("l_returnflag").alias("backend"), F.col("l_linenumber").alias("line"),
    )


CACHE_SQL = """cache AS (
  SELECT l_orderkey AS source_id, l_partkey || '-' || l_suppkey AS key, l_extendedprice AS bytes, l_linestatus AS generation, l_returnflag AS backend, l_linenumber AS line FROM lineitem
)"""


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as listening writes: profile, chapter (props.k), seconds."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "ts", F.col("user_id").alias("profile"), "event_type", F.col("value").alias("seconds"), F.get_json_object("props", "$.k").cast("int").alias("chapter"))


PLAYS_SQL = """plays AS (
  SELECT event_id, ts, user_id AS profile, event_type, value AS seconds, (props->>'$.k')::INT AS chapter FROM events
)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as chapters of blocks: doc_id, source, line_no (from 0), line; blank lines left out."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return d.where(F.length(F.trim("line")) > 0)


LINES_SQL = """lines AS (
  SELECT doc_id, source, lang, line_no, line FROM (
    SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents
  ) WHERE length(trim(line)) > 0
)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as lines of dialogue: conv_id, turn, speaker, text."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("speaker"), "text")
