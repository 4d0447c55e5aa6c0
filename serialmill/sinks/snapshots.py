"""Snapshots of a keyed table, kept in versions of equal buckets.

A version is a bucketed, sorted Parquet table, so what comes later joins it bucket by bucket: only the new side is shuffled. A manifest has a row for each version that was
written whole; a version that broke off is not in it and is overwritten by the next attempt. Another session finds the versions by the manifest and declares their buckets again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
_MANIFEST = "version bigint, schema string, key string, buckets int"


def _table(path: str, version: int) -> str:
    return f"snapshot_{abs(hash(path)) % 10**12}_{version}"


def versions(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], _MANIFEST)


def save(df: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> int:
    """Write ``df`` as the next version; its number. Rows of a key are in one bucket."""
    spark = df.sparkSession
    version = (versions(spark, path).agg(F.max("version")).first()[0] or 0) + 1
    name = _table(path, version)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    df.repartition(buckets, key).write.mode("overwrite").format("parquet").option("path", f"{path}/v{version}").bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    row = [(version, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), key, buckets)]
    spark.createDataFrame(row, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return version


def load(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """A version, by default the newest; None where there is none."""
    known = versions(spark, path)
    r = (known.where(F.col("version") == version) if version else known.orderBy(F.desc("version")).limit(1)).first()
    if r is None:
        return None
    name = _table(path, r["version"])
    if not spark.catalog.tableExists(name):
        spark.sql(f"CREATE TABLE {name} ({r['schema']}) USING parquet CLUSTERED BY (`{r['key']}`) SORTED BY (`{r['key']}`) INTO {r['buckets']} BUCKETS LOCATION '{path}/v{r['version']}'")
    return spark.table(name)


def changed(now: DataFrame, before: DataFrame | None, key: str, mark: str) -> DataFrame:
    """JOI14: the rows whose key is new, or whose mark differs from the snapshot's."""
    if before is None:
        return now
    old = before.select(key, F.col(mark).alias("_was"))
    return now.join(old.hint("merge"), key, "left").where(~F.col(mark).eqNullSafe(F.col("_was"))).drop("_was")
