"""Places in an order that no single task sorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from serialmill.session import shared_folder


def placed(rows: DataFrame, group: str, order: list[Column], out: str = "place") -> DataFrame:
    """``rows`` with their places from 1 in each group. Rows are dealt by ranges of group and order and written; a place is that in the row's range and
    group, moved by the rows of the group in earlier ranges, of which there is one count for each range and group. So a group of any size is sorted by many tasks.
    Groups must not be null; rows that are equal in all of ``order`` are numbered in any order."""
    spark, path = rows.sparkSession, shared_folder(rows.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(parts, F.col(group), *order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    sizes = dealt.groupBy("_range", group).agg(F.count(F.lit(1)).alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_range", group, F.coalesce(earlier, F.lit(0)).alias("_before"))
    here = F.row_number().over(Window.partitionBy("_range", group).orderBy(*order))
    return dealt.join(starts, ["_range", group]).withColumn(out, (here + F.col("_before")).cast("bigint")).drop("_range", "_before")
