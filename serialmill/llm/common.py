"""Shared helpers: table access, the shared working folder, bounded labelled samples."""

from __future__ import annotations

import os
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from serialmill import session

#: White space that separates words: ``[\x20\x09-\x0D]``.
WORD_GAP = r"[ \t\n\x0B\f\r]+"

#: Bytes of rows that Spark hands to a Python worker at once; set where the session has no limit of its own.
BATCH_BYTES = 8_000_000
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship_code(spark: SparkSession) -> None:
    """Executors get this package, and their Python workers batches of bounded size."""
    session.ship_code(spark)
    if spark.conf.get(_LIMIT, None) is None:
        spark.conf.set(_LIMIT, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``. Where that is unset, a local session (tests) gets a folder in /tmp; a cluster must name a shared one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise ValueError(f"spark.checkpoint.dir is unset: on {master} it must name a folder that all executors share")
        base = f"/tmp/spark-{os.getuid()}-checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialise(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it again."""
    spark, path = df.sparkSession, work_dir(df.sparkSession)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` as an array; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP, -1), "")


def id_bucket(col: str, n: int) -> Column:
    """crc32(id as text) mod n."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def bounded_sample(df: DataFrame, key: str, n: int, salt: int = 0, total: int | None = None) -> list:
    """The rows of the ``n`` keys with the smallest hashes, one for each key: of rows with equal keys the least by its other columns.

    Keys above a bar on their hash are left out before anything is shuffled; the bar is raised in the rare case that too few
    remain, so it never changes the result. The rows are fetched by a join with those n keys. ``total``: the rows of ``df``, if known.
    """
    keyed = df.select(key, F.xxhash64(F.col(key), F.lit(salt)).alias("h")).where(F.col(key).isNotNull())
    total = df.count() if total is None else total
    share = min(1.0, 4 * n / max(total, 1))
    while True:
        few = keyed if share >= 1 else keyed.where(F.col("h") < int(-(2**63) + share * 2**64))
        chosen = few.distinct().orderBy("h", key).limit(n).select(key).collect()
        if len(chosen) >= n or share >= 1:
            break
        share = min(1.0, 8 * share)
    if not chosen:
        return []
    small = df.sparkSession.createDataFrame([(r[0],) for r in chosen], StructType([StructField(key, df.schema[key].dataType)]))
    others = [c for c in df.columns if c != key]
    rows = df.join(F.broadcast(small), key, "left_semi").groupBy(key).agg(F.min(F.struct(*others)).alias("r")).select(key, "r.*").collect()
    return sorted(rows, key=lambda r: (r[key], str(r)))


#: Bytes of text that become Python strings at once.
SLICE_BYTES = 8_000_000


def slices(batch: pa.RecordBatch, at: int):
    """A batch in runs of rows whose column ``at`` has about SLICE_BYTES; a longer text stands alone."""
    n, size = batch.num_rows, batch.column(at).nbytes
    step = max(1, n * SLICE_BYTES // size) if size > SLICE_BYTES else n
    for lo in range(0, n, step or 1):
        yield batch.slice(lo, step)


def append_by_text(df: DataFrame, text: str, fields: list[tuple[str, pa.DataType, str]], make) -> DataFrame:
    """Append columns computed from one text column, an Arrow batch at a time.

    ``fields``: (name, Arrow type, Spark type). ``make()`` is called once in each task and returns a
    function from a list of texts (or None) to one list or array for each field. Input columns whose
    names clash with new ones are replaced.
    """
    ship_code(df.sparkSession)
    new = {f[0] for f in fields}
    kept = [c for c in df.columns if c not in new]
    reads = kept if text in kept else [*kept, text]
    src = df.select(*[F.col(f"`{c}`") for c in reads])
    at, n_kept = reads.index(text), len(kept)
    names, kinds = [f[0] for f in fields], [f[1] for f in fields]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:n_kept]] + [f"`{n}` {s}" for n, _, s in fields])

    def run(batches):
        fn = make()
        for b in (part for whole in batches for part in slices(whole, at)):
            made = fn(b.column(at).to_pylist())
            cols = [b.column(i) for i in range(n_kept)] + [pa.array(v, k) for v, k in zip(made, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names[:n_kept], *names])

    return src.mapInArrow(run, schema)
