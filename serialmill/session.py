"""What a session needs before Python code of this package runs on its executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()

#: Bytes of rows that Spark hands to a Python worker at once; set where the session has no limit of its own.
BATCH_BYTES = 8_000_000
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application; their Python workers get batches of bounded size."""
    if spark.conf.get(_LIMIT, None) is None:
        spark.conf.set(_LIMIT, BATCH_BYTES)
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    fd, path = tempfile.mkstemp(prefix="serialmill-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join(os.path.basename(root), os.path.relpath(full, root)))
    context.addPyFile(path)
    atexit.register(os.remove, path)  # executors that join later still fetch it
    _sent.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors share. Only a local session (tests) may leave that unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir is unset: it must name a folder that all executors share")
        base = f"/tmp/spark-{os.getuid()}-checkpoints"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"
