"""Scratch tables and batch sizes.

Scratch tables are Parquet folders below ``spark.checkpoint.dir``.  Reading a
written table again cuts lineage, survives lost executors and gives every later
pass the same rows.  The folders go when the driver ends, or on ``clean_up``.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from quillgraph.shipping import ship

_scratch: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is set (tests)."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        own = tempfile.mkdtemp(prefix="quillgraph-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", found)
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/quillgraph/{name}-{uuid.uuid4().hex}"
    if not _scratch:
        atexit.register(clean_up)
    _scratch.append((spark, path))
    return path


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean_up() -> None:
    """Remove every scratch table of this driver."""
    while _scratch:
        spark, path = _scratch.pop()
        try:
            jvm = spark.sparkContext._jvm
            if jvm is None:
                continue
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the JVM may have gone first
            continue


#: Arrow batches of texts: bytes and rows at most.  JVM and Python each hold a few of them a task.
ARROW_BYTES, ARROW_ROWS = 8 << 20, 2000


def bound_batches(spark: SparkSession) -> None:
    """Before Python runs on executors: they get the package, and Arrow batches of this session stay small, unless it has smaller ones.

    With Spark's 64 MB a batch, a task needs some hundred MB outside the heap.
    """
    ship(spark)
    if _bytes(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) > ARROW_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if rows <= 0 or rows > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def _bytes(setting: str) -> int:
    number = re.match(r"-?\d+", setting)
    unit = {"k": 10, "m": 20, "g": 30}.get(setting.lower().rstrip("b")[-1:], 0)
    value = int(number[0]) << unit if number else 0
    return value if value > 0 else 1 << 62
