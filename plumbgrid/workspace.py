"""Durable intermediate tables.

Long or iterative plans cut their lineage by writing Parquet into the folder that the cluster shares
(``spark.checkpoint.dir``).  Losing an executor afterwards costs a re-read, never a recomputation of the loop.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one is set up only where none is configured (tests, local mode)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = f"file://{tempfile.mkdtemp(prefix='plumbgrid-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Rows of long texts go to Python workers in batches of about ``size`` bytes, unless the session says otherwise."""
    if spark.conf.get(_BATCH).rstrip("b") == str(64 << 20):
        spark.conf.set(_BATCH, str(size))


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session may already be gone at interpreter exit
        pass


_ROOTS: list[str] = []

#: Bytes of a written table that may be broadcast: some 100,000 rows of two numbers.
SMALL_TABLE = 1 << 20


def clear(spark: SparkSession) -> None:
    """Delete the tables of all operator calls so far; call it when their results have been consumed, before the session stops.

    Without this call they go when the interpreter exits, if the session is still there.
    """
    while _ROOTS:
        _delete(spark, _ROOTS.pop())


class Workspace:
    """A private subfolder of the shared folder holding the tables of one operator call."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        bound_batches(spark)
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        _ROOTS.append(self.root)
        atexit.register(_delete, spark, self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return a scan of what was written."""
        schema = df.schema
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(schema).parquet(self.path(name))

    def size(self, name: str) -> int:
        """Bytes of a kept table as written."""
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(name))
        fs = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return int(fs.getContentSummary(target).getLength())

    def beside(self, df: DataFrame, name: str) -> DataFrame:
        """``df``, read from a kept table, as the side of a join: broadcast while the table is small, else shuffled.

        Spark's own rule compares compressed sizes with its threshold; the hash table that the driver then builds of keys that
        compress well is many times that.
        """
        return df.hint("broadcast" if self.size(name) <= SMALL_TABLE else "merge")

    def parts(self, size: int, each: int = 16 << 20) -> int:
        """Partitions for a shuffle of ``size`` bytes, so that a task's share does not grow with the input."""
        return max(self.spark.sparkContext.defaultParallelism, -(-size // each))

    def release(self) -> None:
        """Let the driver notice that finished shuffles are unreferenced, so that their files go at once."""
        for _ in range(2):  # a first collection frees what refers to the shuffles, a second the shuffles themselves
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.5)

    def drop(self, *names: str) -> None:
        """Remove tables that nothing reads any more."""
        for name in names:
            _delete(self.spark, self.path(name))
