"""Where intermediate results live, and how lineage is cut.

Every intermediate file goes to the folder the cluster names in ``spark.checkpoint.dir``: executors and
the driver see the same files there, so a lost executor loses no result. Only when that setting is absent and Spark
runs on one machine (tests) a temporary folder is made and named as the checkpoint folder; on a cluster that is an
error. Scratch paths are deleted when the driver ends, if nobody did so before.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: Rows of a file that :func:`cut` writes, about, where it knows their number.
ROWS_A_FILE = 50_000
_scratch: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of this session; a temporary one is set up only where none is configured."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if not current:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        current = "file://" + tempfile.mkdtemp(prefix="wayfare-checkpoint-")
        spark.sparkContext.setCheckpointDir(current)
    return current.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def n_files(spark: SparkSession, rows: int) -> int:
    """Of about ``rows`` rows: as many as they fill, or as there are cores."""
    return max(1, spark.sparkContext.defaultParallelism, -(-rows // ROWS_A_FILE))


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from those files.

    ``rows``: about how many rows ``df`` may have. They then go to :func:`n_files` files and
    not to one for each partition: a file costs a request to its store, and on a local one child processes of the
    executor (Hadoop's ``chmod``), which hold all of its memory for a moment, however few rows the file has.
    """
    shared_dir(df.sparkSession)
    if rows is not None:
        df = df.coalesce(n_files(df.sparkSession, rows))
    return df.checkpoint(eager=True)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Hadoop's file system, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    if path in _scratch:
        _scratch.remove(path)


@atexit.register
def _drop_scratch() -> None:
    context = SparkContext._active_spark_context
    if context is not None and context._jsc is not None:
        with contextlib.suppress(Exception):  # the store may be gone when the driver ends
            spark = SparkSession(context)
            for path in _scratch[:]:
                drop_path(spark, path)
