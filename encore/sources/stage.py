"""Intermediate tables that several later steps read.

They are written once to the shared folder named by `spark.checkpoint.dir`, so a lost executor
never takes them along, lineage stays short, and the optimizer knows their true sizes. What was
shuffled for such a table goes as soon as it is written. `discard` removes one that no later step
reads, `release` what a session has staged, once its results have been read.
"""

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_written: list[str] = []


def stage_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    Where the setting is missing, a session on this machine alone gets a folder that goes when the
    program ends; a cluster session is refused, as its executors could not see such a folder.
    """
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {SETTING} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="encore-stage-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder, removed by `release`."""
    path = f"{stage_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def staged(table: DataFrame, label: str) -> DataFrame:
    """Write the table and return it as read back."""
    spark = table.sparkSession
    path = new_path(spark, label)
    table.write.parquet(path)
    # Spark removes shuffle files when the driver finds their plan in its garbage, which may be long after the last use
    spark._jvm.System.gc()
    read = spark.read.schema(table.schema).parquet(path)
    read.staged_at = path
    return read


def _remove(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard(table: DataFrame) -> None:
    """Remove a table that `staged` returned; nothing that is still to be computed may read it."""
    _remove(table.sparkSession, table.staged_at)
    _written.remove(table.staged_at)


def release(spark: SparkSession) -> int:
    """Remove everything staged so far; results built on it must have been read. Returns how many paths went."""
    gone = 0
    while _written:
        gone += _remove(spark, _written.pop())
    return gone
