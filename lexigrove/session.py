"""Session helpers: the shared folder, staged tables and table access.

A staged table is a Parquet table written into the folder that the session
names in ``spark.checkpoint.dir``.  It cuts lineage like ``checkpoint()`` does,
survives the loss of executors, and is compressed and column-pruned on read.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_STAGED: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder shared by all executors.

    Where the session names none, a local master gets a temporary one; on a
    cluster that is an error, as executors would write to their own disks.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="lexigrove-")
    atexit.register(shutil.rmtree, path, True)
    spark.sparkContext.setCheckpointDir(path)
    return path


def stage(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexigrove-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    _STAGED[path] = spark
    return out


def release(*tables: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for df in tables:
        path = getattr(df, "_staged_path", None)
        if path and _STAGED.pop(path, None) is not None:
            _delete(df.sparkSession, path)


def release_staged(spark: SparkSession) -> None:
    """Delete all staged tables of a session, once the results that read them are written or collected."""
    for path, owner in list(_STAGED.items()):
        if owner is spark and _STAGED.pop(path, None) is not None:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target.getParent(), True)


@atexit.register
def _release_all() -> None:
    for path, spark in list(_STAGED.items()):
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the JVM is gone; the folder's owner cleans up
            return


#: Bytes of compressed input below which a task isn't worth its start.
_TASK_BYTES = 256 << 10


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False, by: str | None = None) -> DataFrame:
    """One of the driver's Parquet tables.

    ``spread`` is for work that is heavy for each row: a table of fewer row
    groups than the cluster has cores is dealt out to more tasks first.  Tables
    that fill the cores are read as they are, without a shuffle.  ``by`` deals rows
    out by the hash of a column in any case, so that aggregations of what is
    exploded from a row shuffle nothing more.
    """
    path = f"{sf_dir}/{name}.parquet"
    df = spark.read.parquet(path)
    if not (spread or by):
        return df
    cores, size = spark.sparkContext.defaultParallelism, _folder(spark, path).getLength()
    if df.rdd.getNumPartitions() >= cores:
        return df.repartition(max(cores, int(spark.conf.get("spark.sql.shuffle.partitions"))), by) if by else df
    n = max(1, min(cores, -(-size // _TASK_BYTES)))
    return df.repartition(n, by) if by else df.repartition(n)


def _folder(spark: SparkSession, path: str) -> object:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(target)


def version(spark: SparkSession, path: str) -> str:
    """What changes when a file or folder does: its time and size."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return f"{system.getFileStatus(target).getModificationTime()}-{_folder(spark, path).getLength()}"


def keep_until_exit(spark: SparkSession, path: str) -> None:
    """Have a folder's parent within the shared folder deleted with the staged tables."""
    _STAGED[path] = spark
