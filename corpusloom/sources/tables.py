"""The cluster's shared folder and intermediate tables written there."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor sees: ``spark.checkpoint.dir``, or, on one machine alone, an own one where it is unset."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="loom-shared-")
        atexit.register(shutil.rmtree, base[len("file://") :], True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def _on_disk(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    files, at = _on_disk(spark, path)
    files.deleteOnExit(at)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends there and no lost executor undoes it."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # lets Spark's cleaner drop the shuffle files behind the table
    out = spark.read.schema(df.schema).parquet(path)
    out._loom_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing reads any more."""
    for table_ in tables:
        files, at = _on_disk(table_.sparkSession, table_._loom_path)
        files.delete(at, True)
