"""Intermediate tables in the folder that all machines share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a folder of this machine only where that is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="trellis-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        base = "file://" + _own[0]
    return base.rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh URI below the shared folder."""
    return f"{shared_dir(spark)}/trellis/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as Parquet below the shared folder and read it again. Lost executors lose nothing of it.

    The plan that made it is garbage then. Collecting that at once lets Spark's cleaner delete its shuffle files, which
    otherwise stay on the executors' disks until the driver runs short of memory.
    """
    spark, path, schema = df.sparkSession, work_dir(df.sparkSession, name), df.schema
    df.write.option("compression", "zstd").parquet(path)
    del df
    gc.collect()
    spark._jvm.System.gc()

    def again(spark: SparkSession) -> DataFrame:
        d = spark.read.schema(schema).parquet(path)
        d._at, d._again = path, again
        return d

    return again(spark)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by `written` that nothing reads any more."""
    for d in tables:
        jvm = d.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(d._at)
        at.getFileSystem(d.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
