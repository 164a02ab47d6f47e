"""Tables cut in the shared folder: written once and read again, so that lineage ends and rows survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Only where that is unset and all runs
    in one process (tests) a folder of our own is made, which goes when the process ends."""
    if at := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return at.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="memloom-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return f"file://{_local[0]}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, replaces: DataFrame | None = None) -> DataFrame:
    """``df`` written once as zstd Parquet in the shared folder and read again. ``replaces``: a table cut before that
    nothing reads any more once this one is written; its files go."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    if replaces is not None and (old := getattr(replaces, "_cut_at", None)):
        at = spark._jvm.org.apache.hadoop.fs.Path(old)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_at = path
    return out
