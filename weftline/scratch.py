"""Written tables that cut a lineage: in the folder that the driver and all executors share."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

#: For a master of one machine that names no shared folder, as in tests.
_LOCAL = "file:///tmp/checkpoints/weftline"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only a session of one process may do without; a cluster is refused."""
    at = None
    with contextlib.suppress(Exception):
        at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return _LOCAL
    raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new place in the shared folder; what is left there goes when the application ends."""
    path = f"{shared_dir(spark)}/weftline-{what}-{uuid.uuid4().hex}"
    p, fs = _path(spark, path)
    fs.mkdirs(p.getParent())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table through Hadoop's file systems."""
    p, fs = _path(spark, path)
    fs.delete(p, True)


def materialise(df: DataFrame, what: str, codec: str = "snappy") -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, what)
    df.write.mode("append").option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out
