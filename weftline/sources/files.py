"""Small files in any file system that Spark reaches: read and written by the driver."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read(spark: SparkSession, path: str) -> str | None:
    """The text of a file, without a byte order mark; of a folder of parts the text of all; None where there is none."""
    p, fs = _at(spark, path)
    if not fs.exists(p):
        return None
    if fs.getFileStatus(p).isDirectory():
        names = sorted(s.getPath().toString() for s in fs.listStatus(p) if not s.getPath().getName().startswith(("_", ".")))
        return "".join(read(spark, n) or "" for n in names)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").removeprefix("﻿")
    finally:
        stream.close()


def write(spark: SparkSession, path: str, text: str) -> None:
    """Writes under another name first, so that a reader never meets half a file."""
    p, fs = _at(spark, path)
    part, _ = _at(spark, f"{path}.{uuid.uuid4().hex[:8]}.part")
    stream = fs.create(part, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if fs.exists(p):
        fs.delete(p, True)
    fs.rename(part, p)


def delete(spark: SparkSession, path: str) -> bool:
    p, fs = _at(spark, path)
    return fs.delete(p, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below a path."""
    p, fs = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []
