"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..scratch import drop_path, scratch_path  # noqa: F401

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What separates words once A-Z are lower case; a word is any run of other characters.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What goes to a Python worker at once: so many bytes (a longer text goes alone) or rows at most.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20), "spark.sql.execution.arrow.maxRecordsPerBatch": "20000"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """``BATCH`` holds for what runs in here; the session's own values come back after."""
    before = {k: spark.conf.get(k) for k in BATCH}
    for k, v in BATCH.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def materialise(df: DataFrame, what: str, codec: str = "snappy") -> DataFrame:
    """df written to the shared folder and read back, in small batches."""
    with small_batches(df.sparkSession):
        return scratch.materialise(df, what, codec)


def same_rows(*cols: Column) -> Column:
    """128 bits that name equal rows: two 64-bit hashes of the columns."""
    return F.struct(F.xxhash64(*cols).alias("h"), F.xxhash64(F.lit("other"), *reversed(cols)).alias("g"))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone; ``lower`` would also change other letters, so it serves pure ASCII only."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())
    )


def words(text: Column) -> Column:
    """The words of a text as an array; null and texts without words give an empty array."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD)
    # only the first and the last part can be empty
    first = F.when(F.element_at(parts, 1) == "", 2).otherwise(1)
    return F.when(F.size(parts) == 1, F.filter(parts, lambda x: x != "")).otherwise(
        F.slice(
            parts,
            first,
            F.greatest(F.size(parts) - first + F.when(F.element_at(parts, -1) == "", 0).otherwise(1), F.lit(0)),
        )
    )
