"""Files of a run: written by the tasks that have them, under a folder that all of them share."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import run_path


def write_files(files: DataFrame, root: str) -> int:
    """Writes each (filename, markdown) below root; names stay inside it. Returns how many were written.

    A file is written under a temporary name and moved, so a task that runs again leaves it whole.
    """
    root = root if "://" in root else f"file://{root}"

    def run(batches):
        from pyarrow import fs as pafs

        fs, base = pafs.FileSystem.from_uri(root)
        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                parts = [p for p in (name or "").replace("\\", "/").split("/") if p not in ("", ".", "..")]
                if not parts:
                    continue
                at = "/".join([base, *parts])
                fs.create_dir(at.rpartition("/")[0], recursive=True)
                with fs.open_output_stream(f"{at}.part") as f:
                    f.write((text or "").encode())
                fs.move(f"{at}.part", at)
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    return files.select("filename", "markdown").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_bundle(spark: SparkSession, root: str, run_id: str, files: DataFrame, documents: DataFrame | None = None, states: DataFrame | None = None) -> int:
    """A run's files, documents (with a line for each in documents.jsonl) and states."""
    at = run_path(root, run_id)
    n = write_files(files, at)
    if documents is not None:
        n += write_files(documents.select(F.concat(F.lit("documents/"), F.col("file")).alias("filename"), "markdown"), at)
        line = F.struct("id", "url", "title", F.col("fetched_at").alias("fetchedAt"), "bytes", F.concat(F.lit("documents/"), F.col("file")).alias("file"), "headings")
        documents.select(F.to_json(line).alias("value")).write.mode("overwrite").text(f"{at}/documents.jsonl")
    if states is not None:
        n += write_files(states.select(F.concat(F.lit("states/"), F.col("scan_id"), F.lit("-"), F.col("seq"), F.lit(".md")).alias("filename"), "markdown"), at)
    return n


def save_session(spark: SparkSession, root: str, run_id: str, scan_id: str, session: dict) -> None:
    path = run_path(root, run_id, "chat-" + scan_id)
    spark.createDataFrame([(json.dumps(session, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_session(spark: SparkSession, root: str, run_id: str, scan_id: str) -> dict:
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.text(run_path(root, run_id, "chat-" + scan_id)).collect()
    except AnalysisException:
        rows = []
    return json.loads("\n".join(r[0] for r in rows)) if rows else {"messages": [], "files": []}


def append_activity(events: DataFrame, root: str, run_id: str) -> None:
    events.write.mode("append").json(run_path(root, run_id, "activity"))
