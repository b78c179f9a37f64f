"""Token-ID output: flat unsigned integer files and 64-bit document offsets, memory-mapped.

A folder holds, for each shard, ``NNNNN-A.ids`` (N the shard, A the attempt that wrote it; the ids, little-endian unsigned
integers of the narrowest of 16 and 32 bits that holds the vocabulary),
``NNNNN-A.off`` (n+1 unsigned 64-bit offsets into the shard, in ids) and
``NNNNN-A.doc`` (n signed 64-bit document ids, those of null ids first, as 0).
``index.json`` lists the shards in ascending order of doc_id with their sizes,
their numbers of null ids and their bases: the prefix sums of the sizes.

Every attempt of a task writes files of its own, and the index, written last, names
those of the attempts that succeeded: nothing is renamed, which stores of objects
can't do at once, and a task that runs again does no harm. Defined cases: a null text is an empty one (its
end id alone); rows of the same doc_id stay in the order of their texts, nulls
first; an empty table gives an index without shards; other columns are ignored.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, small_batches
from .encoding import BatchEncoder

READ_IDS = 8_000_000


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _uri(path: str) -> str:
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def write_token_files(
    docs: DataFrame, vocabulary: str, end_id: int, path: str, id_col: str = "doc_id", text_col: str = "text"
) -> dict:
    """Encodes docs and writes them to ``path``, a folder that all executors share; returns the index."""
    path = _uri(path)
    dtype = "<u2" if max(end_id, BatchEncoder(vocabulary).size - 1) < 1 << 16 else "<u4"
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    d = d.repartitionByRange(d.doc_id).sortWithinPartitions(d.doc_id, d.text)

    def write(batches):
        from pyspark import TaskContext

        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        fs, root = _filesystem(path)
        fs.create_dir(root, recursive=True)
        names = {k: f"{root}/{part:05d}-{attempt}.{k}" for k in ("ids", "off", "doc")}
        at, n_docs, n_null = 0, 0, 0
        encoder = BatchEncoder(vocabulary, dtype)
        files = {}
        for b in batches:
            if not b.num_rows:
                continue
            if not files:
                files = {k: fs.open_output_stream(n) for k, n in names.items()}
                files["off"].write(np.zeros(1, "<u8").tobytes())
            ids = b.column(0)
            n_null += ids.null_count
            n_docs += b.num_rows
            files["doc"].write(ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            for texts in _some(b.column(1)):
                flat, sizes = encoder.encode(texts, end_id)
                files["ids"].write(flat)
                files["off"].write((at + np.cumsum(sizes, dtype="<u8")).astype("<u8").tobytes())
                at += int(sizes.sum())
        for f in files.values():
            f.close()
        if files:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "attempt": pa.array([attempt], pa.int64()), "docs": pa.array([n_docs], pa.int64()), "nulls": pa.array([n_null], pa.int64()), "ids": pa.array([at], pa.int64())})

    with small_batches(docs.sparkSession):
        shards = sorted(tuple(r) for r in d.mapInArrow(write, "part int, attempt long, docs long, nulls long, ids long").collect())
    base, index = 0, {"dtype": dtype, "end_id": end_id, "shards": []}
    for part, attempt, n, nulls, ids in shards:
        index["shards"].append({"name": f"{part:05d}-{attempt}", "docs": n, "null_ids": nulls, "ids": ids, "base": base})
        base += ids
    fs, root = _filesystem(path)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/index.json") as f:
        f.write(json.dumps(index).encode())
    return index


def _some(column, least: int = 4_000_000):
    """Lists of texts of some MB each, so that one batch of very long texts isn't encoded at once."""
    out, n = [], 0
    for x in column:
        s = x.as_py() or ""
        out.append(s)
        n += len(s)
        if n >= least:
            yield out
            out, n = [], 0
    if out:
        yield out


def _mapped(fs, name: str, dtype: str):
    """The file as an array: memory-mapped where it is local, else read."""
    from pyarrow import fs as pafs

    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(name, dtype=dtype, mode="r") if fs.get_file_info(name).size else np.empty(0, dtype)
    with fs.open_input_file(name) as f:
        return np.frombuffer(f.read(), dtype)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ids as little-endian unsigned 32-bit integers, from the files alone."""
    path = _uri(path)
    fs, root = _filesystem(path)
    with fs.open_input_file(f"{root}/index.json") as f:
        index = json.loads(f.read())
    dtype = index["dtype"]
    rows = [(s["name"], s["null_ids"], s["base"]) for s in index["shards"]]
    schema = "doc_id long, start long, n_tokens long, ids binary"
    if not rows:
        return spark.createDataFrame([], schema)
    shards = spark.createDataFrame(rows, "name string, nulls long, base long").repartition(len(rows))

    def read(batches):
        fs, root = _filesystem(path)
        for b in batches:
            for r in b.to_pylist():
                off, doc = _mapped(fs, f"{root}/{r['name']}.off", "<u8"), _mapped(fs, f"{root}/{r['name']}.doc", "<i8")
                ids = _mapped(fs, f"{root}/{r['name']}.ids", dtype)
                lo = 0
                while lo < len(doc):
                    hi = max(lo + 1, int(np.searchsorted(off, off[lo] + np.uint64(READ_IDS), "right")) - 1)
                    flat = ids[int(off[lo]) : int(off[hi])].astype("<u4")
                    own = (off[lo : hi + 1] - off[lo]).astype(np.int64)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(doc[lo:hi].astype(np.int64), mask=np.arange(lo, hi) < r["nulls"]),
                            "start": pa.array(r["base"] + off[lo:hi].astype(np.int64)),
                            "n_tokens": pa.array(np.diff(own)),
                            "ids": pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((own * 4).astype("<i4").tobytes()), pa.py_buffer(flat.tobytes())]),
                        }
                    )
                    lo = hi

    return shards.mapInArrow(read, schema)


def op8_query(spark: SparkSession, docs: DataFrame, vocabulary: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write_token_files(docs, vocabulary, 2, path)
    return read_token_files(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )

