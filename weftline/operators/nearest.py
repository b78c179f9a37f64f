"""Best matches of vectors by cosine, exact, over all rows.

Rows and queries are written as blocks of plain numbers, and every block of rows meets every block of queries in a
Cartesian product, of which no side goes through the driver. A pair of blocks is one matrix product; a task keeps the
best rows of each query. Scores are rounded, so an error of the last bits matters only next to where rounding turns:
such scores are computed again, in the order of ``text.cosine``. Rows that don't fit a matrix (of another length than
most, with components that are null or not finite, or of extreme size) are scored by that expression.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import cosine
from ..scratch import materialise

#: Rows of a block, of vectors and of queries; what one task has of each at most.
BLOCK, SIDE, TASK_ROWS, TASK_QUERIES = 4096, 512, 65_536, 16_384
DIGITS = 6
#: How near to a half a score's last digit may be before it is computed again; rounding errors are a ten-thousandth of it.
DOUBT = 1e-4


def _packed(size: int):
    """Rows (id, v) to blocks of ids and components, in order of id."""

    def run(batches):
        names = ["ids", "vals"]
        for b in batches:
            ids, flat = b.column(0).to_numpy(), b.column(1).flatten().to_numpy()
            m = flat.reshape(len(ids), -1)
            for at in range(0, len(ids), size):
                order = np.argsort(ids[at : at + size], kind="stable") + at
                row = [ids[order].astype("<i8").tobytes(), np.ascontiguousarray(m[order]).astype("<f8").tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in row], names=names)

    return run


def _exact(q: np.ndarray, v: np.ndarray) -> list[float]:
    """Rounded scores of pairs of rows, added up component by component."""
    dot, qq, vv = (np.zeros(len(q)) for _ in range(3))
    for k in range(q.shape[1]):
        dot, qq, vv = dot + q[:, k] * v[:, k], qq + q[:, k] * q[:, k], vv + v[:, k] * v[:, k]
    scores = np.clip(dot / np.sqrt(qq * vv), 0.0, 1.0)
    return [float(Decimal(repr(float(s))).scaleb(DIGITS).quantize(Decimal(1), ROUND_HALF_UP)) for s in scores]


def best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """[query, k]: scores (in units of the last digit; -1 where there are fewer) and ids of the best rows, which come by id."""
    norm = np.einsum("ij,ij->i", q, q)[:, None] * np.einsum("ij,ij->i", v, v)[None, :]
    at = np.clip(np.divide(q @ v.T, np.sqrt(norm), out=np.zeros(norm.shape), where=norm > 0), 0.0, 1.0) * 10**DIGITS
    score = np.floor(at + 0.5)
    x, y = np.nonzero((np.abs(at + 0.5 - np.rint(at + 0.5)) < DOUBT) & (norm > 0) & (at > DOUBT) & (at < 10**DIGITS - DOUBT))
    for i in range(0, len(x), BLOCK):
        score[x[i : i + BLOCK], y[i : i + BLOCK]] = _exact(q[x[i : i + BLOCK]], v[y[i : i + BLOCK]])
    score[q_ids[:, None] == ids[None, :]] = -1
    key = score * len(ids) + np.arange(len(ids) - 1, -1, -1)  # ties go to the smaller id
    own = np.argpartition(-key, min(k, len(ids)) - 1, axis=1)[:, :k]
    own = np.take_along_axis(own, np.argsort(-np.take_along_axis(key, own, 1), axis=1), 1)
    return np.take_along_axis(score, own, 1), ids[own]


def _matches(k: int):
    def run(batches):
        kept: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for row in b.to_pylist():
                ids, q_ids = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["q_ids"], "<i8")
                v, q = np.frombuffer(row["vals"], "<f8").reshape(len(ids), -1), np.frombuffer(row["q_vals"], "<f8").reshape(len(q_ids), -1)
                score, found = best(q_ids, q, ids, v, k)
                if row["q_ids"] in kept:
                    before = kept[row["q_ids"]]
                    score, found = np.concatenate([before[0], score], 1), np.concatenate([before[1], found], 1)
                    order = np.lexsort((found, -score), axis=1)[:, :k]
                    score, found = np.take_along_axis(score, order, 1), np.take_along_axis(found, order, 1)
                kept[row["q_ids"]] = score, found
        for q_ids, (score, found) in kept.items():
            n, s = np.repeat(np.frombuffer(q_ids, "<i8"), score.shape[1]), score.ravel()
            own = s >= 0
            cols = [n[own], found.ravel()[own], s[own] / 10**DIGITS]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["query_id", "vec_id", "score"])

    return run


def _blocks(rows: DataFrame, size: int, in_task: int, what: str) -> DataFrame:
    spark = rows.sparkSession
    parts = max(1, -(-rows.count() // in_task))
    if what == "rows":
        parts = min(10_000, max(parts, spark.sparkContext.defaultParallelism))
    return materialise(rows.repartition(parts).mapInArrow(_packed(size), "ids binary, vals binary"), what)


def cosine_top(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, vec_id, score) of the k rows of vectors (vec_id, v) that are nearest to each of queries (query_id, q),
    other than those of its own id; scores have ``DIGITS`` digits, ties go to the smaller id."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v")).filter("vec_id is not null")
    q = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("q").cast("array<double>").alias("q")).filter("query_id is not null")
    usual = v.filter("size(v) > 0").groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dims = usual.n if usual else 0

    def fits(c: str):
        large = F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x)
        plain = (F.size(c) == dims) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e60)) & ((large == 0) | (large > 1e-120))
        return F.coalesce(plain, F.lit(False))

    rows = _blocks(v.filter(fits("v")), BLOCK, TASK_ROWS, "rows")
    asked = _blocks(q.filter(fits("q")), SIDE, TASK_QUERIES, "queries")
    pairs = rows.hint("shuffle_replicate_nl").crossJoin(asked.withColumnsRenamed({"ids": "q_ids", "vals": "q_vals"}))
    out = pairs.mapInArrow(_matches(k), "query_id long, vec_id long, score double")
    odd_v, odd_q = v.filter(~fits("v")), q.filter(~fits("q"))
    rest = v.crossJoin(odd_q).unionByName(odd_v.crossJoin(q.filter(fits("q")))).filter("vec_id <> query_id")
    out = out.unionByName(rest.select("query_id", "vec_id", F.round(cosine(F.col("q"), F.col("v")), DIGITS).alias("score")))
    n = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("n", n).filter(F.col("n") <= k).drop("n")
