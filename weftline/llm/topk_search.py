"""Exact top-k search by inner product over a bit-sliced index.

Components are quantised to integers, floor(scale * x). Rows are dealt once, into blocks
of about ``BLOCK``; a block's index has, for each component, one
bitmap for each bit (two's complement, the last one the sign), and is written once.
A query's scores over a block are formed by bitmap arithmetic: its components
pick multiples of the attributes' slices, which are added with carries, many
queries side by side. The best rows are then selected from the most significant
slice of the scores downward: while more rows have the bit than are still
wanted, the others are out; else these are in and the search goes on among the
others. Rows that tie at the boundary are resolved by vec_id, and the scores of
the selected are computed exactly from the integers.

Queries are broadcast in chunks of ``CHUNK_BYTES``; for each chunk every task goes
through its blocks and keeps the best k rows of each query, of which the best k of
all tasks remain. Neither blocks nor their rows are shuffled.

Defined cases: rows whose vec_id or vector is null, or whose vector holds null
or non-finite components, take no part; vectors of fewer components count as
having zeros there (an empty vector has no component); repeated rows are rows of
their own among the candidates, but equal rows ask once; a query never meets rows
of its own vec_id; ties go to the smaller vec_id; an empty table gives no rows;
other columns are ignored. Scores are 64-bit integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise

SCALE = 256
BLOCK = 8192
#: Queries that go through the slices side by side.
SIDE = 64
#: Bytes of queries that are broadcast at once.
CHUNK_BYTES = 32 << 20
#: Tasks that write the index; each has as many blocks as its rows fill.
MOST_TASKS = 10_000
_DIGIT = 7
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v): valid rows, their vectors as integers."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    v = v.filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull()).filter(finite)
    return v.select("vec_id", F.transform("x", lambda e: F.floor(e * scale).cast("long")).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    sizes = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1])
    flat = column.flatten().to_numpy()
    out = np.zeros((len(column), int(sizes.max(initial=0))), np.int64)
    out[np.repeat(np.arange(len(column)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


_BLOCK = "n int, dims int, ids binary, vals binary, bits binary, slices binary"


def _blocks(size: int):
    """Rows to blocks: their ids and integers, the number of slices of each component, and the slices."""
    names = [x.split()[0] for x in _BLOCK.split(", ")]

    def run(batches):
        ids, vecs, n = [], [], 0

        def block():
            dims = max(v.shape[1] for v in vecs)
            i, m = np.concatenate(ids), np.concatenate([np.pad(v, ((0, 0), (0, dims - v.shape[1]))) for v in vecs])
            order = np.argsort(i, kind="stable")  # ties go to the smaller id
            i, m = i[order], m[order]
            made = [slices(m[:, d]) for d in range(dims)]
            row = [len(i), dims, i.astype("<i8").tobytes(), m.astype("<i8").tobytes()]
            row += [np.array([len(x) for x in made], "<i4").tobytes(), b"".join(x.tobytes() for x in made)]
            kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

        for b in batches:
            i, m, at = b.column(0).to_numpy(), _matrix(b.column(1)), 0
            while at < len(i):
                take = min(size - n, len(i) - at)
                ids.append(i[at : at + take])
                vecs.append(m[at : at + take])
                n, at = n + take, at + take
                if n == size:
                    yield block()
                    ids, vecs, n = [], [], 0
        if n:
            yield block()

    return run


def slices(column: np.ndarray) -> np.ndarray:
    """[bit, word]: bitmaps of the integers' two's complement, as few as hold them all; the last one is the sign."""
    top = int(max(column.max(initial=0), -column.min(initial=0) - 1, 0))
    bits = top.bit_length() + 1
    words = -(-len(column) // 64)
    raw = np.zeros((bits, words * 64), np.uint8)
    raw[:, : len(column)] = (column[None, :] >> np.arange(bits, dtype=np.int64)[:, None]) & 1
    return np.packbits(raw, axis=1, bitorder="little").view(np.uint64)


def _add(a: np.ndarray, b: np.ndarray, carry: np.ndarray, low: int = 0) -> None:
    """a += b * 2^low + carry * 2^low in place, over slices on the first axis; b's last slice is its sign."""
    for s in range(low, len(a)):
        y = b[min(s - low, len(b) - 1)]
        t = a[s] ^ y
        both = a[s] & y
        a[s] = t ^ carry
        carry = both | (t & carry)


def _stored(row: dict) -> SlicedBlock:
    """The block that a row of the index holds."""
    ids, values = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["vals"], "<i8").reshape(row["n"], row["dims"])
    bits, words, base, at = np.frombuffer(row["bits"], "<i4"), -(-row["n"] // 64), [], 0
    flat = np.frombuffer(row["slices"], np.uint64)
    for n in bits.tolist():
        base.append(flat[at : at + n * words].reshape(n, words))
        at += n * words
    return SlicedBlock(ids, values, base)


class SlicedBlock:
    """The index of one block: slices of each component, as they were written, and on demand their multiples."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, base: list[np.ndarray]):
        self.ids, self.values, self.base = ids, values, base
        self.words = -(-len(ids) // 64)
        self.peak = np.abs(values).max(axis=0, initial=0)
        self.valid = slices(np.full(len(ids), 1))[0] if len(ids) else np.zeros(0, np.uint64)

    def multiples(self, d: int, most: int) -> np.ndarray:
        """[slice, digit, word] of component d times 0, 1, ... up to 2^k - 1 >= most, by doubling them all at once."""
        base = self.base[d][:, None, :]
        made = np.zeros((len(base) + _DIGIT, 1, self.words), np.uint64)
        for _ in range(most.bit_length()):
            even = np.empty_like(made)
            even[0], even[1:] = 0, made[:-1]
            odd = even.copy()
            _add(odd, base, np.zeros(odd.shape[1:], np.uint64))
            made = np.stack((even, odd), axis=2).reshape(len(made), -1, self.words)
        return made

    def scores(self, queries: np.ndarray, picks: list[list[np.ndarray]]) -> np.ndarray:
        """[slice, query, word]: the scores of all rows for some queries."""
        dims = min(queries.shape[1], len(self.base))
        q = queries[:, :dims]
        most = int((np.abs(q).astype(object) * self.peak[:dims].astype(object)).sum(axis=1).max()) if dims and len(q) else 0
        acc = np.zeros((most.bit_length() + 2, len(q), self.words), np.uint64)
        sign = np.where(q < 0, _ALL, np.uint64(0))
        size = np.abs(q)
        for d in range(dims):
            flip = sign[:, d][:, None]
            for k, made in enumerate(picks[d]):
                own = (size[:, d] >> (_DIGIT * k)) & ((1 << _DIGIT) - 1)
                if not own.any():
                    continue
                y = made[:, own] ^ flip[None]  # -y = ~y + 1
                if _DIGIT * k < len(acc):
                    _add(acc, y, np.broadcast_to(flip, acc.shape[1:]).copy(), _DIGIT * k)
        return acc

    def top(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        """For each query the positions of its k best rows."""
        dims = min(queries.shape[1], len(self.base))
        picks = []
        for d in range(dims):
            size, own = np.abs(queries[:, d]), []
            while True:
                own.append(self.multiples(d, int((size & ((1 << _DIGIT) - 1)).max(initial=0))))
                size = size >> _DIGIT
                if not size.any():
                    break
            picks.append(own)
        for lo in range(0, len(queries), SIDE):
            q, own_ids = queries[lo : lo + SIDE], query_ids[lo : lo + SIDE]
            score = self.scores(q, picks)
            among = np.repeat(self.valid[None], len(q), axis=0)
            for i, (a, b) in enumerate(zip(np.searchsorted(self.ids, own_ids), np.searchsorted(self.ids, own_ids, "right"), strict=True)):
                for p in range(a, b):
                    among[i, p >> 6] &= ~(np.uint64(1) << np.uint64(p & 63))
            sure = np.zeros_like(among)
            for s in range(len(score) - 1, -1, -1):
                has = ~score[s] if s == len(score) - 1 else score[s]  # of the sign, 0 is larger
                with_bit = among & has
                would = sure | with_bit
                n = np.bitwise_count(would).sum(axis=1)
                more, less = (np.where(x, _ALL, np.uint64(0))[:, None] for x in (n > k, n < k))
                sure = np.where(n[:, None] <= k, would, sure)
                among = (with_bit & more) | (among & ~has & less)
            for i in range(len(q)):
                bits = lambda m: np.flatnonzero(np.unpackbits(m.view(np.uint8), bitorder="little"))
                best = bits(sure[i])
                ties = bits(among[i])[: max(0, k - len(best))]
                yield lo + i, np.concatenate((best, ties))


def _search(shared, k: int):
    """Blocks of the index to the best k rows of each query among all blocks of a task."""

    def run(batches):
        qids, qvals = shared.value
        best = [[] for _ in qids]  # (-score, id) of each query
        some = False
        for b in batches:
            for r in b.to_pylist():
                block = _stored(r)
                d = min(r["dims"], qvals.shape[1])
                some = True
                for i, at in block.top(qids, qvals, k):
                    scores = block.values[at, :d] @ qvals[i, :d]
                    best[i] = sorted([*best[i], *zip((-scores).tolist(), block.ids[at].tolist(), strict=True)])[:k]
        if some:
            rows = [(int(q), i, -s) for q, own in zip(qids, best, strict=True) for s, i in own]
            for lo in range(0, len(rows), 20_000):
                q, i, s = zip(*rows[lo : lo + 20_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (q, i, s)], names=["query_id", "vec_id", "score"])

    return run


def top_k(
    vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows for each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    v = quantised(vectors, id_col, vector_col, scale)
    # as few blocks as hold all rows, dealt over tasks once
    n_blocks = max(1, -(-v.count() // BLOCK))
    index = materialise(v.repartition(min(n_blocks, MOST_TASKS)).mapInArrow(_blocks(BLOCK + BLOCK // 8), _BLOCK), "sliced")
    asked = materialise(v.filter(F.col("vec_id") % every == 0).distinct(), "queries")
    total = asked.agg(F.sum(8 * F.size("v") + 16)).first()[0]
    n_chunks = max(1, -(-(total or 0) // CHUNK_BYTES))
    chunk = F.pmod(F.xxhash64("vec_id"), F.lit(n_chunks))
    found = None
    for c in range(n_chunks):
        queries = asked.filter(chunk == c).select("vec_id", "v").toArrow().combine_chunks()
        if not queries.num_rows:
            continue
        qids = queries.column(0).to_numpy()
        qvals = _matrix(queries.column(1).combine_chunks() if isinstance(queries.column(1), pa.ChunkedArray) else queries.column(1))
        shared = spark.sparkContext.broadcast((qids, qvals))
        part = materialise(index.mapInArrow(_search(shared, k), "query_id long, vec_id long, score long"), "found")
        shared.destroy()
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_query(embeddings: DataFrame) -> DataFrame:
    return top_k(embeddings)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), r AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
