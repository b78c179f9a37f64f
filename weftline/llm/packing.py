"""Harmonic packing: pieces of reciprocal-capacity classes fill bins of a fixed count.

A text of n tokens gives n div C pieces of the capacity C, each a sequence by
itself. Its rest r belongs to class k = C div r (at most ``CLASSES``), that of
lengths in (C/(k+1), C/k], and stays whole: a bin of class k closes with its k-th
rest, so bins need no search, and every worker fills its own. A closed bin leaves
a gap; gaps of ``LEAST`` tokens or more wait, and the next text is cut to fill
them, in order, before what remains of it is packed. So only as much text is cut
as closed bins have room for.

When a worker ends, what stands in its unclosed bins is laid end to end and cut at
C; of that one part, shorter than C, is left for each worker. These, one row for
each task whatever the input, are laid together by best fit, and sequences are
numbered by prefix sums of the workers' bins.

Padded are gaps of fewer than ``LEAST`` tokens, gaps that still wait when a worker
ends, and the bins of the workers' last parts.

Defined cases: a null or empty text has its end id alone; each row of repeated
document ids is packed by itself; an empty table gives no pieces; other columns
are ignored.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .encoding import BatchEncoder
from .token_files import _some

CAPACITY = 2048
CLASSES = 32
LEAST = 16
#: Bases of workers' sequences are broadcast up to so many rows (24 bytes each).
MAX_BROADCAST_ROWS = 500_000


class Worker:
    """The bins of one worker. Pieces are numbered as they come, from 0."""

    def __init__(self, capacity: int = CAPACITY, classes: int = CLASSES, least: int = LEAST):
        self.capacity, self.classes, self.least = capacity, classes, least
        self.bins = 0
        #: By class: the pieces (number, length) of the open bin.
        self.open: dict[int, list[tuple[int, int]]] = {}
        #: (bin, offset, length) of room in closed bins.
        self.gaps: deque[tuple[int, int, int]] = deque()
        self.pieces = 0
        #: Pieces by number: bin and offset, as far as they are placed.
        self.placed: dict[int, tuple[int, int]] = {}

    def _bin(self) -> int:
        self.bins += 1
        return self.bins - 1

    def _closed(self, own: list[tuple[int, int]]) -> None:
        at, b = 0, self._bin()
        for piece, n in own:
            self.placed[piece] = (b, at)
            at += n
        if self.capacity - at >= self.least:
            self.gaps.append((b, at, self.capacity - at))

    def add(self, n: int) -> list[int]:
        """Places a text of n tokens; the lengths of its pieces."""
        out = []

        def piece(length: int) -> int:
            out.append(length)
            self.pieces += 1
            return self.pieces - 1

        while self.gaps and n:
            b, at, room = self.gaps.popleft()
            take = min(n, room)
            self.placed[piece(take)] = (b, at)
            n -= take
            if room - take >= self.least:
                self.gaps.appendleft((b, at + take, room - take))
        while n >= self.capacity:
            self.placed[piece(self.capacity)] = (self._bin(), 0)
            n -= self.capacity
        if n:
            k = min(self.capacity // n, self.classes)
            own = self.open.setdefault(k, [])
            own.append((piece(n), n))
            if len(own) == k:
                self._closed(self.open.pop(k))
        return out

    def rest(self) -> list[tuple[int, int]]:
        """(piece, length) of all open bins, as they are to be laid end to end."""
        out = [p for k in sorted(self.open) for p in self.open[k]]
        self.open.clear()
        return out


def best_fit(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each block, the largest first, each where least room is left."""
    out: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins = 0
    for i in sorted((i for i in range(len(sizes)) if sizes[i]), key=lambda i: (-sizes[i], i)):
        free = next((r for r in range(sizes[i], capacity + 1) if room[r]), None)
        if free is None:
            at, free, bins = bins, capacity, bins + 1
        else:
            at = room[free].pop()
        out[i] = (at, capacity - free)
        room[free - sizes[i]].append(at)
    return out


_PIECES = "doc_id long, start long, length long, doc_tokens long, part int, bin long, offset long, ids binary"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("part", pa.int32()), ("bin", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())]
)
#: The bin of what a worker leaves over.
_LAST = -1


def _rows(part, held, placed):
    """Held pieces (doc_id, start, length, doc_tokens, ids) and their places, in batches."""
    for lo in range(0, len(held), 5000):
        own, at = held[lo : lo + 5000], placed[lo : lo + 5000]
        doc, start, length, tokens, ids = zip(*own, strict=True)
        b, offset = zip(*at, strict=True)
        cols = [doc, start, length, tokens, [part] * len(own), b, offset, ids]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW, strict=True)], schema=_ARROW)


def pack(
    docs: DataFrame,
    vocabulary: str,
    end_id: int = 1,
    capacity: int = CAPACITY,
    classes: int = CLASSES,
    least: int = LEAST,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of all texts: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""

    def pieces(batches):
        from pyspark import TaskContext

        part, encoder, own = TaskContext.get().partitionId(), BatchEncoder(vocabulary), Worker(capacity, classes, least)
        waiting: dict[int, tuple] = {}  # pieces of open bins: less than a bin's tokens for each class
        for b in batches:
            at = 0
            for texts in _some(b.column(1)):
                flat, sizes = encoder.encode(texts, end_id)
                doc = b.column(0).slice(at, len(texts)).to_pylist()
                at += len(texts)
                first, begin = own.pieces, 0
                for i, n in zip(doc, sizes.tolist(), strict=True):
                    start = 0
                    for k, length in enumerate(own.add(n)):
                        lo = begin + 4 * start
                        waiting[first + k] = (i, start, length, n, flat[lo : lo + 4 * length])
                        start += length
                    first, begin = own.pieces, begin + 4 * n
                done = list(own.placed)
                yield from _rows(part, [waiting.pop(p) for p in done], [own.placed[p] for p in done])
                own.placed.clear()
        held, placed, at = [], [], 0
        rest = own.rest()
        last = sum(n for _, n in rest) // capacity * capacity  # what lies from here on is the last part
        base = own.bins
        for p, _ in rest:
            doc, start, length, tokens, ids = waiting.pop(p)
            used = 0
            while used < length:
                take = min(length - used, capacity - at % capacity)
                held.append((doc, start + used, take, tokens, ids[4 * used : 4 * (used + take)]))
                placed.append((base + at // capacity, at % capacity) if at < last else (_LAST, at - last))
                at, used = at + take, used + take
        yield from _rows(part, held, placed)

    cut_up = materialise(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(pieces, _PIECES), "pieces", "zstd"
    )
    # one row for each task
    own = F.col("bin") == _LAST
    per = cut_up.groupBy("part").agg(
        F.coalesce(F.max(F.when(~own, F.col("bin"))) + 1, F.lit(0)).alias("bins"), F.coalesce(F.sum(F.when(own, F.col("length"))), F.lit(0)).alias("left")
    )
    parts = per.orderBy("part").collect()
    bases = np.concatenate(([0], np.cumsum([r["bins"] for r in parts], dtype=np.int64))).tolist()
    last = best_fit([r["left"] for r in parts], capacity)
    rows = [(r["part"], b, bases[-1] + at, offset) for r, b, (at, offset) in zip(parts, bases, last, strict=False)]
    placed = docs.sparkSession.createDataFrame(rows, "part int, base long, last_bin long, last_offset long")
    if len(rows) <= MAX_BROADCAST_ROWS:
        placed = F.broadcast(placed)
    return cut_up.join(placed, "part").select(
        "doc_id",
        "start",
        "length",
        "ids",
        "doc_tokens",
        F.when(own, F.col("last_bin")).otherwise(F.col("base") + F.col("bin")).alias("sequence_id"),
        F.when(own, F.col("last_offset") + F.col("offset")).otherwise(F.col("offset")).alias("offset"),
    )


def op1_query(docs: DataFrame, vocabulary: str) -> DataFrame:
    return pack(docs, vocabulary).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
