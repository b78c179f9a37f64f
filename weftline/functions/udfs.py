"""Arrow UDFs that are made when they are used, so that modules can be imported without a session."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: What is turned into Python's objects at once: so many bytes (a longer row goes alone) or rows at most.
PIECE_BYTES, PIECE_ROWS = 1 << 20, 2_000


def _bytes_of(a: pa.Array) -> np.ndarray:
    """About how many bytes each row has: of strings and lists their share, of other rows few."""
    n = len(a)
    if pa.types.is_string(a.type) or pa.types.is_list(a.type):
        ends = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + n + 1].astype(np.int64)
        if pa.types.is_list(a.type):  # offsets of rows point to offsets of what they hold
            inner = a.values
            ends = np.concatenate([[0], np.cumsum(_bytes_of(inner))])[ends]
        return np.diff(ends) + 8
    return np.full(n, a.nbytes // n + 1 if n else 0)


def pieces(columns: tuple[pa.Array, ...]) -> Iterator[tuple[pa.Array, ...]]:
    """Slices of columns, in order."""
    n = len(columns[0])
    total = np.cumsum(sum(_bytes_of(c) for c in columns)) if n else np.zeros(0, np.int64)
    at = 0
    while at < n:
        before = total[at - 1] if at else 0
        until = min(max(at + 1, int(np.searchsorted(total, before + PIECE_BYTES, "right"))), at + PIECE_ROWS)
        yield tuple(c.slice(at, until - at) for c in columns)
        at = until


def _converted(found: pd.Series | pd.DataFrame, kind: pa.DataType) -> pa.Array:
    if isinstance(found, pd.DataFrame):
        own = [pa.array(found[f.name], f.type, from_pandas=True) for f in kind]
        return pa.StructArray.from_arrays(own, fields=list(kind))
    out = pa.array(found, kind, from_pandas=True)
    return out.combine_chunks() if isinstance(out, pa.ChunkedArray) else out


def arrow(schema: str) -> Callable[[Callable], Callable[..., Column]]:
    """Turns a function of pandas series into one of columns.

    Spark's batches have thousands of rows, whatever their size. They stay Arrow's: the function sees a piece of a batch,
    and what it makes of one goes back before it sees the next, so a worker holds the objects of one piece only.
    """

    def add(f: Callable) -> Callable[..., Column]:
        def call(*columns: Column) -> Column:
            kind = to_arrow_type(DataType.fromDDL(schema))

            def each(batch: tuple[pa.Array, ...]) -> Iterator[pa.Array]:
                for piece in pieces(batch):
                    yield _converted(f(*(c.to_pandas() for c in piece)), kind)

            def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
                for b in batches:
                    yield from each((b,))

            def many(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
                for b in batches:
                    yield from each(b)

            one.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
            many.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
            return F.arrow_udf(one if len(columns) == 1 else many, schema)(*columns)

        return functools.wraps(f, assigned=("__name__", "__doc__"))(call)

    return add
