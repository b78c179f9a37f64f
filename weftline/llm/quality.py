"""Quality classifier: compressed sizes under dictionaries of good and of bad text.

Two zstandard dictionaries hold pieces of text labelled good (1) and bad (0). A
text is compressed whole, in short blocks, under each; the
difference of its two compressed sizes is divided by their sum. The same is done
with the text's shape (runs of letters as one letter, digits as 0) and with its
rhythm (for each word how often running it was the one before), for which there are
two further dictionaries each: words tell by the first, layout and signs by the
second, repetition by the third (in natural text words seldom follow themselves: the
third view then is nearly the same for all texts, and the curve gives it little weight). A logistic curve of the three differences is
the score. It is fitted on labelled rows whose pieces are in no dictionary (a
fifth of the sample), so it is calibrated on text that the dictionaries haven't
seen.

The sample is bounded: of each label the ``SAMPLE_DOCS`` rows of the smallest
hashes of (doc_id, text), and of each of these up to ``PIECES`` pieces of
``PIECE_CHARS`` characters from places that the hash names. Only text and
quality are read from labelled rows.

Defined cases: null and empty texts score the share of good rows in the sample;
without rows of both labels every text scores that share (0.5 without any);
labels other than 0 and 1 are ignored; a document with both labels counts under
both; repeated rows each get a row; other columns are ignored.
"""

from __future__ import annotations

import math
import operator
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import worker
from .common import materialise

SAMPLE_DOCS = 1500
PIECES = 2
PIECE_CHARS = 600
#: Of the dictionaries of the text, its shape and its rhythm: bytes, bytes of a block, zstandard's level. Short
#: blocks leave little to find in the block itself, so what a dictionary holds decides.
KINDS = ((1 << 18, 512, 5), (1 << 15, 64, 3), (1 << 14, 32, 3))


_SHAPE = bytes(
    ord("a") if chr(c).islower() or c >= 0x80 else ord("A") if chr(c).isupper() else ord("0") if chr(c).isdigit() else c
    for c in range(256)
)
_RUNS = re.compile(rb"aa+|AA+|00+")


def shape(raw: bytes) -> bytes:
    return _RUNS.sub(lambda m: m[0][:1], raw.translate(_SHAPE))


def rhythm(raw: bytes) -> bytes:
    """A byte for each word after the first: how many times running it has now been the word before again.

    Runs count up, so a run can't be had from itself, only from a dictionary that knows runs.
    """
    words = raw.split()
    same = np.fromiter(map(operator.eq, words, words[1:]), np.int64, max(0, len(words) - 1))
    total = np.cumsum(same)
    return np.minimum(total - np.maximum.accumulate(np.where(same == 0, total, 0)), 255).astype(np.uint8).tobytes()


VIEWS = (bytes, shape, rhythm)

#: Characters at which a text's own evidence and the sample's share of good rows count the same.
SLIGHT = 60


class Model:
    """The dictionaries and the curve."""

    def __init__(self, good: list[str], bad: list[str], kinds=KINDS):
        self.kinds, self._tools = kinds, None
        # the first fifth of each label's pieces is kept for the curve
        g, b = len(good) // 5, len(bad) // 5
        raw = [[t.encode("utf-8", "surrogatepass") for t in texts] for texts in (good[g:], bad[b:])]
        # both dictionaries of a kind are of one size
        self.dictionaries = []
        for (size, _, _), view in zip(kinds, VIEWS, strict=True):
            joined = [b"\n".join(map(view, texts)) for texts in raw]
            least = min(size, *map(len, joined))
            self.dictionaries += [j[len(j) - least :] for j in joined]
        n = len(good) + len(bad)
        self.prior = (len(good) + 0.5) / (n + 1)
        self.weights = np.array([*[0.0] * len(VIEWS), math.log(self.prior / (1 - self.prior))])
        if g and b:
            self._fit(self.differences(good[:g] + bad[:b]), np.array([1.0] * g + [0.0] * b))

    def __getstate__(self):
        return {**self.__dict__, "_tools": None}

    def _compressors(self):
        if self._tools is None:
            import zstandard as zstd

            self._tools = []
            for i, raw in enumerate(self.dictionaries):
                d = zstd.ZstdCompressionDict(raw.ljust(8, b"\0"), dict_type=zstd.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=self.kinds[i // 2][2])
                c = zstd.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
                self._tools.append(c.compress)
        return self._tools

    def differences(self, texts: list[str]) -> np.ndarray:
        """[text, kind]: (size under the bad dictionary - size under the good one) / their sum; 0 for empty texts."""
        tools = self._compressors()
        out = np.zeros((len(texts), len(VIEWS)))
        for i, t in enumerate(texts):
            raw = t.encode("utf-8", "surrogatepass")
            for kind, data in enumerate(view(raw) for view in VIEWS):
                good, bad, g, b = tools[2 * kind], tools[2 * kind + 1], 0, 0
                size = self.kinds[kind][1]
                for lo in range(0, len(data), size):
                    block = data[lo : lo + size]
                    g += len(good(block))
                    b += len(bad(block))
                out[i, kind] = (b - g) / (b + g) if data else 0.0
        return out

    def _fit(self, x: np.ndarray, y: np.ndarray) -> None:
        """Logistic curve by Newton's method, with targets drawn in as Platt does and a small ridge."""
        pos, neg = y.sum(), len(y) - y.sum()
        t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
        scale = np.append(np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0), 1.0)
        z = np.column_stack((x, np.ones(len(x)))) / scale
        w = self.weights.copy()
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            hess = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(w))
            step = np.linalg.solve(hess, z.T @ (p - t) + 1e-2 * w)
            w -= step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
            if np.abs(step).max() < 1e-9:
                break
        self.weights = w / scale

    def score(self, texts: list[str]) -> np.ndarray:
        curve = self.differences(texts) @ self.weights[:-1] + self.weights[-1]
        # a short text says little: its logit stays near that of the sample's share of good rows
        size = np.array([float(len(t)) for t in texts])
        known = math.log(self.prior / (1 - self.prior))
        logit = known + (curve - known) * size / (size + SLIGHT)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def learn(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    sample_docs: int = SAMPLE_DOCS,
) -> Model:
    lab = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1)).distinct()
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.length("text") > 0)
    # ids alone are ranked; the sampled ones, a bounded number, then fetch their texts
    h = F.xxhash64("id", "y")
    known = lab.join(d.select("id").distinct(), "id", "left_semi").select("id", "y", h.alias("h"))
    # each task's smallest hashes, then theirs
    first = [known.filter(F.col("y") == y).orderBy("h", "id").limit(sample_docs) for y in (0, 1)]
    kept = first[0].unionByName(first[1])
    place = lambda k: F.pmod(F.xxhash64("h", F.lit(k)), F.greatest(F.length("text") - PIECE_CHARS, F.lit(0)) + 1).cast("int") + 1
    pieces = F.array(*[F.substring("text", place(k), F.lit(PIECE_CHARS)) for k in range(PIECES)])
    pieces = F.when(F.length("text") <= PIECE_CHARS, F.array("text")).otherwise(pieces)
    rows = d.join(F.broadcast(kept), "id").select("y", "h", "id", pieces.alias("pieces"), F.xxhash64("text").alias("t"))
    # of several texts of an id that of the smallest hash
    rows = rows.groupBy("y", "id").agg(F.min(F.struct("t", "h", "pieces")).alias("r")).select("y", "id", "r.h", "r.pieces").collect()
    own: dict[int, list[str]] = {0: [], 1: []}
    for r in sorted(rows, key=lambda r: (r["y"], r["h"], r["id"])):
        own[r["y"]] += r["pieces"]
    return Model(own[1], own[0])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """Per row of docs: its id, ``more`` columns and the score."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    shared = docs.sparkSession.sparkContext.broadcast(model)
    d = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"), *more)
    out = [f for f in d.schema.fields if f.name != "text"]

    def run(batches):
        worker.owned_by("quality")
        for b in batches:
            s = shared.value.score([x.as_py() or "" for x in b.column(0)])
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in out], pa.array(s)], names=[*[f.name for f in out], "score"])

    return d.mapInArrow(run, StructType([*out, StructField("score", DoubleType())]))


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3 == 1


def op3_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = learn(docs, labels.filter(~held_out()))
    found = materialise(score(docs, model, "doc_id", "text", held_out().alias("held_out")), "quality")
    return found.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))
