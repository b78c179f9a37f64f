"""64-bit SimHash fingerprints of texts, and distances between them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .udfs import arrow

#: Seeds of the two halves, and the hash's constants.
SEED_HIGH, SEED_LOW = 0x9747B28C, 0x01000193
C1, C2, ADD = 0xCC9E2D51, 0x1B873593, 0xE6546B64
F1, F2 = 0x85EBCA6B, 0xC2B2AE35
#: Of each byte whether it is in a token, which are runs of a-z and 0-9 of two or more.
_IN_TOKEN = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz0123456789")).astype(np.uint8)
#: Of each byte its bits, the lowest first, as eight bytes.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
#: Characters of texts that are taken together, some at least.
TOGETHER = 1_000_000


def _rol(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint32(r)) | (x >> np.uint32(32 - r))


def _hashes(units: np.ndarray, begin: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of many pieces of units side by side, one unit a step; the longest pieces come first."""
    mixed = _rol(units.astype(np.uint32) * np.uint32(C1), 15) * np.uint32(C2)
    h = np.full(len(begin), seed, np.uint32)
    live = len(begin)
    for k in range(int(sizes[0]) if live else 0):
        while sizes[live - 1] <= k:
            live = int(np.searchsorted(-sizes, -k))
        h[:live] = _rol(h[:live] ^ mixed[begin[:live] + k], 13) * np.uint32(5) + np.uint32(ADD)
    h ^= sizes.astype(np.uint32)
    h ^= h >> np.uint32(16)
    h *= np.uint32(F1)
    h ^= h >> np.uint32(13)
    h *= np.uint32(F2)
    return h ^ (h >> np.uint32(16))


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(units, size of each token, tokens of each text): the tokens of all texts on end, a space after each."""
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    held = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    until = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)
    edges = np.flatnonzero(np.diff(_IN_TOKEN[held], prepend=np.uint8(0)))
    begin, end = edges[::2], edges[1::2]  # the last character is in no token
    long = end - begin >= 2
    begin, end = begin[long], end[long]
    marks = np.zeros(len(held) + 1, np.int8)
    marks[begin] = 1
    marks[end + 1] -= 1  # 0 where the next token begins
    taken = np.cumsum(marks[:-1], dtype=np.int8).view(bool)
    units = held.copy()
    units[end] = 32
    return units[taken], end - begin, np.diff(np.searchsorted(begin, until), prepend=0)


def _votes(hashes: np.ndarray, features: np.ndarray) -> np.ndarray:
    """[text, bit]: how many of each text's features have the bit. Up to 255 are added as bytes side by side."""
    parts = -(-features // 255)
    within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    at = np.repeat(np.cumsum(features) - features, parts) + 255 * within
    first, out = np.cumsum(parts) - parts, np.empty((len(features), 64), np.int64)
    for k in range(8):
        lanes = np.add.reduceat(_LANES[hashes[:, k]], at).view(np.uint8).reshape(-1, 8)
        out[:, 8 * k : 8 * k + 8] = np.add.reduceat(lanes.astype(np.int64), first, axis=0)
    return out


def fingerprints(texts: list[str], shingle: int = 2) -> np.ndarray:
    """A bit is set if the features that have it outweigh those that don't; a text without tokens gives 0.

    Features are runs of tokens joined by a space: pieces of a text's tokens written on end.
    """
    n, out = max(1, shingle), np.zeros(len(texts), np.uint64)
    units, size, n_tokens = _tokens(texts)
    ends = np.cumsum(size + 1) - 1
    first = np.cumsum(n_tokens) - n_tokens
    features = np.where(n_tokens < n, n_tokens, n_tokens - n + 1)
    text = np.repeat(np.arange(len(texts)), features)
    at = first[text] + np.arange(len(text)) - np.repeat(np.cumsum(features) - features, features)
    until = at + np.where(n_tokens < n, 1, n)[text] - 1
    if not len(text):
        return out.view(np.int64)
    begin, sizes = ends[at] - size[at], ends[until] - ends[at] + size[at]
    order = np.argsort(-sizes, kind="stable")
    both = np.empty((len(text), 2), "<u4")
    both[order, 0], both[order, 1] = (_hashes(units, begin[order], sizes[order], s) for s in (SEED_LOW, SEED_HIGH))
    has = np.flatnonzero(features)
    votes = _votes(both.view(np.uint8), features[has])
    out[has] = np.packbits(2 * votes > features[has, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out.view(np.int64)


def fingerprint(text: str | None, shingle: int = 2) -> int:
    return int(fingerprints([text or ""], shingle)[0])


@arrow("long")
def _fingerprints(text: pd.Series) -> pd.Series:
    parts, held, size = [], [], 0
    for t in text:
        held.append(t or "")
        size += len(held[-1])
        if size >= TOGETHER:
            parts.append(fingerprints(held))
            held, size = [], 0
    found = np.concatenate([*parts, fingerprints(held)])
    return pd.Series(found, index=text.index)


def simhash(text: Column) -> Column:
    return _fingerprints(text)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def is_near_dup(a: Column, b: Column, most: int) -> Column:
    return hamming(a, b) <= most
