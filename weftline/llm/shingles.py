"""Sets of word shingles of many texts at once, as 64-bit hashes.

A-Z are taken as a-z; words are runs of other than white space of ASCII. Bytes
enter a running sum of powers, of which each word's hash is a difference; words'
hashes make the shingles'. No Python loop runs over words. Sums are taken over
``CHUNK_BYTES`` at once (to the end of the word there), long texts included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import worker

WORDS = 5
CHUNK_BYTES = 1_000_000
_M64 = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
#: One odd factor for each place in a shingle.
_PLACES = [pow(0xD6E8FEB86659FD93, 2 * k + 1, 1 << 64) for k in range(16)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
worker.keeps("shingles", lambda: _powers.update(up=np.ones(1, np.uint64), down=np.ones(1, np.uint64)))


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        a = np.full(n, _P if kind == "up" else _P_INV, np.uint64)
        a[0] = 1
        _powers[kind] = np.multiply.accumulate(a)
    return _powers[kind][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every bit of the input moves every bit of the output."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_sets(column: pa.Array, words: int = WORDS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes, sizes) for runs of rows: each row's distinct shingles, ascending, one row after the other.

    A text of fewer words than a shingle, but not none, has its whole sequence
    as the one shingle; nulls are empty.
    """
    worker.owned_by("shingles")
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.empty(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + CHUNK_BYTES, "right")) - 1)
        yield lo, *_sets(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], words)
        lo = hi


def _words(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins, and its hash. bounds: where texts begin, which words don't cross."""
    begins, hashes, lo = [], [], 0
    while lo < len(raw):
        hi = lo + CHUNK_BYTES
        while hi < len(raw) and not _SPACE[raw[hi]]:  # to the end of a word: a sign of white space in the next bytes
            near = np.flatnonzero(_SPACE[raw[hi : hi + 4096]])
            hi += int(near[0]) if len(near) else 4096
        part = raw[lo:hi]
        inside = ~_SPACE[part]
        own = bounds[np.searchsorted(bounds, lo) : np.searchsorted(bounds, lo + len(part))] - lo
        before = np.empty_like(inside)
        before[0] = False
        before[1:] = inside[:-1]
        before[own] = False
        after = np.empty_like(inside)
        after[-1] = False
        after[:-1] = inside[1:]
        after[own[own > 0] - 1] = False
        begin, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        total = np.empty(len(part) + 1, np.uint64)
        total[0] = 0
        np.cumsum((_LOWER[part].astype(np.uint64) + np.uint64(1)) * _power("up", len(part)), out=total[1:])
        h = (total[end] - total[begin]) * _power("down", len(part))[begin]
        hashes.append(mix(h ^ ((end - begin).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))))
        begins.append(begin + lo)
        lo = hi
    return np.concatenate(begins), np.concatenate(hashes)


def _sets(raw: np.ndarray, off: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(off) - 1
    if not len(raw):
        return np.empty(0, np.uint64), np.zeros(n, np.int64)
    begin, h = _words(raw, off[1:-1])
    doc = np.searchsorted(off, begin, "right") - 1
    n_words = np.bincount(doc, minlength=n)

    places = [np.uint64(p) for p in _PLACES]
    s = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for k in range(words):
        s += h[k : k + len(s)] * places[k]
    whole = doc[: len(s)] == doc[words - 1 :] if len(s) else np.zeros(0, bool)
    s, own = s[whole], doc[: len(s)][whole]
    few = np.flatnonzero((n_words > 0) & (n_words < words))
    if len(few):
        first = np.concatenate(([0], np.cumsum(n_words)))[few]
        t = n_words[few].astype(np.uint64) * np.uint64(0x8EBC6AF09C88C6E3)
        for k in range(words - 1):
            has = n_words[few] > k
            t[has] += h[first[has] + k] * places[k]
        s, own = np.concatenate((s, t)), np.concatenate((own, few))
        order = np.argsort(own, kind="stable")
        s, own = s[order], own[order]
    s = mix(s)
    ends = np.searchsorted(own, np.arange(n + 1))
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        if b - a > 1:
            s[a:b].sort()
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != s[:-1]) | (own[1:] != own[:-1])
    return s[keep], np.bincount(own[keep], minlength=n)


def signatures(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set, as signed integers; 0 for empty sets."""
    out = np.zeros(len(sizes), np.uint64)
    has = np.flatnonzero(sizes)
    if len(has):
        starts = np.concatenate(([0], np.cumsum(sizes)))[has]
        out[has] = mix(np.add.reduceat(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), starts) ^ (sizes[has].astype(np.uint64) * np.uint64(_P)))
    return out.view(np.int64)
