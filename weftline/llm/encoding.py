"""Encoding of many texts by a tokenizers vocabulary, each distinct piece once.

Both public BPE vocabularies split a text into pieces that are encoded
independently of each other. Texts of letters, digits and signs up to U+024F are
split here and their pieces looked up; a piece not met before goes to the
library's BPE model. All other texts go to the library whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from . import worker

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_L = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
#: Texts with any other character are left to the library; İ changes its length in lower case.
_PLAIN = re.compile("[^\\t\\n\\r\\x20-\\x7eÀ-ÖØ-öø-įı-ɏ×÷]")
#: How the pre-tokenizers split such texts. In both, a piece means the same alone as in its text.
_SPLIT = {
    "byte": re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[0-9]+| ?[^\s{_L}0-9]+|\s+(?!\S)|\s+"),
    "word": re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[0-9]|[^\s{_L}0-9]+"),
}
#: Pieces kept in a worker; at some 200 bytes each. It starts anew when full.
CACHE = 400_000
_encoders: dict = {}
worker.keeps("encoding", _encoders.clear)


def _kind(spec: dict) -> str | None:
    """Which way to split this vocabulary's pre-tokenizer has, if one known here."""
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if spec["model"].get("type", "BPE") != "BPE":
        return None
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "byte"
    steps = [p.get("type") for p in pre.get("pretokenizers", [])]
    if norm and [n["type"] for n in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and steps == ["Split", "ByteLevel"]:
        return "word"
    return None


def _byte_letters() -> dict[int, str]:
    """The sign that stands for each byte in byte-level vocabularies: itself if it is printable, else the next from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


_BYTES = _byte_letters()


class _Pieces(dict):
    """Bytes of the ids of each piece; one that isn't known yet is encoded as it is asked for."""

    def __init__(self, model, dtype: np.dtype):
        self.model, self.dtype = model, dtype

    def __missing__(self, piece: str) -> bytes:
        letters = piece if piece.isascii() and piece.isalnum() else piece.encode().decode("latin-1").translate(_BYTES)
        out = self[piece] = np.array([t.id for t in self.model.tokenize(letters)], self.dtype).tobytes()
        return out


class BatchEncoder:
    def __init__(self, vocabulary: str, dtype: str = "<u4"):
        worker.owned_by("encoding")
        key = (vocabulary, dtype)
        if key not in _encoders:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(vocabulary)
            tok.encode_special_tokens = True
            with open(vocabulary, encoding="utf-8") as f:
                kind = _kind(json.load(f))
            _encoders[key] = (tok, kind, _Pieces(tok.model, np.dtype(dtype)))
        self.tok, self.kind, self.pieces = _encoders[key]
        self.dtype = np.dtype(dtype)

    @property
    def size(self) -> int:
        return self.tok.get_vocab_size()

    def encode(self, texts: list[str], end_id: int | None = None) -> tuple[bytes, np.ndarray]:
        """The ids of all texts as bytes, one after the other, and each text's number of ids.

        ``end_id`` is put after each text. Where the vocabulary has lower case, a
        text is lowered before it is split.
        """
        tail = b"" if end_id is None else np.array([end_id], self.dtype).tobytes()
        split, low, pieces, out = _SPLIT.get(self.kind), self.kind == "word", self.pieces, []
        for t in texts:
            if len(pieces) > CACHE:
                pieces.clear()
            if split and not _PLAIN.search(t):
                ids = b"".join(map(pieces.__getitem__, split.findall(t.lower() if low else t)))
            else:
                ids = np.array(self.tok.encode(t, add_special_tokens=False).ids, self.dtype).tobytes()
            out.append(ids + tail)
        return b"".join(out), np.fromiter(map(len, out), np.int64, len(out)) // self.dtype.itemsize
