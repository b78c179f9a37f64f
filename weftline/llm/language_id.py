"""Language ID by cross-parsing entropy: suffix automata of labelled text, longest matches, fewest phrases.

For each learned language a suffix automaton of sample text is built. A text is
cross-parsed against each automaton: from the place where the last phrase ended,
the longest match in the language's sample is a phrase, and the next one starts
after it. The language that needs the fewest phrases for each character wins;
ties go to the language with more learned rows, then to the smaller name.

Texts are parsed whole. Segments of ``SEGMENT`` characters go through an automaton
side by side, one character a step, each from the start state at first; then each
is gone through again from the state in which the one before it ended, up to the
first character after which both runs are in the same state, from where they agree.
So phrases run across segments, whose length changes no count. Case is dropped, and runs of characters that aren't letters count as one
space. Every letter of the samples, of any script, is a symbol of its own: the
transitions of the most frequent ones are a table, those of the others are sorted
and searched. Letters that no sample has are phrases of their own.

``score`` is the share by which the best language's phrases fall below the next
language's, scaled to 0..1 (1 if only one language was learned; 0 for a tie).

The sample is bounded: for each language up to ``SAMPLE_DOCS`` rows, those of the
smallest hashes of (doc_id, text), with up to ``SAMPLE_CHARS`` characters in all
and as much of each row as every row may give.

Defined cases: null texts and texts without a letter are ``und`` with score 0;
if no language can be learned, every text is; rows whose language is null are
never learned from; repeated rows each get a row; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import worker
from .common import materialise

SEGMENT = 512
SAMPLE_DOCS = 64
SAMPLE_CHARS = 32_000
#: Letters whose transitions are a table, the most frequent of the samples; those of others are searched.
SYMBOLS = 62
UNKNOWN = "und"
_CODE_POINTS = 0x110000
_NEW = np.uint32(1 << 31)


def _letter(ch: str) -> str:
    """A letter without case."""
    return ch.lower()[:1]


def _transitions(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of each state of the suffix automaton; state 0 is the start."""
    goto: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        cur = len(goto)
        goto.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in goto[p]:
            goto[p][c] = cur
            p = link[p]
        if p != -1:
            q = goto[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(goto)
                goto.append(dict(goto[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and goto[p].get(c) == q:
                    goto[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return goto


def suffix_automaton(symbols: list[int], width: int) -> np.ndarray:
    """Transitions [state, symbol] of the suffix automaton, -1 where there is none; state 0 is the start."""
    return _table(_transitions(symbols), width)


def _table(goto: list[dict[int, int]], width: int) -> np.ndarray:
    """The transitions by the first ``width`` symbols."""
    table = np.full((len(goto), width), -1, np.int32)
    for s, g in enumerate(goto):
        for c, t in g.items():
            if c < width:
                table[s, c] = t
    return table


class Parser:
    """Counts the phrases of texts in each language's sample."""

    def __init__(self, samples: dict[str, list[str]], ranked: list[str]):
        self.langs = ranked
        counts: dict[str, int] = {}
        for texts in samples.values():
            for t in texts:
                for ch in t:
                    if ch.isalpha():
                        ch = _letter(ch)
                        counts[ch] = counts.get(ch, 0) + 1
        letters = sorted(counts, key=lambda c: (-counts[c], c))
        # 0: not a letter, 1: a letter that no sample has
        self.width = min(len(letters), SYMBOLS) + 2
        own = {c: i + 2 for i, c in enumerate(letters)}
        self.lut = np.zeros(_CODE_POINTS, np.uint32)
        for cp in range(_CODE_POINTS):
            ch = chr(cp)
            if ch.isalpha():
                self.lut[cp] = own.get(_letter(ch), 1)
        self.rare = max(len(letters) - SYMBOLS, 1)
        self.tables, self.searched = [], []
        for lang in ranked:
            text = np.concatenate([np.zeros(0, np.uint32), *[np.append(self.symbols([t])[0], 0) for t in samples[lang]]])
            found = _transitions(text.tolist())
            goto = _table(found, self.width)
            # a further state: after a symbol that the sample lacks, which is a phrase of its own
            lone = len(goto)
            after = np.where(goto[0] >= 0, goto[0], lone).astype(np.uint32) * np.uint32(self.width)
            # without a transition a phrase ends, and the next one starts with this symbol
            step = np.where(goto >= 0, goto.astype(np.uint32) * np.uint32(self.width), after | _NEW)
            step[0] = after  # at the start no phrase ends
            step = np.vstack((step, after | _NEW))
            self.tables.append(step.ravel())
            # (state, symbol) of the other letters' transitions as one number, in order, and where they lead
            more = sorted((s * self.rare + c - self.width, t) for s, g in enumerate(found) for c, t in g.items() if c >= self.width)
            keys = np.array([k for k, _ in more], np.int64)
            after = np.full(self.rare, lone, np.int64)
            for c, t in found[0].items():
                if c >= self.width:
                    after[c - self.width] = t
            self.searched.append((keys, np.array([t for _, t in more], np.int64), after))

    def _search(self, lang: int, state: np.ndarray, rare: np.ndarray) -> np.ndarray:
        """What ``tables`` gives, for letters that they don't hold."""
        keys, to, after = self.searched[lang]
        state = state.astype(np.int64) // self.width
        ends = (after[rare] * self.width).astype(np.uint32) | np.where(state > 0, _NEW, np.uint32(0))
        if not len(keys):
            return ends
        key = state * self.rare + rare
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, (to[at] * self.width).astype(np.uint32), ends)

    def _step(self, lang: int, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The states after symbols c, marked where a phrase ended before them."""
        rare = np.flatnonzero(c >= self.width)
        if not len(rare):
            return self.tables[lang][state + c]
        plain = c.copy()
        plain[rare] = 1
        at = self.tables[lang][state + plain]
        at[rare] = self._search(lang, state[rare], c[rare].astype(np.int64) - self.width)
        return at

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of all texts on end, each text's length, and whether it has a letter."""
        cps = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        sym = self.lut[cps]
        text = np.repeat(np.arange(len(texts)), sizes)
        keep = np.ones(len(sym), bool)
        keep[1:] = (sym[1:] != 0) | (sym[:-1] != 0) | (text[1:] != text[:-1])
        letters = np.bincount(text[sym != 0], minlength=len(texts)) > 0
        return sym[keep], np.bincount(text[keep], minlength=len(texts)), letters

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases [text, language], symbols and whether there is a letter, of each text."""
        sym, sizes, letters = self.symbols(texts)
        parts = -(-sizes // SEGMENT)
        text = np.repeat(np.arange(len(texts)), parts)
        first = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        nth = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = first[text] + nth * SEGMENT
        size = np.minimum(SEGMENT, sizes[text] - nth * SEGMENT)
        order = np.argsort(-size, kind="stable")
        text, begin, size = text[order], begin[order], size[order]
        live = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), "right")
        # by segment: the one that goes on from it, if any
        place = np.empty(len(text), np.int64)
        place[order] = np.arange(len(text))
        after = np.full(len(text), -1)
        goes_on = np.flatnonzero(np.append(nth[1:] > 0, False)) if len(nth) else np.zeros(0, np.int64)
        after[place[goes_on]] = place[goes_on + 1]
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        for lang in range(len(self.langs)):
            ran = np.zeros((len(live), len(text)), np.uint32)  # [place, segment]: the state, and whether a phrase ended before it
            state = np.zeros(len(text), np.uint32)
            for k, n in enumerate(live):
                ran[k, :n] = self._step(lang, state[:n], sym[begin[:n] + k])
                state[:n] = ran[k, :n] & ~_NEW
            redo = np.flatnonzero(after >= 0)
            while len(redo):  # segments after which the next one is gone through again
                own, now, k, changed = after[redo], state[redo], 0, []
                while len(own):
                    at = self._step(lang, now, sym[begin[own] + k])
                    same = (at & ~_NEW) == (ran[k, own] & ~_NEW)
                    ran[k, own] = at
                    k += 1
                    ended = ~same & (size[own] <= k)
                    state[own[ended]] = at[ended] & ~_NEW
                    changed.append(own[ended])
                    go = ~same & ~ended
                    own, now = own[go], at[go] & ~_NEW
                redo = np.concatenate(changed)
                redo = redo[after[redo] >= 0]
            out[:, lang] = np.bincount(text, weights=(ran >> np.uint32(31)).sum(axis=0).astype(float), minlength=len(texts)).astype(np.int64)
        return out + (sizes > 0)[:, None], sizes, letters  # the first phrase ends nothing

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        found, _, letters = self.phrases(texts)
        best = found.argmin(axis=1)
        least = found[np.arange(len(texts)), best].astype(float)
        if len(self.langs) > 1:
            second = np.partition(found, 1, axis=1)[:, 1].astype(float)
            score = 1 - least / np.maximum(second, 1)
        else:
            score = np.ones(len(texts))
        lang = [self.langs[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)]
        return lang, np.where(letters, np.clip(score, 0, 1), 0.0)


def learn(
    docs: DataFrame,
    label: str = "lang",
    id_col: str = "doc_id",
    text_col: str = "text",
    sample_docs: int = SAMPLE_DOCS,
    sample_chars: int = SAMPLE_CHARS,
) -> tuple[dict[str, list[str]], list[str]]:
    """Bounded samples of each language, and the languages by their number of rows."""
    each = sample_chars // sample_docs
    d = docs.select(F.col(label).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    d = d.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}"))
    n = d.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    # the rows of the smallest hashes of each language, and of each a piece from a place that its hash names
    h = F.xxhash64("id", "text")
    start = F.pmod(h, F.greatest(F.length("text") - each, F.lit(0)) + 1).cast("int") + 1
    piece = F.struct(h.alias("h"), F.substring("text", start, F.lit(each)).alias("t"))
    nth = F.row_number().over(W.partitionBy("lang").orderBy("p.h", "p.t"))
    kept = d.select("lang", piece.alias("p")).withColumn("nth", nth).filter(F.col("nth") <= sample_docs)
    samples: dict[str, list[str]] = {r["lang"]: [] for r in n}
    for r in sorted(kept.collect(), key=lambda r: (r["lang"], r["nth"])):
        samples[r["lang"]].append(r["p"]["t"])
    return samples, [r["lang"] for r in n]


def identify(
    docs: DataFrame, parser: Parser, id_col: str = "doc_id", text_col: str = "text", *more: Column, keep_text: bool = False
) -> DataFrame:
    """Per row of docs: its id, ``more`` columns (and ``text``, if it is to be kept), lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(parser)
    d = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"), *more)
    out = [f for f in d.schema.fields if keep_text or f.name != "text"]

    def run(batches):
        worker.owned_by("language_id")
        for b in batches:
            at = 0
            for texts in _chunks(b.column(0)):
                lang, score = shared.value.predict(texts)
                own = b.slice(at, len(texts))
                at += len(texts)
                yield pa.RecordBatch.from_arrays(
                    [*[own.column(f.name) for f in out], pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                    names=[*[f.name for f in out], "lang_pred", "score"],
                )

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    return d.mapInArrow(run, StructType([*out, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def _chunks(column, least: int = 2_000_000):
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


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def op7_query(docs: DataFrame) -> DataFrame:
    samples, ranked = learn(docs.filter(~held_out()))
    found = materialise(identify(docs, Parser(samples, ranked), "doc_id", "text", held_out().alias("held_out")), "languages")
    return found.select("doc_id", "held_out", "lang_pred", "score")
