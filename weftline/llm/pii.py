"""Personal data: base patterns, and lexical patterns learned from them that find further identifiers.

Base spans are e-mail addresses, IP addresses, payment cards and telephone
numbers. Seeds are the base spans, and values that a text assigns (by ``=`` or
``:``) to a word such as ``token`` or ``password`` (``KEY_WORDS``). Further
instances are runs of letters and digits with at least two digits, outside base
spans. Every instance, seed or not, has two lexical patterns: the word before it
with the signs between and the sign after it, and, where there are signs other
than spaces between, these with the shape of the value (kinds and numbers of
characters) and the sign after it.

Patterns and instances form a graph over the whole input, of distinct pairs.
Scores go round it: seeds score 1, runs of digits alone 0 (base patterns have
refused them); a pattern's score is the mean score of its instances, drawn
towards 0 by ``SMOOTHING`` of unknown worth; any other instance scores ``DECAY``
times the best of its patterns, so scores fall with the distance from seeds. A
pattern is sure if it scores ``SURE`` or more and has ``SUPPORT`` different
instances at least that are seeds or were found in an earlier round; its
instances are found. Those found after ``ROUNDS`` rounds, and the seeds, get all
their occurrences as spans of kind ``id``.

Base spans never change. Spans count code points, the end is exclusive.

Defined cases: null and empty texts have no spans; each row of repeated rows has
its own; equal values count once for a pattern; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import worker
from .common import materialise, same_rows

KINDS = ("email", "ip", "card", "phone", "id")
ROUNDS = 3
SMOOTHING = 2.0
DECAY = 0.95
SURE = 0.85
SUPPORT = 5
#: Words whose assigned values are seeds.
KEY_WORDS = frozenset("account auth bearer credential iban key passport passwd password pin pwd secret ssn token".split())
#: Rows of patterns' scores (and of found values) broadcast; beyond it they are joined.
MAX_BROADCAST_PATTERNS = 200_000
#: Rows of spans broadcast to redact texts; beyond it they are joined.
MAX_BROADCAST_ROWS = 200_000

_ANY = re.compile(r"[0-9@]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a run of digits that fails from its first one fails from any other
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IDENTIFIER = re.compile(r"[A-Za-z0-9][A-Za-z0-9_-]{6,}[A-Za-z0-9]")
_PART = re.compile(r"[_-]+")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str):
    """As the pattern's leftmost matches, but in linear time: from each @ to its sides."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL_CHARS:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            yield begin, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order; kind indexes KINDS."""
    out = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def context(text: str, start: int) -> tuple[str, str] | None:
    """The word before a place, in lower case, and the signs between, spaces as one; None without either or across lines."""
    at = start
    while at and not text[at - 1].isalnum() and text[at - 1] not in "_\n":
        at -= 1
    begin = at
    while begin and text[begin - 1].isalpha():
        begin -= 1
    if begin == at or at == start:
        return None
    return text[begin:at].lower(), " ".join(f"|{text[at:start]}|".split())[1:-1]


def shape(value: str) -> str:
    """Kinds (digits, hexadecimal, letters, both) and numbers of characters of the parts between - and _."""
    out = []
    for part in _PART.split(value):
        low = part.lower()
        kind = "d" if part.isdigit() else "h" if not low.strip("0123456789abcdef") else "l" if part.isalpha() else "a"
        out.append(f"{kind}{len(part)}")
    return "-".join(out)


def patterns(text: str, start: int, end: int, kind: str | None = None) -> tuple[list[str], bool]:
    """The lexical patterns of a value in its text, and whether a key word's value it is. kind: that of a base span."""
    before = context(text, start)
    if before is None:
        return [], False
    word, signs = before
    after = text[end : end + 1]
    after = after if after and not after.isalnum() and not after.isspace() and after != "_" else ""
    out = [f"w\t{word}\t{signs}\t{after}"]
    if signs.strip():
        out.append(f"s\t{signs}\t{kind or shape(text[start:end])}\t{after}")
    return out, word in KEY_WORDS and ("=" in signs or ":" in signs)


def identifiers(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs of letters and digits, with at least two digits, that touch no base span."""
    out, k, covered = [], 0, 0
    for m in _IDENTIFIER.finditer(text):
        while k < len(base) and base[k][0] < m.end():
            covered = max(covered, base[k][2])
            k += 1
        if covered <= m.start() and sum(c.isdigit() for c in m[0]) >= 2:
            out.append((m.start(), m.end()))
    return out


_SPAN = "struct<start:int,kind:int,end:int>"
_SEEN = "struct<start:int,end:int,patterns:array<string>,value:string,base:boolean,seed:boolean,bad:boolean>"


def _extract(docs: DataFrame) -> DataFrame:
    def run(batches):
        worker.owned_by("pii")
        for b in batches:
            spans, seen = [], []
            for x in b.column(2):
                t = x.as_py() or ""
                own, near = [], []
                if _ANY.search(t):
                    own = base_spans(t)
                    for s, k, e in own:
                        near.append((s, e, patterns(t, s, e, KINDS[k])[0], t[s:e], True, True, False))
                    for s, e in identifiers(t, own):
                        found, key = patterns(t, s, e)
                        bad = not _PART.sub("", t[s:e]).strip("0123456789")
                        near.append((s, e, found, t[s:e], False, key and not bad, bad))
                spans.append([{"start": s, "kind": k, "end": e} for s, k, e in own])
                seen.append([dict(zip(_FIELDS, x, strict=True)) for x in near])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(spans, _SPANS), pa.array(seen, _NEAR)], names=["row", "doc_id", "base", "seen"])

    d = docs.select("row", "doc_id", "text")
    kinds = dict(d.dtypes)
    return d.mapInArrow(run, f"row {kinds['row']}, doc_id {kinds['doc_id']}, base array<{_SPAN}>, seen array<{_SEEN}>")


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_FIELDS = ("start", "end", "patterns", "value", "base", "seed", "bad")
_NEAR = pa.list_(
    pa.struct(list(zip(_FIELDS, (pa.int32(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.bool_(), pa.bool_(), pa.bool_()), strict=True)))
)


def sure_patterns(graph: DataFrame, rounds: int = ROUNDS, sure: float = SURE, support: int = SUPPORT) -> DataFrame:
    """The patterns of (pattern, value, seed, bad) that score high enough, after some rounds over the graph.

    Other columns of graph are ignored; without ``bad`` no value is.
    """
    graph = graph.select("pattern", "value", "seed", (F.col("bad") if "bad" in graph.columns else F.lit(False)).alias("bad"))
    scored = graph.withColumn("score", F.col("seed").cast("double")).withColumn("held", F.col("seed"))
    found = None
    for k in range(rounds):
        found = scored.groupBy("pattern").agg(
            (F.sum("score") / (F.count("*") + SMOOTHING)).alias("worth"), F.sum(F.col("held").cast("long")).alias("support")
        )
        is_sure = (F.col("worth") >= sure) & (F.col("support") >= support)
        if k + 1 < rounds:
            of = _bounded(found.filter("worth > 0").select("pattern", "worth", is_sure.alias("sure")), "worth")
            best = graph.filter("not seed and not bad").join(of, "pattern").groupBy("value").agg(F.max("worth").alias("best"), F.max("sure").alias("found"))
            scored = graph.join(_bounded(best, "best"), "value", "left").select(
                "pattern",
                "value",
                "seed",
                F.when(F.col("seed"), 1.0).otherwise(F.coalesce(DECAY * F.col("best"), F.lit(0.0))).alias("score"),
                (F.col("seed") | F.coalesce("found", F.lit(False))).alias("held"),
            )
    return found.filter(is_sure).select("pattern")


def _bounded(df: DataFrame, what: str) -> DataFrame:
    """df written, and broadcast where it has few rows: hot patterns are then not brought together."""
    df = materialise(df, what)
    return F.broadcast(df) if df.count() <= MAX_BROADCAST_PATTERNS else df


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: row (as numbered by the scan), doc_id, base and spans, arrays of (start, kind, end) in order."""
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scan = materialise(_extract(d), "pii")
    return _with_found(scan)


def _with_found(scan: DataFrame) -> DataFrame:
    seen = scan.select("row", F.explode("seen").alias("s")).select("row", "s.*")
    pairs = seen.select(F.explode("patterns").alias("pattern"), "value", "seed", "bad")
    # a value that a key word has anywhere is a seed everywhere
    graph = materialise(pairs.groupBy("pattern", "value").agg(F.max("seed").alias("own"), F.max("bad").alias("bad")), "graph")
    seeds = _bounded(seen.filter("seed").select("value", F.lit(True).alias("seed")).distinct(), "seeds")
    graph = materialise(graph.join(seeds, "value", "left").select("pattern", "value", F.coalesce("seed", F.lit(False)).alias("seed"), "bad"), "graph")
    sure = _bounded(sure_patterns(graph), "sure")
    values = graph.filter("not bad").join(sure, "pattern", "left_semi").select("value").union(seeds.select("value")).distinct()
    found = seen.filter("not base and not bad").join(_bounded(values, "values"), "value", "left_semi")
    new = found.groupBy("row").agg(F.collect_set(F.struct("start", F.lit(len(KINDS) - 1).alias("kind"), "end")).alias("more"))
    none = F.array().cast(f"array<{_SPAN}>")
    return scan.join(new, "row", "left").select(
        "row", "doc_id", "base", F.array_sort(F.concat("base", F.coalesce("more", none))).alias("spans")
    )


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def _rebuilt(text: str, spans) -> str:
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += (text[at : s["start"]], f"[{KINDS[s['kind']]}]")
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span's kind in brackets in its place; a span that begins inside one before it goes with it.

    Only texts that have spans go to Python workers.
    """

    @F.pandas_udf("string")
    def rebuilt(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _rebuilt(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)

    has = F.size(spans) > 0
    return F.when(has, rebuilt(F.when(has, text), F.when(has, spans))).otherwise(text)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with personal data replaced in their texts; all columns stay, and so do all rows."""
    key = same_rows(F.col(id_col), F.col(text_col))
    d = docs.select(key.alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = _with_found(materialise(_extract(d), "pii")).filter(F.size("spans") > 0)
    # rows of one key are equal, and so are their spans
    found = materialise(found.select(F.col("row").alias("_row"), F.col("spans").alias("_spans")).dropDuplicates(["_row"]), "spans")
    if found.count() <= MAX_BROADCAST_ROWS:
        found = F.broadcast(found)
    out = docs.withColumn("_key", key).join(found, F.col("_key") == F.col("_row"), "left")
    changed = redacted(F.col(text_col), F.col("_spans"))
    return out.select(*[changed.alias(c) if c == text_col else F.col(c) for c in docs.columns])


def op5_query(docs: DataFrame) -> DataFrame:
    """Beside what the base has: n_id, the spans that the learned patterns and key words add, and n_spans, all of them."""
    out = find_pii(docs)
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return out.select(
        "doc_id",
        *[n(k) for k in KINDS],
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
