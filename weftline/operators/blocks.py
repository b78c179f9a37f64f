"""States of a page as lists of blocks, and one document rendered from them."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.markdown import blocks as blocks_of
from ..functions.markdown import split_blocks
from ..functions.text import normalised_block

_TABLE = re.compile(r"\n\s*\|?[\s:|-]*-{2,}")


def block_key(text: str) -> str:
    """SHA-1 of what a block is recognised by (as ``functions.text.normalised_block`` has it)."""
    t = text
    if re.match(r"\s*\|", t) and _TABLE.search(t):
        t = "\n".join(sorted(x.strip() for x in t.split("\n")))
    plain = " ".join(re.sub(r"!\[\s*\]\([^)]*\)", " ", t).split()).lower()
    return hashlib.sha1((plain or " ".join(t.split()).lower()).encode()).hexdigest()


def is_weak(text: str) -> bool:
    """Too slight to place other blocks by: a rule, or two characters at most."""
    t = text.strip()
    return len(t) <= 2 or re.fullmatch(r"([-*_=])\1{2,}", re.sub(r"\s+", "", t)) is not None


class State:
    def __init__(self, label: str | None, provenance: str | None, order: int | None, keys: list[str]):
        self.label, self.provenance, self.order, self.keys = label or None, provenance or "baseline", order or 0, keys


def load(states: list[tuple[str | None, str | None, int | None, str | None]]) -> tuple[list[State], dict[str, str], dict[str, str]]:
    """States of (label, provenance, order, markdown), the text of each block, and where it was first seen."""
    out, texts, origin = [], {}, {}
    for label, provenance, order, markdown in states:
        by_key = {}
        for t in split_blocks(markdown):
            by_key.setdefault(block_key(t), t)
        s = State(label, provenance, order, list(by_key))
        for k, t in by_key.items():
            texts.setdefault(k, t)
            origin.setdefault(k, s.provenance)
        out.append(s)
    return out, texts, origin


def rendered(states: list[State], texts: dict[str, str], origin: dict[str, str]) -> list[tuple[str, str | None, str]]:
    """(text, label, provenance) of one document: the frame that most states share, and each state's own blocks
    before the frame block that follows them there."""
    if not states:
        return []
    base = states[0].keys
    if len(states) == 1:
        return [(texts[k], None, origin[k]) for k in base]
    since: dict[str, int] = {}
    for i, s in enumerate(states):
        for k in s.keys:
            since.setdefault(k, i)
    variants = {i for i, s in enumerate(states) if i and not set(base) <= set(s.keys)}
    votes = Counter(k for i in variants for k in states[i].keys)
    frame = {k for k in base if not variants or 2 * votes[k] > len(variants)}
    placed: dict[str | None, list[tuple[int, int]]] = {}
    own: dict[int, list[str]] = {}
    for i, s in enumerate(states):
        own[i] = [k for k in s.keys if k not in frame and (i in variants or since[k] == i)]
        if own[i]:
            after = s.keys[s.keys.index(own[i][0]) + 1 :]
            anchor = next((k for k in after if k in frame and not is_weak(texts[k])), None)
            placed.setdefault(anchor, []).append((s.order, i))
    out: list[tuple[str, str | None, str]] = []

    def put(anchor):
        for _, i in sorted(placed.get(anchor, [])):
            out.extend((texts[k], states[i].label, states[i].provenance) for k in own[i])

    for k in base:
        if k in frame:
            put(k)
            out.append((texts[k], None, origin[k]))
    put(None)
    return out


def to_markdown(blocks: list[tuple[str, str | None, str]]) -> str:
    parts, last = [], None
    for text, label, _ in blocks:
        if label and label != last:
            parts.append(f"**{label}:**")
        last = label
        parts.append(text)
    return re.sub(r"\n{3,}", "\n\n", "\n\n".join(parts)).strip()


def distinct_states(states: list[State], texts: dict[str, str]) -> list[dict]:
    out, seen = [], set()
    for s in states:
        if tuple(s.keys) not in seen:
            seen.add(tuple(s.keys))
            out.append({"label": s.label, "provenance": s.provenance, "order": s.order, "markdown": "\n\n".join(texts[k] for k in s.keys)})
    return out


RENDERED = (
    "page_id {0}, markdown string, size int, blocks array<struct<text:string,provenance:string>>, "
    "states array<struct<label:string,provenance:string,order:int,markdown:string>>"
)


def render_pages(states: DataFrame, page: str = "page_id") -> DataFrame:
    """One row for each page of states (page_id, state_idx, label, provenance, order, markdown): its document, the
    number of distinct blocks, the blocks in reading order, and its distinct states."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("state_idx").astype(object).where(lambda x: x.notna(), None)
        own, texts, origin = load(list(zip(g["label"], g["provenance"], g["order"], g["markdown"], strict=True)))
        doc = rendered(own, texts, origin)
        row = {
            "page_id": g["page_id"].iloc[0], "markdown": to_markdown(doc), "size": len(texts),
            "blocks": [{"text": t, "provenance": p or "baseline"} for t, _, p in doc], "states": distinct_states(own, texts),
        }
        return pd.DataFrame([row])

    s = states.withColumnRenamed(page, "page_id")
    return s.groupBy("page_id").applyInPandas(run, RENDERED.format(dict(s.dtypes)["page_id"])).withColumnRenamed("page_id", page)


def new_blocks(states: DataFrame) -> DataFrame:
    """(page_id, state_idx, added): how many blocks each state shows first; native after the split."""
    b = states.select("page_id", "state_idx", F.explode(blocks_of(F.col("markdown"))).alias("text"))
    b = b.select("page_id", "state_idx", F.sha1(normalised_block(F.col("text"))).alias("key")).distinct()
    first = b.groupBy("page_id", "key").agg(F.min("state_idx").alias("state_idx"))
    n = first.groupBy("page_id", "state_idx").agg(F.count("*").alias("added"))
    every = states.select("page_id", "state_idx").distinct()
    return every.join(n, ["page_id", "state_idx"], "left").withColumn("added", F.coalesce("added", F.lit(0)))


def frame_blocks(states: DataFrame) -> DataFrame:
    """(page_id, key, hits, variants, in_frame) of each block of a page's first state: the majority vote, native."""
    b = states.select("page_id", "state_idx", F.explode(blocks_of(F.col("markdown"))).alias("text"))
    b = b.select("page_id", "state_idx", F.sha1(normalised_block(F.col("text"))).alias("key")).distinct()
    first = states.groupBy("page_id").agg(F.min("state_idx").alias("first"))
    base = b.join(first, "page_id").filter("state_idx = first").select("page_id", "key")
    sizes = base.groupBy("page_id").agg(F.count("*").alias("all"))
    held = b.join(first, "page_id").filter("state_idx > first").join(base, ["page_id", "key"]).select("page_id", "state_idx", "key")
    n_held = held.groupBy("page_id", "state_idx").agg(F.count("*").alias("n"))
    every = states.join(first, "page_id").filter("state_idx > first").select("page_id", "state_idx").distinct()
    variant = every.join(n_held, ["page_id", "state_idx"], "left").join(sizes, "page_id").filter(F.coalesce("n", F.lit(0)) < F.col("all"))
    variant = variant.select("page_id", "state_idx")
    votes = held.join(variant, ["page_id", "state_idx"]).groupBy("page_id", "key").agg(F.count("*").alias("hits"))
    total = variant.groupBy("page_id").agg(F.count("*").alias("variants"))
    out = base.join(votes, ["page_id", "key"], "left").join(total, "page_id", "left").fillna(0, ["hits", "variants"])
    return out.withColumn("in_frame", (F.col("variants") == 0) | (2 * F.col("hits") > F.col("variants")))


def section_numbers(lines: DataFrame) -> DataFrame:
    """lines (doc, line_no, text) with ``in_fence`` and ``section``: running counts of fences and headings, native."""
    w = W.partitionBy("doc").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    fence = F.col("text").rlike(r"^\s*(```|~~~)")
    x = lines.withColumn("fences", F.sum(fence.cast("int")).over(w))
    x = x.withColumn("in_fence", fence | (F.col("fences") % 2 == 1))
    head = (~F.col("in_fence") & F.col("text").rlike(r"^#{1,3}\s+")).cast("int")
    return x.withColumn("section", F.sum(head).over(w)).drop("fences")
