"""Markdown structure: blocks, sections, headings, tables, atoms. Arrow UDFs over whole texts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import normalised
from .udfs import arrow

_FENCE = re.compile(r"\s*(`{3,}|~{3,})")
_HEADING = re.compile(r"(#{1,3})\s+(.*)", re.S)


def _fenced(lines: list[str]):
    """(line, inside, opens, closes) of each line; a fence closes by the signs that opened it."""
    fence = None
    for line in lines:
        m = _FENCE.match(line)
        if not m:
            yield line, fence is not None, False, False
        elif fence is None:
            fence = m[1]
            yield line, True, True, False
        else:
            closes = line.strip().startswith(fence)
            if closes:
                fence = None
            yield line, True, False, closes


def split_blocks(markdown: str | None) -> list[str]:
    """Paragraphs; a fenced block is one, with its empty lines."""
    out: list[str] = []
    held: list[str] = []

    def flush():
        text = "\n".join(held).strip()
        if text:
            out.append(text)
        held.clear()

    for line, inside, opens, closes in _fenced((markdown or "").split("\n")):
        if opens or (not inside and not line.strip()):
            flush()
        if inside or line.strip():
            held.append(line)
        if closes:
            flush()
    flush()
    return out


def _toggled(markdown: str | None):
    """(line, inside) where any fence line turns the state."""
    inside = False
    for line in (markdown or "").split("\n"):
        if re.match(r"\s*(```|~~~)", line):
            inside = not inside
            yield line, True
        else:
            yield line, inside


def sections(markdown: str | None, width: int = 120, keep_empty: bool = False) -> list[tuple[str, str]]:
    """(heading, text) of the parts that headings of level 1 to 3 begin; what stands before is ``(intro)``."""
    out: list[tuple[str, list[str]]] = [("(intro)", [])]
    for line, inside in _toggled(markdown):
        m = None if inside else _HEADING.match(line)
        if m:
            out.append((m[2].strip()[:width], [line]))
        else:
            out[-1][1].append(line)
    found = [(h, "\n".join(lines).strip()) for h, lines in out]
    return [s for i, s in enumerate(found) if s[1] or (keep_empty and i == 0 and out[0][1])]


def headings(markdown: str | None) -> list[tuple[int, str]]:
    """(level, text) of headings of level 1 to 3 outside fences, closing signs dropped."""
    out = []
    for line, inside in _toggled(markdown):
        m = None if inside else re.fullmatch(r"(#{1,3})\s+(.+?)\s*#*\s*", line)
        if m:
            out.append((len(m[1]), m[2].strip()))
    return out


def section_paths(blocks: list[str]) -> list[list[str]]:
    """Of each block the titles of the headings above it."""
    above: list[tuple[int, str]] = []
    out = []
    for b in blocks:
        m = re.match(r"(#{1,6})\s", b)
        if m:
            while above and above[-1][0] >= len(m[1]):
                above.pop()
        out.append([t for _, t in above])
        if m:
            above.append((len(m[1]), re.sub(r"^#{1,6}\s*", "", b).strip()[:80]))
    return out


def repair_tables(markdown: str | None) -> str:
    """Tables made rectangular, empty rows left out; fenced lines stay."""
    out: list[str] = []
    run: list[str] = []

    def cells(row: str) -> list[str]:
        row = re.sub(r"\|\s*$", "", re.sub(r"^\|", "", row.strip()))
        return [re.sub(r"`{3,}[A-Za-z0-9]*\s*([^`]*?)\s*`{3,}", lambda m: f"`{m[1].strip()}`", c.strip()) for c in re.split(r"(?<!\\)\|", row)]

    def flush():
        at = next((i for i, r in enumerate(run) if re.search("-{2,}", r) and re.fullmatch(r"[\s|:-]+", r.strip())), None)
        if at is None:
            out.extend(run)
        else:
            rows = [cells(r) for r in run]
            width = max([1, *(len(r) for i, r in enumerate(rows) if i != at)])
            for i, r in enumerate(rows):
                if i == at:
                    r = ["---"] * width
                elif i > at and not any(r):
                    continue
                out.append("| " + " | ".join(r + [""] * (width - len(r))) + " |")
        run.clear()

    for line, inside, _, _ in _fenced((markdown or "").split("\n")):
        if not inside and re.match(r"\s*\|", line):
            run.append(line)
            continue
        if run:
            flush()
        out.append(line)
    if run:
        flush()
    return "\n".join(out)


#: Actions that pages offer beside their text.
TOOLBAR = (
    r"(?:edit (?:this )?page|edit (?:on|in) github|edit source|copy (?:page|markdown)(?: as markdown)?|copy as markdown"
    r"|view source|view (?:page )?source|open in [^\]\n]{0,30}|report (?:an? )?(?:issue|problem|bug)|give feedback"
    r"|send feedback|provide feedback|was this (?:page )?helpful[^\n]*)"
)
_DROPPED = re.compile(rf"(?i:[ \t]*{TOOLBAR}[ \t]*)|[ \t]*\]\([^)]*\)\[?[ \t]*|#{{1,6}}[ \t]*|\s*[\[\]!]\s*")


def cleanup_lines(markdown: str | None) -> str:
    """Without toolbar lines, stray brackets, empty headings and runs of blanks; fenced lines stay."""
    out: list[str] = []
    for line, inside, _, _ in _fenced((markdown or "").split("\n")):
        if not inside:
            line = re.sub(r"(\S)[ \t]{2,}", r"\1 ", line)
            line = re.sub(r"\]\(([^)]*)\)\[", r"](\1) [", line).rstrip(" \t")
            if line and _DROPPED.fullmatch(line):
                continue
            if not line.strip() and out and out[-1] == "":
                continue
            line = line if line.strip() else ""
        out.append(line)
    return "\n".join(out).strip()


def _blocks_of(text: pd.Series) -> pd.Series:
    return text.map(split_blocks, na_action=None)


@arrow("array<string>")
def _split_blocks(text: pd.Series) -> pd.Series:
    return _blocks_of(text)


@arrow("array<struct<heading:string,text:string>>")
def _sections(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [{"heading": h, "text": x} for h, x in sections(t)], na_action=None)


@arrow("array<struct<heading:string,text:string>>")
def _page_sections(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [{"heading": h, "text": x} for h, x in sections(t, 100, True)], na_action=None)


@arrow("array<struct<level:int,text:string>>")
def _headings(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [{"level": n, "text": x} for n, x in headings(t)], na_action=None)


@arrow("array<array<string>>")
def _paths(blocks: pd.Series) -> pd.Series:
    return blocks.map(lambda b: section_paths(list(b) if b is not None else []), na_action=None)


def blocks(markdown: Column) -> Column:
    return _split_blocks(markdown)


def doc_sections(markdown: Column) -> Column:
    """Sections for retrieval: none is empty, headings up to 120 characters."""
    return _sections(markdown)


def page_sections(markdown: Column) -> Column:
    """Sections for scoping: an empty intro stays, headings up to 100 characters."""
    return _page_sections(markdown)


def outline(markdown: Column) -> Column:
    return _headings(markdown)


def paths(block_texts: Column) -> Column:
    return _paths(block_texts)


# --- values that a text claims -----------------------------------------------------------------------------------

#: What a value looks like, in the order in which texts are gone through.
_STAGES = [
    ("code", re.compile(r"`([^`\n]+)`"), lambda b: len(b.strip()) >= 2 and len(b) <= 120),
    ("url", re.compile(r"(https?://[^\s<>\"'`)\]]+)"), None),
    ("string", re.compile(r"'([^'\n]{2,80})'"), lambda b: len(b.split()) <= 4),
    ("string", re.compile(r'"([^"\n]{2,80})"'), lambda b: len(b.split()) <= 4),
]
_CODE = re.compile(r"```[^\n]*\n(.*?)```", re.S)
_NUMBER = re.compile(r"[€$£]\s?[0-9][0-9.,]*|[0-9][0-9.,]*\s?%|\b[0-9]+(?:[.,][0-9]+)+\b|\b[0-9]{2,}\b")
_NUMERIC = re.compile(r"[€$£]?\s?[0-9][0-9.,]*\s?%?")


def folded(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def atoms(markdown: str | None) -> list[tuple[str, str]]:
    """(value, kind) of what can be checked: lines of code, code spans, URLs, quoted words, numbers.

    Each stage takes its matches out of the text before the next one reads it; equal values count once.
    """
    text, found = markdown or "", []
    for m in _CODE.finditer(text):
        for line in m[1].split("\n"):
            if len(line.strip()) >= 10 and re.search("[A-Za-z0-9]", line):
                found.append((line.strip(), "code-line"))
    text = _CODE.sub(" ", text)
    for kind, pattern, fits in _STAGES:
        for m in pattern.finditer(text):
            value = re.sub(r"[.,;:!?]+$", "", m[1]) if kind == "url" else m[1]
            if fits is None or fits(m[1]):
                found.append((value.strip(), kind))
        text = pattern.sub(" ", text)
    text = re.sub(r"(?m)^[ \t]*(?:[-*+]|[0-9]+[.)])[ \t]", " ", text)
    text = re.sub(r"(?m)^[ \t]*\|[\s:|-]*\|?[ \t]*$", " ", text)
    found += [(m[0].strip(), "number") for m in _NUMBER.finditer(text)]
    out: dict[str, tuple[str, str]] = {}
    for value, kind in found:
        if folded(value):
            out.setdefault(folded(value), (value, kind))
    return list(out.values())


@arrow("array<struct<value:string,kind:string>>")
def _atoms(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [{"value": v, "kind": k} for v, k in atoms(t)], na_action=None)


def atom_list(markdown: Column) -> Column:
    return _atoms(markdown)


#: What Markdown sets a backslash before.
_ESCAPED = r"\\([\\`*_{}\[\]()#+\-.!|<>~])"


def checked(df: DataFrame, markdown: Column, sources: Column, allow: Column) -> DataFrame:
    """df with _total and _unverified: how many values a text claims, and those, in order, that neither its sources nor
    the allowed text hold. Only finding the values needs Python; each is looked up in one folded text of its row."""
    hay = normalised(F.array_join(F.coalesce(sources, F.array().cast("array<string>")), "\n"))
    d = df.withColumn("_atoms", F.coalesce(atom_list(F.coalesce(markdown, F.lit(""))), F.array().cast("array<struct<value:string,kind:string>>")))
    d = d.withColumn("_hay", hay).withColumn("_allowed", normalised(allow)).withColumn("_plain", F.regexp_replace("_hay", "[^0-9a-z]", ""))

    def known(atom: Column) -> Column:
        value = normalised(atom["value"])
        digits = F.regexp_replace(value, "[^0-9]", "")
        numeric = ((atom["kind"] == "number") | value.rlike(rf"^(?:{_NUMERIC.pattern})$")) & (digits != "")
        holds = lambda form: F.contains(F.col("_hay"), form) | F.contains(F.col("_allowed"), form)
        return holds(value) | holds(F.regexp_replace(value, _ESCAPED, "$1")) | (numeric & (holds(digits) | F.contains(F.col("_plain"), digits)))

    missing = F.transform(F.filter("_atoms", lambda a: ~known(a)), lambda a: a["value"])
    return d.select(*df.columns, F.size("_atoms").alias("_total"), missing.alias("_unverified"))
