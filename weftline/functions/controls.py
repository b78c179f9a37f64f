"""What a page's markup hides, and the controls that would show it, as far as they can be told without a browser."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column

from .html import Node, _main, tree
from .udfs import arrow

MOST_CONTROLS, MOST_SAMPLES = 150, 80
#: A hidden block counts from so many characters on; so many of them are its sample. Labels are cut likewise.
LEAST_HIDDEN, SAMPLE, LABEL = 41, 140, 80

_HIDES = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
_MORE = re.compile(r"\b(?:load|show|view|see|read|expand)\s+(?:more|all)\b", re.I)
_NEVER = frozenset("template script style noscript".split())


def _is_hidden(n: Node) -> bool:
    closed = n.parent is not None and n.parent.tag == "details" and "open" not in n.parent.attrs and n.tag != "summary"
    return closed or "hidden" in n.attrs or bool(_HIDES.search(n.get("style")))


def hidden_blocks(page: str | None) -> tuple[int, list[tuple[int, str]]]:
    """Characters that a page's main content hides, and a sample (characters, beginning) of each outermost hidden block."""
    total, out = 0, []
    stack = [c for c in reversed(_main(tree(page), None).children) if isinstance(c, Node)]
    while stack:
        n = stack.pop()
        if n.tag in _NEVER or n.get("aria-hidden") == "true":
            continue
        if not _is_hidden(n):
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]
        elif len(text := n.text()) >= LEAST_HIDDEN:
            total += len(text)
            if len(out) < MOST_SAMPLES:
                out.append((len(text), text[:SAMPLE]))
    return total, out


def _kind(n: Node, label: str) -> str | None:
    role = n.get("role").lower()
    if role == "tab":
        return "tab"
    if n.tag == "summary" or "accordion" in n.get("class").lower():
        return "accordion"
    if n.tag == "select" or role in ("combobox", "listbox") or n.get("aria-haspopup") not in ("", "false"):
        return "dropdown"
    if n.tag in ("button", "a") or role == "button":
        if _MORE.search(label):
            return "loadmore"
        if "aria-expanded" in n.attrs or "aria-controls" in n.attrs:
            return "expander"
    return None


def page_controls(page: str | None) -> list[dict]:
    """(kind, label, signature, expanded, hidden_payload) of what would show more, in document order."""
    root = tree(page)
    named = {n.get("id"): n for n in root.walk() if n.get("id")}
    out = []
    for n in root.walk():
        label = (n.get("aria-label") or n.text())[:LABEL]
        kind = _kind(n, label)
        if kind is None:
            continue
        if n.tag == "summary" and n.parent is not None:
            shown = "open" in n.parent.attrs
            payload = 0 if shown else len(n.parent.text()) - len(n.text())
        else:
            shown = n.get("aria-expanded") == "true" or n.get("aria-selected") == "true"
            target = named.get(n.get("aria-controls"))
            payload = len(target.text()) if target is not None and _is_hidden(target) else 0
        signature = f"{kind}|{re.sub('[0-9]+', '#', label.lower())}"
        out.append({"kind": kind, "label": label, "signature": signature, "expanded": "true" if shown else "false", "hidden_payload": max(0, payload)})
        if len(out) >= MOST_CONTROLS:
            break
    return out


@arrow("array<struct<kind:string,label:string,signature:string,expanded:string,hidden_payload:int>>")
def _controls(page: pd.Series) -> pd.Series:
    return page.map(page_controls, na_action=None)


@arrow("struct<hidden_chars:int,hidden:array<struct<n:int,s:string>>>")
def _hidden(page: pd.Series) -> pd.DataFrame:
    rows = [hidden_blocks(p) for p in page]
    return pd.DataFrame({"hidden_chars": [n for n, _ in rows], "hidden": [[{"n": k, "s": s} for k, s in own] for _, own in rows]})


def controls_of(page: Column) -> Column:
    return _controls(page)


def hidden_of(page: Column) -> Column:
    """(hidden_chars, hidden): what ``truthful_residual`` takes."""
    return _hidden(page)
