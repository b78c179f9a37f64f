"""Registers the functions for SQL: expressions as Arrow functions, and table functions for blocks, sections, links, atoms."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from .functions import html, markdown, relevance, simhash, url


def _series(f):
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action=None)

    return run


SCALARS = {
    "normalize_url": (url.canonical, "string"),
    "simhash": (simhash.fingerprint, "long"),
    "task_tokens": (relevance.tokenize, "array<string>"),
    "repair_tables": (markdown.repair_tables, "string"),
    "cleanup_lines": (markdown.cleanup_lines, "string"),
    "html_markdown": (lambda p: html.extract_markdown(p)[1], "string"),
}


class SplitBlocks:
    def eval(self, text: str) -> Iterator[Row]:
        yield from ((i, b) for i, b in enumerate(markdown.split_blocks(text)))


class SplitSections:
    def eval(self, text: str) -> Iterator[Row]:
        yield from ((i, h, t) for i, (h, t) in enumerate(markdown.sections(text)))


class ExtractLinks:
    def eval(self, page: str, base: str) -> Iterator[Row]:
        yield from ((i, h, x) for i, (h, x) in enumerate(html.page_links(page, base)))


class ExtractAtoms:
    def eval(self, text: str) -> Iterator[Row]:
        yield from ((i, v, k) for i, (v, k) in enumerate(markdown.atoms(text)))


TABLES = {
    "split_blocks": (SplitBlocks, "ord int, text string"),
    "split_sections": (SplitSections, "ord int, heading string, text string"),
    "extract_links": (ExtractLinks, "ord int, href string, label string"),
    "extract_atoms": (ExtractAtoms, "ord int, value string, kind string"),
}


def register(spark: SparkSession) -> None:
    """All functions, by name, for this session's SQL."""
    for name, (f, kind) in SCALARS.items():
        spark.udf.register(name, F.pandas_udf(_series(f), kind))
    for name, (handler, schema) in TABLES.items():
        spark.udtf.register(name, F.udtf(handler, returnType=schema, useArrow=True))
