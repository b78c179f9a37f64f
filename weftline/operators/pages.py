"""Pages between fetch and file: error pages, enriched blocks, caches, files that hold a page, new hidden text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.markdown import blocks as blocks_of
from ..functions.markdown import paths
from ..functions.text import classify_block, content_word_len, normalised

ERROR_FLOOR = 200


def without_error_pages(pages: DataFrame, floor: int = ERROR_FLOOR) -> DataFrame:
    """pages (status, markdown) with ``kept``: an error status with little text loses its body, though not its links."""
    thin = content_word_len(F.col("markdown")) < floor
    error = (F.coalesce("status", F.lit(0)) >= 400) & thin
    return pages.withColumn("kept", ~error).withColumn("markdown", F.when(error, "").otherwise(F.col("markdown")))


def enriched_blocks(pages: DataFrame, page: str = "page_id", markdown: str = "markdown") -> DataFrame:
    """(page_id, ord, text, type, has_image, section_path) of every block of each page."""
    b = pages.select(F.col(page).alias("page_id"), blocks_of(F.col(markdown)).alias("blocks"))
    b = b.select("page_id", "blocks", paths(F.col("blocks")).alias("paths"))
    each = b.select("page_id", F.posexplode(F.arrays_zip("blocks", "paths")).alias("ord", "b"))
    kind = classify_block(F.col("b.blocks"))
    return each.select("page_id", "ord", F.col("b.blocks").alias("text"), kind["type"].alias("type"), kind["has_image"].alias("has_image"), F.col("b.paths").alias("section_path"))


def scoped_blocks(blocks: DataFrame, kept: DataFrame) -> DataFrame:
    """Blocks (page_id, text) whose text, case and layout aside, is in what scoping kept (page_id, markdown)."""
    k = kept.select("page_id", F.explode(blocks_of(F.col("markdown"))).alias("t")).select("page_id", normalised(F.col("t")).alias("_k")).distinct()
    b = blocks.withColumn("_k", normalised(F.col("text")))
    return b.join(k, ["page_id", "_k"], "left_semi").drop("_k")


def with_cache(rows: DataFrame, cache: DataFrame, *keys: str, value: str = "verdict") -> DataFrame:
    """rows with the cached verdict of their key, null where unknown; labels under two characters are never cached."""
    c = cache.select(*keys, F.col(value).alias("_v")).dropDuplicates(list(keys))
    out = rows.join(c, list(keys), "left")
    known = F.length("label") >= 2 if "label" in keys else F.lit(True)
    return out.withColumn("cached", F.when(known, F.col("_v"))).drop("_v")


def first_files(files: DataFrame, pages: DataFrame) -> DataFrame:
    """pages (url) with ``file``, the first file (filename, pos, pages) that holds each."""
    held = files.select("filename", "pos", F.explode("pages").alias("url")).groupBy("url").agg(F.min_by("filename", "pos").alias("file"))
    return pages.join(held, "url", "left")


def candidate_routes(routes: DataFrame, links: DataFrame) -> DataFrame:
    """Mined routes (page_id, href) that are no real link of their page."""
    return routes.join(links.select("page_id", "href").distinct(), ["page_id", "href"], "left_anti")


def same_targets(a: Column, b: Column) -> Column:
    """Equal sets of URLs; an empty one equals none."""
    s = lambda c: F.array_sort(F.array_distinct(F.filter(c, lambda x: x.isNotNull())))
    return (F.size(a) > 0) & (F.size(b) > 0) & (s(a) == s(b))
