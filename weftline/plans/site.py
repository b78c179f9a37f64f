"""A site's crawl as one plan: fetched pages and an earlier run in, kept pages, counts and files out."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import guards, html, text, url
from ..functions.options import Options
from ..operators import assemble, dedup, incremental, metrics, pages
from ..scratch import materialise


@dataclasses.dataclass
class Result:
    pages: DataFrame
    fates: DataFrame
    counts: DataFrame
    files: DataFrame
    documents: DataFrame | None
    links: DataFrame


def run(fetched: DataFrame, base: str, options: Options, generated_at: str, restored: DataFrame | None = None) -> Result:
    """fetched: scan_id, seq, task, url, status, mitigated, html, fetched_at. ``restored`` holds records of a run that was
    stopped (scan_id, seq, page, links): they come first, and only their exact twins are skipped.

    Scope, challenges and error pages go first, on native columns; then Markdown; then duplicates; then files.
    """
    f = fetched.withColumn("url", url.normalize_url(F.col("url"), F.lit(base))).filter(F.col("url").isNotNull())
    f = f.filter(url.in_scope(F.col("url"), F.lit(base), options.include, options.exclude))
    f = f.repartition(4 * fetched.sparkSession.sparkContext.defaultParallelism, "scan_id", "seq")  # few row groups hold many pages
    f = f.withColumn("x", html.markdown_of(F.col("html"), F.col("url")))
    f = f.withColumn("title", F.col("x.title")).withColumn("markdown", F.col("x.markdown")).drop("x")
    f = f.withColumn("signal", guards.challenge_signal(F.col("status"), F.col("mitigated"), F.col("html"), text.content_word_len(F.col("markdown"))))
    f = f.withColumn("hrefs", html.static_hrefs(F.col("html"))).drop("html")
    # pages are parsed once: what follows reads what was made of them. A filter before they are written would be pushed
    # below the parse and parse them again
    f = pages.without_error_pages(materialise(f, "extracted").filter("signal is null").drop("signal"))
    links = f.select("scan_id", F.col("seq").alias("page_id"), F.col("url").alias("src"), F.explode("hrefs").alias("href"))
    links = links.withColumn("dst", url.normalize_url(F.col("href"), F.col("src"))).filter(F.col("dst").isNotNull())
    body = f.filter("kept and trim(markdown) <> ''").select("scan_id", "seq", "task", "url", "title", "markdown", "fetched_at")
    if restored is not None:
        old, _ = dedup.replayed(restored)
        old = old.select("scan_id", "seq", "page.task", "page.url", "page.title", "page.markdown", F.col("page.meta.fetchedAt").alias("fetched_at"))
        body = old.unionByName(body)
    marked = materialise(dedup.fingerprinted(body), "marked")
    fates = materialise(dedup.tiers(marked, options.mirror_hamming, options.near_dup_hamming, options.max_pages), "fates")
    kept = marked.join(fates.filter("fate = 'keep'"), ["scan_id", "seq"], "left_semi")
    # a duplicate's links aren't followed
    links = links.join(kept.select("scan_id", F.col("seq").alias("page_id")), ["scan_id", "page_id"], "left_semi")
    return Result(
        kept,
        fates,
        dedup.drop_counts(fates),
        assemble.assemble_scan(kept, generated_at),
        assemble.assemble_documents(kept) if options.per_document else None,
        links,
    )


def refresh(baseline: DataFrame, sitemap: DataFrame, responses: DataFrame, crawled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plan, report) of an incremental run over a baseline's pages."""
    planned = incremental.conditional(incremental.plan(baseline, incremental.lastmod_map(sitemap)), responses)
    return planned, incremental.report(planned, incremental.unchanged(crawled, baseline))


def format_report(row: dict) -> str:
    """A report's values as aligned lines, rates in percent."""
    width = max((len(k) for k in row), default=0)
    show = lambda k, v: "-" if v is None else f"{100 * v:.1f} %" if isinstance(v, float) and k.endswith(("ratio", "recall", "precision", "f1", "share")) else f"{v}"
    return "\n".join(f"{k.ljust(width)}  {show(k, v)}" for k, v in row.items())


def evaluation(texts: DataFrame, spec: DataFrame, kept: DataFrame, sitemap: DataFrame) -> str:
    return format_report(metrics.evaluate(texts, spec, kept, sitemap).first().asDict())
