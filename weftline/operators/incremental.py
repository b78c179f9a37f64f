"""What of an earlier run can be used again, and how two runs differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _given(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")), F.lit("")) != ""


def is_static_safe(states: Column, residual: Column) -> Column:
    """One state and nothing left hidden: then a 304 says that the page is unchanged."""
    return (F.coalesce(states, F.lit(0)) <= 1) & (F.coalesce(residual, F.lit(0)) == 0)


def plan(baseline: DataFrame, lastmods: DataFrame) -> DataFrame:
    """baseline (url, lastmod, ...) with ``action``: reuse where stored and current lastmod are given and equal,
    check where a 304 could clear the page, recrawl otherwise. lastmods: url, current."""
    b = baseline.filter(_given(F.col("url"))).join(lastmods.select("url", "current"), "url", "left")
    same = _given(F.col("lastmod")) & _given(F.col("current")) & (F.col("lastmod") == F.col("current"))
    checkable = is_static_safe(F.col("states"), F.col("residual")) & (_given(F.col("http_etag")) | _given(F.col("http_last_modified")))
    return b.withColumn("action", F.when(same, "reuse").when(checkable, "check").otherwise("recrawl")).drop("current")


def conditional(planned: DataFrame, responses: DataFrame) -> DataFrame:
    """planned with 304 answers taken in: such pages are reused, with validators as the answer renews them.
    responses: url, status, etag, last_modified."""
    r = responses.select("url", "status", F.col("etag").alias("_e"), F.col("last_modified").alias("_m"))
    out = planned.join(r, "url", "left")
    cleared = (F.col("action") == "check") & (F.coalesce("status", F.lit(0)) == 304)
    renewed = lambda new, old: F.when(cleared & _given(F.col(new)), F.col(new)).otherwise(F.col(old))
    return (
        out.withColumn("http_etag", renewed("_e", "http_etag"))
        .withColumn("http_last_modified", renewed("_m", "http_last_modified"))
        .withColumn("via", F.when(F.col("action") == "reuse", "lastmod").when(cleared, "304"))
        .withColumn("action", F.when(cleared, "reuse").when(F.col("action") == "check", "recrawl").otherwise(F.col("action")))
        .drop("status", "_e", "_m")
    )


def unchanged(pages: DataFrame, baseline: DataFrame) -> DataFrame:
    """Pages crawled again whose content hash is their baseline's."""
    return pages.join(baseline.select("url", F.col("content_hash").alias("hash")), ["url", "hash"], "left_semi")


def report(planned: DataFrame, same: DataFrame) -> DataFrame:
    """One row: reused, via_lastmod, via_304, recrawled, unchanged_by_hash."""
    n = planned.agg(
        F.count_if(F.col("action") == "reuse").alias("reused"),
        F.count_if(F.col("via") == "lastmod").alias("via_lastmod"),
        F.count_if(F.col("via") == "304").alias("via_304"),
        F.count_if(F.col("action") == "recrawl").alias("recrawled"),
    )
    return n.crossJoin(same.agg(F.count("*").alias("unchanged_by_hash")))


def lastmod_map(entries: DataFrame) -> DataFrame:
    """(url, current) of entries (url, lastmod, pos): blanks dropped, of repeated URLs the last one."""
    e = entries.filter(F.col("url").isNotNull() & _given(F.col("lastmod")))
    return e.groupBy("url").agg(F.max_by("lastmod", "pos").alias("current"))


def run_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(url, change, bytes_before, bytes_after) of runs (url, bytes, pos); the last row of a URL counts."""

    def last(run, name):
        return run.groupBy("url").agg(F.max_by("bytes", "pos").alias(name))

    both = last(before, "bytes_before").join(last(after, "bytes_after"), "url", "full_outer")
    change = (
        F.when(F.col("bytes_before").isNull(), "added")
        .when(F.col("bytes_after").isNull(), "removed")
        .when(F.col("bytes_before") != F.col("bytes_after"), "changed")
        .otherwise("same")
    )
    return both.withColumn("change", change)


def run_totals(diff: DataFrame) -> DataFrame:
    """One row of a ``run_diff``: pages and bytes of both runs, their difference, and pages by change."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    n = lambda change: F.count_if(F.col("change") == change).alias(change)
    return diff.agg(
        F.count_if(F.col("change") != "added").alias("pages_before"),
        F.count_if(F.col("change") != "removed").alias("pages_after"),
        total("bytes_before").alias("bytes_before"),
        total("bytes_after").alias("bytes_after"),
        (total("bytes_after") - total("bytes_before")).alias("bytes_delta"),
        n("added"), n("removed"), n("changed"),
    )


def baseline_run(runs: DataFrame, targets: list[str]) -> DataFrame:
    """The newest run that is done, incremental, has a journal and the same set of targets. runs: run_id, created_at,
    status, incremental, has_journal, targets (canonical)."""
    want = F.array_sort(F.array_distinct(F.array(*[F.lit(t) for t in targets]))) if targets else None
    if want is None:
        return runs.limit(0)
    own = runs.filter((F.col("status") == "done") & F.col("incremental") & F.col("has_journal"))
    own = own.filter(F.array_sort(F.array_distinct("targets")) == want)
    return own.orderBy(F.desc("created_at"), F.desc("run_id")).limit(1)
