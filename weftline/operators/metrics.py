"""Counts and rates of runs: strategies, usage, coverage, respect for a task, residuals, streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import normalised


def rate(part: Column, whole: Column, empty: float | None = None) -> Column:
    return F.when(whole == 0, F.lit(empty).cast("double")).otherwise(F.round(F.try_divide(part, whole), 3))


def strategy_counts(pages: DataFrame, scan: str = "scan_id") -> DataFrame:
    """Pages by strategy, of each scan and of all (scan null)."""
    return pages.groupingSets([[scan, "strategy"], ["strategy"]], scan, "strategy").agg(F.count("*").alias("pages"))


USAGE = ("calls", "input_tokens", "output_tokens", "cached_input_tokens")


def usage_rollup(usage: DataFrame) -> DataFrame:
    """Usage of each (scan, kind), each kind, and in all."""
    sums = [F.sum(c).alias(c) for c in USAGE]
    return usage.groupingSets([["scan_id", "kind"], ["kind"], []], "scan_id", "kind").agg(*sums)


def token_breakdown(usage: DataFrame) -> DataFrame:
    """(kind, ..., total, share, rank): where tokens went, the most first."""
    k = usage.groupBy("kind").agg(*[F.sum(c).alias(c) for c in USAGE]).withColumn("total", F.col("input_tokens") + F.col("output_tokens"))
    grand = k.agg(F.sum("total").alias("_grand"))
    k = k.crossJoin(F.broadcast(grand)).withColumn("share", rate(F.col("total"), F.col("_grand"), 0.0)).drop("_grand")
    return k.withColumn("rank", F.row_number().over(W.orderBy(F.desc("total"), "kind")))


def cached_share(usage: DataFrame) -> DataFrame:
    return usage.agg(F.sum("input_tokens").alias("input_tokens"), F.sum("cached_input_tokens").alias("cached_input_tokens")).withColumn(
        "cached_share", rate(F.col("cached_input_tokens"), F.col("input_tokens"), 0.0)
    )


def residual_summary(pages: DataFrame) -> DataFrame:
    """One row: pages, with_residual, chars and words (six characters each) of hidden text that stayed hidden."""
    c = F.coalesce("residual", F.lit(0))
    chars = F.coalesce(F.sum(F.greatest(c, F.lit(0))), F.lit(0))
    return pages.agg(F.count("*").alias("pages"), F.count_if(c > 0).alias("with_residual"), chars.alias("chars"), F.round(chars / 6).cast("long").alias("words"))


def worst_residuals(pages: DataFrame, n: int = 5) -> DataFrame:
    return pages.filter("residual > 0").select("url", F.col("residual").alias("chars")).orderBy(F.desc("chars"), "url").limit(n)


#: Snippets whose anchors are sent as a literal set.
MAX_ANCHORS = 5000


def containment(texts: DataFrame, snippets: DataFrame) -> DataFrame:
    """snippets (id, snippet) with ``found``: whether any text holds it, case and white space aside.

    A text that holds a snippet of three words or more has each word between its first and last as a word of its own:
    the longest of these is the snippet's anchor, and texts meet snippets by equi-join on anchors before they are
    compared. Shorter snippets, and all where there are more than ``MAX_ANCHORS`` of them, are compared with every text;
    they are the small side, and broadcast only as far as Spark's own size limit lets them.
    """
    s = snippets.filter(F.trim("snippet") != "").withColumn("_s", normalised(F.col("snippet")))
    t = texts.select(normalised(F.col("text")).alias("_t"))
    parts = F.split("_s", " ")
    inner = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))
    anchor = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    sides = s.select("id", "_s", anchor.alias("_a"))
    anchors = [r[0] for r in sides.filter("_a is not null").select("_a").distinct().limit(MAX_ANCHORS + 1).collect()]
    few = len(anchors) <= MAX_ANCHORS
    if anchors and few:
        own = t.withColumn("_a", F.explode(F.array_intersect(F.split("_t", " "), F.array(*[F.lit(a) for a in anchors]))))
        met = own.join(sides, "_a").filter(F.contains(F.col("_t"), F.col("_s"))).select("id")
        rest = sides.filter("_a is null")
    else:
        met, rest = None, sides
    if met is None or not rest.isEmpty():
        other = t.join(rest.select("id", "_s"), F.contains(F.col("_t"), F.col("_s"))).select("id")
        met = other if met is None else met.unionByName(other)
    held = met.distinct().withColumn("found", F.lit(True))
    return s.drop("_s").join(held, "id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def coverage(found: DataFrame) -> DataFrame:
    """One row: total, found, ratio; all is covered where nothing was expected."""
    n, k = F.count("*"), F.count_if(F.col("found"))
    return found.agg(n.alias("total"), k.alias("found"), rate(k, n, 1.0).alias("ratio"))


def task_respect(include: DataFrame, exclude: DataFrame) -> DataFrame:
    """One row: recall of what must be there, precision as what must not be there is absent, and their F1."""
    i = include.agg(F.count("*").alias("include_total"), F.count_if("found").alias("include_found"))
    e = exclude.agg(F.count("*").alias("exclude_total"), F.count_if("found").alias("leaked"))
    both = i.crossJoin(e)
    both = both.withColumn("recall", rate(F.col("include_found"), F.col("include_total")))
    both = both.withColumn("precision", rate(F.col("exclude_total") - F.col("leaked"), F.col("exclude_total")))
    r, p = F.col("recall"), F.col("precision")
    return both.withColumn("f1", F.when(r + p > 0, F.round(2 * r * p / (r + p), 3)))


def sitemap_coverage(kept: DataFrame, sitemap: DataFrame) -> DataFrame:
    """(url, status): covered or missing for each URL of the sitemap, extra for pages it doesn't list."""
    k, s = kept.select("url").distinct(), sitemap.select("url").distinct()
    return (
        s.join(k, "url", "left_semi").withColumn("status", F.lit("covered"))
        .unionByName(s.join(k, "url", "left_anti").withColumn("status", F.lit("missing")))
        .unionByName(k.join(s, "url", "left_anti").withColumn("status", F.lit("extra")))
    )


def truthful_residual(pages: DataFrame, least: int = 60) -> DataFrame:
    """pages (hidden_chars, hidden array<struct<n,s>>, markdown) with ``residual``: hidden samples of some length that
    the captured text holds aren't counted as lost."""
    text = normalised(F.col("markdown"))
    known = F.aggregate(
        F.coalesce("hidden", F.array().cast("array<struct<n:int,s:string>>")),
        F.lit(0),
        lambda a, h: a + F.when((F.length(normalised(h["s"])) >= least) & F.contains(text, normalised(h["s"])), h["n"]).otherwise(0),
    )
    return pages.withColumn("residual", F.greatest(F.lit(0), F.coalesce("hidden_chars", F.lit(0)) - known))


def reveal_priority(kind: Column, hidden_payload: Column, expanded: Column) -> Column:
    """Controls that hide most come first; open ones last."""
    rank = F.when(kind == "tab", 3).when(kind.isin("expander", "accordion"), 2).when(kind.isin("dropdown", "loadmore"), 1).otherwise(0)
    return F.when(expanded == "true", -1000).otherwise(rank * 100) + F.least(F.coalesce(hidden_payload, F.lit(0)), F.lit(5000)) / 50


def inert_streaks(log: DataFrame, inert: int = 4, recheck: int = 5) -> DataFrame:
    """log (key, page_no, productive) with ``streak``, the length of the run of inert pages before each, and ``tried``:
    after four inert pages only every fifth page is tried until one is productive again (gaps and islands)."""
    w = W.partitionBy("key").orderBy("page_no")
    x = log.withColumn("_p", F.col("productive").cast("int"))
    x = x.withColumn("_island", F.coalesce(F.sum("_p").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    x = x.withColumn("streak", F.row_number().over(W.partitionBy("key", "_island").orderBy("page_no")) - 1)
    ordinal = F.row_number().over(w)
    return x.withColumn("tried", (F.col("streak") < inert) | (ordinal % recheck == 0)).drop("_p", "_island")


def progress(events: DataFrame) -> DataFrame:
    """events (scan_id, seq, type) with running counts of queued and done pages."""
    w = W.partitionBy("scan_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    n = lambda t: F.sum(F.when(F.col("type") == t, 1).otherwise(0)).over(w)
    return events.withColumn("done", n("page")).withColumn("total", n("queued"))


TRACE_TYPES = ("page", "reveal", "dedup", "warn", "error", "resume", "done")


def trace(events: DataFrame) -> DataFrame:
    """Events worth a line in the activity trace."""
    return events.filter(F.col("type").isin(*TRACE_TYPES))


def evaluate(texts: DataFrame, spec: DataFrame, kept: DataFrame, sitemap: DataFrame) -> DataFrame:
    """One row for a golden spec (kind, id, snippet) of kinds reveal, include, exclude: coverage, respect, sitemap."""
    found = {k: containment(texts, spec.filter(F.col("kind") == k)) for k in ("reveal", "include", "exclude")}
    cov = coverage(found["reveal"]).select(F.col("ratio").alias("reveal_ratio"))
    sm = sitemap_coverage(kept, sitemap).agg(
        F.count_if(F.col("status") == "covered").alias("covered"), F.count_if(F.col("status") == "missing").alias("missing")
    )
    sm = sm.withColumn("sitemap_ratio", rate(F.col("covered"), F.col("covered") + F.col("missing"), 1.0))
    return cov.crossJoin(task_respect(found["include"], found["exclude"])).crossJoin(sm)
