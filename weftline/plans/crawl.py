"""A crawl as rounds: each fetches the newest addresses, keeps a journal, and finds the next ones."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import guards, html, url
from ..functions.options import Options
from ..scratch import materialise
from ..sources import runs
from ..sources.catalog import append_journal, run_path
from . import site

#: What a fetch gives for each address it was asked for.
FETCHED = "url string, status int, mitigated string, html string, fetched_at string"
Fetch = Callable[[DataFrame], DataFrame]


class Stop:
    """Set from another thread, it ends a crawl after the round that runs."""

    def __init__(self):
        self._event = threading.Event()

    def stop(self) -> None:
        self._event.set()

    def __bool__(self) -> bool:
        return self._event.is_set()


def _tried(fetch: Fetch, asked: DataFrame) -> DataFrame:
    """What a fetch gives, where it failed once more asked for: kept at the first try or the second, else an error."""
    failed = (F.coalesce("status", F.lit(0)) == 0) | (F.col("status") >= 500) | guards.challenge_signal(
        F.col("status"), F.col("mitigated"), F.col("html"), F.length(F.coalesce("html", F.lit("")))
    ).isNotNull()
    first = materialise(fetch(asked).select(*[c.split()[0] for c in FETCHED.split(", ")]).withColumn("failed", failed), "fetched")
    lost = asked.join(first.filter("not failed").select("url"), "url", "left_anti")
    if lost.isEmpty():
        return first
    again = materialise(fetch(lost).select(*[c.split()[0] for c in FETCHED.split(", ")]).withColumn("failed", failed), "fetched")
    return first.filter("not failed").unionByName(again)


def crawl(
    spark: SparkSession, seeds: list[str], fetch: Fetch, base: str, options: Options, scan_id: str, generated_at: str,
    task: str | None = None, stop: Stop | None = None, journal: str | None = None, restored: DataFrame | None = None, max_rounds: int = 50,
) -> tuple[site.Result, str]:
    """(result, status) of a crawl from seeds; status is done or stopped.

    ``fetch`` takes a table of addresses (url) and gives ``FETCHED``. Addresses are canonical, in scope, and asked for
    once; a failed one is asked for a second time. If the seeds give no page, the site's root is tried once. Each round's
    pages go to the journal, from which ``restored`` takes a stopped crawl up: its pages aren't fetched again, but their
    links are followed.
    """

    def known(df: DataFrame) -> DataFrame:
        """Distinct canonical addresses in scope."""
        u = df.select(url.normalize_url(F.col("url"), F.lit(base)).alias("url"))
        return u.filter(F.col("url").isNotNull() & url.in_scope(F.col("url"), F.lit(base), options.include, options.exclude)).distinct()

    queue = spark.createDataFrame([(u,) for u in seeds], "url string")
    done = spark.createDataFrame([], "url string")
    if restored is not None:
        done = materialise(known(restored.select("page.url")), "restored")
        queue = queue.unionByName(restored.select(F.explode("links").alias("url")))
    newest, fetched, n, rooted, status = materialise(known(queue).join(done, "url", "left_anti"), "queue"), None, done.count(), False, "done"
    seen = done.unionByName(newest)
    for k in range(max_rounds):
        if newest.isEmpty():
            break
        if stop:
            status = "stopped"
            break
        if options.max_pages is not None:
            newest = newest.orderBy("url").limit(max(0, options.max_pages - n))
            if newest.isEmpty():
                break
        got = _tried(fetch, newest).withColumn("round", F.lit(k))
        own = materialise(got.withColumn("hrefs", html.static_hrefs(F.col("html"))), "round")
        good = own.filter("not failed")
        count = good.count()
        n += count
        found = good.select("url", F.explode("hrefs").alias("href")).select(url.normalize_url(F.col("href"), F.col("url")).alias("url"))
        if journal:
            md = html.markdown_of(F.col("html"), F.col("url"))
            page = F.struct("url", F.lit(task).alias("task"), F.col("m.title").alias("title"), F.col("m.markdown").alias("markdown"), F.struct(F.col("fetched_at").alias("fetchedAt")).alias("meta"))
            append_journal(good.withColumn("m", md).select(page.alias("page"), F.col("hrefs").alias("links")), journal)
        fetched = own if fetched is None else fetched.unionByName(own)
        newest = materialise(known(found).join(seen, "url", "left_anti"), "queue")
        if newest.isEmpty() and not rooted and n == 0:  # nothing produced: the root, once
            rooted = True
            root = spark.createDataFrame([(str(url.parse("/", base)),)], "url string")
            newest = materialise(known(root).join(seen, "url", "left_anti"), "queue")
        seen = seen.unionByName(newest)
    if fetched is None:
        fetched = spark.createDataFrame([], f"{FETCHED}, failed boolean, round int, hrefs array<string>")
    pages = fetched.filter("not failed").select(
        F.lit(scan_id).alias("scan_id"), (F.lit(1_000_000_000).cast("long") * F.col("round") + F.row_number().over(W.partitionBy("round").orderBy("url"))).cast("long").alias("seq"),
        F.lit(task).cast("string").alias("task"), "url", "status", "mitigated", "html", "fetched_at",
    )
    old = None
    if restored is not None:  # restored pages come first
        old = restored.withColumn("scan_id", F.lit(scan_id)).withColumn("seq", F.monotonically_increasing_id() - F.lit(1 << 62))
        old = materialise(old, "journal")
    return site.run(pages, base, options, generated_at, old), status


def resume(spark: SparkSession, root: str, run_id: str, fetch: Fetch, generated_at: str, stop: Stop | None = None) -> list[tuple[str, site.Result, str]]:
    """(scan_id, result, status) of each target of a run that was stopped or has crashed."""
    run = runs.load_for_resume(spark, root, run_id)
    known = {f.name for f in Options.__dataclass_fields__.values()}
    options = Options.of(**{k: v for k, v in run.options.items() if k in known})
    out = []
    for i, (target, task) in enumerate(run.targets):
        sid = runs.scan_of(target, i)
        result, status = crawl(spark, [target], fetch, target, options, sid, generated_at, task, stop, run_path(root, run_id, sid, runs.JOURNAL), run.journals.get(sid))
        out.append((sid, result, status))
    return out

