"""Links and routes: what to follow, in which order, and the frontier that follows it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.relevance import link_score, link_tokens, task_terms
from ..functions.url import in_scope, normalize_url
from ..scratch import scratch_path

#: How many are judged (or embedded) at once.
LINK_BATCH, CONTROL_BATCH, TEXT_BATCH = 160, 100, 64
BATCHES = {"links": LINK_BATCH, "controls": CONTROL_BATCH, "texts": TEXT_BATCH}


def in_scope_unique(urls: DataFrame, base: str, include: str | None = None, exclude: str | None = None, url: str = "url") -> DataFrame:
    """Distinct canonical URLs in scope."""
    u = urls.select(normalize_url(F.col(url), F.lit(base)).alias(url)).filter(F.col(url).isNotNull())
    return u.filter(in_scope(F.col(url), F.lit(base), include, exclude)).distinct()


def all_links(*sources: DataFrame) -> DataFrame:
    """Candidates (page_id, href, label, context) of several sources, the first source that has a link wins."""
    each = [s.select("page_id", "href", "label", "context", F.lit(i).alias("source")) for i, s in enumerate(sources)]
    out = each[0]
    for s in each[1:]:
        out = out.unionByName(s)
    best = F.min_by(F.struct("label", "context", "source"), F.col("source"))
    return out.groupBy("page_id", "href").agg(best.alias("b")).select("page_id", "href", "b.label", "b.context", "b.source")


def scored(links: DataFrame, task: str, semantic: DataFrame | None = None) -> DataFrame:
    """links (page_id, pos, href, label, context) with score. Distinct links are scored once; semantic (href, score)
    takes precedence."""
    terms = task_terms(task)
    own = links.select("href", "label", "context").distinct()
    own = own.withColumn("score", link_score(terms, link_tokens(F.col("href"), F.col("label"), F.col("context"))))
    same = [links[c].eqNullSafe(own[c]) for c in ("href", "label", "context")]
    out = links.join(own, same[0] & same[1] & same[2], "left").select(links["*"], own["score"])
    if semantic is not None and terms:
        s = semantic.select(F.col("href").alias("_h"), F.col("score").alias("_s"))
        out = out.join(s, F.col("href") == F.col("_h"), "left").withColumn("score", F.coalesce("_s", "score")).drop("_h", "_s")
    return out


def pruned(links: DataFrame, least: float, has_terms: bool = True) -> DataFrame:
    """links with ``kept``: below the threshold a link goes, but only if its page has one that reaches it."""
    if not has_terms or least <= 0:
        return links.withColumn("kept", F.lit(True))
    best = F.max("score").over(W.partitionBy("page_id"))
    return links.withColumn("kept", (best < least) | (F.col("score") >= least))


def ranked(links: DataFrame, batch: int = LINK_BATCH) -> DataFrame:
    """links with rank (best score first, then position) and the batch it falls into."""
    w = W.partitionBy("page_id").orderBy(F.desc("score"), "pos")
    return links.withColumn("rank", F.row_number().over(w)).withColumn("batch", F.floor((F.col("rank") - 1) / batch))


def in_batches(rows: DataFrame, kind: str, by: str, *order: str) -> DataFrame:
    """rows with the batch they are judged in and their index there: links, controls or texts of each ``by`` in order."""
    n = F.row_number().over(W.partitionBy(by).orderBy(*order)) - 1
    size = BATCHES[kind]
    return rows.withColumn("_n", n).withColumn("batch", F.floor(F.col("_n") / size).cast("int")).withColumn("index", (F.col("_n") % size).cast("int")).drop("_n")


def verdicts_applied(links: DataFrame, verdicts: DataFrame) -> DataFrame:
    """links (page_id, batch, index) with ``follow``. verdicts: page_id, batch, keep (array of indexes, null if the
    reply could not be read). An empty list is a verdict; an unreadable one, or one all out of range, lets all through."""
    n = links.groupBy("page_id", "batch").agg((F.max("index") + 1).alias("n"))
    v = verdicts.join(n, ["page_id", "batch"], "right")
    valid = F.filter("keep", lambda i: (i >= 0) & (i < F.col("n")))
    every = F.col("keep").isNull() | ((F.size("keep") > 0) & (F.size(valid) == 0))
    v = v.select("page_id", "batch", valid.alias("valid"), every.alias("every"))
    return links.join(v, ["page_id", "batch"], "left").withColumn(
        "follow", F.col("every") | F.array_contains("valid", F.col("index"))
    ).drop("valid", "every")


def sections_kept(sections: DataFrame, verdicts: DataFrame, floor: int = 1200) -> DataFrame:
    """sections (page_id, index, text) that a verdict (page_id, keep) names; pages that are short, have one section, or
    whose verdict is empty or unreadable stay whole."""
    per = sections.groupBy("page_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("size"))
    v = per.join(verdicts, "page_id", "left")
    valid = F.filter("keep", lambda i: (i >= 0) & (i < F.col("n")))
    whole = (F.col("size") < floor) | (F.col("n") <= 1) | F.col("keep").isNull() | (F.size(valid) == 0)
    v = v.select("page_id", whole.alias("_whole"), valid.alias("_valid"))
    kept = F.col("_whole") | F.array_contains("_valid", F.col("index"))
    return sections.join(v, "page_id").filter(kept).drop("_whole", "_valid")


def budget_routes(routes: DataFrame, most: int) -> DataFrame:
    """routes (page_id, pos, score) within the budget: the best, but only where scores differ; else the first."""
    w, page = W.partitionBy("page_id").orderBy(F.desc("_key"), "pos"), W.partitionBy("page_id")
    varied = F.min("score").over(page) < F.max("score").over(page)
    r = routes.withColumn("_key", F.when(varied, F.col("score")).otherwise(0.0))
    return r.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= most).drop("_key", "_rank")


def decide_follow(candidates: DataFrame, cache: DataFrame, task: str, gate: bool, verdicts: DataFrame | None = None, least: float = 0.0) -> DataFrame:
    """(page_id, href, follow, score, rank): cached verdicts first, then pruning, then the gate's verdicts by batch."""
    c = scored(candidates, task)
    c = c.join(cache.select("page_id", "href", F.col("follow").alias("cached")), ["page_id", "href"], "left")
    known = c.filter("cached is not null").select("page_id", "href", F.col("cached").alias("follow"), "score", "pos")
    fresh = pruned(c.filter("cached is null"), least, bool(task_terms(task)))
    gone = fresh.filter("not kept").select("page_id", "href", F.lit(False).alias("follow"), "score", "pos")
    rest = fresh.filter("kept")
    if gate and verdicts is not None:
        r = ranked(rest).withColumn("index", (F.col("rank") - 1) % LINK_BATCH)
        rest = verdicts_applied(r, verdicts)
    else:
        rest = rest.withColumn("follow", F.lit(True))
    out = known.unionByName(gone).unionByName(rest.select("page_id", "href", "follow", "score", "pos"))
    w = W.partitionBy("page_id").orderBy(F.desc("score"), "pos")
    return out.withColumn("rank", F.row_number().over(w)).drop("pos")


def crawl_order(edges: DataFrame, seeds: DataFrame, max_depth: int = 20, expandable: DataFrame | None = None) -> DataFrame:
    """(url, depth): pages reached from the seeds over edges (src, dst), each at its least depth.

    Every round joins only the newest pages with the edges and drops those seen before; rounds are written tables in
    the shared folder. Pages not in ``expandable`` (duplicates) are reached, but their links aren't followed.
    """
    spark = edges.sparkSession
    root = scratch_path(spark, "frontier")

    def written(df: DataFrame, k: int) -> DataFrame:
        df.write.parquet(f"{root}/depth={k}")
        return spark.read.schema("url string").parquet(f"{root}/depth={k}")

    newest, paths = written(seeds.select("url").distinct(), 0), [f"{root}/depth=0"]
    seen = newest
    for k in range(1, max_depth + 1):
        if newest.isEmpty():
            break
        open_ = newest if expandable is None else newest.join(expandable.select("url"), "url", "left_semi")
        found = edges.join(open_.select(F.col("url").alias("src")), "src", "left_semi").select(F.col("dst").alias("url")).distinct()
        newest = written(found.join(seen, "url", "left_anti"), k)
        paths.append(f"{root}/depth={k}")
        seen = spark.read.schema("url string").parquet(*paths)
    return spark.read.schema("url string, depth int").option("basePath", root).parquet(*paths)


def attempts(fetches: DataFrame) -> DataFrame:
    """(url, outcome): kept at the first try, at the retry, or an error. fetches: url, attempt, status, challenged."""
    ok = (F.col("status").between(200, 399)) & ~F.coalesce("challenged", F.lit(False))
    best = F.min(F.when(ok, F.col("attempt")))
    per = fetches.filter("attempt <= 1").groupBy("url").agg(best.alias("at"))
    return per.select("url", F.when(F.col("at") == 0, "kept").when(F.col("at") == 1, "retried").otherwise("error").alias("outcome"))


def html_loads(fetches: DataFrame, mode: Column) -> DataFrame:
    """fetches (body, browser) with ``load``: static, browser or none, by mode never, auto or always."""
    from ..functions.text import looks_rendered

    static = F.col("body").isNotNull()
    return fetches.withColumn(
        "load",
        F.when((mode == "always") & F.col("browser"), "browser")
        .when(static & ((mode == "never") | looks_rendered(F.col("body")) | ~F.col("browser")), "static")
        .when((mode != "never") & F.col("browser"), "browser")
        .when(static, "static")
        .otherwise("none"),
    )
