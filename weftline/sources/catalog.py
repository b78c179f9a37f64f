"""Runs on disk: journals, manifests, sitemaps, long texts, targets. Readers take any path that Spark reads."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.url import path_of

STATE = "struct<label:string,provenance:string,order:int,markdown:string>"
META = (
    "struct<strategy:string,framework:string,fetchedAt:string,bytes:bigint,revealResidualChars:bigint,lastmod:string,"
    "contentHash:string,httpEtag:string,httpLastModified:string,source:string>"
)
PAGE = f"struct<url:string,task:string,title:string,markdown:string,states:array<{STATE}>,meta:{META}>"
RECORD = f"page {PAGE}, links array<string>"
RUN = "id string, createdAt string, durationMs bigint, status string, pages bigint, url string, task string, incremental boolean, scans array<struct<id:string,url:string,task:string,pages:bigint>>"
_ID = re.compile(r"[A-Za-z0-9_-]+")


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """Records of a journal; torn and blank lines are skipped."""
    j = spark.read.schema(f"{RECORD}, _corrupt_record string").json(path, mode="PERMISSIVE")
    return j.filter(F.col("_corrupt_record").isNull() & F.col("page.url").isNotNull()).drop("_corrupt_record")


def append_journal(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """Runs below a folder, newest first; runs of one target, as older versions wrote them, have one scan."""
    r = spark.read.schema(f"{RUN}, _corrupt_record string").json(f"{root}/*/run.json", multiLine=True)
    one = F.array(F.struct(F.lit("01").alias("id"), "url", "task", F.coalesce("pages", F.lit(0)).alias("pages")))
    r = r.filter(F.col("_corrupt_record").isNull() & F.col("id").isNotNull()).withColumn("scans", F.coalesce("scans", one))
    return r.select("id", "createdAt", "durationMs", F.coalesce("status", F.lit("done")).alias("status"), "incremental", "scans").orderBy(F.desc("createdAt"), F.desc("id"))


def run_path(root: str, run_id: str, *parts: str) -> str:
    """The place of a run's file; ids and names that could leave the folder are refused."""
    for p in (run_id, *parts):
        if p in ("", ".", "..") or "/" in p or "\\" in p or (p == run_id and not _ID.fullmatch(p)):
            raise ValueError(f"not a name: {p!r}")
    return "/".join((root.rstrip("/"), run_id, *parts))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def write_run(spark: SparkSession, root: str, run: dict) -> None:
    """run.json without secrets, functions and internal options."""
    run = {**run, "options": sanitized(run.get("options") or {})}
    spark.createDataFrame([(json.dumps(run),)], "value string").coalesce(1).write.mode("overwrite").text(f"{run_path(root, run['id'])}/run.json")


def sanitized(options: dict) -> dict:
    """Options as they may be written: without the key of a provider, objects of the running program and functions;
    patterns by their text."""
    out = {k: v.pattern if isinstance(v, re.Pattern) else v for k, v in options.items()}
    return {k: v for k, v in out.items() if not (callable(v) or k in ("apiKey", "api_key", "llm") or k.startswith("__"))}


def delete_run(spark: SparkSession, root: str, run_id: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_path(root, run_id))
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def read_targets(text: str | None = None, task: str | None = None, urls: list[str] = (), tasks: list[str] = ()) -> list[tuple[str, str | None]]:
    """(url, task): of a JSON list of strings or objects, or of one of them (a byte order mark is skipped); else of
    URLs with their tasks, of which one alone is for all."""
    if text is None:
        nth = lambda i: tasks[0] if len(tasks) == 1 else tasks[i] if i < len(tasks) else task
        return [(u, nth(i)) for i, u in enumerate(urls)]
    data = json.loads(text.lstrip("\ufeff"))
    out = []
    for t in data if isinstance(data, list) else [data]:
        if isinstance(t, str):
            out.append((t, task))
        elif isinstance(t, dict) and t.get("url"):
            out.append((t["url"], t.get("task") or task))
    return out


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden specs, one a file; a byte order mark is skipped."""
    schema = "name string, url string, task string, expect struct<revealContent:array<string>,mustInclude:array<string>,mustExclude:array<string>,sitemapUrls:array<string>,sitemap:string,sitemapPrefix:string>"
    text = F.regexp_replace("value", "^\ufeff", "")
    return spark.read.text(path, wholetext=True).select(F.from_json(text, schema).alias("g")).select("g.*")


def golden_snippets(golden: DataFrame) -> DataFrame:
    """(name, kind, id, snippet) that golden specs ask for: what reveals must show, what must and must not be there."""
    kinds = {"reveal": "revealContent", "include": "mustInclude", "exclude": "mustExclude"}

    def listed(kind: str, column: str) -> Column:
        return F.transform(F.coalesce(F.col(f"expect.{column}"), F.array().cast("array<string>")), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("snippet")))

    each = F.flatten(F.array(*[listed(k, c) for k, c in kinds.items()]))
    return golden.select("name", F.posexplode(each).alias("id", "s")).select("name", "s.kind", "id", "s.snippet")


def golden_sitemap(golden: DataFrame, collected: DataFrame) -> DataFrame:
    """(name, url) that a spec's coverage is scored against: the URLs it lists, else those collected (name, url), under
    its prefix where it names one."""
    spec = golden.select("name", "expect.sitemapUrls", F.regexp_replace(F.coalesce("expect.sitemapPrefix", F.lit("")), "/$", "").alias("prefix"))
    listed = spec.filter("sitemapUrls is not null").select("name", F.explode("sitemapUrls").alias("url"))
    path = path_of(F.col("url"))
    own = collected.join(spec.filter("sitemapUrls is null"), "name")
    under = (F.col("prefix") == "") | (path == F.col("prefix")) | path.startswith(F.concat("prefix", F.lit("/")))
    return listed.unionByName(own.filter(under).select("name", "url"))


def sitemap_entries(docs: DataFrame) -> DataFrame:
    """(url, loc, lastmod, pos) of sitemaps (url, xml); one entry or many, lastmod '' where it is missing."""
    x = F.from_xml(F.col("xml"), "url array<struct<loc:string,lastmod:string>>")
    e = docs.select("url", F.posexplode(x["url"]).alias("pos", "e"))
    return e.select("url", F.trim("e.loc").alias("loc"), F.trim(F.coalesce("e.lastmod", F.lit(""))).alias("lastmod"), "pos").filter("loc <> ''")


def sitemap_children(docs: DataFrame) -> DataFrame:
    """(url, child) of sitemap indexes."""
    x = F.from_xml(F.col("xml"), "sitemap array<struct<loc:string>>")
    return docs.select("url", F.explode(x["sitemap"]).alias("s")).select("url", F.trim("s.loc").alias("child"))


def collect_sitemaps(docs: DataFrame, roots: list[str], max_depth: int = 4) -> DataFrame:
    """(loc, lastmod) of all entries reached from the roots, the first lastmod of each; depth-bounded, cycles end."""
    reached = docs.filter(F.col("url").isin(roots)).select("url", F.lit(0).alias("depth"))
    level, children = reached, sitemap_children(docs)
    for k in range(1, max_depth + 1):
        level = children.join(level.select("url"), "url").select(F.col("child").alias("url")).distinct().withColumn("depth", F.lit(k))
        reached = reached.unionByName(level)
    reached = reached.groupBy("url").agg(F.min("depth").alias("depth"))
    e = sitemap_entries(docs.join(reached, "url")).join(reached, "url")
    first = F.min_by("lastmod", F.struct("depth", "url", "pos"))
    return e.groupBy("loc").agg(first.alias("lastmod"))


def robots_sitemaps(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?im)^\s*sitemap\s*:\s*(\S+)"), 1)


def split_llms(docs: DataFrame, least: int = 500) -> DataFrame:
    """(origin, pos, url, title, markdown) of long texts (origin, text): split at headings of level 1, or of level 2
    where there are fewer than two; a section names its URL in its first lines, else it gets one from its title."""
    from ..functions.text import slug

    d = docs.filter((F.length("text") >= least) & ~F.col("text").rlike(r"(?i)^\s*<(?:!doctype|html|\?xml)"))
    lines = F.split("text", r"\r?\n")
    n = lambda p: F.size(F.filter(lines, lambda x: x.rlike(p)))
    first = F.when(F.element_at(lines, 1).rlike(r"^#\s+.+"), 0).otherwise(1)
    d = d.withColumn("_mark", F.when(n(r"^#\s+.+") + first >= 2, r"^#\s+.+").otherwise(r"^##\s+.+"))
    # a line that begins a section, or the first one, gives its number; sections are slices of the lines
    begins = F.filter(F.transform(lines, lambda x, i: F.when(F.regexp(x, F.col("_mark")) | (i == 0), i)), lambda i: i.isNotNull())
    each = F.transform(F.col("_at"), lambda i, k: F.slice(F.col("_lines"), i + 1, F.coalesce(F.get(F.col("_at"), k + 1), F.size("_lines")) - i))
    d = d.select("origin", "_mark", lines.alias("_lines"), begins.alias("_at")).select("origin", F.posexplode(each).alias("pos", "own"), "_mark")
    head = F.element_at("own", 1)
    title = F.when(F.regexp(head, F.col("_mark")), F.trim(F.regexp_replace(head, r"^##?\s+", ""))).otherwise("")
    title = F.when(title == "", F.concat(F.lit("Section "), F.col("pos") + 1)).otherwise(title)
    named = F.regexp_extract(F.array_join(F.slice("own", 1, 6), "\n"), r"(?im)^\s*>?\s*(?:source|url|canonical)\s*[:=]\s*(?:\[[^\]]*\]\()?\s*<?(https?://[^\s)>]+)", 1)
    md = F.regexp_replace(F.array_join("own", "\n"), r"^\s+|\s+$", "")
    out = d.select("origin", "pos", title.alias("title"), md.alias("markdown"), named.alias("_named")).filter("markdown <> ''")
    url = F.when(F.col("_named") != "", F.col("_named")).otherwise(F.concat("origin", F.lit("/#"), slug(F.col("title"))))
    return out.select("origin", "pos", url.alias("url"), "title", "markdown")
