"""Kept pages as files: one for a scan, one for each page, one for each page's states."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.markdown import headings
from ..functions.text import slug
from ..functions.url import host_of, path_of
from ..functions.udfs import arrow

#: Words that name no file.
NAME_STOP_WORDS = "extract get the a an of all from and to for me please only list every their its in on with".split()


def task_name(task: Column) -> Column:
    """The first four telling words of a task, joined by dashes."""
    w = F.split(F.regexp_replace(F.lower(F.coalesce(task, F.lit(""))), r"[^a-z0-9\s]", " "), r"\s+")
    name = F.array_join(F.slice(F.filter(w, lambda x: (x != "") & ~x.isin(NAME_STOP_WORDS)), 1, 4), "-")
    return F.when(name == "", "content").otherwise(name)


def site_name(url: Column) -> Column:
    return F.regexp_replace(host_of(url), r"^www\.", "")


def file_name(task: Column, url: Column) -> Column:
    named = F.when(F.trim(F.coalesce(task, F.lit(""))) == "", site_name(url)).otherwise(task_name(task))
    s = slug(F.regexp_replace(named, r"(?i)\.md$", ""))
    return F.concat(s, F.lit(".md"))


def title_of(name: Column) -> Column:
    return F.initcap(F.regexp_replace(F.regexp_replace(name, r"(?i)\.md$", ""), "[-_]+", " "))


def _quoted(c: Column) -> Column:
    """A string as JSON has it."""
    return F.regexp_extract(F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)


def _head(title: Column, url: Column, body: Column | None = None) -> Column:
    """What stands above a page's text where a scan has several: its source, and its title unless ``body`` begins with one."""
    named = F.trim(F.when(F.coalesce(title, F.lit("")) != "", title).otherwise(F.coalesce(url, F.lit("Page"))))
    head = F.concat(F.lit("# "), named, F.lit("\n\n"))
    if body is not None:
        head = F.when(body.rlike(r"^#\s"), "").otherwise(head)
    return F.concat(head, F.lit("_Source: "), F.coalesce(url, F.lit("")), F.lit("_\n\n"))


def _bodies(pages: DataFrame) -> DataFrame:
    body = F.regexp_replace(F.col("markdown"), r"^\s+|\s+$", "")
    return pages.withColumn("_body", body).filter(F.coalesce("_body", F.lit("")) != "")


def assemble_scan(pages: DataFrame, generated_at: str) -> DataFrame:
    """(scan_id, filename, title, markdown, bytes, pages): a scan's pages in order of seq, as one text.

    pages: scan_id, seq, task, url, title, markdown. Blank pages are left out; where there are several, each has its
    source, and its title unless its text begins with one. A scan is one row here, so it must fit a string;
    :func:`scan_texts` measures scans of any size.
    """
    row = F.struct("seq", "url", "title", F.col("_body").alias("body"))
    g = _bodies(pages).groupBy("scan_id").agg(F.array_sort(F.collect_list(row)).alias("rows"), F.min_by("task", "seq").alias("task"))

    def part(r):
        return F.concat(_head(r["title"], r["url"], r["body"]), r["body"])

    many = F.size("rows") > 1
    text = F.when(many, F.array_join(F.transform("rows", part), "\n\n---\n\n")).otherwise(F.element_at("rows", 1)["body"])
    sources = F.array_distinct(F.filter(F.transform("rows", lambda r: r["url"]), lambda u: F.coalesce(u, F.lit("")) != ""))
    listed = F.when(F.size(sources) > 0, F.concat(F.lit("sources:\n"), F.array_join(F.transform(sources, lambda u: F.concat(F.lit("  - "), u)), "\n"), F.lit("\n"))).otherwise("")
    front = F.concat(F.lit("---\ntask: "), _quoted(F.col("task")), F.lit(f"\ngeneratedAt: {generated_at}\n"), listed, F.lit("---\n\n"))
    out = g.withColumn("pages", sources).withColumn("filename", file_name(F.col("task"), F.element_at("rows", 1)["url"]))
    out = out.withColumn("markdown", F.concat(front, text, F.lit("\n")))
    return out.select("scan_id", "filename", title_of(F.col("filename")).alias("title"), "markdown", F.octet_length("markdown").alias("bytes"), "pages")


def scan_texts(pages: DataFrame, as_given: bool = False) -> DataFrame:
    """(scan_id, filename, chars, sha1, sources): each scan's text as :func:`assemble_scan` has it, without front matter.

    The text goes by part by part, in order of seq, and is nowhere held: a scan's task sorts its pages, spilling them,
    and sees a batch at a time. ``as_given`` takes texts as they are: blank ones stay, and each has its source and
    title whatever it begins with, and even if it is alone; a null text has a source, but no part.
    """
    p = pages.withColumn("_body", F.col("markdown")) if as_given else _bodies(pages)
    kind, batch_kind = dict(pages.dtypes)["scan_id"], to_arrow_type(pages.schema["scan_id"].dataType)
    names = p.groupBy(F.col("scan_id").alias("_scan")).agg(
        F.min_by("task", "seq").alias("task"), F.min_by("url", "seq").alias("url"),
        F.count_distinct(F.when(F.col("url") != "", F.col("url"))).cast("int").alias("sources"),
    )
    head = _head(F.col("title"), F.col("url"), None if as_given else F.col("_body"))
    parts = p.filter("_body is not null").select("scan_id", "seq", head.alias("head"), F.col("_body").alias("body"))
    parts = parts.repartition("scan_id").sortWithinPartitions("scan_id", "seq", "head", "body")
    sized = parts.select("scan_id", F.col("head").cast("binary"), F.length("head").alias("n_head"), F.col("body").cast("binary"), F.length("body").alias("n_body"))
    between = b"\n\n---\n\n"

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, alone, n, scan = None, None, 0, None  # alone: a scan's first page has its head only if another follows
        done: list[tuple] = []

        def end() -> None:
            nonlocal n
            if text is None:
                return
            if alone:
                text.update(alone[2])
                n += alone[3]
            done.append((scan, n, text.hexdigest()))

        for batch in batches:
            for own, *part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                head, n_head, body, n_body = part
                if text is None or own != scan:
                    end()
                    text, n, scan, alone = hashlib.sha1(), 0, own, None if as_given else (head, n_head, body, n_body)
                    if alone:
                        continue
                else:
                    if alone:
                        text.update(alone[0] + alone[2])
                        n, alone = alone[1] + alone[3], None
                    text.update(between)
                    n += len(between)
                text.update(head)
                text.update(body)
                n += n_head + n_body
        end()
        scans, chars, digests = zip(*done, strict=True) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(scans, batch_kind), pa.array(chars, pa.int64()), pa.array(digests, pa.string())], ["scan_id", "chars", "sha1"])

    texts = sized.mapInArrow(measure, f"scan_id {kind}, chars long, sha1 string")
    out = names.join(texts, F.col("_scan").eqNullSafe(F.col("scan_id")), "left")
    return out.select(F.col("_scan").alias("scan_id"), file_name(F.col("task"), F.col("url")).alias("filename"), "chars", "sha1", "sources")


DOCUMENT = "scan_id {0}, seq {1}, id string, url string, title string, fetched_at string, bytes int, markdown string, headings array<struct<level:int,text:string>>, file string"


def assemble_documents(pages: DataFrame) -> DataFrame:
    """One document for each page that isn't blank, with an id that is unique in its scan.

    Ids come from paths; a scan's are given out in order of seq, so a scan is one group, but of ids alone: texts join
    them afterwards.
    """
    source = F.when(path_of(F.col("url")).isin("", "/"), host_of(F.col("url"))).otherwise(path_of(F.col("url")))
    p = pages.filter(F.trim(F.coalesce("markdown", F.lit(""))) != "")
    p = p.withColumn("_base", F.when(source == "", None).otherwise(slug(source)))
    kinds = dict(pages.dtypes)

    def number(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("seq")
        used: set[str] = set()
        following: dict[str, int] = {}  # of each base the number that is tried next
        ids = []
        for i, base in enumerate(g["_base"]):
            base = base or f"page-{i + 1}"
            own, n = base, following.get(base, 2)
            while own in used:
                own, n = f"{base}-{n}", n + 1
            following[base] = n
            used.add(own)
            ids.append(own)
        return pd.DataFrame({"scan_id": g["scan_id"], "seq": g["seq"], "id": ids})

    ids = p.select("scan_id", "seq", "_base").groupBy("scan_id").applyInPandas(number, f"scan_id {kinds['scan_id']}, seq {kinds['seq']}, id string")

    @arrow("array<struct<level:int,text:string>>")
    def outline(md: pd.Series) -> pd.Series:
        return md.map(lambda t: [{"level": n, "text": x} for n, x in headings(t)], na_action=None)

    body = F.regexp_replace(F.col("markdown"), r"^\s+|\s+$", "")
    d = p.join(ids, ["scan_id", "seq"]).withColumn("markdown", body)
    return d.select(
        "scan_id", "seq", "id", F.coalesce("url", F.lit("")).alias("url"), F.trim(F.coalesce("title", F.lit(""))).alias("title"),
        F.coalesce("fetched_at", F.lit("")).alias("fetched_at"), F.octet_length("markdown").alias("bytes"), "markdown",
        outline(F.col("markdown")).alias("headings"), F.concat("id", F.lit(".md")).alias("file"),
    )


def document_file(url: str, title: str, fetched_at: str, markdown: str) -> str:
    front = [f"{k}: {v}" for k, v in (("url", json.dumps(url, ensure_ascii=False)), ("title", json.dumps(title, ensure_ascii=False)), ("fetchedAt", fetched_at)) if v not in ('""', "")]
    return "\n".join(["---", *front, "---", "", markdown]) + "\n"


def index_file(documents: list[dict], title: str, generated_at: str) -> str:
    lines = [f"# {title}", "", f"_{len(documents)} document(s) · generated {generated_at}_", ""]
    lines += [f"- [{d['title'] or d['id']}](documents/{d['file']})" + (f" — {d['url']}" if d["url"] else "") for d in documents]
    return "\n".join(lines) + "\n"


def assemble_states(pages: DataFrame) -> DataFrame:
    """(scan_id, seq, markdown) of pages with several states: each state whole, under its name."""

    def name(s, k):
        from_ = F.when((s["provenance"] != "baseline") & (F.coalesce(s["provenance"], F.lit("")) != ""), s["provenance"])
        return F.coalesce(F.when(s["label"] != "", s["label"]), from_, F.when(k == 0, "base").otherwise(F.concat(F.lit("state "), k + 1)))

    def part(s, k):
        return F.concat(F.lit("## State: "), name(s, k), F.lit("\n\n"), F.regexp_replace(F.coalesce(s["markdown"], F.lit("")), r"^\s+|\s+$", ""))

    p = pages.filter(F.size("states") > 1)
    head = F.concat(F.lit("> "), F.size("states"), F.lit(" distinct states, each whole."))
    return p.select("scan_id", "seq", F.concat(head, F.lit("\n\n"), F.array_join(F.transform("states", part), "\n\n"), F.lit("\n")).alias("markdown"))


def produced_files(reply: str) -> list[tuple[str, str]]:
    """(name, text) of the files that a reply holds between ``=== FILE: name`` and ``=== END`` lines."""
    out = []
    for m in re.finditer(r"(?ms)^=+\s*FILE:\s*(\S[^\n]*?)\s*=*\n(.*?)(?=^=+\s*(?:FILE:|END))", (reply or "") + "\n=== END"):
        out.append((m[1], m[2].strip()))
    return out


def is_document_worthy(text: Column) -> Column:
    """A table, two headings or five list items make a reply a document."""
    t = F.coalesce(text, F.lit(""))
    table = t.rlike(r"(?m)^[^\n]*\|[^\n]*\n(?=[^\n]*-)\s*\|?[\s:|-]+\|?\s*$")
    return table | (F.regexp_count(t, F.lit(r"(?m)^#{1,6}\s+\S")) >= 2) | (F.regexp_count(t, F.lit(r"(?m)^\s*([-*+]|\d+\.)\s+\S")) >= 5)


def document_name(instruction: Column, reply: Column) -> Column:
    """The file name of a reply that is a document: its first heading, else what was asked."""
    head = F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?m)^#{1,6}\s+(.+?)\s*$", 1)
    named = F.when(head != "", head).otherwise(F.coalesce(instruction, F.lit("answer")))
    short = F.substring(F.trim(F.regexp_replace(named, r"[*_`#|]", "")), 1, 60)
    return F.concat(F.when(short == "", "answer").otherwise(short), F.lit(".md"))
