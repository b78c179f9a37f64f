"""Reworking a run's files on request: what the reader of a request sees, and what becomes of its reply."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.relevance import tokens
from ..functions.simhash import simhash
from ..functions.text import strip_front_matter
from ..functions.udfs import arrow
from ..operators import assemble, dedup, retrieve
from ..scratch import materialise

#: The newest files of a conversation that a request may refer to.
PRODUCED = 6


def _label(kind: str) -> Column:
    """What tells a reader which file this is."""
    n = F.col("nth").cast("string")
    bits = F.filter(
        F.array(
            F.when(F.coalesce("filename", F.lit("")) != "", F.concat(F.lit('"'), "filename", F.lit('"'))).otherwise(F.concat(F.lit(f"{kind} "), n)),
            F.when(F.col("bytes").isNotNull(), F.concat(F.col("bytes").cast("string"), F.lit(" bytes"))),
            F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit('titled "'), "title", F.lit('"'))),
            F.when(F.size(F.coalesce("sources", F.array().cast("array<string>"))) > 0, F.concat(F.lit("crawled from "), F.array_join("sources", " , "))),
            F.when(F.col("partial"), F.lit("only the sections that matter here")),
        ),
        lambda x: x.isNotNull(),
    )
    return F.concat(F.lit(f"===== {kind} ["), n, F.lit("] — "), F.array_join(bits, " · "), F.lit(" =====\n"), F.trim(F.coalesce("content", F.lit(""))))


def _rendered(files: DataFrame, order: str, kind: str, name: str) -> DataFrame:
    """(request_id, name): the files of a request, each under its label."""
    every = F.array_sort(F.collect_list(F.struct(order, "filename", "bytes", "title", "sources", "partial", "content")))
    g = files.groupBy("request_id").agg(every.alias("own")).select("request_id", F.posexplode("own").alias("nth", "f"))
    g = g.select("request_id", (F.col("nth") + 1).alias("nth"), "f.*").select("request_id", "nth", _label(kind).alias("text"))
    return g.groupBy("request_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "text"))), lambda x: x["text"]), "\n\n").alias(name))


def context(docs: DataFrame, requests: DataFrame, produced: DataFrame | None = None, scores: DataFrame | None = None, cap: int = retrieve.CONTEXT) -> DataFrame:
    """(request_id, sources, produced, mode, truncated): what the reader of each request sees.

    docs: request_id, di, filename, bytes, title, sources, content. requests: request_id, instruction. produced:
    request_id, pos, filename, bytes, content, the files of the conversation so far. Sources come first, as far as ``cap``
    characters go; where they exceed it, the sections that matter (mode retrieval) or the beginning (head). What was
    produced before has what is left, its newest ``PRODUCED`` files.
    """
    docs = docs.filter(F.trim(F.coalesce("content", F.lit(""))) != "")
    picked = retrieve.context_pack(docs, requests.select("request_id", "instruction", F.lit(cap).alias("budget")), scores)
    more = docs.select("request_id", "di", "bytes", "title", "sources")
    own = picked.join(more, ["request_id", "di"])
    n = docs.groupBy("request_id").agg(F.count("*").alias("docs"))
    facts = own.groupBy("request_id").agg(F.first("mode").alias("mode"), F.count("*").alias("given"), F.max("partial").alias("cut")).join(n, "request_id")
    out = _rendered(own, "di", "SOURCE", "sources").join(facts, "request_id")
    long = F.length("sources") > cap
    left_out = F.col("docs") - F.col("given")
    note = F.when(left_out > 0, F.concat(F.lit("\n\n("), left_out.cast("string"), F.lit(" other file(s) hold nothing that matters here.)"))).otherwise("")
    out = out.select(
        "request_id",
        F.concat(F.substring("sources", 1, cap), note).alias("sources"),
        F.when(long & (F.col("mode") == "full"), "head").otherwise(F.col("mode")).alias("mode"),
        (long | (F.col("mode") != "full") | F.col("cut")).alias("truncated"),
    )
    if produced is None:
        return out.withColumn("produced", F.lit("")).select("request_id", "sources", "produced", "mode", "truncated")
    newest = produced.filter(F.trim(F.coalesce("content", F.lit(""))) != "").groupBy("request_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("pos", "filename", "bytes", "content")), False), 1, PRODUCED).alias("f"))
    files = newest.select("request_id", F.explode("f").alias("f")).select("request_id", "f.*")
    plain = retrieve.strip_fidelity_banner(strip_front_matter(F.col("content")))
    files = files.withColumn("content", plain).withColumn("title", F.lit("")).withColumn("sources", F.array().cast("array<string>")).withColumn("partial", F.lit(False))
    out = out.join(_rendered(files, "pos", "PRODUCED BEFORE", "produced"), "request_id", "left")
    room = F.greatest(F.lit(cap) - F.length("sources"), F.lit(0))
    return out.select("request_id", "sources", F.substring(F.coalesce("produced", F.lit("")), F.lit(1), room).alias("produced"), "mode", "truncated")


@arrow("array<struct<filename:string,content:string>>")
def _files(reply: pd.Series) -> pd.Series:
    return reply.map(lambda r: [{"filename": n, "content": t} for n, t in assemble.produced_files(r)], na_action=None)


def outputs(replies: DataFrame, docs: DataFrame, earlier: DataFrame, verify: bool = True) -> tuple[DataFrame, DataFrame]:
    """(files, skipped) of replies (request_id, instruction, reply).

    A reply's files are those that it marks; a reply without any is one itself if it is a document. Files near one that
    the conversation had (earlier: request_id, content), or near one before them in the reply, are skipped. Values that
    neither the sources (docs: request_id, content) nor the instruction hold are named in a warning at the file's head.
    files: request_id, filename, content, total, verified, unverified.
    """
    r = replies.withColumn("_f", _files(F.col("reply")))
    whole = F.array(F.struct(assemble.document_name(F.col("instruction"), F.col("reply")).alias("filename"), F.col("reply").alias("content")))
    r = r.withColumn("_f", F.when(F.size("_f") > 0, F.col("_f")).when(assemble.is_document_worthy(F.col("reply")), whole).otherwise(F.slice("_f", 1, 0)))
    f = r.select("request_id", "instruction", F.posexplode("_f").alias("nth", "f")).select("request_id", "instruction", "nth", "f.*")
    f = materialise(f.withColumn("fingerprint", simhash(F.col("content"))), "produced")
    old = earlier.select("request_id", simhash(retrieve.strip_fidelity_banner(F.col("content"))).alias("fingerprint"))
    kept = dedup.not_reemitted(f.select("request_id", F.col("nth").alias("id"), "fingerprint"), old, within="request_id")
    fresh = f.join(kept.select("request_id", F.col("id").alias("nth")), ["request_id", "nth"], "left_semi")
    skipped = f.join(kept.select("request_id", F.col("id").alias("nth")), ["request_id", "nth"], "left_anti").select("request_id", "filename")
    if not verify:
        none = F.lit(None)
        return fresh.select("request_id", "filename", "content", none.cast("int").alias("total"), none.cast("int").alias("verified"), none.cast("array<string>").alias("unverified")), skipped
    sources = docs.groupBy("request_id").agg(F.collect_list("content").alias("sources"))
    v = retrieve.verify(fresh.join(sources, "request_id", "left"), "content", "sources", "instruction")
    banner = retrieve.fidelity_banner(F.col("total"), F.col("unverified"))
    return v.select("request_id", "filename", F.concat(banner, "content").alias("content"), "total", "verified", "unverified"), skipped


def gists(docs: DataFrame) -> DataFrame:
    """(request_id, di, si, gist): the heading and first characters by which a section is embedded."""
    from ..functions.markdown import doc_sections

    s = docs.select("request_id", "di", F.posexplode(doc_sections(F.col("content"))).alias("si", "s"))
    return s.select("request_id", "di", "si", F.concat("s.heading", F.lit("\n"), F.substring("s.text", 1, retrieve.GIST)).alias("gist"))


def scorer(embed: Callable[[DataFrame, DataFrame], DataFrame] | None, model: str | None, disabled: bool = False, warn: Callable[[str], None] | None = None):
    """A function (docs, requests) to the sections' scores, or None where terms are to be counted.

    Sections are scored by ``embed`` (gists, requests to request_id, di, si, score) only where a model is named, models
    aren't disabled and the instructions have terms. Once it fails, one warning is given and terms count from then on.
    """
    live = bool(embed and model and not disabled)

    def scores(docs: DataFrame, requests: DataFrame) -> DataFrame | None:
        nonlocal live
        if not live or requests.filter(F.size(tokens(F.coalesce("instruction", F.lit("")))) > 0).isEmpty():
            return None
        try:
            return materialise(embed(gists(docs), requests), "scores")
        except Exception as e:  # whatever a provider raises
            live = False
            if warn:
                warn(f"embedding model {model!r} failed ({str(e)[:160]}); terms are counted instead")
            return None

    return scores
