"""Command line: a corpus from a table of fetched pages, stopped runs taken up again, files for a request, lists of runs,
evaluation against a golden spec, registered queries."""

from __future__ import annotations

import argparse
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weftline", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("corpus", help="fetched pages to files")
    c.add_argument("fetched")
    c.add_argument("--base", required=True)
    c.add_argument("--out", required=True)
    c.add_argument("--run", required=True)
    c.add_argument("--generated-at", required=True)
    c.add_argument("--mode", default="complete")
    c.add_argument("--max-pages", type=int)
    c.add_argument("--include")
    c.add_argument("--exclude")
    c.add_argument("--per-document", action="store_true")
    t = sub.add_parser("resume", help="a stopped run goes on; pages come from a table of fetched ones")
    t.add_argument("root")
    t.add_argument("id")
    t.add_argument("fetched")
    t.add_argument("--generated-at", required=True)
    h = sub.add_parser("reshape", help="what a reader of a request sees of a run's files, or the files of a reply")
    h.add_argument("root")
    h.add_argument("id")
    h.add_argument("instruction")
    h.add_argument("--scan", default="")
    h.add_argument("--reply", help="file that holds a reply; its files are checked and written to the run")
    h.add_argument("--no-verify", action="store_true")
    e = sub.add_parser("eval", help="a run's pages (url, text, bytes) against a golden spec")
    e.add_argument("spec")
    e.add_argument("pages")
    e.add_argument("--baseline", help="pages of an earlier run, to compare with")
    e.add_argument("--out", help="folder for the report")
    sub.add_parser("version")
    r = sub.add_parser("runs", help="the runs below a folder")
    r.add_argument("action", choices=["list", "rm", "clear", "path"])
    r.add_argument("root")
    r.add_argument("id", nargs="?")
    q = sub.add_parser("query", help="a registered query over a folder of tables")
    q.add_argument("name")
    q.add_argument("tables")
    q.add_argument("--rows", type=int, default=20)
    return p


def _resume(spark, a) -> int:
    from pyspark.sql import functions as F

    from .plans import crawl
    from .sources import bundle, runs

    table = spark.read.parquet(a.fetched)

    def fetch(asked):
        return asked.join(table, "url", "left").select("url", F.coalesce("status", F.lit(0)).alias("status"), "mitigated", "html", "fetched_at")

    begun = runs.load_for_resume(spark, a.root, a.id)
    scans, status = [], "done"
    for (url, task), (sid, result, ended) in zip(begun.targets, crawl.resume(spark, a.root, a.id, fetch, a.generated_at), strict=True):
        bundle.write_bundle(spark, f"{a.root.rstrip('/')}/{a.id}", sid, result.files, result.documents)
        files = [{"filename": r.filename, "bytes": r.bytes} for r in result.files.select("filename", "bytes").collect()]
        scans.append({"scanId": sid, "url": url, "task": task, "title": sid, "pages": result.pages.count(), "files": files})
        status = ended if ended != "done" else status
    m = runs.save(spark, a.root, a.id, begun.created_at, begun.targets, begun.options, scans, status=status)
    print(f"{m['stats']['pages']} page(s), {status}")
    return 0


def _reshape(spark, a) -> int:
    from .plans import reshape
    from .sources import files, runs

    scan = runs.scan(runs.get(spark, a.root, a.id), a.scan)
    if scan is None:
        print(f"no scan {a.scan!r}", file=sys.stderr)
        return 1
    sid = str(scan.get("scanId") or "")
    rows = []
    for i, f in enumerate(scan.get("files") or []):
        text = runs.read_file(spark, a.root, a.id, sid, f["filename"])
        if text:
            rows.append(("r", i, f["filename"], f.get("bytes") or len(text.encode()), f.get("title") or "", [scan["url"]] if scan.get("url") else [], text))
    docs = spark.createDataFrame(rows, "request_id string, di long, filename string, bytes long, title string, sources array<string>, content string")
    if not rows:
        print("nothing was extracted for this scan", file=sys.stderr)
        return 1
    session = runs.session(spark, a.root, a.id, sid)
    known = [(f["filename"], runs.read_chat_file(spark, a.root, a.id, sid, f["filename"]) or "") for f in session["files"]]
    produced = spark.createDataFrame([("r", i, n, len(t.encode()), t) for i, (n, t) in enumerate(known)], "request_id string, pos long, filename string, bytes long, content string")
    if not a.reply:
        request = spark.createDataFrame([("r", a.instruction)], "request_id string, instruction string")
        r = reshape.context(docs, request, produced).first()
        print(r.sources + (f"\n\n{r.produced}" if r.produced else ""))
        return 0
    replies = spark.createDataFrame([("r", a.instruction, files.read(spark, a.reply) or "")], "request_id string, instruction string, reply string")
    kept, skipped = reshape.outputs(replies, docs, produced, not a.no_verify)
    used = {n for n, _ in known}
    for f in kept.collect():
        name = runs.chat_name(f.filename, used)
        runs.write_chat_file(spark, a.root, a.id, sid, name, f.content)
        session["files"].append({"filename": name, "bytes": len(f.content.encode())})
        print(name if not f.unverified else f"{name}: not in the sources: {', '.join(f.unverified[:10])}")
    for f in skipped.collect():
        print(f"{f.filename}: like a file of this conversation, left out")
    session["messages"] += [{"role": "user", "content": a.instruction}]
    runs.write_session(spark, a.root, a.id, sid, session)
    return 0


def _eval(spark, a) -> int:
    from .functions.url import known_as
    from .operators import incremental
    from .plans import site
    from .sources import catalog, files

    pages = spark.read.parquet(a.pages)
    golden = catalog.read_golden(spark, a.spec)
    report = site.evaluation(pages.select("text"), catalog.golden_snippets(golden), pages.select("url"), catalog.golden_sitemap(golden, golden.select("name", "url").limit(0)).select("url"))
    if a.baseline:
        from pyspark.sql import functions as F

        run = lambda df: df.select(known_as(F.col("url")).alias("url"), "bytes", F.monotonically_increasing_id().alias("pos"))
        totals = incremental.run_totals(incremental.run_diff(run(spark.read.parquet(a.baseline)), run(pages))).first().asDict()
        report += "\n" + site.format_report(totals)
    print(report)
    if a.out:
        name = golden.first()["name"] or "report"
        files.write(spark, f"{a.out.rstrip('/')}/{name}.eval.txt", report + "\n")
    return 0


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "version":
        from . import __version__

        print(__version__)
        return 0
    from pyspark.sql import SparkSession

    from .functions.options import Options
    from .plans import site
    from .plans.queries import QUERIES
    from .sources import bundle, catalog, runs

    spark = SparkSession.builder.appName("weftline").getOrCreate()
    if a.command == "corpus":
        o = Options.of(mode=a.mode, max_pages=a.max_pages, include=a.include, exclude=a.exclude, per_document=a.per_document)
        out = site.run(spark.read.parquet(a.fetched), a.base, o, a.generated_at)
        n = bundle.write_bundle(spark, a.out, a.run, out.files, out.documents)
        print(f"{n} file(s)")
    elif a.command in ("resume", "reshape", "eval"):
        return {"resume": _resume, "reshape": _reshape, "eval": _eval}[a.command](spark, a)
    elif a.command == "runs" and a.action == "clear":
        print(f"{runs.delete_all(spark, a.root)} run(s) deleted")
    elif a.command == "runs" and a.action == "list":
        catalog.read_runs(spark, a.root).select("id", "createdAt", "status").show(truncate=False)
    elif a.command == "runs" and a.action == "rm":
        return 0 if catalog.delete_run(spark, a.root, a.id or "") else 1
    elif a.command == "runs":
        print(catalog.run_path(a.root, a.id) if a.id else a.root)
    elif a.name in QUERIES:
        QUERIES[a.name](spark, a.tables).show(a.rows, truncate=False)
    else:
        print(f"no query {a.name!r}; there are {', '.join(QUERIES)}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
