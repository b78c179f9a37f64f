import json
import re

import pytest
from pyspark.sql import functions as F

from weftline import cli
from weftline.functions.options import Options
from weftline.operators import assemble, dedup, incremental
from weftline.plans import crawl, reshape
from weftline.sources import catalog, files, runs


def test_files(spark, tmp_path):
    at = str(tmp_path / "a" / "x.txt")
    assert files.read(spark, at) is None
    files.write(spark, at, "é\n1")
    files.write(spark, at, "é\n2")
    assert files.read(spark, at) == "é\n2" and files.folders(spark, str(tmp_path)) == ["a"]
    (tmp_path / "b.json").write_bytes(b"\xef\xbb\xbf{}")
    assert files.read(spark, str(tmp_path / "b.json")) == "{}" and files.delete(spark, at)


def test_life_of_a_run(spark, tmp_path):
    root, targets = str(tmp_path), [("https://a.example/x", "t"), ("https://b.example/", None)]
    options = {"mode": "complete", "apiKey": "s", "llm": {}, "__resume": 1, "on": print, "include": re.compile("/x"), "tokenBudget": 5}
    runs.begin(spark, root, "r1", "2024", targets, options)
    saved = json.loads(files.read(spark, f"{root}/r1/run.json"))
    assert saved["status"] == "running" and saved["options"] == {"mode": "complete", "include": "/x", "tokenBudget": 5}
    page = {"url": "https://a.example/x", "markdown": "m"}
    files.write(spark, f"{root}/r1/01-a-example/{runs.JOURNAL}", json.dumps({"page": page, "links": ["https://a.example/y"]}) + "\n{torn")
    stopped = runs.load_for_resume(spark, root, "r1")
    assert stopped.targets == targets and list(stopped.journals) == ["01-a-example"] and stopped.journals["01-a-example"].count() == 1
    scans = [{"scanId": "01-a-example", "url": targets[0][0], "pages": [1, 2], "tokens": {"calls": 2}, "files": [{"filename": "f.md", "bytes": 3, "x": 1}], "warnings": ["w"]}, {"scanId": "02-b-example", "stats": {"pages": 5}}]
    m = runs.save(spark, root, "r1", "2024", targets, {"incremental": True}, scans, 7, ["w1", "w2"], status="stopped")
    assert m["stats"]["pages"] == 7 and m["stats"]["tokens"]["calls"] == 2
    s = json.loads(files.read(spark, f"{root}/r1/run.json"))
    assert s["warnings"] == 2 and s["scans"][0]["files"] == [{"filename": "f.md", "bytes": 3}] and s["scans"][0]["warnings"] == 1
    assert runs.load_for_resume(spark, root, "r1").options == {"incremental": True}
    runs.save(spark, root, "r1", "2024", targets, {"incremental": True}, scans)
    assert files.read(spark, f"{root}/r1/01-a-example/{runs.JOURNAL}")  # the next incremental run reads it
    with pytest.raises(ValueError, match="done"):
        runs.load_for_resume(spark, root, "r1")
    runs.save(spark, root, "r1", "2024", targets, {}, scans)
    assert files.read(spark, f"{root}/r1/01-a-example/{runs.JOURNAL}") is None
    runs.begin(spark, root, "r2", "2025", [], {})
    with pytest.raises(ValueError, match="targets"):
        runs.load_for_resume(spark, root, "r2")
    with pytest.raises(LookupError):
        runs.load_for_resume(spark, root, "r3")
    (tmp_path / "other").mkdir()
    assert runs.delete_all(spark, root) == 2 and files.folders(spark, root) == ["other"]


def test_older_runs(spark, tmp_path):
    files.write(spark, f"{tmp_path}/old/run.json", json.dumps({"id": "old", "pages": 3, "targets": [{"url": "https://x.example/a"}], "task": "t"}))
    r = runs.get(spark, str(tmp_path), "old")
    assert r["status"] == "done" and runs.scan(r) == {"scanId": "", "url": "https://x.example/a", "task": "t", "title": "x.example", "pages": 3, "files": [], "warnings": 0}
    assert runs.scan({"scans": [{"scanId": "1"}, {"scanId": "2"}]}, "2") == {"scanId": "2"} and runs.scan({"scans": []}) is None
    assert runs.cache_root(None, {}, "/h/") == "/h/.weftline" and runs.cache_root(None, {"WEFTLINE_RUNS": "/e"}, "/h") == "/e" and runs.cache_root("/o", {"WEFTLINE_RUNS": "/e"}, "/h") == "/o"
    assert runs.same_targets(["https://x.example/a/", "https://x.example/b"], ["https://x.example/b?utm_source=q", "https://x.example/a"]) and not runs.same_targets(["a"], [])
    assert runs.read_activity(spark, str(tmp_path), "old").count() == 0


def test_activity(spark, tmp_path):
    from weftline.sources import bundle

    events = spark.createDataFrame([("warn", "t0", "s", {"url": "u"}), ("page", "t1", "s", {})], "type string, ts string, scan_id string, payload map<string,string>")
    for _ in range(2):
        bundle.append_activity(events, str(tmp_path), "r1")
    got = runs.read_activity(spark, str(tmp_path), "r1")
    assert got.count() == 4 and {r.payload["url"] for r in got.filter("type = 'warn'").collect()} == {"u"}


def test_targets_and_golden(spark, tmp_path):
    assert catalog.read_targets('﻿["a", {"url": "b", "task": "t"}, {"x": 1}]', "d") == [("a", "d"), ("b", "t")]
    assert catalog.read_targets(urls=["a", "b"], tasks=["t"]) == [("a", "t"), ("b", "t")]
    assert catalog.read_targets(urls=["a", "b", "c"], tasks=["t", "u"]) == [("a", "t"), ("b", "u"), ("c", None)]
    spec = {"name": "g", "url": "https://x.example/", "expect": {"mustInclude": ["one"], "mustExclude": ["two"], "sitemapPrefix": "/docs/"}}
    (tmp_path / "g.json").write_bytes(b"\xef\xbb\xbf" + json.dumps(spec, indent=1).encode())
    g = catalog.read_golden(spark, str(tmp_path / "g.json"))
    assert {(r.kind, r.snippet) for r in catalog.golden_snippets(g).collect()} == {("include", "one"), ("exclude", "two")}
    urls = [("g", f"https://x.example{p}") for p in ("/docs", "/docs/a", "/docsy", "/b")]
    got = catalog.golden_sitemap(g, spark.createDataFrame(urls, "name string, url string"))
    assert {r.url[17:] for r in got.collect()} == {"/docs", "/docs/a"}


def test_run_totals(spark):
    run = lambda rows: spark.createDataFrame(rows, "url string, bytes long, pos long")
    d = incremental.run_diff(run([("a", 10, 0), ("b", 5, 1)]), run([("a", 12, 0), ("c", 1, 1)]))
    assert incremental.run_totals(d).first().asDict() == {"pages_before": 2, "pages_after": 2, "bytes_before": 15, "bytes_after": 13, "bytes_delta": -2, "added": 1, "removed": 1, "changed": 1}
    assert incremental.run_totals(d.limit(0)).first().bytes_delta == 0


PAGES = {
    "https://s.example/": ("<p>home</p>", ["/a", "/b"]), "https://s.example/a": ("alpha", ["/c"]), "https://s.example/b": ("beta", ["/a"]),
    "https://s.example/c": ("gamma", []), "https://s.example/flaky": ("delta", ["/a"]),
}


def _fetch(spark, asked, lost=frozenset(), flaky=frozenset()):
    def fetch(urls):
        rows = []
        for r in urls.collect():
            asked.append(r.url)
            body, links = PAGES.get(r.url, ("", []))
            if r.url in lost or (r.url in flaky and asked.count(r.url) == 1):
                rows.append((r.url, 500, "", "", "n"))
            else:
                text = f"<main><h1>{body}</h1><p>{(body + ' is told at length here. ') * 40}</p>{''.join(f'<a href={chr(34)}{x}{chr(34)}>x</a>' for x in links)}</main>"
                rows.append((r.url, 200, "", text, "n"))
        return spark.createDataFrame(rows, crawl.FETCHED)

    return fetch


def _crawl(spark, seeds, asked, **more):
    kw = {k: more.pop(k) for k in ("lost", "flaky") if k in more}
    return crawl.crawl(spark, seeds, _fetch(spark, asked, **kw), "https://s.example/", more.pop("options", Options.of()), "s", "now", **more)


def test_crawl(spark, tmp_path):
    asked: list[str] = []
    out, status = _crawl(spark, ["https://s.example/"], asked, journal=str(tmp_path / "j"))
    assert status == "done" and sorted(asked) == sorted(x for x in PAGES if "flaky" not in x)
    assert {r.url for r in out.pages.collect()} == set(asked)
    j = catalog.read_journal(spark, str(tmp_path / "j"))
    assert j.count() == 4
    # taken up again: what the journal has isn't fetched again, its links are
    asked.clear()
    part = j.filter(F.col("page.url") == "https://s.example/")
    out, _ = _crawl(spark, ["https://s.example/"], asked, restored=part)
    assert sorted(asked) == [f"https://s.example/{x}" for x in "abc"] and out.pages.count() == 4


def test_crawl_retries_bounds_and_stops(spark):
    asked: list[str] = []
    out, _ = _crawl(spark, ["https://s.example/flaky"], asked, flaky={"https://s.example/flaky"}, options=Options.of(max_pages=1))
    assert asked == ["https://s.example/flaky"] * 2 and out.pages.count() == 1
    asked.clear()
    out, _ = _crawl(spark, ["https://s.example/gone"], asked, lost={"https://s.example/gone"})
    assert asked[:3] == ["https://s.example/gone", "https://s.example/gone", "https://s.example/"] and out.pages.count() == 4
    stop = crawl.Stop()
    stop.stop()
    out, status = _crawl(spark, ["https://s.example/"], [], stop=stop)
    assert status == "stopped" and out.pages.count() == 0


def _docs(spark, texts):
    rows = [("r", i, f"f{i}.md", 10 + i, "T", ["https://x.example/"], t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "request_id string, di long, filename string, bytes long, title string, sources array<string>, content string")


def test_reshape_context(spark):
    request = spark.createDataFrame([("r", "the prices please")], "request_id string, instruction string")
    produced = spark.createDataFrame([("r", i, f"p{i}.md", 3, f"---\na: 1\n---\n\nold {i} " + "y" * 50) for i in range(9)], "request_id string, pos long, filename string, bytes long, content string")
    r = reshape.context(_docs(spark, ["one text", "  "]), request, produced).first()
    assert r["mode"] == "full" and not r.truncated and '===== SOURCE [1] — "f0.md" · 10 bytes · titled "T" · crawled from https://x.example/ =====\none text' == r.sources
    assert "p8.md" in r.produced and "p2.md" not in r.produced and "a: 1" not in r.produced and r.produced.index("p3.md") < r.produced.index("p8.md")
    long = ["# Prices\n" + "price " * 60, "# Else\n" + "zzz " * 200]
    r = reshape.context(_docs(spark, long), request, produced, cap=600).first()
    assert r["mode"] == "retrieval" and r.truncated and "1 other file(s)" in r.sources and "zzz" not in r.sources and len(r.sources) + len(r.produced) <= 600
    r = reshape.context(_docs(spark, long), spark.createDataFrame([("r", "extract everything")], "request_id string, instruction string"), cap=600).first()
    assert r["mode"] == "head" and len(r.sources) == 600 and r.produced == ""


def test_reshape_outputs(spark):
    body = "# List\n\n- " + "\n- ".join(f"item {w} costs a lot of money" for w in "red green blue black white".split())
    reply = f"Here\n=== FILE: a.md ===\n{body}\n=== FILE: b.md ===\n{body}\n=== FILE: c.md ===\nother words, 4711 of them, stand here at last\n=== END"
    replies = spark.createDataFrame([("r", "list 4711", reply), ("q", "make a list", body), ("n", "hm", "just words")], "request_id string, instruction string, reply string")
    earlier = spark.createDataFrame([("q", "quite other words that were said before")], "request_id string, content string")
    kept, skipped = reshape.outputs(replies, _docs(spark, [body]).select("request_id", "content"), earlier)
    got = {(r.request_id, r.filename): r for r in kept.collect()}
    assert set(got) == {("r", "a.md"), ("r", "c.md"), ("q", "List.md")} and [tuple(x) for x in skipped.collect()] == [("r", "b.md")]
    assert got["r", "c.md"].unverified == [] and got["r", "a.md"].content == body
    # what another conversation had doesn't matter
    kept, _ = reshape.outputs(replies.filter("request_id = 'q'"), _docs(spark, [body]).select("request_id", "content"), spark.createDataFrame([("r", body)], earlier.schema))
    assert kept.count() == 1
    kept, skipped = reshape.outputs(replies.filter("request_id = 'q'"), _docs(spark, [body]).select("request_id", "content"), spark.createDataFrame([("q", body)], earlier.schema), verify=False)
    assert kept.count() == 0 and skipped.count() == 1


def test_scorer(spark):
    docs, warned = _docs(spark, ["# A\n" + "x" * 500, "# B\nshort"]), []
    request = spark.createDataFrame([("r", "about prices")], "request_id string, instruction string")
    assert {r.gist for r in reshape.gists(docs).collect()} == {"A\n# A\n" + "x" * 296, "B\n# B\nshort"}
    embed = lambda gists, req: gists.select("request_id", "di", "si", F.lit(0.5).alias("score"))
    assert reshape.scorer(embed, "m")(docs, request).count() == 2
    for off in (reshape.scorer(embed, None), reshape.scorer(embed, "m", disabled=True), reshape.scorer(None, "m")):
        assert off(docs, request) is None
    assert reshape.scorer(embed, "m")(docs, spark.createDataFrame([("r", "extract all")], request.schema)) is None

    def broken(gists, req):
        raise RuntimeError("down")

    s = reshape.scorer(broken, "m", warn=warned.append)
    assert s(docs, request) is None and s(docs, request) is None and len(warned) == 1 and "down" in warned[0]


def test_names(spark):
    rows = [("ask", "text\n## The *Title* here ##\nx"), ("do `this`", "no heading"), (None, ""), ("*", "x")]
    df = spark.createDataFrame(rows, "i string, r string").select(assemble.document_name(F.col("i"), F.col("r")).alias("n"))
    assert [r.n for r in df.collect()] == ["The Title here.md", "do this.md", "answer.md", "answer.md"]
    worthy = ["| a | b |\n|---|---|\n| 1 | 2 |", "# a\n\n# b", "\n".join(f"{i}. x" for i in range(5)), "# a\n- b", "a | b\nplain", ""]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(worthy)], "i int, t string").select("i", assemble.is_document_worthy(F.col("t")).alias("w")).orderBy("i").collect()
    assert [r.w for r in got] == [True, True, True, False, False, False]
    used: set[str] = set()
    assert [runs.chat_name(n, used) for n in ("a b.md", "a b", "../x", "..")] == ["a-b.md", "a-b-2.md", "x.md", "file.md"]


def test_ids_of_many_like_pages(spark):
    p = spark.createDataFrame([("s", i, "https://x.example/p", "t", "now", "x") for i in range(3000)] + [("s", 3000, "https://x.example/p-2", "t", "now", "x")], "scan_id string, seq int, url string, title string, fetched_at string, markdown string")
    ids = [r.id for r in assemble.assemble_documents(p).orderBy("seq").collect()]
    assert len(set(ids)) == 3001 and ids[:3] == ["p", "p-2", "p-3"] and ids[-1] == "p-2-2"


def test_split_llms(spark):
    text = "intro\n# One\nurl: https://x.example/one\n" + "a\n" * 300 + "# Two\nb\n"
    d = spark.createDataFrame([("https://x.example", text), ("o", "short"), ("h", "<!doctype html>" + "x" * 600)], "origin string, text string")
    got = sorted((r.pos, r.url, r.title, r.markdown[:9]) for r in catalog.split_llms(d).collect())
    assert got == [(0, "https://x.example/#section-1", "Section 1", "intro"), (1, "https://x.example/one", "One", "# One\nurl"), (2, "https://x.example/#two", "Two", "# Two\nb")]


def test_near_pairs_within(spark):
    rows = [("a", 1, 0), ("a", 2, 0b111), ("b", 3, 0b11), ("b", 4, 0b11), ("a", 5, -1), ("b", 6, -8)]
    df = spark.createDataFrame(rows, "s string, id int, fingerprint long")
    got = {tuple(r) for r in dedup.near_pairs(df, within="s").collect()}
    assert got == {("a", 1, 2, 3), ("b", 3, 4, 0)}
    assert {(r.a, r.b, r.distance) for r in dedup.near_pairs(df).collect()} == {(1, 2, 3), (1, 3, 2), (2, 3, 1), (3, 4, 0), (5, 6, 3)}


def test_near_pairs_brute(spark):
    import random

    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(12)]
    prints = {i: r.choice(base) ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))) for i in range(150)}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(i, signed(v)) for i, v in prints.items()], "id int, fingerprint long")
    for most in (0, 3, 8):
        rep = {}
        for i, v in sorted(prints.items()):
            rep.setdefault(v, i)
        want = {(min(rep[x], rep[y]), max(rep[x], rep[y]), (x ^ y).bit_count()) for x in rep for y in rep if x < y and (x ^ y).bit_count() <= most}
        want |= {(rep[v], i, 0) for i, v in prints.items() if rep[v] != i}
        assert {tuple(x) for x in dedup.near_pairs(df, most).collect()} == want


def test_commands(spark, tmp_path, capsys):
    root = str(tmp_path / "runs")
    assert cli.main(["version"]) == 0
    runs.begin(spark, root, "r1", "2024", [("https://s.example/", "t")], {"mode": "complete"})
    rows = _fetch(spark, [])(spark.createDataFrame([(u,) for u in PAGES], "url string"))
    rows.write.parquet(str(tmp_path / "fetched"))
    assert cli.main(["resume", root, "r1", str(tmp_path / "fetched"), "--generated-at", "now"]) == 0
    run = runs.get(spark, root, "r1")
    assert run["status"] == "done" and run["stats"]["pages"] == 4 and run["scans"][0]["files"][0]["filename"] == "t.md"
    assert runs.read_file(spark, root, "r1", "01-s-example", "t.md").startswith("---")
    assert cli.main(["reshape", root, "r1", "the list"]) == 0 and "alpha is told" in capsys.readouterr().out
    (tmp_path / "reply").write_text("=== FILE: x.md ===\n# X\n\n4242 things\n=== END")
    assert cli.main(["reshape", root, "r1", "the list", "--reply", str(tmp_path / "reply")]) == 0 and "x.md: not in the sources: 4242" in capsys.readouterr().out
    assert "Fidelity check" in runs.read_chat_file(spark, root, "r1", "01-s-example", "x.md") and runs.session(spark, root, "r1", "01-s-example")["files"][0]["filename"] == "x.md"
    pages = spark.createDataFrame([("https://s.example/a", "One two", 5)], "url string, text string, bytes long")
    pages.write.parquet(str(tmp_path / "pages"))
    (tmp_path / "g.json").write_text(json.dumps({"name": "g", "expect": {"mustInclude": ["one two"], "sitemapUrls": ["https://s.example/a"]}}))
    assert cli.main(["eval", str(tmp_path / "g.json"), str(tmp_path / "pages"), "--baseline", str(tmp_path / "pages"), "--out", str(tmp_path / "out")]) == 0
    assert "bytes_delta" in files.read(spark, str(tmp_path / "out" / "g.eval.txt"))
    assert cli.main(["runs", "clear", root]) == 0 and files.folders(spark, root) == []
