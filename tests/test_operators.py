import hashlib
import json
import random
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from weftline.functions.simhash import fingerprint
from weftline.operators import assemble, blocks, dedup, incremental, links, metrics, retrieve
from weftline.plans.queries import ORACLES, QUERIES
from weftline.sources import catalog


def test_tiers_greedy(spark):
    rows = [
        ("s", 1, "https://a/en/x", "h1", "/x", 0), ("s", 2, "https://b/x", "h2", "/x", 0b111), ("s", 3, "https://b/x", "h2", "/x", 0b111),
        ("s", 4, "https://c/y", "h1", "/y", 0), ("s", 5, "https://d/x", "h5", "/x", 0xFFFF), ("s", 6, "https://e/z", "h6", "/z", 0b1),
    ]
    p = spark.createDataFrame(rows, "scan_id string, seq int, url string, hash string, sibling_key string, fingerprint long")
    fates = lambda **k: [r.fate for r in dedup.tiers(p, **k).orderBy("seq").collect()]
    assert fates() == ["keep", "mirror", "exact", "exact", "keep", "keep"]
    assert fates(near=2) == ["keep", "mirror", "exact", "exact", "keep", "near"]
    assert fates(max_pages=1) == ["keep", "over", "over", "over", "over", "over"]
    assert fates(mirror=0) == ["keep", "keep", "exact", "exact", "keep", "keep"]


def test_tiers_random_against_one_pass(spark):
    r = random.Random(4)
    rows = [("s", i, f"https://h{r.randint(0, 3)}/p{r.randint(0, 4)}", f"h{r.randint(0, 30)}", f"/p{r.randint(0, 4)}", r.choice([0, 3, 0xFF, 0xFFF, 0xF0F0F0])) for i in range(60)]
    p = spark.createDataFrame(rows, "scan_id string, seq int, url string, hash string, sibling_key string, fingerprint long")
    for mirror, near, cap in ((8, 0, None), (4, 2, None), (8, 0, 5), (0, 3, 7)):
        want = dedup.decide([x[1:] for x in rows], mirror, near, cap)
        got = [x.fate for x in dedup.tiers(p, mirror, near, cap).orderBy("seq").collect()]
        assert got == want


def test_near_pairs_against_brute(spark):
    r = random.Random(2)
    fps = [r.getrandbits(63) for _ in range(40)]
    fps += [f ^ (1 << r.randrange(63)) ^ (1 << r.randrange(63)) for f in fps] + fps[:3]
    rows = list(enumerate(fps))
    got = {(x.a, x.b) for x in dedup.near_pairs(spark.createDataFrame(rows, "id int, fingerprint long"), 3).collect()}
    rep = {}
    for i, a in rows:
        rep.setdefault(a, i)
    want = {tuple(sorted((rep[a], rep[b]))) for a in rep for b in rep if a < b and (a ^ b).bit_count() <= 3}
    assert got == want | {(rep[a], i) for i, a in rows if rep[a] != i}


def test_baseline_run(spark):
    rows = [("r1", "1", "done", True, True, ["a", "b"]), ("r2", "2", "done", True, True, ["b", "a", "a"]), ("r3", "3", "stopped", True, True, ["a", "b"]), ("r4", "4", "done", True, True, ["a"])]
    runs = spark.createDataFrame(rows, "run_id string, created_at string, status string, incremental boolean, has_journal boolean, targets array<string>")
    assert incremental.baseline_run(runs, ["a", "b"]).first().run_id == "r2" and incremental.baseline_run(runs, []).count() == 0


def test_reemission(spark):
    mk = lambda xs: spark.createDataFrame([(i, fingerprint(t)) for i, t in xs], "id int, fingerprint long")
    long = " ".join(f"word{i}" for i in range(80))
    got = dedup.not_reemitted(mk([(1, long), (2, "quite other text here"), (3, long)]), mk([(9, "old output of words")]))
    assert sorted(x.id for x in got.collect()) == [1, 2]


def test_block_render_worked_case():
    s = [("x", "tab", 0, "\n\n".join(v)) for v in (["aaa", "bbb", "ccc"], ["aaa", "bbb", "ddd"], ["rrr", "bbb", "ddd"])]
    states, texts, origin = blocks.load([(None, "baseline", 0, s[0][3]), *s[1:]])
    out = [t for t, _, _ in blocks.rendered(states, texts, origin)]
    assert out.count("bbb") == 1 and out.count("aaa") == 2 and out.count("ddd") == 2 and out.count("ccc") == 1 and out.count("rrr") == 1


def test_block_pages(spark):
    rows = [(1, 0, None, None, 0, "# A\n\ntext"), (1, 1, "Tab", "tab:1", 1, "# A\n\ntext\n\nmore"), (1, 2, "Tab", "tab:1", 1, "# A\n\ntext\n\nmore"), (2, 0, None, None, 0, None)]
    st = spark.createDataFrame(rows, "page_id int, state_idx int, label string, provenance string, order int, markdown string")
    got = {r.page_id: r for r in blocks.render_pages(st).collect()}
    assert got[1].markdown == "# A\n\ntext\n\n**Tab:**\n\nmore" and got[1]["size"] == 3 and len(got[1].states) == 2 and got[2].markdown == ""
    assert {(r.page_id, r.state_idx): r.added for r in blocks.new_blocks(st).collect()} == {(1, 0): 2, (1, 1): 1, (1, 2): 0, (2, 0): 0}
    assert all(r.in_frame for r in blocks.frame_blocks(st).collect())


def packed(spark, docs, instruction, budget, scores=None):
    rows = [("r", i, name, size, text) for i, (name, size, text) in enumerate(docs)]
    d = spark.createDataFrame(rows, "request_id string, di long, filename string, bytes long, content string")
    got = retrieve.context_pack(d, spark.createDataFrame([("r", instruction, budget)], "request_id string, instruction string, budget int"), scores)
    return sorted((r["mode"], r.di, r.partial, r.content) for r in got.collect())


def test_retrieval_modes(spark):
    a = "intro\n# Prices\n" + "price list " * 60 + "\n# Other\n" + "zzz " * 100
    docs = [("a.md", 10, a), ("b.md", 77, "# Else\n" + "yyy " * 200)]
    assert packed(spark, docs, "show the prices", 900) == [("retrieval", 0, True, "# Prices\n" + ("price list " * 60).strip())]
    assert [r[0] for r in packed(spark, docs, "x", 10**6)] == ["full"] * 2
    assert [r[:2] for r in packed(spark, docs, "extract everything", 100)] == [("head", 0), ("head", 1)]
    assert [r[1] for r in packed(spark, docs, "what is in b.md", 1000)] == [1]
    assert [r[1] for r in packed(spark, docs, "what has 77 bytes", 1000)] == [1]
    scores = spark.createDataFrame([("r", 0, 2, 0.5), ("r", 1, 0, -1.0)], "request_id string, di long, si int, score double")
    assert packed(spark, docs, "prices", 900, scores) == [("retrieval", 0, True, "# Other\n" + ("zzz " * 100).strip())]
    assert packed(spark, [("a.md", 1, None)], "x", -1) == [("head", 0, False, None)]


def brute_pack(sizes, budget):
    left, out = budget, []
    for i, n in enumerate(sizes):
        if left < retrieve.SLACK:
            break
        if n <= left or not out:
            out.append((i, min(n, left)))
            left -= min(n, left)
    return out


def test_budget_pack(spark):
    r = random.Random(2)
    rows = [(k, [(i, r.randint(1, 900)) for i in range(r.randint(0, 12))], r.randint(100, 3000)) for k in range(200)]
    df = spark.createDataFrame(rows, "k int, ranked array<struct<i:int,size:int>>, budget int")
    got = {x.k: [(t.of.i, t.take) for t in x.p] for x in df.select("k", retrieve.budget_pack(F.col("ranked"), F.col("budget")).alias("p")).collect()}
    assert got == {k: brute_pack([n for _, n in own], budget) for k, own, budget in rows}


def test_context_pack(spark):
    docs = spark.createDataFrame([("r", 0, "a.md", 5, "# Prices\nprice " * 40), ("r", 1, "b.md", 6, "# Z\nzz " * 90)], "request_id string, di long, filename string, bytes long, content string")
    req = spark.createDataFrame([("r", "prices", 700)], "request_id string, instruction string, budget int")
    got = retrieve.context_pack(docs, req).collect()
    assert {r.mode for r in got} == {"retrieval"} and [r.filename for r in got] == ["a.md"]


def test_fidelity_banner(spark):
    rows = [(1, "has `alpha_beta` and 77", ["alpha_beta"], ""), (2, "nothing", [], "")]
    v = retrieve.verify(spark.createDataFrame(rows, "id int, markdown string, sources array<string>, allow string"))
    v = v.withColumn("banner", retrieve.fidelity_banner(F.col("total"), F.col("unverified")))
    v = v.withColumn("back", retrieve.strip_fidelity_banner(F.concat("banner", "markdown")))
    a, b = v.orderBy("id").collect()
    assert (a.total, a.verified, a.unverified, a.ratio) == (2, 1, ["77"], 0.5) and "`77`" in a.banner and a.back == a.markdown
    assert b.ratio == 1 and b.banner == ""


def test_prune_and_verdicts(spark):
    l = spark.createDataFrame([(1, 0, 0.0), (1, 1, 1.0), (2, 0, 0.0)], "page_id int, pos int, score double")  # noqa: E741
    assert sorted((r.page_id, r.pos, r.kept) for r in links.pruned(l, 0.5).collect()) == [(1, 0, False), (1, 1, True), (2, 0, True)]
    x = spark.createDataFrame([(1, 0, i) for i in range(3)] + [(2, 0, 0), (3, 0, 0), (4, 0, 0)], "page_id int, batch int, index int")
    v = spark.createDataFrame([(1, 0, [2]), (2, 0, []), (3, 0, [9])], "page_id int, batch int, keep array<int>")
    got = {(r.page_id, r["index"]): r.follow for r in links.verdicts_applied(x, v).collect()}
    assert got == {(1, 0): False, (1, 1): False, (1, 2): True, (2, 0): False, (3, 0): True, (4, 0): True}


def test_batches(spark):
    rows = spark.createDataFrame([(1, i) for i in range(250)] + [(2, 0)], "page_id int, pos int")
    for kind, size in (("links", 160), ("controls", 100), ("texts", 64)):
        got = {(r.page_id, r.pos): (r.batch, r["index"]) for r in links.in_batches(rows, kind, "page_id", "pos").collect()}
        assert got == {(1, i): (i // size, i % size) for i in range(250)} | {(2, 0): (0, 0)}


def test_candidates_and_attempts(spark):
    link = "page_id int, href string, label string, context string"
    a, b = spark.createDataFrame([(1, "x", "A", "")], link), spark.createDataFrame([(1, "x", "B", ""), (1, "y", "C", "")], link)
    assert {(r.href, r.label, r.source) for r in links.all_links(a, b).collect()} == {("x", "A", 0), ("y", "C", 1)}
    urls = spark.createDataFrame([("https://s.example/a/",), ("https://s.example/a?utm_source=q",), ("https://o.example/",), ("mailto:a@b",)], "url string")
    assert [r.url for r in links.in_scope_unique(urls, "https://s.example/").collect()] == ["https://s.example/a"]
    tries = [("a", 0, 200, False), ("b", 0, 500, False), ("b", 1, 200, False), ("c", 0, 200, True), ("c", 1, 403, None), ("c", 2, 200, False)]
    got = links.attempts(spark.createDataFrame(tries, "url string, attempt int, status int, challenged boolean")).collect()
    assert {r.url: r.outcome for r in got} == {"a": "kept", "b": "retried", "c": "error"}
    long = "<p>" + "words " * 300 + "</p>"
    loads = [(1, long, True, "never"), (2, "<p>x</p>", True, "auto"), (3, None, True, "auto"), (4, long, True, "auto"), (5, long, True, "always"), (6, "x", False, "auto"), (7, None, False, "never")]
    df = links.html_loads(spark.createDataFrame(loads, "i int, body string, browser boolean, mode string"), F.col("mode"))
    assert {r.i: r.load for r in df.collect()} == {1: "static", 2: "browser", 3: "browser", 4: "static", 5: "browser", 6: "static", 7: "none"}


def test_residuals_and_priorities(spark):
    c = spark.createDataFrame([(1, "tab", 9000, "false"), (2, "accordion", 100, "false"), (3, "loadmore", None, "false"), (4, "tab", 50, "true")], "i int, kind string, hidden_payload int, expanded string")
    got = {r.i: r.p for r in c.select("i", metrics.reveal_priority(F.col("kind"), F.col("hidden_payload"), F.col("expanded")).alias("p")).collect()}
    assert got == {1: 400.0, 2: 202.0, 3: 100.0, 4: -999.0}


def test_texts_without_noise(spark):
    from weftline.functions import text

    md = "[![i](a)](b) x ![y](z) <img src=q> [t](u) <https://v.example/>  \n\n\n\nend"
    rows = spark.createDataFrame([(md, "---\na: 1\n---\n\nbody", "one\n\nfill feGaussianBlur x\n\ntwo", "a1b22")], "m string, f string, s string, d string")
    r = rows.select(
        text.apply_exclusions(F.col("m")).alias("none"), text.apply_exclusions(F.col("m"), images=True).alias("images"), text.apply_exclusions(F.col("m"), links=True).alias("links"),
        text.strip_front_matter(F.col("f")).alias("front"), text.strip_svg_noise(F.col("s")).alias("svg"), text.mask_digits(F.col("d")).alias("masked"),
        text.state_fingerprint(F.lit("1|2"), F.array(F.lit("a"), F.lit("b")), F.col("f")).alias("state"),
    ).first()
    assert r.none == md and "a)" not in r.images and "![y]" not in r.images and "<img" not in r.images and "[t](u)" in r.images
    assert "https" not in r.links and "](u)" not in r.links and r.links.endswith(" t\n\nend")
    assert r.front == "body" and r.svg == "one\n\ntwo" and r.masked == "a#b#" and len(r.state) == 16


def test_json_of_a_reply(spark):
    from weftline.functions import text

    rows = [(1, 'say {no} then\n```json\n{"keep": [1]}\n```'), (2, 'x {"keep": [2, 3]} y'), (3, "nothing"), (4, None), (5, "```\nnot json\n``` {\"keep\": []}")]
    df = spark.createDataFrame(rows, "i int, r string").select("i", text.first_json(F.col("r"), "keep array<int>")["keep"].alias("k"))
    assert {r.i: r.k for r in df.collect()} == {1: [1], 2: [2, 3], 3: None, 4: None, 5: []}


def test_index_and_document_files():
    docs = [{"id": "a", "title": "A", "file": "a.md", "url": "https://s.example/a"}, {"id": "b", "title": "", "file": "b.md", "url": ""}]
    index = assemble.index_file(docs, "T", "now")
    assert "# T" in index and "- [A](documents/a.md) — https://s.example/a" in index and "- [b](documents/b.md)\n" in index
    text = assemble.document_file("https://s.example/a", 'say "x"', "now", "body")
    assert text.startswith("---\nurl: ") and '\\"x\\"' in text and text.endswith("---\n\nbody\n")


def test_state_files(spark):
    state = "array<struct<label:string,provenance:string,order:int,markdown:string>>"
    rows = [("s", 1, [("", "baseline", 0, " a "), ("Tab", "tab:1", 1, "b"), ("", "menu", 2, None)]), ("s", 2, [("", "baseline", 0, "x")])]
    got = assemble.assemble_states(spark.createDataFrame(rows, f"scan_id string, seq int, states {state}")).collect()
    assert len(got) == 1 and [x for x in got[0].markdown.split("\n") if x.startswith("## ")] == ["## State: base", "## State: Tab", "## State: menu"]


def test_semantic_scores(spark):
    s = spark.createDataFrame([("r", 0, 0, [1.0, 0.0]), ("r", 0, 1, [0.0, 1.0]), ("q", 0, 0, [1.0, 1.0])], "request_id string, di int, si int, vector array<double>")
    q = spark.createDataFrame([("r", [1.0, 0.0])], "request_id string, vector array<double>")
    got = {(r.request_id, r.si): (r.score, r.c) for r in retrieve.semantic_scores(s, q).withColumn("c", retrieve.combined_score(F.when(F.col("score") > 0, F.col("score")), F.lit(0.25))).collect()}
    assert got == {("r", 0): (1.0, 1.0), ("r", 1): (0.0, 0.25), ("q", 0): (0.0, 0.25)}


def test_sections_kept(spark):
    s = spark.createDataFrame([(1, i, "x" * 700) for i in range(2)] + [(2, 0, "short")], "page_id int, index int, text string")
    v = spark.createDataFrame([(1, [1]), (2, [5])], "page_id int, keep array<int>")
    assert sorted((r.page_id, r["index"]) for r in links.sections_kept(s, v).collect()) == [(1, 1), (2, 0)]


def test_decide_follow(spark):
    c = spark.createDataFrame([(1, i, h, lab, "") for i, (h, lab) in enumerate([("https://x.example/prices", "Prices"), ("https://x.example/a", "About"), ("https://x.example/b", "Blog")])], "page_id int, pos int, href string, label string, context string")
    cache = spark.createDataFrame([(1, "https://x.example/b", True)], "page_id int, href string, follow boolean")
    got = {r.href[-1]: r.follow for r in links.decide_follow(c, cache, "find prices", False, least=0.5).collect()}
    assert got == {"s": True, "a": False, "b": True}


def test_frontier(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "d"), ("d", "e")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "url string")
    assert {r.url: r.depth for r in links.crawl_order(e, seeds).collect()} == {"a": 0, "b": 1, "c": 2, "d": 2, "e": 3}
    keep = spark.createDataFrame([("a",), ("b",), ("c",)], "url string")
    assert {r.url for r in links.crawl_order(e, seeds, expandable=keep).collect()} == {"a", "b", "c", "d"}


def test_incremental(spark):
    rows = [("a", "1", 1, 0, "", ""), ("b", "1", 1, 0, "e", ""), ("c", "", 2, 0, "e", ""), ("d", "1", 1, 5, "e", ""), (None, "1", 1, 0, "", "")]
    b = spark.createDataFrame(rows, "url string, lastmod string, states int, residual int, http_etag string, http_last_modified string")
    m = incremental.lastmod_map(spark.createDataFrame([("a", "0", 0), ("a", "1", 1), ("b", "2", 0), ("d", "", 0)], "url string, lastmod string, pos int"))
    p = incremental.plan(b, m)
    assert {r.url: r.action for r in p.collect()} == {"a": "reuse", "b": "check", "c": "recrawl", "d": "recrawl"}
    c = incremental.conditional(p, spark.createDataFrame([("b", 304, "new", "")], "url string, status int, etag string, last_modified string"))
    assert {r.url: (r.action, r.http_etag) for r in c.collect()}["b"] == ("reuse", "new")
    same = spark.createDataFrame([("c", "h")], "url string, hash string")
    assert list(incremental.report(c, same).first()) == [2, 1, 1, 2, 1]


def test_metrics(spark):
    u = spark.createDataFrame([("s", "a", 1, 10, 5, 4), ("s", "b", 1, 0, 5, 0), ("t", "a", 1, 10, 0, 0)], "scan_id string, kind string, calls long, input_tokens long, output_tokens long, cached_input_tokens long")
    assert [(r.kind, r.total, r.share) for r in metrics.token_breakdown(u).orderBy("rank").collect()] == [("a", 25, 0.833), ("b", 5, 0.167)]
    assert metrics.cached_share(u).first().cached_share == 0.2
    t = spark.createDataFrame([("Alpha  beta",)], "text string")
    sn = spark.createDataFrame([(1, "alpha BETA"), (2, "gamma"), (3, " ")], "id int, snippet string")
    assert {r.id: r.found for r in metrics.containment(t, sn).collect()} == {1: True, 2: False}
    assert metrics.coverage(sn.limit(0).withColumn("found", F.lit(True))).first().ratio == 1.0
    none = spark.createDataFrame([], "found boolean")
    r = metrics.task_respect(none, none).first()
    assert r.recall is None and r.precision is None and r.f1 is None


def test_assembly(spark):
    rows = [("s", 1, "get the prices", "https://www.x.example/a", "A", "body a", "t"), ("s", 2, "get the prices", "https://x.example/a/", "B", "# own\nb", "t"), ("s", 3, "get the prices", "https://x.example/", "", "  ", "t"), ("u", 1, "", "https://www.y.example/", "Y", "y", "t")]
    p = spark.createDataFrame(rows, "scan_id string, seq int, task string, url string, title string, markdown string, fetched_at string")
    got = {r.scan_id: r for r in assemble.assemble_scan(p, "now").collect()}
    assert got["s"].filename == "prices.md" and got["s"].title == "Prices" and got["u"].filename == "y-example.md"
    assert "# A\n\n_Source: https://www.x.example/a_\n\nbody a\n\n---\n\n_Source: https://x.example/a/_\n\n# own\nb\n" in got["s"].markdown
    assert got["u"].markdown.endswith("---\n\ny\n") and got["s"].markdown.startswith('---\ntask: "get the prices"\ngeneratedAt: now\nsources:\n  - https://www.x.example/a\n')
    ids = [r.id for r in assemble.assemble_documents(p).filter("scan_id = 's'").orderBy("seq").collect()]
    assert ids == ["a", "a-2"]


def test_tiers_of_groups_that_span_batches(spark):
    r = random.Random(9)
    rows = [(r.choice(["s", None]), i, f"https://h{r.randint(0, 9)}/p", f"h{i}", r.choice(["/p", "/q", "", None]), r.choice([0, 3, 0xFFFF, 0xF0F0F0F0F0])) for i in range(80)]
    p = spark.createDataFrame(rows, "scan_id string, seq int, url string, hash string, sibling_key string, fingerprint long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {x.seq: x.fate for x in dedup.tiers(p).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {}
    for scan in ("s", None):
        own = [x for x in rows if x[0] == scan]
        want |= dict(zip((x[1] for x in own), dedup.decide([x[1:] for x in own], 8, 0, None), strict=True))
    assert got == want


def test_scan_texts(spark):
    rows = [("s", 2, "", "https://x.example/b", "B", " # own\nb "), ("s", 1, "", "https://x.example/a", "A", "b\u00f6dy a\n"), ("s", 3, "", "https://x.example/a", "", "  "), ("u", 1, "", "https://y.example/", "Y", "y"), (None, 1, "t", "https://z.example/", "", "z"), ("v", 1, "", "", "", None)]
    p = spark.createDataFrame(rows, "scan_id string, seq int, task string, url string, title string, markdown string").repartition(3)
    whole = {r.scan_id: r for r in assemble.assemble_scan(p, "now").collect()}
    got = {r.scan_id: r for r in assemble.scan_texts(p).collect()}
    assert set(got) == set(whole) == {"s", "u", None}
    for scan, r in whole.items():
        text = re.sub(r"(?s)\A---\n.*?\n---\n\n|\n\Z", "", r.markdown)
        assert (got[scan].filename, got[scan].sources) == (r.filename, len(r.pages))
        assert (got[scan].chars, got[scan].sha1) == (len(text), hashlib.sha1(text.encode()).hexdigest())
    given = {r.scan_id: r for r in assemble.scan_texts(p, as_given=True).collect()}
    assert given["u"].chars == len("# Y\n\n_Source: https://y.example/_\n\ny") and given["v"].chars is None and given["v"].sources == 0


def test_assemble_scan_of_odd_rows_is_the_sql(spark, tmp_path):
    texts = ["", "   ", None, "# own head\nx", "\x0btab ", "x \u0085", " \u2028y", "\n\n z\n", "a b", "$1 \\ &"]
    rows = [(i, t, f"src{i % 2}") for i, t in enumerate(texts)] + [(20, "alone", "src7"), (21, None, "src8"), (22, "no source", None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    found = [tuple(r) for r in QUERIES["assemble_scan"](spark, str(tmp_path)).collect()]
    assert sorted(found, key=repr) == sorted(duck.execute(ORACLES["assemble_scan"]).fetchall(), key=repr)


def test_catalog(spark, tmp_path):
    rec = lambda u: json.dumps({"page": {"url": u, "markdown": "x"}, "links": ["l"]})
    (tmp_path / "j.jsonl").write_text(rec("a") + "\n\n" + rec("b") + '\n{"page": {"url": "c", "mark')
    j = catalog.read_journal(spark, str(tmp_path / "j.jsonl"))
    assert sorted(r.page.url for r in j.collect()) == ["a", "b"]
    pages, seeds = dedup.replayed(j.select(F.lit("s").alias("scan_id"), F.monotonically_increasing_id().alias("seq"), "page", "links"))
    assert pages.count() == 1 and seeds.count() == 1
    with pytest.raises(ValueError):
        catalog.run_path("/r", "../x")
    assert catalog.sanitized({"a": 1, "apiKey": "s", "__x": 2}) == {"a": 1}
    assert catalog.read_targets('﻿["u", {"url": "v", "task": "t"}, {}]', "d") == [("u", "d"), ("v", "t")]
    catalog.write_run(spark, str(tmp_path / "runs"), {"id": "r1", "createdAt": "2024", "url": "u", "pages": 3, "options": {"token": "x"}})
    r = catalog.read_runs(spark, str(tmp_path / "runs")).first()
    assert r.id == "r1" and r.scans[0].pages == 3
    assert catalog.delete_run(spark, str(tmp_path / "runs"), "r1")


def test_sitemaps(spark):
    one = "<urlset><url><loc> https://x/a </loc></url></urlset>"
    many = "<urlset><url><loc>https://x/a</loc><lastmod>2</lastmod></url><url><loc>https://x/b</loc><lastmod>1</lastmod></url></urlset>"
    index = "<sitemapindex><sitemap><loc>m1</loc></sitemap><sitemap><loc>m2</loc></sitemap><sitemap><loc>root</loc></sitemap></sitemapindex>"
    docs = spark.createDataFrame([("root", index), ("m1", one), ("m2", many)], "url string, xml string")
    assert {r["loc"]: r.lastmod for r in catalog.collect_sitemaps(docs, ["root"]).collect()} == {"https://x/a": "", "https://x/b": "1"}


def test_llms(spark):
    body = "# One\nSource: https://x.example/one\n" + "text " * 80 + "\n# Two\n" + "more " * 60
    docs = spark.createDataFrame([("https://x.example", body), ("https://y.example", "<!doctype html>" + body), ("https://z.example", "short")], "origin string, text string")
    got = [(r.url, r.title) for r in catalog.split_llms(docs).orderBy("pos").collect()]
    assert got == [("https://x.example/one", "One"), ("https://x.example/#two", "Two")]


def test_near_pairs_never_broadcasts(spark):
    """What is broadcast goes through the driver; keys are twenty times what their classes are, whatever size is guessed."""
    df = spark.createDataFrame([(i, 7 * i) for i in range(50)], "id int, fingerprint long")
    out = dedup.near_pairs(df)
    assert out.count() > 0
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_greedy_pass_over_many_kin():
    """A page is compared with all its kin at once: the time of a path with thousands of pages stays small."""
    r = random.Random(9)
    rows = [(i, f"u{i % 7}", f"h{i}", "/p", r.getrandbits(64) - (1 << 63)) for i in range(12_000)]
    rows += [(12_000, "u1", "x", "/p", rows[5][4]), (12_001, "u0", "y", "/p", rows[7][4])]
    began = time.time()
    fates = dedup.decide(rows, 8, 0, None)
    assert time.time() - began < 6
    assert fates[-2:] == ["mirror", "keep"] and set(fates[:-2]) == {"keep"}


def test_fingerprinted_reads_a_text_once(spark):
    p = spark.createDataFrame([("s", 1, "https://a/x", "Some [t](https://x) https://y\n text")], "scan_id string, seq int, url string, markdown string")
    out = dedup.fingerprinted(p)
    assert out.first().fingerprint == fingerprint("some text")
    assert "sha1(cast(_signature#" in out._jdf.queryExecution().executedPlan().toString()  # what hash and fingerprint share is made once
