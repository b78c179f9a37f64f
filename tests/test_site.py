import json

import pytest
from pyspark.sql import functions as F

from weftline import cli, scratch, sql
from weftline.functions import html
from weftline.functions.options import Options, api_base, new_run_id
from weftline.operators import pages
from weftline.plans import site
from weftline.plans.queries import QUERIES
from weftline.sources import bundle, catalog


def test_options():
    assert Options.of(mode="").mode == "auto" and Options.of(mirror_hamming=99).mirror_hamming == 64 and Options.of(max_pages=0).max_pages is None
    for bad in ({"mode": "x"}, {"mode": "targeted", "no_ai": True}, {"no_ai": True, "task": "t"}, {"no_ai": True, "min_relevance": 0.1}):
        with pytest.raises(ValueError):
            Options.of(**bad)
    assert api_base("http://x/") == api_base("http://x/v1") == "http://x/v1" and len(new_run_id()) > 10


def _fetched(spark):
    body = lambda t: f"<main><h1>{t}</h1><p>{(t + ' is told at length here. ') * 12}</p><a href='/{t}'>x</a></main>"
    rows = [
        ("s", 1, "t", "https://x.example/a", 200, "", body("alpha"), "n"), ("s", 2, "t", "https://x.example/b?utm_source=q", 200, "", body("alpha"), "n"),
        ("s", 3, "t", "https://other.example/", 200, "", body("beta"), "n"), ("s", 4, "t", "https://x.example/c", 403, "", "<p>Just a moment</p>", "n"),
        ("s", 5, "t", "https://x.example/d", 404, "", "<p>not found</p>", "n"), ("s", 6, "t", "https://x.example/e", 200, "", body("gamma"), "n"),
    ]
    return spark.createDataFrame(rows, "scan_id string, seq int, task string, url string, status int, mitigated string, html string, fetched_at string")


def test_run_and_bundle(spark, tmp_path):
    out = site.run(_fetched(spark), "https://x.example/", Options.of(per_document=True), "now")
    assert {r.seq: r.fate for r in out.fates.collect()} == {1: "keep", 2: "exact", 6: "keep"}
    assert {r.dst for r in out.links.collect()} == {"https://x.example/alpha", "https://x.example/gamma"}
    assert bundle.write_bundle(spark, str(tmp_path), "r1", out.files, out.documents) == 3
    assert (tmp_path / "r1" / "t.md").read_text().startswith("---\ntask:") and (tmp_path / "r1" / "documents" / "a.md").exists()
    lines = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "r1" / "documents.jsonl")).collect()]
    assert {x["id"] for x in lines} == {"a", "e"}


def test_resumed(spark):
    page = spark.createDataFrame([("s", 0, "t", "https://x.example/z", "Z", "# alpha\n\n" + "alpha is told at length here. " * 12)], "scan_id string, seq int, task string, url string, title string, markdown string")
    meta = F.expr(f"CAST(NULL AS {catalog.META})")
    rec = page.select("scan_id", "seq", F.struct("url", "task", "title", "markdown", F.expr(f"CAST(NULL AS array<{catalog.STATE}>)").alias("states"), meta.alias("meta")).alias("page"), F.array(F.lit("l")).alias("links"))
    out = site.run(_fetched(spark), "https://x.example/", Options.of(), "now", rec)
    assert {r.seq: r.fate for r in out.fates.collect()}[0] == "keep"


def test_refresh_and_report(spark):
    b = spark.createDataFrame([("a", "1", 1, 0, "", "", "h")], "url string, lastmod string, states int, residual int, http_etag string, http_last_modified string, content_hash string")
    sm = spark.createDataFrame([("a", "1", 0)], "url string, lastmod string, pos int")
    none = spark.createDataFrame([], "url string, status int, etag string, last_modified string")
    planned, report = site.refresh(b, sm, none, spark.createDataFrame([], "url string, hash string"))
    assert planned.first().action == "reuse" and report.first().reused == 1
    spec = spark.createDataFrame([("reveal", 1, "hello"), ("include", 2, "hello"), ("exclude", 3, "bad")], "kind string, id int, snippet string")
    text = site.evaluation(spark.createDataFrame([("Hello you",)], "text string"), spec, sm.select("url"), sm.select("url"))
    assert "recall" in text and "100.0 %" in text


def test_pages(spark):
    b = pages.enriched_blocks(spark.createDataFrame([(1, "# A\n\nx\n\n## B\n\n- l")], "page_id int, markdown string")).orderBy("ord").collect()
    assert [(r.type, list(r.section_path)) for r in b] == [("heading", []), ("text", ["A"]), ("heading", ["A"]), ("list", ["A", "B"])]
    blocks = spark.createDataFrame([(1, "Keep  me"), (1, "drop")], "page_id int, text string")
    assert [r.text for r in pages.scoped_blocks(blocks, spark.createDataFrame([(1, "keep me")], "page_id int, markdown string")).collect()] == ["Keep  me"]
    r = spark.range(1).select(pages.same_targets(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("a"), F.lit("a"))).alias("x"), pages.same_targets(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("y")).first()
    assert r.x and not r.y
    routes = spark.createDataFrame([(1, "/a"), (1, "/b")], "page_id int, href string")
    assert [r.href for r in pages.candidate_routes(routes, routes.filter("href = '/a'")).collect()] == ["/b"]


def test_sql(spark):
    sql.register(spark)
    assert spark.sql("SELECT normalize_url('https://X.example/a/') AS u, simhash('') AS h").first().u == "https://x.example/a"
    assert spark.sql("SELECT * FROM split_sections('# A\n\ntext')").count() == 1
    assert spark.sql("SELECT t.v FROM VALUES ('see `foo_bar`') AS x(md), LATERAL extract_atoms(x.md) AS t(o, v, k)").first().v == "foo_bar"


def test_sessions(spark, tmp_path):
    assert bundle.read_session(spark, str(tmp_path), "r1", "s") == {"messages": [], "files": []}
    bundle.save_session(spark, str(tmp_path), "r1", "s", {"messages": [{"role": "user", "content": "hi"}], "files": []})
    assert bundle.read_session(spark, str(tmp_path), "r1", "s")["messages"][0]["content"] == "hi"


def test_cli(spark, sf, tmp_path, capsys):
    _fetched(spark).write.parquet(str(tmp_path / "f"))
    assert cli.main(["corpus", str(tmp_path / "f"), "--base", "https://x.example/", "--out", str(tmp_path), "--run", "r9", "--generated-at", "now"]) == 0
    assert cli.main(["runs", "path", str(tmp_path), "r9"]) == 0 and cli.main(["query", "nonsense", sf]) == 2
    assert cli.main(["runs", "rm", str(tmp_path), "r9"]) == 0 and not (tmp_path / "r9").exists()


def test_site_corpus_parses_each_page_once(spark, sf):
    df = QUERIES["site_corpus"](spark, sf)
    assert "ArrowEvalPython" not in df._jdf.queryExecution().executedPlan().toString()
    html_pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert df.agg(F.sum("pages")).first()[0] == html_pages.count()


def test_first_elements_come_from_one_pass():
    root = html.tree("<title>t</title><div class='x content' id='main'><article>a</article></div><main role='main'><article>b</article><h1>h</h1></main><body><p id='content'>")
    found = html._firsts(list(root.walk()))
    assert all(found.get(s) is html._first(root, s) for s in html._WHOLE) and found["main article"].text() == "b"
    n = html.tree("<p>ab <b>cd</b>\x1c e</p>")
    assert n.brief(7) == n.text() == "ab cd e" and n.brief(6) is None
    m = html._Measures(n, "")
    assert m.length(0, len(n.raw())) == 7 and m.length(1, 4) == 3


def test_run_parses_each_page_once_and_streams_groups(spark, monkeypatch):
    plans = {}

    def kept(df, what, codec="snappy"):
        plans[what] = df._jdf.queryExecution().executedPlan().toString()
        return scratch.materialise(df, what, codec)

    monkeypatch.setattr(site, "materialise", kept)
    out = site.run(_fetched(spark), "https://x.example/", Options.of(), "now")
    parses = [x for x in plans["extracted"].splitlines() if "ArrowEvalPython" in x and "(html#" in x]
    assert len(parses) == 1 and "FlatMapGroupsInPandas" not in plans["fates"]
    assert "Python" not in out.fates._jdf.queryExecution().executedPlan().toString()  # written: both its readers read that
    assert {r.seq: r.fate for r in out.fates.collect()} == {1: "keep", 2: "exact", 6: "keep"}
