import random
import re
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftline.functions import guards, html, markdown, relevance, robots, simhash, text, udfs, url


@pytest.mark.parametrize(
    ("raw", "base", "want"),
    [
        ("https://Example.com/a/b/#top", None, "https://example.com/a/b"),
        ("https://example.com", None, "https://example.com/"),
        ("https://example.com/#/contact", None, "https://example.com/#/contact"),
        ("https://example.com/p#!x", None, "https://example.com/p#!x"),
        ("../c?utm_source=x&tab=2", "https://example.com/a/b", "https://example.com/c?tab=2"),
        ("//cdn.example.com:443/x", "https://example.com/", "https://cdn.example.com/x"),
        ("https://example.com/a?_ga_123=4&mc_x=1", None, "https://example.com/a"),
        ("https://example.com/a b?q=ü", None, "https://example.com/a%20b?q=%C3%BC"),
        ("https://example.com/https://other.site/x", None, None),
        ("https://example.com/web/1/https://other.site/x", None, "https://example.com/web/1/https://other.site/x"),
        ("mailto:x@example.com", None, None),
        ("/x", None, None),
        ("", "https://example.com/a?b=1", "https://example.com/a?b=1"),
        ("https://example.com/a/./b/../c/", None, "https://example.com/a/c"),
        ("http://", None, None),
        (None, None, None),
    ],
)
def test_canonical(raw, base, want):
    assert url.canonical(raw, base) == want


def test_canonical_is_idempotent():
    r = random.Random(1)
    for _ in range(3000):
        raw = "https://h.example/" + "".join(r.choice("ab/.%2e?&=#!~ ü+") for _ in range(r.randint(0, 20)))
        once = url.canonical(raw)
        assert once is None or url.canonical(once) == once, raw


def _one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_url_expressions(spark):
    u = lambda x: F.lit(x)
    r = _one(
        spark,
        url.sibling_key(u("https://x.example/en-us/docs/")),
        url.sibling_key(u("https://x.example/en")),
        url.sibling_key(u("nonsense")),
        url.same_site(u("https://docs.x.example/a"), u("https://x.example/")),
        url.same_site(u("https://x.example/a"), u("https://docs.x.example/")),
        url.same_site(u("https://evilx.example/a"), u("https://x.example/")),
        url.in_scope(u("https://x.example/a"), u("https://x.example/"), exclude="/a"),
        url.in_scope(u("https://other.example/a"), u("https://x.example/"), include="other"),
        url.in_scope(u("https://x.example/a"), u("https://x.example/"), include="("),
        url.under_prefix(u("https://x.example/docs/a"), u("/docs")),
        url.under_prefix(u("https://x.example/docsy"), u("/docs")),
        url.scan_id(F.lit(3), u("https://www.x.example/")),
        url.host_suffixes(u("https://a.b.c/")),
    )
    assert list(r) == ["/docs", "/", "", True, False, False, False, True, True, True, False, "03-www-x-example", ["a.b.c", "b.c", "c"]]


def test_text_expressions(spark):
    r = _one(
        spark,
        text.page_signature(F.lit("  [a](b) See  ![i](j) https://x.example/q  THIS ")),
        text.page_signature(F.lit(None).cast("string")),
        text.content_word_len(F.lit("# Hi [link](u) ![i](j) <https://x.example> there")),
        text.slug(F.lit("  Ünïcode & Co! ")),
        text.slug(F.lit("!!!")),
        text.strip_images(F.lit("a [![x](y)](z) b ![p](q)  \nc")),
        text.strip_links(F.lit("a [b](c) <https://x.example>")),
        text.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0), F.lit(9.0))),
        text.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))),
        text.shingle_features(F.lit("One two, three")),
        text.shingle_features(F.lit("one")),
    )
    assert list(r)[:7] == ["see this", "", 8, "n-code-co", "section", "a  b\nc", "a b"]
    assert round(r[7], 6) == round(0.5**0.5, 6) and r[8] == 0 and r[9] == ["one two", "two three"] and r[10] == ["one"]


def test_classify_block(spark):
    cases = {"# H": "heading", "```\nx": "code", "| a |\n|---|": "table", "- a\n- b": "list", "![a](b)": "image", "plain ![a](b) text": "text", "": "text"}
    df = spark.createDataFrame(list(cases.items()), "t string, want string")
    for row in df.select("want", text.classify_block(F.col("t"))["type"].alias("got")).collect():
        assert row.got == row.want


def test_simhash_properties():
    base = " ".join(f"word{i} text{i % 7}" for i in range(200))
    near = base.replace("word5 ", "other ")
    far = " ".join(f"quite{i} different{i % 11}" for i in range(200))
    bits = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    f = simhash.fingerprint
    assert f(base) == f(base.upper()) and bits(f(base), f(near)) <= 8 and bits(f(base), f(far)) >= 16
    assert f("") == f(None) == f("日本") == 0


def _reference_hash(s, seed):
    m, h = 0xFFFFFFFF, seed
    for c in s.encode("utf-16-le")[::2]:
        k = c * 0xCC9E2D51 & m
        k = (k << 15 | k >> 17) & m
        h ^= k * 0x1B873593 & m
        h = (h << 13 | h >> 19) & m
        h = (h * 5 + 0xE6546B64) & m
    h ^= len(s)
    h = (h ^ h >> 16) * 0x85EBCA6B & m
    h = (h ^ h >> 13) * 0xC2B2AE35 & m
    return h ^ h >> 16


def test_simhash_single_feature():
    v = _reference_hash("token", simhash.SEED_HIGH) << 32 | _reference_hash("token", simhash.SEED_LOW)
    assert simhash.fingerprint("token") & (2**64 - 1) == v


def test_tokens():
    assert relevance.tokenize("getUserName Menù 2024 the perché") == ["user", "name", "menu", "perche"]
    assert relevance.tokenize("提取价格x1") == ["提取", "取价", "价格", "x1"]
    assert relevance.task_terms("extract everything") == []


def test_link_score(spark):
    own = F.array(F.lit("prices"), F.lit("menu"), F.lit("abc"))
    r = _one(spark, relevance.link_score(["price", "menus"], own), relevance.link_score(["ab"], own), relevance.link_score([], own))
    assert list(r) == [1.0, 0.0, 1.0]


def test_challenge(spark):
    sig = lambda **k: guards.challenge_signal(F.lit(k.get("status", 200)), F.lit(k.get("mitigated", "")), F.lit(k.get("html", "")), F.lit(k.get("n", 10)))
    r = _one(
        spark, sig(mitigated="challenge"), sig(html="x cdn-cgi/challenge-platform"), sig(html="Just a moment", status=403), sig(html="Just a moment"),
        sig(html="just a moment <meta http-equiv='refresh'>"), sig(html="hcaptcha.com/1/api.js", n=900),
    )
    assert list(r) == ["header", "widget", "interstitial", None, "interstitial", None]
    r = _one(spark, *[guards.challenge_backoff_ms(F.lit(x).cast("string")) for x in ("3", "99", None, "soon")])
    assert list(r) == [3000, 15000, 2500, 2500]


def test_consent(spark):
    rows = [
        (1, "Accept all", 10, "We use cookies", ""), (2, "Reject all", 5, "We use cookies", ""), (3, "Cookie policy", 90, "We use cookies", "/policy"),
        (4, "Subscribe", 99, "Join us", ""), (5, "No thanks", 1, "Join us", ""), (6, "Buy", 9, "Offer", ""), (7, "Zurr", 3, "privacy", ""), (8, "Blub", 8, "privacy", ""),
    ]
    df = spark.createDataFrame(rows, "id int, label string, area int, overlay_text string, href string")
    assert {r.overlay_text: r.id for r in guards.pick_consent(df).collect()} == {"We use cookies": 2, "Join us": 5, "privacy": 8}


def test_robots(spark):
    body = "User-agent: bot\nUser-agent: weft\nDisallow: /a\nAllow: /a/b\nCrawl-delay: 2\n\nUser-agent: *\nDisallow: /\n"
    assert robots.applicable(body, "weftline/1") == ([("disallow", "/a"), ("allow", "/a/b")], 2.0)
    assert robots.applicable(body, "other")[0] == [("disallow", "/")]
    assert robots.applicable("", "x") == ([], None)
    urls = spark.createDataFrame([("u1", "o", "/a/x"), ("u2", "o", "/a/b/c"), ("u3", "o", "/z.html"), ("u4", "p", "/a")], "url string, origin string, path string")
    rules = spark.createDataFrame([("o", body + "# x\n")], "origin string, text string").select("origin", robots.rules_of(F.col("text"), "weft").alias("rules"))
    assert {r.url: r.allowed for r in robots.allowed(urls, rules).collect()} == {"u1": False, "u2": True, "u3": True, "u4": True}


def test_pacing(spark):
    rows = [("h", 0, 0, 100), ("h", 1, 10, 100), ("h", 2, 500, 100), ("h", 3, 510, 100), ("g", 0, 5, 0)]
    a = spark.createDataFrame(rows, "host string, i int, arrival_ms long, delay_ms long")
    assert sorted((r.host, r.i, r.start_ms) for r in robots.pacing(a).collect()) == [("g", 0, 5), ("h", 0, 0), ("h", 1, 100), ("h", 2, 500), ("h", 3, 600)]


PAGE = """<html><head><title>T</title></head><body><nav><a href="/x">x</a></nav><main><article>
<h1>Title</h1><p>Some <b>bold</b> and <em>soft</em> text with a <a href="../y?a=1#z">link</a>.</p>
<pre><code class="language-py">def f():

    return 1
</code></pre><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>x|y</td></tr><tr><td>2</td></tr></table>
<ul><li>one<ul><li>two</li></ul></li></ul><div class="ad-banner">buy</div>
<ul class=more><li><a href=/1>first other page</a></li><li><a href=/2>second other page</a></li><li><a href=/3>third</a></li><li><a href=/4>fourth</a></li></ul>
</article></main><footer>foot</footer><script>var r=["/api/users","/x.js"]</script></body></html>"""


def test_extract_markdown():
    title, md = html.extract_markdown(PAGE, "https://s.example/d/p")
    assert title == "Title"
    for part in ("# Title", "**bold**", "_soft_", "[link](https://s.example/y?a=1#z)", "```py\ndef f():\n\n    return 1\n```", "| a | b |\n| --- | --- |\n| 1 | x\\|y |\n| 2 |  |", "- one\n  - two"):
        assert part in md, md
    for part in ("foot", "buy", "second other page", "/api/users"):
        assert part not in md
    assert html.extract_markdown(None) == ("", "") and html.extract_markdown("") == ("", "")


def test_visual_headings():
    _, md = html.extract_markdown('<article><div style="font-size:32px">Big</div><p>long text of the body here, and more of it</p><span style="font-weight:700">Bold line</span></article>')
    assert "## Big" in md and "#### Bold line" in md


def test_links_and_routes():
    assert html.page_links(PAGE, "https://s.example/d/p")[0] == ("https://s.example/x", "x")
    assert html.mined_routes(PAGE, "https://s.example/d/p") == ["https://s.example/api/users"]


def test_markdown_structure():
    md = "intro\n\n# A\ntext\n\n```\n# not\n\nx\n```\n## B ##\n| a | b |\n|--|\n| 1 |\n||\n"
    assert markdown.split_blocks(md)[:3] == ["intro", "# A\ntext", "```\n# not\n\nx\n```"]
    assert [h for h, _ in markdown.sections(md)] == ["(intro)", "A", "B ##"]
    assert markdown.headings(md) == [(1, "A"), (2, "B")]
    assert markdown.section_paths(["# A", "x", "## B", "y", "# C"]) == [[], ["A"], ["A"], ["A", "B"], []]
    assert markdown.repair_tables("| a | b |\n|--|\n| 1 |\n||") == "| a | b |\n| --- | --- |\n| 1 |  |"
    assert markdown.cleanup_lines("a  b\nEdit this page\n\n\n\n##\n](u)\nc") == "a b\n\nc"


def test_atoms_and_fidelity(spark):
    md = "Costs $1,299 or 15%. Use `foo bar` and 'short one' at https://x.example/a.\n```\nlet value = 1;\n```\n1. item 42"
    kinds = {v: k for v, k in markdown.atoms(md)}
    assert kinds == {"let value = 1;": "code-line", "foo bar": "code", "https://x.example/a": "url", "short one": "string", "$1,299": "number", "15%": "number", "42": "number"}
    rows = [
        (1, md, ["1299 and 15 % of foo   BAR, let value = 1;", "short one"], "https://x.example/a"), (2, "no values", [], None), (3, None, None, None),
        (4, "`a\\_b` and `a_c`", ["a_b"], ""), (5, "1 234 567 and 89 and 1.5", ["1,234.567", "1 . 5"], "89"),
    ]
    df = spark.createDataFrame(rows, "i int, md string, sources array<string>, allow string")
    got = {r.i: (r["_total"], r["_unverified"]) for r in markdown.checked(df, F.col("md"), F.col("sources"), F.col("allow")).collect()}
    assert got == {1: (7, ["42"]), 2: (0, []), 3: (0, []), 4: (2, ["a_c"]), 5: (4, [])}


def test_hidden_text_and_controls(spark):
    from weftline.functions import controls
    from weftline.operators import metrics

    body = "a text that is long enough to count as hidden " * 4
    page = (
        f"<main><p>shown</p><details><summary>More 12</summary><p>{body}</p></details><div id=p1 hidden>{body}<div style='display:none'>{body}</div></div>"
        f"<div style='color:red; visibility : hidden'>short</div><div aria-hidden=true hidden>{body}</div><button aria-controls=p1 aria-expanded=false>Panel</button>"
        "<button>Show all</button><button>Copy</button><div role=tab aria-selected=true>One</div><select><option>x</option></select><details open><summary>Open</summary>y</details></main>"
    )
    total, found = controls.hidden_blocks(page)
    assert [n for n, _ in found] == [len(body.strip()), len((body + body).strip())] and total == sum(n for n, _ in found) and len(found[0][1]) == 140
    got = [(c["kind"], c["signature"], c["expanded"], c["hidden_payload"] > 0) for c in controls.page_controls(page)]
    assert got == [
        ("accordion", "accordion|more #", "false", True), ("expander", "expander|panel", "false", True), ("loadmore", "loadmore|show all", "false", False),
        ("tab", "tab|one", "true", False), ("dropdown", "dropdown|x", "false", False), ("accordion", "accordion|open", "true", False),
    ]
    assert controls.page_controls(None) == [] and controls.hidden_blocks("") == (0, []) and len(controls.page_controls("<button>show more</button>" * 400)) == 150
    df = spark.createDataFrame([(1, page, body), (2, page, "")], "i int, html string, markdown string").withColumn("h", controls.hidden_of(F.col("html")))
    df = df.select("i", "markdown", "h.*", controls.controls_of(F.col("html")).alias("c"))
    # what another state has shown isn't lost
    assert {r.i: (r.residual, len(r.c)) for r in metrics.truthful_residual(df).collect()} == {1: (0, 6), 2: (total, 6)}


def test_small_expressions(spark):
    from weftline.sources import catalog

    robots_txt = "User-agent: *\n sitemap : https://s.example/a.xml\nSitemap:https://s.example/b.xml"
    page = """<script>var a = "/api/users", b = "/x.js"</script>"""
    df = spark.createDataFrame([(robots_txt, page, "\n\n# A\nx", "Label", "Head", "https://s.example/some-page/b_c")], "r string, p string, m string, label string, context string, href string")
    r = df.select(
        catalog.robots_sitemaps(F.col("r")).alias("maps"), html.routes_of(F.col("p"), F.col("href")).alias("routes"), markdown.page_sections(F.col("m")).alias("sections"),
        relevance.link_text(F.col("label"), F.col("context"), F.col("href")).alias("text"), relevance.link_text(F.lit(""), F.lit(None).cast("string"), F.col("href")).alias("path"),
        simhash.is_near_dup(F.lit(0), F.lit(7), 3).alias("near"), simhash.is_near_dup(F.lit(0), F.lit(-1), 3).alias("far"),
    ).first()
    assert r.maps == ["https://s.example/a.xml", "https://s.example/b.xml"] and r.routes == ["https://s.example/api/users"]
    assert [(x.heading, x.text) for x in r.sections] == [("(intro)", ""), ("A", "# A\nx")] and r.text == "Label — Head — some page b c" and r.path == "some page b c"
    assert r.near and not r.far


def test_slug_of_long_texts(spark):
    """Only what the slug is made of is rewritten; the rest of a text costs nothing."""
    texts = ["x" * 80 + "-" * 9, "x" * 79 + " - y", "x" * 80 + " y", " " * 5000 + "A", "-" * 5000, "\u212a É" * 90, "a. " * 300]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.slug(F.col("t")).alias("s"))
    for t, s in df.collect():
        assert s == (re.sub("[^A-Za-z0-9_]+", "-", t.lower()).strip("-")[:80] or "section")
    began = time.time()
    long = spark.range(10).select(F.repeat(F.lit("word, "), 200_000).alias("t")).select(F.max(text.slug(F.concat("t", F.lit("!")))).alias("s"))
    assert len(long.first().s) == 80 and time.time() - began < 8


def test_signature_white_space(spark):
    texts = ["a  b\u00a0\tc", " \u3000x\u2003 y ", "\ufeffA [l](u)  https://h/x\u2028z", "caf\u00e9 \u2013 ok", "\u1680\u205f", "![i](j)", "a\u202fb"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.page_signature(F.col("t")).alias("s"))
    for t, s in df.collect():
        t = re.sub(rf"https?://[^{text.SPACE}]+", "", re.sub(text.LINK_OR_IMAGE, "", t))
        assert s == re.sub(text.SPACES, " ", t).strip(" ").lower()


def test_fingerprints_against_the_definition():
    """Feature by feature, for texts of one token, of short runs only, of many features and of letters that lower case changes."""
    r = random.Random(8)
    texts = ["", "a", "ab", "ab c de", "\u0130ab x1", "-".join(r.choice(["the", "of", "x", "9z", "k\u00e9y"]) for _ in range(2000))]
    texts += ["".join(r.choice("ab1 Z.\u00e9\n") for _ in range(r.randint(0, 400))) for _ in range(50)]
    for shingle in (1, 2, 3):
        found = simhash.fingerprints(texts, shingle)
        for t, got in zip(texts, found, strict=True):
            w = re.findall("[a-z0-9]{2,}", t.lower())
            features = [" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] if len(w) >= shingle else w
            # of one feature alone the fingerprint is its hash
            bits = [int(simhash.fingerprints([f], len(f.split()))[0]) & (2**64 - 1) for f in features]
            want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in bits) > len(bits))
            assert int(got) & (2**64 - 1) == want


def test_arrow_functions_see_pieces(spark):
    """What a function makes of a batch is never held as a whole: it sees a megabyte or so at a time."""

    @udfs.arrow("struct<rows:int,chars:int,t:string>")
    def seen(t: pd.Series, n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"rows": [len(t)] * len(t), "chars": [sum(map(len, t.dropna()))] * len(t), "t": [f"{x[0]}{k}" if x else None for x, k in zip(t, n, strict=True)]})

    @udfs.arrow("array<string>")
    def halves(parts: pd.Series) -> pd.Series:
        return parts.map(lambda p: [x[:1] for x in p] if p is not None else None, na_action=None)

    text_of = F.when(F.col("id") % 7 == 3, None).otherwise(F.repeat(F.concat(F.col("id") % 10, F.lit("é")), 20_000))
    df = spark.range(0, 300, 1, 1).select("id", text_of.alias("t"))
    rows = df.select("id", seen(F.col("t"), F.col("id")).alias("x"), halves(F.array(F.lit("yy"), F.lit("zz"))).alias("h")).collect()
    assert [r.id for r in rows] == list(range(300))
    assert all(r.x.chars <= 1 << 20 and r.x.t == (None if r.id % 7 == 3 else f"{r.id % 10}{r.id}") for r in rows)
    assert max(r.x.rows for r in rows) < 60 and all(r.h == ["y", "z"] for r in rows)
    big = spark.range(1).select(halves(F.array(F.repeat(F.lit("ab"), 2_000_000), F.lit("q"))).alias("h"))
    assert big.first().h == ["a", "q"]
