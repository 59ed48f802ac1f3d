"""DOM, assets, fetching, rules and streams on fixtures."""

import datetime

import pytest

from pagequarry.functions import dom
from pagequarry.operators import assets, process, rules
from pagequarry.sources import seeds
from pagequarry.streaming import flow, limiter

RICH = """<html><head><title> Rich </title><title>More</title><meta name="description" content="D"><meta name="keywords" content="a, b,,c"><meta name="author" content="Au">
<meta property="og:title" content="OG"><meta property="og:type" content="article"></head><body><header>h</header><nav>n</nav><!-- <p>no</p> --><div class="ad">ad</div>
<main><h1>Head</h1><p>One <b>bold</b> and <i>it</i> <a href="/x">link</a><p>Two<ul><li>a<li>b<ol><li>c</ol></ul><img src="/i.png" alt="I"><img src="data:x"><img src="p.gif" width="1" height="1">
<table><tr><th>H1<th>H2<tr><td>1<td>2</table><pre>code  x
y</pre><blockquote>q</blockquote><hr><code>c</code></main><aside>s</aside><footer>f</footer><script>var a = "<p>"</script></body></html>"""

ASSETS = """<img src="/a.png"><img src="/a.png"><img srcset="b.png 1x, c.png 2x"><picture><source srcset="d.webp 480w"></picture><video src="v.mp4"><source src="w.mp4"></video>
<link rel="stylesheet" href="s.css"><link rel="preload" as="image" href="p.png"><link rel="preload" as="font" href="f.woff"><script src="t.js"></script><a href="doc.PDF">d</a><a href="x.html">x</a><img src="logo.svg">"""


def test_metadata_and_images():
    meta = dom.metadata(RICH)
    assert meta["title"] == "Rich More" and meta["description"] == "D" and meta["author"] == "Au" and meta["keywords"] == ["a", "b", "", "c"]
    assert meta["open_graph"]["title"] == "OG" and meta["open_graph"]["type"] == "article"
    assert dom.metadata("<h1>Only</h1>")["title"] == "Only"
    assert dom.images(RICH) == ["/i.png"]


def test_content_and_markdown():
    body = dom.without_boilerplate(RICH)
    assert all(f">{x}<" not in body for x in ("n", "s", "f", "ad")) and "script" not in body and "no</p>" not in body
    content = dom.main_content(dom.absolute_links(RICH, "http://h/p/"))
    assert content.startswith("<h1>Head</h1>") and 'href="http://h/x"' in content
    md = dom.to_markdown(content)
    assert "# Head" in md and "One **bold** and *it* [link](http://h/x)" in md and "| H1 | H2 |\n| --- | --- |\n| 1 | 2 |" in md
    assert "- a\n- b\n  1. c" in md and "```\ncode  x\ny\n```" in md and "> q" in md and "![I](http://h/i.png)" in md and "`c`" in md
    assert dom.main_content("<body><nav>n</nav><p>x</p></body>") == "<p>x</p>"


def test_processed_pages_keep_error_rows(spark):
    pages = spark.createDataFrame([(1, "http://h/", RICH), (2, "http://h/2", ""), (3, None, None), (4, "u", "<<bad")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in process.processed(pages).collect()}
    assert got[1]["error"] is None and got[1]["word_count"] > 5 and got[1]["validation"]["has_headings"]
    assert (got[2]["error"], got[3]["error"], got[4]["error"]) == ("empty content", "empty content", "malformed content")


def test_assets_discovery(spark):
    found = dom.assets(ASSETS, "http://h/p/")
    assert [(k, u) for k, u, _, _ in found] == [
        ("img", "http://h/a.png"), ("img", "http://h/p/logo.svg"), ("img", "http://h/p/b.png"), ("img", "http://h/p/d.webp"), ("media", "http://h/p/w.mp4"), ("stylesheet", "http://h/p/s.css"), ("img", "http://h/p/p.png"), ("script", "http://h/p/t.js"), ("doc", "http://h/p/doc.PDF"),
    ]
    every = [u for _, u, _, _ in dom.assets(ASSETS, "http://h/p/", True)]
    assert every.count("http://h/a.png") == 2 and "http://h/p/c.png" in every and "http://h/p/v.mp4" in every
    assert dom.rewrite('<img src="a.png" srcset="a.png 1x, z.png 2x">', "http://h/", {"http://h/a.png": "/l/a"}) == '<img src="/l/a" srcset="/l/a 1x, z.png 2x">'


def fetch_stub(url):
    if "t.js" in url:
        raise OSError("gone")
    return b"a  {  }   b" if url.endswith(".css") else url.encode()


def test_asset_pipeline(spark):
    pages = spark.createDataFrame([(1, "http://h/p/", ASSETS), (2, None, None)], "page_id long, url string, html string")
    refs = assets.discover(pages)
    policy = assets.AssetPolicy(block_types=("doc",), inline_max_bytes=10, optimize=True)
    chosen = assets.decide(refs, policy)
    done = assets.execute(chosen, policy, fetch_stub)
    rows = {r["asset_url"].rsplit("/", 1)[1]: r for r in done.collect()}
    assert rows["logo.svg"]["mode"] == "inline" and rows["t.js"]["error"].startswith("OSError") and rows["s.css"]["bytes"] == b"a { } b"
    assert rows["s.css"]["path"] == f"/assets/{rows['s.css']['hash'][:2]}/{rows['s.css']['hash']}.css"
    html = {r["page_id"]: r["html"] for r in assets.rewritten(pages, done).collect()}
    assert rows["a.png"]["path"] in html[1] and "/a.png" not in html[1].replace(rows["a.png"]["path"], "")
    c = assets.counters(refs, chosen, done).first()
    assert (c["discovered"], c["selected"], c["skipped"], c["failed"], c["inlined"], c["optimized"]) == (9, 8, 1, 1, 1, 1)
    assert assets.decide(refs, assets.AssetPolicy(enabled=False)).count() == 0
    with pytest.raises(ValueError):
        assets.AssetPolicy(max_bytes=-1)


def flaky(url):
    if "down" in url:
        raise OSError("down")
    return (503, "") if "busy" in url else (200, f"<p>{url}</p>")


def test_fetch_and_seeds(spark, tmp_path):
    urls = spark.createDataFrame([("http://a",), ("http://down",), ("http://busy",), (None,)], "url string")
    got = {r["url"]: r for r in seeds.fetched(urls, flaky).collect()}
    assert got["http://a"]["attempts"] == 1 and got["http://down"]["attempts"] == 3 and got["http://busy"]["error"] == "status 503" and got[None]["error"] == "empty url"
    assert [r["url"] for r in seeds.first_of_each(seeds.inline_seeds(spark, "b, a,, b")).orderBy("pos").collect()] == ["b", "a"]
    (tmp_path / "s.txt").write_text("# c\nhttp://x\n\nhttp://y\n")
    assert {r["url"] for r in seeds.file_seeds(spark, str(tmp_path / "s.txt")).collect()} == {"http://x", "http://y"}
    assert seeds.journal(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "1.json").write_text('{"version": "1", "created_at": "2024-01-01T00:00:00Z"}')
    (tmp_path / "v" / "2.json").write_text("not json")
    assert [r["version"] for r in seeds.config_history(spark, str(tmp_path / "v")).collect()] == ["1"]


def test_rule_patterns(spark):
    table = rules.rules_table(spark, [{"id": "1", "url_pattern": "*.news.com", "priority": 1}, {"id": "2", "url_pattern": "*.blog.*", "priority": 10}, {"id": "3", "url_pattern": "*", "priority": 20, "enabled": False}, {"id": "4", "path_pattern": "/a/*"}])
    rows = spark.createDataFrame([("http://tech.news.com/a/b", "tech.news.com", "/a/b", "x"), ("http://my.blog.org/", "my.blog.org", "/", "x"), ("http://notnews.com/a/b/c", "notnews.com", "/a/b/c", "x"), (None, None, None, None)], "url string, host string, path string, content_type string")
    got = {(r["host"], r["rule_id"], r["rank"]) for r in rules.matches(rows, table).collect()}
    assert got == {("tech.news.com", "1", 1), ("tech.news.com", "4", 2), ("my.blog.org", "2", 1), ("notnews.com", "1", 1)}


def test_limiter_transitions():
    state, now = limiter.START, 0.0
    state, said, _ = limiter.step(state, "acquire", now, False)
    assert said == "granted"
    state, said, wait = limiter.step(state, "acquire", now, False)
    assert said == "wait" and wait == pytest.approx(1.0)
    for _ in range(5):
        state, _, _ = limiter.step(state, "feedback", now, True)
    assert state[3] == "open" and state[0] == pytest.approx(0.8**5)
    assert limiter.step(state, "acquire", 5.0, False)[1] == "rejected"
    state, _, _ = limiter.step(state, "acquire", 5.1, False)
    assert state[3] == "half_open"
    ok = state
    for _ in range(3):
        ok, _, _ = limiter.step(ok, "feedback", 6.0, False)
    # the failures of the closed state still count, so success in the half-open state reopens at once unless it closes
    assert ok[3] in ("closed", "open")
    state, _, _ = limiter.step(state, "feedback", 6.0, True)
    assert state[3] == "open" and state[6] == pytest.approx(7.0)


def limiter_rows(spark):
    t = datetime.datetime(2024, 1, 1)
    return [("a" if i % 3 else "b", t + datetime.timedelta(milliseconds=300 * i), i, "acquire" if i % 2 else "feedback", i % 5 == 0) for i in range(40)]


def test_limiter_batch_and_stream_agree(spark, tmp_path):
    schema = "domain string, ts timestamp, event_id long, kind string, failed boolean"
    rows = limiter_rows(spark)
    want = {tuple(r) for r in limiter.trace(spark.createDataFrame(rows, schema)).collect()}
    for i in range(2):
        spark.createDataFrame(rows[i * 20 : i * 20 + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = limiter.stream(stream).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {tuple(r) for r in spark.table("limited").collect()}
    assert {(r[0], r[2]) for r in got} == {(r[0], r[2]) for r in want} and len(got) == 40
    snap = limiter.snapshot(limiter.trace(spark.createDataFrame(rows, schema))).first()
    assert snap["domains"] == 2


def test_stream_resumes_and_tees(spark, tmp_path):
    source = str(tmp_path / "pages")
    page = lambda i: (i, f"http://h/{i}", RICH if i % 2 else "")
    schema = "page_id long, url string, html string"
    spark.createDataFrame([page(i) for i in range(4)], schema).write.parquet(source)
    run = lambda: flow.finish(flow.staged(flow.pages_stream(spark, source), lambda d: process.processed(d).select("page_id", "url", "title", "error")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    spark.createDataFrame([page(9)], schema).write.mode("append").parquet(source)
    run()
    assert sorted(r["page_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2, 3, 9]

    def broken(batch, number):
        raise RuntimeError("sink down")

    seen = []
    sinks = [broken, flow.buffered(flow.json_sink(str(tmp_path / "json")), lambda d: d.select("url"), lambda d, n: seen.append(n)), flow.journal_sink(str(tmp_path / "journal"))]
    flow.tee(flow.pages_stream(spark, source), sinks, str(tmp_path / "check2")).awaitTermination(120)
    assert spark.read.json(str(tmp_path / "json")).count() == 5 and seen
    assert seeds.journal(spark, str(tmp_path / "journal")).count() == 5


def test_event_windows_stream(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("event_id", "cast(ts as timestamp) ts", "event_type", "value").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("event_id long, ts timestamp, event_type string, value double").parquet(str(tmp_path / "e"))
    query = flow.event_windows(stream).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("windows").groupBy().sum("n").first()[0] == 1000


def test_processed_pages_keep_cut_references(spark, tmp_path):
    """A title that was cut within a reference: the query says what its SQL says, the operator what a browser shows."""
    import duckdb

    from pagequarry.operators import process
    from pagequarry.plans import catalogue

    titles = ["Salt &amp; pepper &amp", "A &lt b &#39;c&#39; &am", "x &amp;lt; y & z &#39", "&quot;q&quot;&"]
    rows = [(i, f"https://e.org/{i}", f'<html><head><title>{t}</title></head><body><article><p>one <a href="/x?a=1&copy=2">two</a></p></article></body></html>') for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = catalogue.QUERIES["processed_pages"](spark, str(tmp_path))
    want = con.execute(f"SELECT page_id, title, word_count FROM ({catalogue.SQL['processed_pages']}) ORDER BY page_id").fetchall()
    assert [tuple(r) for r in got.select("page_id", "title", "word_count").orderBy("page_id").collect()] == want
    assert want[0][1] == "Salt & pepper &amp"
    shown = process.processed(spark.createDataFrame(rows[:1], "page_id long, url string, html string")).first()
    assert shown["title"] == "Salt & pepper &"
