"""Engine, configuration and telemetry."""

import json

import pytest

from pagequarry.functions import site_files
from pagequarry.operators import assets, telemetry, tree
from pagequarry.plans import config as C
from pagequarry.plans.engine import Engine, with_assets
from pagequarry.sources.seeds import Politeness, fetch_all

HTML = "<html><head><title>A page about {0}</title></head><body><nav>menu</nav><article><h1>{0}</h1><p>" + "several words of text " * 15 + '<img src="/i.png"></article></body></html>'


def fetch(url):
    if "bad" in url:
        raise OSError("unreachable")
    return 200, HTML.format(url.rsplit("/", 1)[1])


def stub(url):
    return b"bytes of " + url.encode()


def test_engine_resumes(spark, tmp_path):
    cfg = C.overlay(C.EngineConfig(), {"resume": True, "journal": str(tmp_path / "journal"), "crawl": {"allowed": {"h.org": True}}, "output": {"routes": [["*.md", "markdown"]], "default_sink": "main"}, "processing": {"quality_threshold": 0.5}})
    seeds = spark.createDataFrame([("http://h.org/a",), ("http://h.org/b.md",), ("http://sub.h.org/bad",), ("http://other.org/x",), (" http://h.org/a ",)], "url string")
    engine = Engine(spark, cfg, fetch, before=[with_assets(assets.AssetPolicy(rewrite_prefix="/assets"), stub)])
    rows = {r["url"]: r for r in engine.run(seeds, str(tmp_path / "out")).collect()}
    assert set(rows) == {"http://h.org/a", "http://h.org/b.md", "http://sub.h.org/bad"}
    assert rows["http://h.org/a"]["success"] and rows["http://h.org/b.md"]["sink"] == "markdown" and "/assets/" in rows["http://h.org/a"]["content"]
    assert not rows["http://sub.h.org/bad"]["success"] and rows["http://sub.h.org/bad"]["attempts"] == 3
    assert engine.snapshot()["failed"] == 1 and engine.snapshot()["health"] == "healthy"
    again = Engine(spark, cfg, fetch)
    assert {r["url"] for r in again.pages(seeds).collect()} == {"http://sub.h.org/bad"}


def test_configuration(tmp_path):
    assert C.seconds("1m30s") == 90 and C.seconds("200ms") == pytest.approx(0.2)
    for bad in ({"general": {"max_concurrency": 0}}, {"processing": {"quality_threshold": 2.0}}, {"crawl": {"max_depth": "x"}}, {"what": 1}, {"general": {"timeout_s": "soon"}}):
        with pytest.raises(C.ConfigError):
            C.overlay(C.EngineConfig(), bad)
    assert C.overlay(C.EngineConfig(), {"general": {"timeout_s": "5s"}}).general.timeout_s == 5
    (tmp_path / "c.json").write_text(json.dumps({"crawl": {"max_pages": 7, "site_delays": {"h": 2.0}}}))
    loaded = C.load(str(tmp_path / "c.json"))
    assert loaded.crawl.max_pages == 7 and loaded.crawl.delay("h") == 2.0 and loaded.crawl.delay("x") == 1.0
    assert C.load(str(tmp_path / "none.json")) == C.EngineConfig()
    run, told = C.Runtime(C.EngineConfig(), str(tmp_path / "versions")), []
    run.observers.append(lambda old, new: told.append(new.crawl.max_pages))
    assert run.update({"crawl": {"max_pages": 1}}) and not run.update({"crawl": {"max_pages": 1}}) and run.update({"crawl": {"max_pages": 2}})
    assert run.reload(str(tmp_path / "c.json")) and told == [1, 2, 7]
    assert run.rollback("1").crawl.max_pages == 1 and len(run.history()) == 4
    assert C.HealthPolicy(degraded_ratio=0.9, unhealthy_ratio=-1, sample_percent=500).normalised() == C.HealthPolicy(degraded_ratio=0.9, unhealthy_ratio=0.9, sample_percent=100)
    clock = [0.0]
    made = C.Cached(lambda: clock[0], 2, lambda: clock[0])
    assert made.get() == 0
    clock[0] = 1.5
    assert made.get() == 0
    clock[0] = 2.5
    assert made.get() == 2.5


def test_telemetry(spark):
    from pyspark.sql import functions as F

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    lines = [r["line"] for r in telemetry.exposition(telemetry.samples(events, F.lit("events_total"), ["event_type"], F.lit(1), "counter")).collect()]
    assert len(lines) == 5 and all(x.startswith('events_total{event_type="') for x in lines) and sum(float(x.split(" ")[1]) for x in lines) == 1000
    kept = telemetry.sampled(events, "user_id", 50)
    assert 0 < kept.count() < 1000 and kept.select("user_id").distinct().join(events, "user_id").count() == kept.count()
    spans = spark.createDataFrame([("t", "a", None, 0, 10), ("t", "b", "a", 2, 5)], "trace_id string, span_id string, parent_id string, s long, e long").selectExpr("trace_id", "span_id", "parent_id", "timestamp_micros(s) start", "timestamp_micros(e) end")
    assert {r["span_id"]: r["micros"] for r in telemetry.span_tree(spans).collect()} == {"a": 10, "b": 3}
    burst = spark.createDataFrame([(i, "x" if i % 2 else "y") for i in range(10)], "time long, category string")
    subs = spark.createDataFrame([("all", "*", 4), ("x", "x", 100)], "name string, category string, buffer int")
    assert {r["name"]: (r["delivered"], r["dropped"]) for r in telemetry.bus_stats(telemetry.delivered(burst, subs)).collect()} == {"all": (4, 6), "x": (5, 0)}


def test_site_files(spark):
    nodes = [{"path": "a", "parent": "", "title": "A&", "url": ""}, {"path": "a/b", "parent": "a", "title": "B", "url": "u"}, {"path": "c", "parent": "", "title": "C", "url": "v"}]
    assert site_files.navigation_list(nodes) == '<ul><li><span>A&amp;</span><ul><li><a href="u">B</a></li></ul></li><li><a href="v">C</a></li></ul>'
    assert "@media print" in site_files.style_sheet() and "dark" not in site_files.style_sheet()
    assert '"content": "xx"' in site_files.search_script([{"title": "t", "url": "u", "content": "xxx", "keywords": ["k"]}], 2)
    pages = spark.createDataFrame([("http://h/docs/a", "/docs/a", "A", "# One\n## Two", None)], "url string, path string, title string, markdown string, content string")
    assert {(r["path"], r["pos"], r["level"], r["title"]) for r in tree.contents(pages).collect()} == {("docs", -1, 1, "docs"), ("docs/a", -1, 2, "A"), ("docs/a", 0, 3, "One")}


def test_enhanced_output_and_backends(spark):
    from pyspark.sql import functions as F

    from pagequarry.plans.engine import enhanced, metric_lines

    rows = [(1, "http://h/guide/setup", "/guide/setup", "Setup Guide", "Install with config api reference", "# Setup\n## Steps", []), (2, "http://h/api/auth", "/api/auth", "Auth API", "See the setup guide, api and config", "# Auth", [])]
    pages = spark.createDataFrame(rows, "page_id long, url string, path string, title string, content string, markdown string, keywords array<string>")
    out = enhanced(pages)
    assert out["contents"].count() == 6 and out["index"].count() == 5 and out["topics"].count() == 4 and out["search"].count() == 2
    assert {(r["src"], r["type"]) for r in out["references"].collect()} == {("http://h/api/auth", "mentions"), ("http://h/guide/setup", "related_topic")}
    metrics = telemetry.samples(pages, F.lit("pages_total"), [], F.lit(1), "counter")
    assert metric_lines(metrics, "prom").first()["line"] == "pages_total 2.0" and metric_lines(metrics, "otel").first()["name"] == "pages.total" and metric_lines(metrics, "none").count() == 0
    assert {(r["path"], r["title"]) for r in tree.strict_by_host(pages).collect()} == {("guide", "guide"), ("guide/setup", "Setup Guide"), ("api", "api"), ("api/auth", "Auth API")}


def test_each_url_is_fetched_once(spark, tmp_path):
    """However often a result is read, with assets in front and a journal behind; the journal and the counts are those of the run."""
    log = tmp_path / "log"
    log.mkdir()

    def counted(url):
        import os
        import uuid

        (log / f"{uuid.uuid4().hex}-{os.getpid()}").write_text(url)
        return 200, HTML.format(url.rsplit("/", 1)[1])

    cfg = C.overlay(C.EngineConfig(), {"journal": str(tmp_path / "journal"), "crawl": {"allowed": {"h.org": True}}})
    engine = Engine(spark, cfg, counted, before=[with_assets(assets.AssetPolicy(), stub)], manner=Politeness(limited=False))
    for urls in (["http://h.org/a", "http://h.org/b"], ["http://h.org/c"]):
        done = engine.run(spark.createDataFrame([(u,) for u in urls], "url string"), str(tmp_path / "out"))
        assert {r["url"] for r in done.collect()} == set(urls) and done.count() == len(urls) == engine.counts["processed"]
    assert sorted(f.read_text() for f in log.iterdir()) == ["http://h.org/a", "http://h.org/b", "http://h.org/c"]
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "journal")).collect()) == ["http://h.org/a", "http://h.org/b", "http://h.org/c"]


def test_waits_grow_and_domains_take_turns():
    """Full jitter up to a doubled bound; the bucket of a domain gives permits, the breaker opens, and others go on meanwhile."""
    manner = Politeness(least=0.2, most=1.0)
    assert [manner.wait(n, lambda: 1.0) for n in (1, 2, 3, 4, 99)] == [0.2, 0.4, 0.8, 1.0, 1.0] and manner.wait(2, lambda: 0.5) == 0.2 and manner.wait(2, lambda: 0.0) == 0.4
    now, seen = [1000.0], []

    def sleep(s):
        now[0] += s

    def get(url):
        seen.append((round(now[0] - 1000, 3), url))
        if "down" in url:
            raise OSError("down")
        return 200, "x"

    manner = Politeness(least=0.0, clock=lambda: now[0], sleep=sleep, seed=1)
    rows = fetch_all([f"http://a/{i}" for i in range(4)] + ["http://b/0", "", None], get, 1, manner, {})
    assert [r[1] for r in rows] == [200] * 5 + [None, None] and rows[5][3] == "empty url"
    # one permit at once, then at the growing rate of the domain; b need not wait for a
    assert [t for t, u in seen if "/a/" in u][0] == 0 and [t for t, u in seen if "/b/" in u] == [0] and [t for t, u in seen if "/a/" in u][-1] > 2.5
    seen.clear()
    rows = fetch_all([f"http://down/{i}" for i in range(9)], get, 1, manner, {})
    assert [r[3] for r in rows].count("OSError: down") == 5 and [r[3] for r in rows].count("circuit open") == 4


def test_crawl_follows_links(spark, tmp_path):
    web = {"http://h.org/": '<a href="a">a</a><a href="http://x.org/">out</a>', "http://h.org/a": "<a class=q HREF='b?x=1'>b</a><a href=/>home</a>", "http://h.org/b": '<a href="/c#z">c</a>', "http://h.org/c": "end"}

    def get(url):
        return (200, f"<title>t</title><article>{web[url]}</article>") if url in web else (404, "")

    seeds = spark.createDataFrame([("http://h.org/",)], "url string")
    for depth, pages, want in ((9, 0, ["", "a", "b", "c"]), (2, 0, ["", "a", "b"]), (9, 2, ["", "a"])):
        cfg = C.overlay(C.EngineConfig(), {"crawl": {"allowed": {"h.org": True}, "max_depth": depth, "max_pages": pages}})
        engine = Engine(spark, cfg, get, manner=Politeness(limited=False))
        assert sorted((r["url"], r["depth"]) for r in engine.crawl(seeds).collect()) == [(f"http://h.org/{p}", i) for i, p in enumerate(want)]


def test_endpoints_and_monitor(spark):
    import urllib.error
    import urllib.request

    state = {"status": "healthy"}
    with telemetry.Endpoints(lambda: state, lambda: ["# TYPE a counter", "a 1.0"]) as served:
        at = f"http://127.0.0.1:{served.port}"
        assert json.load(urllib.request.urlopen(f"{at}/healthz")) == state
        assert urllib.request.urlopen(f"{at}/metrics").read() == b"# TYPE a counter\na 1.0\n"
        state["status"] = "unhealthy"
        for path, code in (("healthz", 503), ("nothing", 404)):
            with pytest.raises(urllib.error.HTTPError) as e:
                urllib.request.urlopen(f"{at}/{path}")
            assert e.value.code == code
    clock = iter([1.0, 2.0, 4.0, 8.0])
    monitor = telemetry.Monitor(lambda: next(clock))

    def fails():
        raise ValueError("no")

    with monitor.operation("rules", policy="p"), pytest.raises(ValueError):
        monitor.watched("rule", fails, rule="r")()
    spans = {r["name"]: r for r in telemetry.span_tree(monitor.table(spark)).collect()}
    assert (spans["rules"]["micros"], spans["rule"]["micros"]) == (7_000_000, 2_000_000)
    assert spans["rule"]["error"] == "ValueError: no" and spans["rule"]["parent_id"] == spans["rules"]["span_id"] and spans["rules"]["attributes"] == {"policy": "p"}


def test_links_and_references(spark):
    """RFC 3986's own examples, and tags by place."""
    from urllib.parse import urljoin

    from pyspark.sql import functions as F

    from pagequarry.functions import urls
    from pagequarry.sources import pages

    base = "http://a/b/c/d;p?q"
    refs = ["g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", "g?y#s", ";x", "g;x", "", ".", "./", "..", "../", "../g", "../..", "../../", "../../g", "../../../g", "/./g", "/../g", "g.", "..g", "./../g", "./g/.", "g/./h", "g/../h", "http:g/x", "mailto:x", "g?y/./x", "g#s/../x"]
    rows = spark.createDataFrame([(base, r) for r in refs] + [("nowhere", "x"), ("http://h", "x"), (None, "x")], "b string, r string")
    got = rows.select("b", "r", urls.resolve(F.col("b"), F.col("r")).alias("t")).collect()
    for row in got[: len(refs)]:
        assert row["t"] == ("http:g/x" if row["r"] == "http:g/x" else urljoin(base, row["r"]))
    assert [r["t"] for r in got[len(refs) :]] == [None, "http://h/x", None]
    html = '<meta content=\'a, "b"\' name=keywords><META NAME=og x="name=keywords"><script>"<meta name=x content=1>"</script><meta property="og:title" content="T &amp; U">'
    shown = spark.createDataFrame([(html,)], "h string").select(pages.meta(F.col("h"), "keywords"), pages.meta(F.col("h"), "og"), pages.meta(F.col("h"), "x"), pages.meta(F.col("h"), "og:title", "property")).first()
    assert tuple(shown) == ('a, "b"', None, None, "T & U")


def test_globs():
    import re

    from pagequarry.operators.rules import glob_regex

    for pattern, yes, no in (("/en/*", "/en/a", "/en/a/b"), ("[a-c]?", "b1", "d1"), ("[^a]x", "bx", "ax"), ("a\\*", "a*", "ab"), ("*.html", "x.html", "x/y.html")):
        assert re.search(glob_regex(pattern), yes) and not re.search(glob_regex(pattern), no)
    for bad in ("[ab", "x\\", "[a-]"):
        assert not any(re.search(glob_regex(bad), x) for x in ("a", "b", "[ab", "x", ""))


def test_deep_pages_are_rendered(spark):
    from pagequarry.operators import process

    rows = [(i, "http://h/", tag * 20_000 + "in" + tail) for i, (tag, tail) in enumerate([("<div>", ""), ("<span>", ""), ("<blockquote>", "</blockquote>"), ("<table><tr><td>", ""), ("<ul><li>", "")]) if i != 4]
    rows.append((9, "http://h/", "<ul><li>" * 3000 + "in"))
    done = process.processed(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(done) == len(rows) and all(r["error"] is None and "in" in r["markdown"] for r in done)


def test_policies_and_views():
    for bad in (lambda: C.FetchPolicy(timeout_s=0), lambda: C.FetchPolicy(max_retries=-1), lambda: C.ScrapeConfig("", ("h",)), lambda: C.ScrapeConfig("u", ()), lambda: C.ScrapeConfig("u", ("h",), 0)):
        with pytest.raises(C.ConfigError):
            bad()
    scrape = C.ScrapeConfig("http://h/", ("h",), 3, 0)
    assert scrape.workers == 1 and scrape.crawl_policy().allowed == {"h": True} and scrape.crawl_policy().max_depth == 3
    manager = C.PolicyManager()
    with pytest.raises(C.ConfigError):
        manager.configure({"general": {"max_concurrency": 0}})
    assert manager.current == C.EngineConfig()
    manager.configure({"crawl": {"site_delays": {"h": 2.0}}, "processing": {"quality_threshold": 0.29, "image_extraction": False}, "output": {"compression": True}})
    assert manager.for_host("h")["delay"] == 2.0 and manager.for_host("x")["delay"] == 1.0
    view, outlet = manager.current.processor(), manager.current.outlet()
    assert view.steps() == {"metadata_extraction": True, "image_extraction": False, "markdown_conversion": True} and view.min_words == 28 and view.accepts(28) and not view.accepts(27)
    assert outlet.compression and outlet.accepts(1 << 20, True) and not outlet.accepts((1 << 20) + 1, True)


def test_forwarding_and_stopping(spark, tmp_path):
    from pagequarry.streaming import flow

    got = []
    sink = flow.forwarding(lambda b, n: got.append(("first", n)), lambda b, n: got.append(("next", n)))
    sink(None, 4)
    assert got == [("first", 4), ("next", 4)]
    with pytest.raises(ZeroDivisionError):
        flow.forwarding(lambda b, n: 1 // 0, lambda b, n: got.append("never"))(None, 5)
    assert "never" not in got and flow.in_flight(spark.range(10), 3).rdd.getNumPartitions() == 3
    spark.range(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.format("memory").queryName("drained").start()
    flow.stopped([stream])
    assert not stream.isActive and spark.table("drained").count() == 5
