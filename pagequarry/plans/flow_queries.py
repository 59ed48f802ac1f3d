"""More registered queries: fetching, crawling, assets, DOM processing, sinks, streams, configuration and telemetry over whole driver tables, with their SQL.

Pages with assets, meta data and all kinds of links are made of the rows of `pages` by a template (ASSET_PAGE and the like); the SQL tells what must come out of it
row by row and does not share a pattern with the code.
"""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from pagequarry.functions import text, urls
from pagequarry.operators import assets, crawl, metrics, process, related, rules, site_index, telemetry, tree
from pagequarry.operators.ranking import scratch
from pagequarry.plans import config
from pagequarry.plans.catalogue import COUNTS, HOST_OF, RELATED, RULES_SQL, SQL, L, P, events, ok, parsed, register, site_policies, table, with_markdown
from pagequarry.plans.engine import enhanced, metric_lines, with_assets
from pagequarry.sources import extensions, seeds
from pagequarry.sources import pages as pages_source
from pagequarry.streaming import flow, limiter

col = F.col

#: origin, folder and parent folder of a page's URL
BASE = r"""B AS (SELECT page_id, url, html, CAST(page_id AS VARCHAR) AS id, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1) AS scheme, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) AS origin,
  CASE WHEN contains(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/') THEN regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '[^/]*$', '') ELSE '/' END AS folder FROM pages),
U AS (SELECT *, CASE WHEN folder = '/' THEN '/' ELSE regexp_replace(folder, '[^/]+/$', '') END AS up FROM B)"""


def templated(spark, sf_dir, template: str):
    """pages with html made of a template, in which `@` is the page_id."""
    return table(spark, sf_dir, "pages").select("page_id", "url", F.replace(F.lit(template), F.lit("@"), col("page_id").cast("string")).alias("html"))


# fetching and crawling -----------------------------------------------------------------------------------------------------------


def stub_fetch(url: str) -> tuple[int, str]:
    """What it gives depends on the length of the URL only."""
    kind = len(url) % 5
    if kind == 0:
        raise OSError("unreachable")
    return {1: 503, 2: 404}.get(kind, 200), f"<title>{url}</title>"


@register("""SELECT url, CASE WHEN length(url) % 5 = 1 THEN 503 WHEN length(url) % 5 = 2 THEN 404 WHEN length(url) % 5 > 2 THEN 200 END AS status,
  CASE WHEN length(url) % 5 = 0 THEN 'OSError: unreachable' WHEN length(url) % 5 = 1 THEN 'status 503' WHEN length(url) % 5 = 2 THEN 'status 404' END AS error,
  CASE WHEN length(url) % 5 < 2 THEN 2 ELSE 1 END AS attempts, length(CASE WHEN length(url) % 5 > 0 THEN '<title>' || url || '</title>' END) AS n FROM pages""")
def fetched_pages(spark, sf_dir):
    """SRC-04, STR-03, STR-10, EXT-01: errors are rows; what may pass is tried again; four tasks at a time."""
    manner = seeds.Politeness(least=0.0, limited=False)
    return seeds.fetched(flow.in_flight(table(spark, sf_dir, "pages"), 4), stub_fetch, 2, manner).select("url", "status", "error", "attempts", F.length("html").cast("long").alias("n"))


CRAWLED = f"""K AS (SELECT regexp_replace(url, '[?#].*$', '') AS url, any_value(html) AS html FROM pages GROUP BY 1),
S AS (SELECT min(regexp_replace(url, '[?#].*$', '')) AS url FROM P GROUP BY host),
H1 AS (SELECT S.url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM S JOIN K USING (url)),
T1 AS (SELECT DISTINCT url, regexp_replace(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || href, '[?#].*$', '') AS target FROM H1 WHERE starts_with(href, '/')),
A1 AS (SELECT target, max_by(R.allowed, length(R.domain)) AS allowed FROM T1 LEFT JOIN R ON {HOST_OF.format('target')} = R.domain OR ends_with({HOST_OF.format('target')}, '.' || R.domain) GROUP BY target),
D AS (SELECT url, 0 AS depth FROM S UNION ALL SELECT target, 1 FROM A1 WHERE allowed AND target NOT IN (SELECT url FROM S))"""


@register(f"WITH {P}, {RULES_SQL}, {CRAWLED} SELECT D.url, CAST(depth AS BIGINT) AS depth, K.url IS NOT NULL AS found FROM D LEFT JOIN K ON K.url = D.url")
def crawl_pages(spark, sf_dir):
    """SRC-05, JN-07: from the first page of each host along the links that the policies allow; `pages` is the web."""
    p = table(spark, sf_dir, "pages")
    web = p.groupBy(urls.canonical(col("url")).alias("url")).agg(F.any_value("html").alias("html"))
    first = p.groupBy(urls.host(col("url")).alias("host")).agg(F.min(urls.canonical(col("url"))).alias("url"))
    done = crawl.recursive(first, lambda wanted: wanted.join(web, "url"), site_policies(spark))
    return done.select("url", "depth", col("html").isNotNull().alias("found"))


LINK_PAGE = """<!-- <a href="/no">x</a> --><script>var a = '<a href="/no">';</script><A class=x HREF='../up/@.html?q=1&amp;r=2'>a</A><a data-href="/no" href=rel/@>b</a>
<a title="a > b" href="//other.example/p/../q">c</a><a href="?page=@">d</a><a href=" /abs/./@ ">e</a><a href="mailto:x@y">f</a><a name=here>g</a><a href="https://h.example/@#f">h</a>"""
LINK_ROWS = "(0, '../up/' || id || '.html?q=1&r=2', origin || up || 'up/' || id || '.html?q=1&r=2'), (1, 'rel/' || id, origin || folder || 'rel/' || id), (2, '//other.example/p/../q', scheme || '://other.example/p/../q'), (3, '?page=' || id, regexp_replace(url, '[?#].*$', '') || '?page=' || id), (4, '/abs/./' || id, origin || '/abs/' || id), (6, 'https://h.example/' || id || '#f', 'https://h.example/' || id || '#f')"


@register(f"WITH {BASE} SELECT page_id, CAST(v.pos AS BIGINT) AS pos, v.href, v.target FROM U, LATERAL (VALUES {LINK_ROWS}) v(pos, href, target)")
def dom_links(spark, sf_dir):
    """HTML-08, URL-02: attributes in any order, quotes and case; comments and scripts hold no links; references of all kinds."""
    return pages_source.links(templated(spark, sf_dir, LINK_PAGE)).select("page_id", "pos", "href", "target")


# assets --------------------------------------------------------------------------------------------------------------------------

ASSET_PAGE = """<html><head><link rel="stylesheet" href="/css/@.css"><link as=style rel=preload href="//cdn.example.org/p@.css"></head><body><IMG src='img/@.png' srcset="/s/@.png 1x, /s/b.png 2x">
<video><source src="../v/@.mp4"></video><script src="/js/a.js"></script><script src="/js/a.js"></script><a href="/d/@.PDF">d</a></body></html>"""
REFERENCES = {
    "src": "'img', origin || folder || 'img/' || id || '.png', 'src', 'img/' || id || '.png'",
    "first": "'img', origin || '/s/' || id || '.png', 'srcset', '/s/' || id || '.png'",
    "second": "'img', origin || '/s/b.png', 'srcset', '/s/b.png'",
    "media": "'media', origin || up || 'v/' || id || '.mp4', 'src', '../v/' || id || '.mp4'",
    "css": "'stylesheet', origin || '/css/' || id || '.css', 'href', '/css/' || id || '.css'",
    "preload": "'stylesheet', scheme || '://cdn.example.org/p' || id || '.css', 'href', '//cdn.example.org/p' || id || '.css'",
    "script": "'script', origin || '/js/a.js', 'src', '/js/a.js'",
    "doc": "'doc', origin || '/d/' || id || '.PDF', 'href', '/d/' || id || '.PDF'",
}


def _references(names: str) -> str:
    rows = ", ".join(f"({i}, {REFERENCES[n]})" for i, n in enumerate(names.split()))
    return f"{BASE}, V AS (SELECT page_id, CAST(v.pos AS BIGINT) AS pos, v.type, v.asset_url, v.attr, v.original FROM U, LATERAL (VALUES {rows}) v(pos, type, asset_url, attr, original))"


ONCE, ALL = "src first media css preload script doc", "src first second media css preload script script doc"


@register(f"WITH {_references(ONCE)} SELECT * FROM V")
def asset_discovery(spark, sf_dir):
    """AS-01, SET-05: eight families, the first candidate of a srcset, each (type, URL) once."""
    return assets.discover(templated(spark, sf_dir, ASSET_PAGE))


@register(f"WITH {_references(ALL)} SELECT * FROM V")
def asset_references_all(spark, sf_dir):
    """AS-02: all candidates, repeats kept."""
    return assets.discover(templated(spark, sf_dir, ASSET_PAGE), True)


def stub_body(url: str) -> bytes:
    if url.endswith(".mp4"):
        raise OSError("gone")
    return f"body  of   {url}\n".encode()


EXECUTED = rf"""{_references(ONCE)}, W AS (SELECT *, 'body  of   ' || asset_url || chr(10) AS raw FROM V WHERE type <> 'doc'),
X AS (SELECT *, CASE WHEN type = 'media' THEN NULL WHEN type IN ('stylesheet', 'script') THEN regexp_replace(raw, '\s+', ' ', 'g') ELSE raw END AS body FROM W),
Y AS (SELECT *, sha256(body) AS hash, regexp_extract(asset_url, '(\.[a-zA-Z0-9]+)$', 1) AS ext FROM X)"""
PLACE = "'/assets/' || substring(hash, 1, 2) || '/' || hash || ext"


@register(f"WITH {EXECUTED} SELECT page_id, pos, type, hash, CAST(strlen(body) AS BIGINT) AS size, CASE WHEN body IS NOT NULL THEN type IN ('stylesheet', 'script') END AS optimised, CASE WHEN body IS NOT NULL THEN {PLACE} END AS path, CASE WHEN body IS NULL THEN 'OSError: gone' END AS error FROM Y")
def asset_execute(spark, sf_dir):
    """AS-03 to AS-06, SRC-07: fetched, made smaller, hashed and placed; a failed fetch is a row."""
    policy = assets.AssetPolicy(block_types=("doc",), optimize=True)
    done = assets.execute(assets.decide(assets.discover(templated(spark, sf_dir, ASSET_PAGE)), policy), policy, stub_body)
    return done.select("page_id", "pos", "type", "hash", "size", "optimised", "path", "error")


@register(rf"""WITH {EXECUTED}, Z AS (SELECT page_id, list_sort(list(hash || chr(1) || original || chr(1) || {PLACE})) AS steps FROM Y WHERE body IS NOT NULL GROUP BY page_id)
SELECT U.page_id, list_reduce(list_concat([replace('{ASSET_PAGE.replace("'", "''")}', '@', id)], steps), lambda h, s: replace(h, split_part(s, chr(1), 2), split_part(s, chr(1), 3))) AS html FROM U JOIN Z USING (page_id)""")
def asset_rewrite(spark, sf_dir):
    """AS-08, AS-10, EXT-02, EXT-04, EXT-07: the whole asset stage in front of processing, originals replaced in order of hash."""
    stage = with_assets(assets.AssetPolicy(block_types=("doc",), optimize=True), stub_body)
    return stage(templated(spark, sf_dir, ASSET_PAGE)).select("page_id", "html")


@register("SELECT page_id, '<p><img src=\"/local/' || page_id || '.png\" srcset=\"/local/' || page_id || '.png 1x, /b.png 2x\"><a href=\"/x\">t</a></p>' AS html FROM pages")
def asset_dom_rewrite(spark, sf_dir):
    """AS-09: by attribute, each candidate of a srcset on its own."""
    rows = templated(spark, sf_dir, "<body><p><img src=/i/@.png srcset='/i/@.png 1x, /b.png 2x'><a href=/x>t</a></p></body>")

    def run(batches):
        import pyarrow as pa

        from pagequarry.functions import dom

        for b in batches:
            ids = b.column("page_id").to_pylist()
            out = [dom.rewrite(h, "http://h/", {f"http://h/i/{i}.png": f"/local/{i}.png"}) for i, h in zip(ids, b.column("html").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array(out, pa.string())], names=["page_id", "html"])

    return rows.mapInArrow(run, "page_id long, html string")


# processing ----------------------------------------------------------------------------------------------------------------------

FULL_PAGE = """<html><head><title> Page @ &amp; more </title><meta content="one, two ,three" name=keywords><META NAME="description" CONTENT="About @"><meta name="author" content="A. Writer"></head>
<body><!-- hidden --><nav>menu</nav><header>top</header><main class="x"><h1>Page @</h1><p>Some <b>bold</b>  and <a href="sub/@">a link</a>.<br>Next</p><div class="ads">buy</div><ul><li>one<li>two<ol><li>deep</ol></ul>
<table><tr><th>k<th>v<tr><td>@<td><i>w</i></table><img src="/i/@.png" alt="pic"><img src="/t.gif" width=1 height=1><script>bad()</script><pre>x  y</pre></main><footer>end</footer></body></html>"""
FULL_CONTENT = """'<h1>Page ' || id || '</h1><p>Some <b>bold</b>  and <a href="' || origin || folder || 'sub/' || id || '">a link</a>.<br>Next</p><ul><li>one</li><li>two<ol><li>deep</li></ol></li></ul>' || chr(10)
  || '<table><tr><th>k</th><th>v</th></tr><tr><td>' || id || '</td><td><i>w</i></td></tr></table><img src="' || origin || '/i/' || id || '.png" alt="pic"><pre>x  y</pre>'"""
FULL_MARKDOWN = "array_to_string(['# Page ' || id, '', 'Some **bold** and [a link](' || origin || folder || 'sub/' || id || ').', 'Next', '', '- one', '- two', '  1. deep', '', '| k | v |', '| --- | --- |', '| ' || id || ' | *w* |', '', '![pic](' || origin || '/i/' || id || '.png)', '', '```', 'x  y', '```'], chr(10))"


@register(f"""WITH {BASE} SELECT page_id, url, 'Page ' || id || ' & more' AS title, 'About ' || id AS description, 'A. Writer' AS author, 'one|two|three' AS keywords, {FULL_CONTENT} AS content, {FULL_MARKDOWN} AS markdown,
  origin || '/i/' || id || '.png' AS images, CAST(18 AS BIGINT) AS word_count, CAST(NULL AS VARCHAR) AS error FROM U""")
def processed_templates(spark, sf_dir):
    """HTML-01 to HTML-12, TXT-18: metadata, content without boilerplate, absolute links, Markdown and images of pages of one template."""
    done = process.processed(templated(spark, sf_dir, FULL_PAGE))
    shown = F.regexp_replace("markdown", r"(?m)[ \t]+$", "")
    return done.select("page_id", "url", "title", "description", "author", F.array_join("keywords", "|").alias("keywords"), "content", shown.alias("markdown"), F.array_join("images", "|").alias("images"), "word_count", "error")


@register("SELECT page_id, 'Meta ' || page_id AS title, 'one|two words' AS keywords, '<p class=\"x\">in</p>' AS content FROM pages")
def parsed_templates(spark, sf_dir):
    """TXT-11, HTML-06: attributes on title, article and meta tags, in any order and case."""
    page = """<TITLE data-x=1>Meta @</TITLE><meta content="one, two words," Name='Keywords'><article class="y" id=z><p class="x">in</p></article>"""
    return pages_source.parsed(templated(spark, sf_dir, page)).select("page_id", "title", F.array_join("keywords", "|").alias("keywords"), "content")


@register("SELECT doc_id, substring(text, 1, 200) AS shown, coalesce(regexp_replace(source, '^\\s+|\\s+$', '', 'g') <> '', false) AS described FROM documents")
def js_text(spark, sf_dir):
    """TXT-15, QLT-12."""
    return table(spark, sf_dir, "documents").select("doc_id", text.truncated_for_js(col("text")).alias("shown"), text.description_ok(col("source"), True).alias("described"))


@register(f"WITH {P}, {RELATED}, W2 AS (SELECT title, min(url) AS own FROM P GROUP BY title), N AS (SELECT Q.title, Q.url, Q.page_id, row_number() OVER (PARTITION BY Q.title ORDER BY Q.rank) AS n FROM Q JOIN W2 USING (title) WHERE Q.rank <= 5 AND Q.url <> W2.own) SELECT title, n AS rank, page_id, url FROM N WHERE n <= 3")
def related_references(spark, sf_dir):
    """WIN-02: the first three related pages of a title that are not its own page."""
    p = parsed(spark, sf_dir)
    own = p.groupBy("title").agg(F.min("url").alias("own"))
    found = related.related_to_titles(p.select("title"), p).join(own, "title")
    return related.top_references(found, col("own"), 3).select("title", "rank", "page_id", "url")


# sinks, streams and files --------------------------------------------------------------------------------------------------------

EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark, sf_dir):
    return spark.readStream.schema(EVENT).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(sf_dir)


@register("SELECT event_type, count(*) AS lines, count(*) AS journalled, count(*) AS forwarded, CAST(sum(user_id) AS BIGINT) AS users FROM events GROUP BY 1")
def tee_stream(spark, sf_dir):
    """SNK-01, SNK-02, SNK-05, SNK-06, SNK-08, SNK-09, STR-01, STR-02, STR-04, EXT-03, EXT-05: one stream to a JSON sink with a step before it, and to a journal that forwards."""
    out = scratch(spark)
    rows = flow.staged(event_stream(spark, sf_dir), lambda d: d.withColumn("url", F.concat("event_type", F.lit("/"), col("event_id").cast("string"))))
    sinks = [flow.buffered(flow.json_sink(f"{out}/json"), before=lambda b: b.select("event_id", "event_type", "user_id")), flow.forwarding(flow.journal_sink(f"{out}/journal"), flow.journal_sink(f"{out}/forwarded"))]
    flow.tee(rows, sinks, f"{out}/checkpoint").awaitTermination()
    lines = extensions.spilled(spark, f"{out}/json", "event_id long, event_type string, user_id long").groupBy("event_type").agg(F.count("*").alias("lines"), F.sum("user_id").alias("users"))
    told = lambda folder: seeds.journal(spark, f"{out}/{folder}").groupBy(F.split_part("url", F.lit("/"), F.lit(1)).alias("event_type")).agg(F.count("*").alias("n"))
    done, passed = told("journal").withColumnRenamed("n", "journalled"), told("forwarded").withColumnRenamed("n", "forwarded")
    return lines.join(done, "event_type").join(passed, "event_type").select("event_type", "lines", "journalled", "forwarded", "users")


@register("SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name FROM nation")
def watched_files(spark, sf_dir):
    """SRC-16: JSON files of a folder as a stream."""
    out = scratch(spark)
    table(spark, sf_dir, "nation").select(col("n_nationkey").cast("long").alias("k"), col("n_name").alias("name")).write.json(f"{out}/in")
    flow.finish(extensions.watch(spark, f"{out}/in", "k long, name string"), f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.schema("k long, name string").parquet(f"{out}/rows")


@register("SELECT DISTINCT sha256(url) || '.bin' AS name, CAST(strlen('body  of   ' || url || chr(10)) AS BIGINT) AS size FROM pages")
def downloaded_assets(spark, sf_dir):
    """SRC-08: files in a shared folder, one for each URL, however many rows ask for it."""
    out = scratch(spark)

    def run(batches):
        import pyarrow as pa

        get = extensions.download(stub_body, out.removeprefix("file://").removeprefix("file:"))  # a mounted folder
        for b in batches:
            names = [get(u, n) for u, n in zip(b.column("url").to_pylist(), b.column("name").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["path"])

    rows = table(spark, sf_dir, "pages").select("url", F.concat(F.sha2(F.encode("url", "UTF-8"), 256), F.lit(".bin")).alias("name"))
    rows.unionByName(rows).mapInArrow(run, "path string").write.format("noop").mode("overwrite").save()
    return spark.read.format("binaryFile").load(out).select(F.element_at(F.split("path", "/"), -1).alias("name"), col("length").alias("size"))


@register(f"SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events WHERE {'ts IS NOT NULL'} GROUP BY ALL")
def stream_windows(spark, sf_dir):
    """Windowed counts of a stream with a watermark; all windows, as the batch query of the same plan gives them."""
    e = table(spark, sf_dir, "events").withColumn("ts", col("ts").cast("timestamp"))
    return flow.event_windows(e).select(col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@register("SELECT doc_id, lang, source, n_chars FROM documents")
def spill_reload(spark, sf_dir):
    """SNK-10, SRC-10: rows written aside by the hash of their key and read again."""
    out = scratch(spark)
    extensions.spill(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), out, "source")
    return extensions.spilled(spark, out, "doc_id long, lang string, source string, n_chars long")


@register("SELECT CAST(n_nationkey AS VARCHAR) AS version, n_name AS description, 'a' || n_regionkey AS author FROM nation")
def config_versions(spark, sf_dir):
    """SNK-14, SRC-14, CFG-03: a history of versions as JSON files, read as a table."""
    out = scratch(spark)
    n = table(spark, sf_dir, "nation").select(col("n_nationkey").cast("string").alias("version"), col("n_name").alias("description"), F.lit("2024-01-01T00:00:00Z").alias("created_at"), F.concat(F.lit("a"), "n_regionkey").alias("author"), F.lit("{}").alias("config"))
    n.write.json(out)
    return seeds.config_history(spark, out).select("version", "description", "author")


@register(r"SELECT user_id % 7 AS test, count(*) AS n, count(*) FILTER (event_type <> 'error') AS good, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1")
def recorded_results(spark, sf_dir):
    """SNK-14, SRC-15: results of tests recorded as JSON and read again."""
    out = scratch(spark)
    rows = events(spark, sf_dir).select((col("user_id") % 7).cast("string").alias("test_id"), col("user_id").cast("string").alias("user_id"), F.lit("control").alias("variant"), ok().alias("success"), col("micros").cast("double").alias("response_time"))
    extensions.record_results(rows, out)
    back = extensions.experiment_results(spark, out)
    return back.groupBy(col("test_id").cast("long").alias("test")).agg(F.count("*").alias("n"), F.count_if("success").alias("good"), F.sum("response_time").cast("long").alias("cents"))


# configuration and telemetry -----------------------------------------------------------------------------------------------------


@register(f"WITH {P} SELECT page_id, CASE host WHEN 'spam-farm.example.org' THEN 9.5::DOUBLE ELSE 2.0::DOUBLE END AS delay, CASE host WHEN 'spam-farm.example.org' THEN '#a .b|main' ELSE 'main|article|.content' END AS selectors FROM P")
def host_settings(spark, sf_dir):
    """POL-05, CFG-01, SRC-11, SRC-13: delays and selectors by host from a configuration laid over the defaults."""
    cfg = config.overlay(config.EngineConfig(), {"crawl": {"default_delay": "2s", "site_delays": {"spam-farm.example.org": 9.5}, "site_selectors": {"spam-farm.example.org": ["#a .b", "main"]}}})
    rows = table(spark, sf_dir, "pages").select("page_id", config.host_settings(cfg.crawl, F.coalesce(urls.host(col("url")), F.lit(""))).alias("s"))
    return rows.select("page_id", "s.delay", F.array_join("s.selectors", "|").alias("selectors"))


@register(f"WITH {P}, {COUNTS} SELECT page_id, 'html' AS format, words >= 70 AS processed, strlen(content) <= 1048576 AND content <> '' AS written, 'content_extraction,content_cleaning,image_extraction,markdown_conversion' AS steps FROM C")
def policy_gates(spark, sf_dir):
    """POL-07, POL-12, POL-14, POL-16: what processing and output take from the policies, as gates over all pages."""
    cfg = config.PolicyManager().configure({"processing": {"quality_threshold": 0.7, "metadata_extraction": False}, "output": {"default_format": "html"}})
    view, outlet = cfg.processor(), cfg.outlet()
    rows = text.counted(parsed(spark, sf_dir))
    steps = F.array_join(rules.processing_steps({k: F.lit(v) for k, v in view.steps().items()}), ",")
    return rows.select("page_id", F.lit(outlet.format).alias("format"), view.accepts(col("word_count")).alias("processed"), outlet.accepts(F.octet_length("content"), col("content") != "").alias("written"), steps.alias("steps"))


def _escaped(x: str) -> str:
    for shown, meant in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("''", "&#39;")):
        x = f"replace({x}, '{shown}', '{meant}')"
    return x


@register(f"""WITH N AS ({SQL['nav_nodes']}) SELECT path, level, CASE WHEN url <> '' THEN '<a href="' || {_escaped('url')} || '">' || {_escaped('title')} || '</a>' ELSE '<span>' || {_escaped('title')} || '</span>' END AS item FROM N""")
def navigation_items(spark, sf_dir):
    """TRE-03."""
    return tree.navigation_items(tree.navigation(parsed(spark, sf_dir)))


@register(f"WITH N AS ({SQL['search_index']}) SELECT page_id, title, url, substring(content, 1, 200) AS content, weight FROM N")
def search_documents(spark, sf_dir):
    """SCH-06, TXT-15: what the search script of a site gets of each page, from the JSON it gets."""
    index = site_index.search_index(parsed(spark, sf_dir))
    sent = index.select(F.to_json(F.struct("page_id", "title", "url", text.truncated_for_js(col("content")).alias("content"), "weight")).alias("value"))
    return sent.select(F.from_json("value", "page_id long, title string, url string, content string, weight double").alias("d")).select("d.*")


ENHANCED = {"contents": "table_of_contents", "index": "index_entries", "topics": "topic_index", "search": "search_index", "references": "cross_references"}


@register(" UNION ALL ".join(f"SELECT '{part}' AS part, count(*) AS n FROM ({SQL[query]}) t" + (" WHERE title <> ''" if part == "index" else "") for part, query in ENHANCED.items()))
def enhanced_output(spark, sf_dir):
    """SCH-08: how many rows each part of the enhanced output has; references are counted without their pairs."""
    n = lambda part: F.coalesce(F.sum("refs"), F.lit(0)) if part == "references" else F.count("*")
    parts = [rows.agg(n(part).alias("n")).select(F.lit(part).alias("part"), "n") for part, rows in enhanced(with_markdown(spark, sf_dir), related.cross_reference_counts).items()]
    return functools.reduce(lambda a, b: a.unionByName(b), parts)


@register("SELECT event_id, user_id FROM events WHERE CAST('0x' || substring(md5(CAST(user_id AS VARCHAR)), 1, 8) AS BIGINT) % 10000 < 2500")
def sampled_traces(spark, sf_dir):
    """STR-18: a quarter of all traces (here: users), each whole; sampling is the feature."""
    return telemetry.sampled(table(spark, sf_dir, "events"), "user_id", 25).select("event_id", "user_id")


@register("""WITH C AS (SELECT event_type, count(*)::DOUBLE AS n FROM events GROUP BY 1) SELECT 'prom' AS backend, 'all_events_total{type="' || event_type || '"}' AS name, n AS value FROM C UNION ALL SELECT 'otel', 'all.events.total', n FROM C""")
def metric_backends(spark, sf_dir):
    """OBS-12: the same samples for two backends, and none for `none`."""
    e = table(spark, sf_dir, "events").withColumnRenamed("event_type", "type")
    counted = telemetry.samples(e, F.lit("all_events_total"), ["type"], F.lit(1), "counter")
    lines = metric_lines(counted, "prom").select(F.lit("prom").alias("backend"), F.split_part("line", F.lit(" "), F.lit(1)).alias("name"), F.split_part("line", F.lit(" "), F.lit(2)).cast("double").alias("value"))
    rows = metric_lines(counted, "otel").select(F.lit("otel").alias("backend"), "name", "value")
    return lines.unionByName(rows).unionByName(metric_lines(counted, "none").select(F.lit("none").alias("backend"), "name", "value"))


BOUNDS = (1.0, 5.0, 25.0)


@register(f"""WITH C AS (SELECT event_type, count(*) AS n, sum(CAST(round(value * 100) AS BIGINT)) AS s, {', '.join(f'count(*) FILTER (value <= {b}) AS b{i}' for i, b in enumerate(BOUNDS))} FROM events GROUP BY 1),
S AS (SELECT 'events_total' AS name, 'events_total{{type="' || event_type || '"}} ' || CAST(n::DOUBLE AS VARCHAR) AS line FROM C
  {' '.join(f"UNION ALL SELECT 'event_cents', 'event_cents_bucket{{le=" + chr(34) + str(100 * b) + chr(34) + ",type=" + chr(34) + "' || event_type || '" + chr(34) + f"}} ' || CAST(b{i}::DOUBLE AS VARCHAR) FROM C" for i, b in enumerate(BOUNDS))}
  UNION ALL SELECT 'event_cents', 'event_cents_bucket{{le="+Inf",type="' || event_type || '"}} ' || CAST(n::DOUBLE AS VARCHAR) FROM C
  UNION ALL SELECT 'event_cents', 'event_cents_count{{type="' || event_type || '"}} ' || CAST(n::DOUBLE AS VARCHAR) FROM C)
SELECT name, line FROM S UNION ALL VALUES ('events_total', '# HELP events_total Events by type'), ('events_total', '# TYPE events_total counter'), ('event_cents', '# HELP event_cents event_cents'), ('event_cents', '# TYPE event_cents histogram')""")
def metrics_scrape(spark, sf_dir):
    """SNK-11, OBS-01, OBS-04, AGG-23: the text of a scrape with counters and a histogram (its sum left out here: large floats print unlike)."""
    e = events(spark, sf_dir).withColumnRenamed("event_type", "type")
    counted = telemetry.samples(e, F.lit("events_total"), ["type"], F.lit(1), "counter")
    spread = telemetry.buckets(e, "event_cents", ["type"], col("micros"), [100 * b for b in BOUNDS])
    lines = telemetry.scrape(counted.unionByName(spread), {"events_total": "Events by type"})
    return lines.filter(~col("line").startswith("event_cents_sum")).select("name", "line")


@register("""WITH A AS (SELECT user_id, event_id, ts, lag(event_id) OVER w AS parent, lag(ts) OVER w AS before, lead(ts) OVER w AS next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT CAST(event_id AS VARCHAR) AS span_id, CAST(parent AS VARCHAR) AS parent_id, before AS parent_start, CAST(epoch_us(coalesce(next, ts)) - epoch_us(ts) AS BIGINT) AS micros FROM A""")
def span_durations(spark, sf_dir):
    """OBS-05: spans (each event up to the user's next) with their parent's start."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("ts", col("ts").cast("timestamp"))
    spans = e.select(col("user_id").cast("string").alias("trace_id"), col("event_id").cast("string").alias("span_id"), F.lag("event_id").over(w).cast("string").alias("parent_id"), col("ts").alias("start"), F.coalesce(F.lead("ts").over(w), "ts").alias("end"))
    return telemetry.span_tree(spans).select("span_id", "parent_id", col("parent_start").cast("timestamp_ntz").alias("parent_start"), "micros")


@register("""SELECT '{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}' AS value FROM events""")
def correlated_log(spark, sf_dir):
    """OBS-07: one JSON line for each event."""
    return telemetry.correlated_log(table(spark, sf_dir, "events").select("event_id", "event_type", "user_id"))


def limiter_events(spark, sf_dir):
    return events(spark, sf_dir).select(F.concat(F.lit("d"), (col("user_id") % 16).cast("string")).alias("domain"), "ts", "event_id", F.when(col("event_type") == "view", "acquire").otherwise("feedback").alias("kind"), (~ok()).alias("failed"))


#: the limiter's transition on (rate, tokens, refilled, breaker, failures, successes, attempt), one event a level; `x` holds the state before, `e` the event
LIMITER_SQL = """WITH RECURSIVE E AS (SELECT 'd' || (user_id % 16) AS domain, event_id, ts, epoch_us(ts)::DOUBLE / 1000000.0::DOUBLE AS now, event_type = 'view' AS acquire, event_type = 'error' AS failed,
  row_number() OVER (PARTITION BY user_id % 16 ORDER BY ts, event_id) AS n FROM events),
X AS (SELECT DISTINCT domain, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::TIMESTAMP AS ts, '' AS kind, '' AS decision, 0.0::DOUBLE AS wait, 1.0::DOUBLE AS rate, 1.0::DOUBLE AS tokens, NULL::DOUBLE AS refilled, 'closed' AS breaker, 0::BIGINT AS failures, 0::BIGINT AS successes, 0.0::DOUBLE AS attempt FROM E
UNION ALL SELECT domain, n, event_id, ts, CASE WHEN acquire THEN 'acquire' ELSE 'feedback' END,
    CASE WHEN NOT acquire THEN 'recorded' WHEN rejected THEN 'rejected' WHEN filled >= 1 THEN 'granted' ELSE 'wait' END,
    CASE WHEN acquire AND NOT rejected AND filled < 1 THEN (1 - filled) / greatest(rate, 0.1::DOUBLE) ELSE 0.0::DOUBLE END,
    CASE WHEN acquire THEN rate WHEN failed THEN greatest(0.1::DOUBLE, rate * 0.8::DOUBLE) ELSE least(5.0::DOUBLE, rate * 1.05::DOUBLE) END,
    CASE WHEN acquire AND NOT rejected THEN CASE WHEN filled >= 1 THEN filled - 1 ELSE filled END ELSE tokens END,
    CASE WHEN acquire AND NOT rejected THEN greatest(coalesce(refilled, now), now) ELSE refilled END,
    CASE WHEN acquire THEN CASE WHEN breaker = 'open' AND NOT rejected THEN 'half_open' ELSE breaker END
      WHEN breaker = 'half_open' THEN CASE WHEN s2 >= 3 THEN 'closed' WHEN f2 > 0 THEN 'open' ELSE 'half_open' END
      WHEN breaker = 'closed' AND f2 >= 5 THEN 'open' ELSE breaker END,
    CASE WHEN acquire THEN failures WHEN breaker = 'half_open' AND (s2 >= 3 OR f2 > 0) THEN 0 WHEN breaker = 'closed' AND f2 >= 5 THEN 0 ELSE f2 END,
    CASE WHEN acquire THEN successes WHEN breaker = 'half_open' AND (s2 >= 3 OR f2 > 0) THEN 0 WHEN breaker = 'closed' AND f2 >= 5 THEN 0 ELSE s2 END,
    CASE WHEN acquire THEN attempt WHEN breaker = 'half_open' AND s2 >= 3 THEN 0.0::DOUBLE WHEN breaker = 'half_open' AND f2 > 0 THEN now + 1.0::DOUBLE WHEN breaker = 'closed' AND f2 >= 5 THEN now + 5.0::DOUBLE ELSE attempt END
  FROM (SELECT x.domain, e.n, e.event_id, e.ts, e.now, e.acquire, e.failed, x.rate, x.tokens, x.refilled, x.breaker, x.failures, x.successes, x.attempt, x.breaker = 'open' AND e.now <= x.attempt AS rejected,
      CASE WHEN x.refilled IS NULL OR e.now <= x.refilled THEN x.tokens ELSE least(10.0::DOUBLE, x.tokens + (e.now - x.refilled) * x.rate) END AS filled,
      x.failures + CASE WHEN e.failed THEN 1 ELSE 0 END AS f2, x.successes + CASE WHEN NOT e.failed AND x.breaker = 'half_open' THEN 1 ELSE 0 END AS s2
    FROM X x JOIN E e ON e.domain = x.domain AND e.n = x.n + 1))"""


@register(f"{LIMITER_SQL} SELECT domain, event_id, kind, decision, round(wait, 6) AS wait, round(rate, 6) AS rate, round(tokens, 6) AS tokens, breaker FROM X WHERE n > 0")
def limiter_trace(spark, sf_dir):
    """STR-05 to STR-07: the token bucket and the breaker of each domain, event by event."""
    return limiter.trace(limiter_events(spark, sf_dir)).select("domain", "event_id", "kind", "decision", F.round("wait", 6).alias("wait"), F.round("rate", 6).alias("rate"), F.round("tokens", 6).alias("tokens"), "breaker")


@register(f"{LIMITER_SQL}, Z AS (SELECT domain, arg_max(breaker, n) AS breaker FROM X WHERE n > 0 GROUP BY domain) SELECT count(*) AS domains, count(*) FILTER (breaker = 'open') AS open, count(*) FILTER (breaker = 'half_open') AS half_open FROM Z")
def limiter_snapshot(spark, sf_dir):
    """AGG-18."""
    return limiter.snapshot(limiter.trace(limiter_events(spark, sf_dir)))


@register(f"WITH {L}, G AS (SELECT page_id, count(*) AS n FROM L GROUP BY page_id) SELECT n AS out_links, count(*) AS pages FROM G GROUP BY n")
def link_histogram(spark, sf_dir):
    """HTML-08, AGG-23: how many pages have how many links."""
    found = pages_source.links(table(spark, sf_dir, "pages")).groupBy("page_id").agg(F.count("*").alias("out_links"))
    return found.groupBy("out_links").agg(F.count("*").alias("pages"))


@register("SELECT event_type AS metric, count(*) AS n, min(value) AS low, max(value) AS high FROM events GROUP BY 1")
def metric_ranges(spark, sf_dir):
    """OBS-01: gauges as ranges, in one aggregate."""
    return metrics.ranges(events(spark, sf_dir), "event_type", "value")
