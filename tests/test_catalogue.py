"""Every registered query of the library's own operators against its SQL on small tables."""

import pytest
from pyspark.sql import functions as F

from pagequarry.plans import catalogue
from tests.conftest import MEDIUM, SMALL
from tests.oracle import compare, connection


@pytest.fixture(scope="module")
def duck():
    return connection(SMALL)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_matches_sql(spark, duck, name):
    differs, _, _ = compare(spark, duck, catalogue.QUERIES[name], catalogue.SQL[name], SMALL)
    assert differs is None


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.SQL)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def greedy(pairs):
    """The sequential rule."""
    taken, out = set(), set()
    for i in sorted({a for a, _, _ in pairs}):
        if i in taken:
            continue
        for a, b, _ in sorted(pairs):
            if a == i and b not in taken:
                taken.add(b)
                out.add((i, b))
    return out


def test_duplicate_groups_follow_the_greedy_rule(spark):
    import random

    from pagequarry.operators import related

    rng = random.Random(4)
    for n in (3, 12, 40):
        pairs = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(n * 2)})
        rows = [(a, b, 0.5 + a / 1000) for a, b in pairs]
        got = related.duplicate_groups(spark.createDataFrame(rows, "i long, j long, similarity double")).collect()
        assert {(r["leader"], r["member"]) for r in got} == greedy(rows)
    assert related.duplicate_groups(spark.createDataFrame([], "i long, j long, similarity double")).count() == 0


def test_similar_pairs_asymmetric_and_pruned(spark):
    import random

    from pagequarry.operators import related

    rng = random.Random(1)
    vocab = ["alpha", "bravo", "charlie", "delta", "echoes", "foxtrot", "golfing", "hotel"]
    docs = [(i, " ".join(rng.choices(vocab[: rng.randint(1, 8)], k=rng.randint(1, 14)))) for i in range(60)] + [(100, "single"), (101, "single " * 10), (102, ""), (103, None)]
    words = {i: (t or "").split() for i, t in docs}
    want = set()
    for i, a in words.items():
        for j, b in words.items():
            if i < j and a and b:
                common = sum(w in set(a) for w in b)
                union = len(a) + len(b) - common
                if union > 0 and common / union >= 0.7:
                    want.add((i, j, round(common / union, 9)))
    got = related.similar_pairs(spark.createDataFrame(docs, "id long, content string")).collect()
    assert {(r["i"], r["j"], round(r["similarity"], 9)) for r in got} == want
    assert (100, 101, 10.0) in want


def test_contained_in_blocks(spark):
    from pagequarry.operators import related

    pages = spark.createDataFrame(
        [("u1", "See Setup Guide and u2"), ("u2", "nothing"), ("u3", "setup"), ("u4", None), ("u5", 'a <a href="HTTP://h/p/q?x=http://k/z">the  Old\tmill by a River\nbed</a>'), ("u6", "")], "url string, content string"
    )
    patterns = [
        ("u2", "explicit_link", "u2"), ("u3", "mentions", "setup"), ("u1", "mentions", "setup guide"), ("u1", "mentions", "up guid"), ("u2", "mentions", "p g"), ("h", "explicit_link", "http://h/p"), ("k", "explicit_link", "http://k/z"),
        ("n", "explicit_link", "http://k/zz"), ("m", "mentions", "old\tmill by a riv"), ("m2", "mentions", "mill by the river"), ("w", "mentions", " "), ("w2", "mentions", "   "), ("t", "mentions", "bed</a> "), ("o", "mentions", "ld\tmil"), ("u5", "mentions", "river"),
    ]
    rows = [(u, (c + " ").lower()) for u, c in pages.collect() if c is not None]
    want = {(u, d, k) for u, c in rows for d, k, p in patterns if p in c and u != d}
    assert {d for _, d, _ in want} >= {"u2", "u3", "h", "k", "m", "w", "t", "o"}
    for block in (1, 100):
        got = [tuple(r) for r in related.contained(pages, spark.createDataFrame(patterns, "dst string, kind string, pattern string"), block).collect()]
        assert set(got) == want and len(got) == len(want)


def test_frontier_stops_at_pages(spark):
    from pagequarry.operators import crawl

    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "url string")
    assert {tuple(r) for r in crawl.frontier(seeds, edges, 9).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    assert crawl.frontier(seeds, edges, 9, max_pages=2).count() == 2


def test_frontier_runs_until_empty(spark):
    from pagequarry.operators import crawl

    edges = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(12, 3), (20, 21)], "src long, dst long")
    seeds = spark.createDataFrame([(0,)], "url long")
    assert {tuple(r) for r in crawl.frontier(seeds, edges).collect()} == {(i, i) for i in range(13)}


def test_frontier_follows_links_deep(spark):
    differs, _, _ = compare(spark, connection(MEDIUM), catalogue.QUERIES["frontier_bfs"], catalogue.SQL["frontier_bfs"], MEDIUM)
    assert differs is None
    assert catalogue.QUERIES["frontier_bfs"](spark, MEDIUM).agg({"depth": "max"}).first()[0] >= 3


def test_a_level_reads_only_the_buckets_it_meets(spark):
    """A chain with links back: each level has one new URL, and known ones in at most two of the buckets; URLs that no filter knows read nothing."""
    from pagequarry.operators.visited import Visited

    frame = lambda names: spark.createDataFrame([(n,) for n in names], "url string")
    visited = Visited(spark, 64)
    first = [f"u{i}" for i in range(500)]
    assert visited.add(frame(first).withColumn("depth", F.lit(0).cast("long"))) == 500
    assert {r["url"] for r in visited.new(frame(["v1", "v2", "v2", None])).collect()} == {"v1", "v2"}
    assert {r["url"] for r in visited.new(frame(["u3", "v1", "u400", "v9"])).collect()} == {"v1", "v9"}
    assert len(visited.met[0]) <= 1 and 1 <= len(visited.met[1]) <= 3
    visited.add(frame(["v1", "v9"]).withColumn("depth", F.lit(1).cast("long")))
    assert {r["url"] for r in visited.new(frame(["v1", "u7", "w"])).collect()} == {"w"}
    assert visited.add(frame([]).withColumn("depth", F.lit(2).cast("long"))) == 0
    assert {r["url"] for r in visited.new(frame([*first, "v9", "x"])).collect()} == {"x"}
    assert visited.rows().count() == 502


def test_crawl_keeps_one_row_of_a_url(spark):
    from pagequarry.operators import crawl

    web = {"http://a/1": '<a href="/2">x</a><a href="/3">x</a>', "http://a/2": '<a href="/4?q">x</a><a href="/1">x</a>', "http://a/4": '<a href="/5#f">x</a>', "http://a/5": "end"}
    rows = spark.createDataFrame([(u, h) for u, h in web.items() for _ in range(2)], "url string, html string")
    seeds, policies = spark.createDataFrame([("http://a/1",), ("http://a/1?x",), (None,)], "url string"), spark.createDataFrame([("a", True)], "domain string, allowed boolean")
    load = lambda wanted: rows.join(wanted, "url", "left_semi")
    got = sorted((r["url"], r["depth"], r["html"] is not None) for r in crawl.recursive(seeds, load, policies).collect())
    assert got == [("http://a/1", 0, True), ("http://a/2", 1, True), ("http://a/3", 1, False), ("http://a/4", 2, True), ("http://a/5", 3, True)]
    assert crawl.recursive(seeds, load, policies, max_pages=3).count() == 3


def test_page_hierarchy_fixture():
    from pagequarry.operators import tree

    pages = [("http://x/", "home", "Home"), ("http://x/docs/", "docs", "Documentation"), ("http://x/docs/guide/", "docs/guide", "User Guide"), ("http://x/docs/guide/setup", "docs/guide/setup", "Setup Instructions"), ("http://x/api/", "api", "API Reference")]
    nodes = tree.strict_hierarchy(pages)
    assert {(n["path"], n["title"]) for n in nodes} >= {("docs", "Documentation"), ("docs/guide/setup", "Setup Instructions"), ("api", "API Reference"), ("docs", "docs")}


def test_medium_tables_for_the_flagship(spark):
    differs, _, _ = compare(spark, connection(MEDIUM), catalogue.QUERIES["page_quality_report"], catalogue.SQL["page_quality_report"], MEDIUM)
    assert differs is None
