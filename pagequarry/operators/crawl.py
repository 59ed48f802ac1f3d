"""Crawl decisions and the frontier (POL-01 to POL-05, JN-07, JN-10, SRC-05)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.functions import urls
from pagequarry.operators.ranking import scratch
from pagequarry.operators.visited import BUCKET_URLS, Visited
from pagequarry.sources import pages


def suffixes(host: Column) -> Column:
    """A host and all its parent domains, the longest first."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def domain_policy(rows: DataFrame, policies: DataFrame, host: str = "host") -> DataFrame:
    """JN-09, JN-10: rows with the policy of the exact host, else of the most specific parent domain, else nulls.

    policies: domain (unique) and more columns.  One equi-join on the exploded parent domains of the *distinct* hosts, so a host with a large share
    of the rows is resolved once.
    """
    hosts = rows.select(host).distinct().filter(F.col(host).isNotNull())
    tried = hosts.select(host, F.posexplode(suffixes(F.col(host))).alias("_level", "domain")).join(policies, "domain")
    columns = [c for c in policies.columns if c != "domain"]
    best = tried.groupBy(host).agg(F.min_by(F.struct("domain", *columns), "_level").alias("_p"))
    return rows.join(best, host, "left").select(*rows.columns, F.col("_p.domain").alias("policy_domain"), *[F.col(f"_p.{c}").alias(c) for c in columns])


def crawl_decisions(rows: DataFrame, policies: DataFrame, max_depth: int, follow_external: bool) -> DataFrame:
    """POL-01, POL-03: should_crawl and reason for rows of url, depth; policies: domain, allowed."""
    known = domain_policy(rows.withColumn("host", urls.host(F.col("url"))), policies)
    external = F.col("policy_domain").isNull()
    reason = (
        F.when(F.col("host").isNull(), "invalid URL")
        .when(~F.coalesce("allowed", F.lit(False)), "domain not allowed")
        .when((F.col("depth") >= max_depth) | (external & F.lit(not follow_external)), "exceeds maximum depth")
        .otherwise("")
    )
    return known.withColumn("reason", reason).withColumn("should_crawl", F.col("reason") == "")


def follow_decisions(links: DataFrame, policies: DataFrame, max_depth: int, follow_external: bool) -> DataFrame:
    """POL-02: should_follow and reason for rows of url, target, depth."""
    rows = links.withColumn("base_host", urls.host(F.col("url"))).withColumn("host", urls.host(F.col("target")))
    known = domain_policy(rows, policies)
    reason = (
        F.when(F.col("depth") + 1 >= max_depth, "exceeds maximum depth")
        .when(~F.col("base_host").eqNullSafe(F.col("host")) & F.lit(not follow_external), "external links disabled")
        .when(~F.coalesce("allowed", F.lit(False)), "target domain not allowed")
        .otherwise("")
    )
    return known.withColumn("reason", reason).withColumn("should_follow", F.col("reason") == "")


def recursive(seeds: DataFrame, load: Callable[[DataFrame], DataFrame], policies: DataFrame, max_depth: int | None = None, max_pages: int | None = None, follow_external: bool = False, buckets: int = 8) -> DataFrame:
    """SRC-05: what `load` (urls to rows with url, html and more) gives for the seeds and for all that can be reached by the links in it, with depth.

    URLs are known without query and fragment.  A level is loaded once and written to the shared folder; its links, as far as the policies (domain, allowed) let
    them be followed, less all URLs of earlier levels, are the next.  Only counts come to the driver.  The crawl ends when nothing new is found, at
    max_depth links, or at max_pages URLs (of the level that reaches it the first by URL).  A URL that `load` has no row for stays, without html; of several rows one is kept.
    buckets: of the visited table; about one for each million URLs that a level may have.
    """
    spark = seeds.sparkSession
    folder = scratch(spark)
    visited = Visited(spark, buckets)
    wanted = seeds.select(urls.canonical(F.col("url")).alias("url")).filter("url IS NOT NULL").distinct()
    level, total = 0, 0
    while True:
        if max_pages is not None:
            wanted = wanted.orderBy("url").limit(max_pages - total)
        found = visited.add(wanted.withColumn("depth", F.lit(level).cast("long")))
        asked = visited.last()
        # a source may give a URL twice; one row of it is enough
        rows = asked.join(load(asked.select("url")).dropDuplicates(["url"]), "url", "left")
        rows.write.parquet(f"{folder}/level={level}")
        here = spark.read.schema(rows.schema).parquet(f"{folder}/level={level}")
        total += found
        if not found or (max_depth is not None and level >= max_depth) or (max_pages is not None and total >= max_pages):
            break
        level += 1
        links = pages.links(here.select(F.xxhash64("url").alias("page_id"), "url", "html")).withColumn("depth", F.lit(level - 1))
        followed = follow_decisions(links, policies, (max_depth or level) + 1, follow_external).filter("should_follow")
        wanted = visited.new(followed.select(urls.canonical(F.col("target")).alias("url")))
    return spark.read.schema(here.schema).parquet(*[f"{folder}/level={i}" for i in range(level + 1)])


def buckets_for(rows: DataFrame) -> int:
    """Buckets of a visited table for at most so many URLs."""
    return max(8, -(-rows.count() // BUCKET_URLS))


def frontier(seeds: DataFrame, edges: DataFrame, max_depth: int | None = None, max_pages: int | None = None) -> DataFrame:
    """SRC-05, JN-07, WIN-09: url, depth of every page that seeds reach, within max_depth links if given; edges: src, dst.

    A level is an equi-join of the last one with the edges and a look into the buckets of the visited table that its targets meet; only counts and numbers of buckets
    come to the driver.  With max_pages the search stops after the level that reaches it.
    """
    visited = Visited(seeds.sparkSession, buckets_for(edges))
    total = visited.add(seeds.select("url").distinct().withColumn("depth", F.lit(0).cast("long")))
    level = 0
    while (max_depth is None or level < max_depth) and (max_pages is None or total < max_pages):
        targets = edges.join(visited.last().select(F.col("url").alias("src")), "src").select(F.col("dst").alias("url"))
        level += 1
        found = visited.add(visited.new(targets).withColumn("depth", F.lit(level).cast("long")))
        total += found
        if not found:
            break
    return visited.rows()
