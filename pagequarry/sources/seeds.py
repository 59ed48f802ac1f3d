"""Seeds, journals and a page source with an injected fetcher."""

from __future__ import annotations

import heapq
import random
import time
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagequarry.functions import urls as url_functions
from pagequarry.streaming import limiter


def inline_seeds(spark: SparkSession, text: str) -> DataFrame:
    """SRC-01: pos, url of a comma-separated list."""
    df = spark.createDataFrame([(text,)], "t string").select(F.posexplode(F.split("t", ",")).alias("pos", "url"))
    return df.select(F.col("pos").cast("long").alias("pos"), F.trim("url").alias("url")).filter("url <> ''")


def file_seeds(spark: SparkSession, path: str) -> DataFrame:
    """SRC-02: one seed a line, `#` starts a comment line."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("pos"), F.trim("value").alias("url"))
    return lines.filter((F.col("url") != "") & ~F.col("url").startswith("#"))


def first_of_each(seeds: DataFrame, by: str = "url", order: str = "pos") -> DataFrame:
    """SRC-03: the first of each, in order; a partial aggregate, so a hot seed costs a row for each task."""
    others = [c for c in seeds.columns if c not in (by, order)]
    picked = seeds.groupBy(by).agg(F.min(F.struct(order, *others)).alias("v"))
    return picked.select(*[F.col(by) if c == by else F.col(f"v.{c}").alias(c) for c in seeds.columns])


def journal(spark: SparkSession, path: str) -> DataFrame:
    """SRC-09: processed URLs; a missing journal skips nothing."""
    try:
        return spark.read.text(path).select(F.trim("value").alias("url")).filter("url <> ''")
    except Exception as error:  # noqa: BLE001 - only a missing path means an empty journal
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], "url string")


def remaining(seeds: DataFrame, done: DataFrame) -> DataFrame:
    """JN-06, SET-03: seeds that the journal lacks."""
    return seeds.join(done.select("url").distinct(), "url", "left_anti")


def config_history(spark: SparkSession, path: str) -> DataFrame:
    """SRC-14, CFG-03: versions in a folder of JSON files, bad files left out."""
    schema = "version string, description string, created_at timestamp, author string, config string, _bad string"
    rows = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_bad").option("pathGlobFilter", "*.json").json(path)
    return rows.filter("_bad IS NULL AND version IS NOT NULL").drop("_bad").orderBy("created_at", "version")


@dataclass(frozen=True)
class Politeness:
    """STR-03, STR-05, STR-06: how a task fetches: the waits between attempts, and whether a domain's rate limiter gives permits.

    The wait before attempt n + 1 is drawn evenly from 0 to least * 2**(n - 1) seconds, at most `most` (full jitter).
    """

    least: float = 0.2
    most: float = 5.0
    limited: bool = True
    clock: Callable[[], float] = time.time
    sleep: Callable[[float], None] = time.sleep
    seed: int | None = None

    def wait(self, attempt: int, draw: Callable[[], float]) -> float:
        longest = min(self.most, self.least * 2 ** min(attempt - 1, 60))
        return draw() * longest or longest


def fetch_all(urls: list[str], fetch: Callable[[str], tuple[int, str]], retries: int, manner: Politeness, states: dict) -> list[tuple]:
    """(url, status, html, error, attempts) of every URL, in order.  What waits for its time lets others go first, so a slow domain holds up only itself."""
    draw = random.Random(manner.seed).random
    rows: list = [None] * len(urls)
    queue: list[tuple[float, int, int]] = []  # ready at, place, attempt
    for i, url in enumerate(urls):
        if url:
            queue.append((0.0, i, 1))
        else:
            rows[i] = (url, None, None, "empty url", 0)
    heapq.heapify(queue)
    while queue:
        ready, i, attempt = heapq.heappop(queue)
        now = manner.clock()
        if ready > now:
            manner.sleep(ready - now)
            now = max(ready, manner.clock())
        url, again = urls[i], True
        domain = urlsplit(url).netloc.lower().rpartition("@")[2] if manner.limited else ""
        if domain:
            states[domain], decision, wait = limiter.step(states.get(domain, limiter.START), "acquire", now, False)
            if decision == "wait":
                heapq.heappush(queue, (now + max(wait, 0.001), i, attempt))  # so that time goes on
                continue
        if domain and decision == "rejected":
            rows[i] = (url, None, None, "circuit open", attempt)
        else:
            try:
                status, html = fetch(url)
                again = status >= 500 or status == 429
                rows[i] = (url, status, html, None if status < 400 else f"status {status}", attempt)
            except Exception as e:  # noqa: BLE001 - whatever a fetcher raises is this row's error
                rows[i] = (url, None, None, f"{type(e).__name__}: {e}", attempt)
            if domain:
                states[domain] = limiter.step(states[domain], "feedback", manner.clock(), again)[0]
        if again and attempt < retries:
            heapq.heappush(queue, (manner.clock() + manner.wait(attempt, draw), i, attempt + 1))
    return rows


def fetched(urls: DataFrame, fetch: Callable[[str], tuple[int, str]], retries: int = 3, manner: Politeness | None = None) -> DataFrame:
    """SRC-04, STR-03, STR-05: url, status, html, error, attempts; `fetch` runs on executors, at most `retries` times a URL with growing waits, and errors are rows.

    With a limiter (manner.limited) all URLs of a domain go to one task, whose token bucket and breaker give the permits: a domain's rate is sequential by
    nature.  Without one, URLs stay where they are.  A task that is lost fetches again; write the result out before using it twice.
    """
    manner = manner or Politeness(limited=False)

    def run(batches):
        import pyarrow as pa

        states: dict = {}
        for b in batches:
            rows = fetch_all(b.column("url").to_pylist(), fetch, retries, manner, states)
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["url", "status", "html", "error", "attempts"])

    wanted = urls.select("url")
    if manner.limited:
        wanted = wanted.repartition(url_functions.host(F.col("url")))
    return wanted.mapInArrow(run, "url string, status int, html string, error string, attempts int")


def ranked(df: DataFrame, keys: list[str], *order, most: int) -> DataFrame:
    """The first `most` rows of each key; Spark limits each task's groups before the exchange."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).filter(F.col("rank") <= most)
