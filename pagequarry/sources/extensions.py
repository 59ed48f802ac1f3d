"""Extension surfaces and further sources (EXT-01 to EXT-05, EXT-08, SRC-06 to SRC-08, SRC-10, SRC-15 to SRC-17, SNK-14, JN-08, SET-02, STR-09)."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from pagequarry.functions import text
from pagequarry.sources import pages


class Fetcher(Protocol):
    """EXT-01: url -> (status, html); it runs on executors and may raise."""

    def __call__(self, url: str) -> tuple[int, str]: ...


class Processor(Protocol):
    """EXT-02, EXT-05: any DataFrame -> DataFrame, for `df.transform`, in front of or behind a stage or a sink."""

    def __call__(self, rows: DataFrame) -> DataFrame: ...


class Sink(Protocol):
    """EXT-03: a micro-batch and its number; it must bear to see a number twice."""

    def __call__(self, batch: DataFrame, number: int) -> None: ...


class AssetStrategy(Protocol):
    """EXT-04: the life of assets as tables: discover (one page to many references), decide, execute, rewrite."""

    def discover(self, pages: DataFrame) -> DataFrame: ...

    def decide(self, references: DataFrame) -> DataFrame: ...

    def execute(self, actions: DataFrame) -> DataFrame: ...

    def rewrite(self, pages: DataFrame, materialised: DataFrame) -> DataFrame: ...


class _Slice(InputPartition):
    """Some URLs, or a file of them."""

    def __init__(self, urls: list[str], file: str | None = None):
        self.urls, self.file = urls, file

    def __iter__(self) -> Iterator[str]:
        yield from self.urls
        if self.file:
            with open(self.file, encoding="utf-8") as lines:
                yield from (x for line in lines if (x := line.strip()) and not x.startswith("#"))


class _PageReader(DataSourceReader):
    def __init__(self, urls: list[str], folder: str | None, fetch: Fetcher, parts: int):
        self.urls, self.folder, self.fetch, self.parts = urls, folder, fetch, max(1, parts)

    def partitions(self) -> list[_Slice]:
        if self.folder:
            return [_Slice([], f.path) for f in sorted(os.scandir(self.folder), key=lambda f: f.name) if f.is_file() and not f.name.startswith(("_", "."))] or [_Slice([])]
        return [_Slice(self.urls[i :: self.parts]) for i in range(self.parts) if self.urls[i :: self.parts]] or [_Slice([])]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        for url in partition:
            try:
                status, html = self.fetch(url)
                yield url, status, html, None
            except Exception as e:  # noqa: BLE001 - an error is this row's
                yield url, None, None, f"{type(e).__name__}: {e}"


def page_source(name_: str, fetch: Fetcher) -> type[DataSource]:
    """EXT-01, SRC-04: a Spark data source of that name: `spark.read.format(name).option("urls", "u1 u2").option("partitions", 2).load()`, or
    `.option("seeds", folder)` for a shared folder of text files, a URL a line: a file is a partition that executors read, so the URLs never come to the driver.
    """

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return name_

        def schema(self) -> str:
            return "url string, status int, html string, error string"

        def reader(self, schema) -> DataSourceReader:
            return _PageReader(self.options.get("urls", "").split(), self.options.get("seeds"), fetch, int(self.options.get("partitions", "1")))

    return Pages


def seed_union(*parts: DataFrame) -> DataFrame:
    """SET-02: distinct URLs of several seed tables."""
    out = parts[0].select("url")
    for p in parts[1:]:
        out = out.unionByName(p.select("url"))
    return out.distinct()


def with_cache(urls: DataFrame, cache: DataFrame, columns: Iterable[str]) -> DataFrame:
    """JN-08, STR-09: urls with what a cache table (url unique) has, and whether it hit; Spark's block manager keeps and spills, so there is no LRU to write."""
    known = cache.select("url", *columns, F.lit(True).alias("hit"))
    return urls.join(known, "url", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def crawler_page(html: Column) -> Column:
    """SRC-06, HTML-06: struct<title, words> as the crawler reads a page: title, else h1, else og:title, else `Untitled`; all text counts, scripts too."""
    pick = lambda pattern: F.nullif(text.trimmed(F.regexp_extract(html, pattern, 1)), F.lit(""))
    shared = F.nullif(text.trimmed(pages.meta(html, "og:title", "property")), F.lit(""))
    title = F.coalesce(pick(r"(?is)<title[^>]*>(.*?)</title>"), pick(r"(?is)<h1[^>]*>(.*?)</h1>"), shared, F.lit("Untitled"))
    return F.struct(title.alias("title"), text.word_count(html).alias("words"))


def simulated(urls: DataFrame) -> DataFrame:
    """SRC-17: url, title, success of a deterministic test source: a URL with `fail-extraction` fails."""
    failed = F.col("url").contains("fail-extraction")
    return urls.select("url", F.when(~failed, F.lit("Test Page")).alias("title"), (~failed).alias("success"))


def capped(fetch: Callable[[str], tuple[int, bytes]], most: int) -> Callable[[str], bytes]:
    """SRC-07: a fetch of at most `most` bytes (0: all); any status but 200 raises."""

    def get(url: str) -> bytes:
        status, body = fetch(url)
        if status != 200:
            raise OSError(f"status {status}")
        return body[:most] if most else body

    return get


def download(fetch: Callable[[str], bytes], folder: str) -> Callable[[str, str], str]:
    """SRC-08: (url, name) -> path in a shared folder; a file that is there counts as downloaded, and a download appears at once or not at all."""

    def get(url: str, name: str) -> str:
        path = os.path.join(folder, name)
        if not os.path.exists(path):
            os.makedirs(folder, exist_ok=True)
            part = f"{path}.{os.getpid()}.part"
            with open(part, "wb") as f:
                f.write(fetch(url))
            os.replace(part, path)
        return path

    return get


def experiment_results(spark: SparkSession, path: str, pretty: bool = False) -> DataFrame:
    """SRC-15: recorded results of A/B tests, from JSON lines or arrays on one line; with `pretty` from one array over many lines a file."""
    return spark.read.schema("test_id string, user_id string, variant string, success boolean, response_time double, recorded_at timestamp").option("multiLine", pretty).json(path)


def record_results(results: DataFrame, path: str) -> None:
    """SNK-14: appends results; files are added, none is rewritten."""
    results.write.mode("append").json(path)


def watch(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """SRC-16: JSON files that appear in a folder, as a stream; with STR-19's checksums only changes pass on."""
    return spark.readStream.schema(schema).json(folder)


def spill(rows: DataFrame, path: str, key: str = "url", folders: int = 64) -> None:
    """SNK-10: rows written aside as JSON, in folders by the FNV-1a hash of their key, so that one key is found without reading all."""
    bucket = F.lpad(F.hex(F.pmod(text.fnv32a(F.coalesce(F.col(key), F.lit(""))), F.lit(folders))), 2, "0")
    rows.withColumn("spill", bucket).write.mode("append").partitionBy("spill").json(path)


def spilled(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-10: rows written aside as JSON, read again, without the column of the folders."""
    return spark.read.schema(schema).json(path).select(*StructType.fromDDL(schema).names)
