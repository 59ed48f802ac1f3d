"""Assets of pages (AS-01 to AS-10, POL-17, WIN-04 to WIN-06, AGG-08)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.functions import text, urls
from pagequarry.operators.ranking import sum_before


@dataclass(frozen=True)
class AssetPolicy:
    enabled: bool = True
    max_bytes: int = 0
    max_per_page: int = 0
    inline_max_bytes: int = 0
    allow_types: tuple[str, ...] = ()
    block_types: tuple[str, ...] = ()
    optimize: bool = False
    rewrite_prefix: str = "/assets"

    def __post_init__(self):
        if min(self.max_bytes, self.max_per_page, self.inline_max_bytes) < 0:
            raise ValueError("limits must not be negative")
        if self.enabled and not self.rewrite_prefix.startswith("/"):
            raise ValueError("the rewrite prefix must start with /")


def discover(pages: DataFrame, all_candidates: bool = False) -> DataFrame:
    """AS-01, AS-02: page_id, pos, type, asset_url, attr, original of every reference of pages (page_id, url, html)."""

    def run(batches):
        import pyarrow as pa

        from pagequarry.functions import dom

        kinds = (pa.int64(), pa.int64(), *[pa.string()] * 4)
        for b in batches:
            rows = [(i, n, *a) for i, u, h in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True) if h and u for n, a in enumerate(dom.assets(h, u, all_candidates))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["page_id", "pos", "type", "asset_url", "attr", "original"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, pos long, type string, asset_url string, attr string, original string")


def first_occurrences(assets: DataFrame) -> DataFrame:
    """WIN-04: the first of each (page, type, URL)."""
    others = [c for c in assets.columns if c not in ("page_id", "type", "asset_url", "pos")]
    return assets.groupBy("page_id", "type", "asset_url").agg(F.min(F.struct("pos", *others)).alias("v")).select("page_id", "v.pos", "type", "asset_url", *[f"v.{c}" for c in others])


def decide(assets: DataFrame, policy: AssetPolicy) -> DataFrame:
    """POL-17, WIN-05, SET-06: selected references with their mode, at most max_per_page of each page in order."""
    if not policy.enabled:
        return assets.limit(0).withColumn("mode", F.lit(""))
    kept = assets.filter(~F.col("type").isin(*policy.block_types)) if policy.block_types else assets
    kept = kept.filter(F.col("type").isin(*policy.allow_types)) if policy.allow_types else kept
    inline = F.lower("asset_url").rlike(r"\.svg$") if policy.inline_max_bytes else F.lit(False)
    kept = kept.withColumn("mode", F.when(inline, "inline").otherwise("download"))
    if not policy.max_per_page:
        return kept
    w = Window.partitionBy("page_id").orderBy("pos")
    return kept.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= policy.max_per_page).drop("_n")


def within_budget(assets: DataFrame, size: str, most: int) -> DataFrame:
    """WIN-06: references of a page while the bytes before them are below the budget."""
    return sum_before(assets, ["page_id"], ["pos"], size, "before").filter(F.col("before") < most)


def asset_path(prefix: Column, hash_: Column, url: Column) -> Column:
    """AS-05: prefix/hh/hash.ext."""
    return F.concat(prefix, F.lit("/"), F.substring(hash_, 1, 2), F.lit("/"), hash_, urls.extension(urls.path(url)))


def optimised_size(kind: Column, size: Column) -> Column:
    """AS-07: the simulated optimiser's whole-number percentages."""
    percent = F.when(kind == "css", 70).when(kind == "javascript", 65).when(kind == "image", 80).otherwise(100)
    return F.floor(size * percent / 100).cast("long")


def optimised(kind: Column, body: Column) -> Column:
    """AS-06: style sheets and scripts with white space collapsed, if that is shorter."""
    return F.when(kind.isin("stylesheet", "script"), text.minified(body)).otherwise(body)


def execute(actions: DataFrame, policy: AssetPolicy, fetch: Callable[[str], bytes]) -> DataFrame:
    """AS-03, AS-04: actions plus bytes, hash, path, size, optimised, error; `fetch` runs on executors, each asset_url of a page once, and errors are rows."""
    budget = policy.max_bytes

    def run(batches):
        import pyarrow as pa

        for b in batches:
            data, errors = [], []
            for url in b.column("asset_url").to_pylist():
                try:
                    body = fetch(url)
                    data.append(bytes(body[:budget] if budget else body))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 - whatever a fetcher raises is this row's error
                    data.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(data, pa.binary()), pa.array(errors, pa.string())], names=[*b.schema.names, "raw", "error"])

    from pyspark.sql import types as T

    rows = actions.filter(F.col("mode").isin("download", "inline"))
    rows = rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("raw", T.BinaryType()), T.StructField("error", T.StringType())]))
    if budget:
        rows = within_budget(rows.withColumn("_size", F.coalesce(F.octet_length("raw"), F.lit(0)).cast("long")), "_size", budget).drop("_size", "before")
    body = optimised(F.col("type"), F.decode("raw", "UTF-8")) if policy.optimize else None
    rows = rows.withColumn("bytes", F.when(F.col("type").isin("stylesheet", "script"), F.encode(body, "UTF-8")).otherwise(F.col("raw")) if body is not None else F.col("raw"))
    rows = rows.withColumn("hash", F.sha2("bytes", 256))
    return rows.withColumn("path", asset_path(F.lit(policy.rewrite_prefix), F.col("hash"), F.col("asset_url"))).withColumn("size", F.octet_length("bytes").cast("long")).withColumn("optimised", F.octet_length("bytes") < F.octet_length("raw"))


def rewritten(pages: DataFrame, materialised: DataFrame) -> DataFrame:
    """AS-08: page_id, html with every original replaced by its path, in order of hash; a short original may hit inside a longer one, as in the reference."""
    per_page = materialised.filter("bytes IS NOT NULL").groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("hash", "original", "path"))).alias("a"))
    html = F.aggregate(F.coalesce("a", F.array()), F.col("html"), lambda h, a: F.replace(h, a["original"], a["path"]))
    return pages.join(per_page, "page_id", "left").select("page_id", "url", html.alias("html"))


def counters(discovered: DataFrame, selected: DataFrame, materialised: DataFrame) -> DataFrame:
    """AGG-08: one row of counts."""
    a = discovered.agg(F.count("*").alias("discovered"))
    b = selected.agg(F.count("*").alias("selected"), F.count_if(F.col("mode") == "inline").alias("inlined"))
    ok = F.col("error").isNull()
    c = materialised.agg(F.count_if(ok).alias("downloaded"), F.count_if(~ok).alias("failed"), F.count_if(F.col("optimised")).alias("optimized"), F.coalesce(F.sum(F.octet_length("raw")), F.lit(0)).alias("bytes_in"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes_out"))
    return a.join(b, F.lit(True)).join(c, F.lit(True)).withColumn("skipped", F.col("discovered") - F.col("selected"))
