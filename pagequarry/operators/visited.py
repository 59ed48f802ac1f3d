"""A table of visited URLs in hash buckets, with a Bloom filter for each bucket of each level.

A level's candidates meet the filters of their buckets first.  What no filter knows is new without reading a URL; only the buckets of the others are read, and decide.
So a level costs what its candidates and the buckets they meet cost, not all that was visited before.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.operators.ranking import scratch, written

#: bits of a filter for each URL, and places that a URL sets; about 0.3 % of unknown URLs look known
BITS, PLACES = 16, 4
#: URLs of a level in one bucket, about
BUCKET_URLS = 1 << 20


def places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """PLACES bit numbers for each 64-bit hash."""
    h = hashes.view(np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return (low[:, None] + np.arange(PLACES, dtype=np.uint64) * high[:, None]) % np.uint64(bits)


def _filter(key, table):
    """The Bloom filter of one bucket of a level."""
    h = table.column("h").to_numpy()
    bits = max(64, BITS * len(h)) // 8 * 8
    field = np.zeros(bits, np.uint8)
    field[places(h, bits).ravel().astype(np.int64)] = 1
    return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([np.packbits(field).tobytes()], pa.binary())})


def _probe(candidates, filters):
    """Whether any filter of the bucket knows a candidate."""
    h = candidates.column("h").to_numpy()
    known = np.zeros(len(h), bool)
    for bits in filters.column("filter").to_pylist():
        field = np.unpackbits(np.frombuffer(bits, np.uint8))
        known |= field[places(h, len(field)).astype(np.int64)].all(axis=1)
    return pa.table({"url": candidates.column("url"), "bucket": candidates.column("bucket"), "known": known})


class Visited:
    """Visited URLs, or ids of any type, in the shared folder; `met` has the buckets that each level read."""

    def __init__(self, spark: SparkSession, buckets: int = 8):
        self.spark, self.folder, self.buckets, self.levels, self.met = spark, scratch(spark), buckets, 0, []

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("url"), F.lit(self.buckets)).cast("int")

    def add(self, rows: DataFrame) -> int:
        """Writes a level of new URLs (url, depth) by bucket, with its filters; their number."""
        self.kind = rows.schema["url"].dataType.simpleString()
        rows = rows.select("url", "depth", self.bucket().alias("bucket"))
        # a URL's place in a bucket is free: each bucket is one file, whatever task a URL comes from
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/urls/level={self.levels}")
        self.levels += 1
        here = self._level(self.levels - 1)
        made = here.select("bucket", F.xxhash64(F.lit(1), "url").alias("h")).groupBy("bucket").applyInArrow(_filter, "bucket int, filter binary")
        made.write.parquet(f"{self.folder}/filters/level={self.levels - 1}")
        return here.count()

    def _level(self, level: int) -> DataFrame:
        return self.spark.read.schema(f"url {self.kind}, depth long, bucket int").parquet(f"{self.folder}/urls/level={level}")

    def last(self) -> DataFrame:
        """url, depth of the last level."""
        return self._level(self.levels - 1).select("url", "depth")

    def rows(self) -> DataFrame:
        """url, depth of all that was visited."""
        out = self._level(0)
        for level in range(1, self.levels):
            out = out.unionByName(self._level(level))
        return out.select("url", "depth")

    def new(self, candidates: DataFrame) -> DataFrame:
        """The distinct URLs of candidates (url) that were not visited; null is no URL."""
        asked = candidates.select("url").filter("url IS NOT NULL").distinct().select("url", self.bucket().alias("bucket"), F.xxhash64(F.lit(1), "url").alias("h"))
        filters = self.spark.read.schema("bucket int, filter binary").parquet(*[f"{self.folder}/filters/level={i}" for i in range(self.levels)])
        probed = written(asked.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(_probe, f"url {self.kind}, bucket int, known boolean"))
        doubtful = probed.filter("known")
        met = sorted(r["bucket"] for r in doubtful.select("bucket").distinct().collect())  # numbers of buckets
        self.met.append(met)
        if not met:
            return probed.select("url")
        read = None
        for level in range(self.levels):
            part = self._level(level).filter(F.col("bucket").isin(met)).select("url")
            read = part if read is None else read.unionByName(part)
        return probed.filter("NOT known").select("url").unionByName(doubtful.select("url").join(read, "url", "left_anti"))
