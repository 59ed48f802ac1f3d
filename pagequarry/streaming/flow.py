"""Streaming flow (STR-01 to STR-04, STR-11 to STR-14, SNK-01 to SNK-09): sources, stages, sinks and resume on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def pages_stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """STR-02: pages as a stream; files_per_trigger is the back-pressure."""
    return spark.readStream.schema("page_id long, url string, html string").option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def staged(rows: DataFrame, *stages: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """STR-01: stages one after the other; narrow stages fuse into one pass."""
    for stage in stages:
        rows = rows.transform(stage)
    return rows


def finish(rows: DataFrame, out: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """STR-04, STR-11: everything there is, then stop; a restart with the same checkpoint resumes, and files are written exactly once."""
    return rows.writeStream.format(fmt).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def in_flight(rows: DataFrame, most: int) -> DataFrame:
    """STR-10: rows in as many partitions as may be worked on at a time."""
    return rows.repartition(max(1, most))


def stopped(queries: Sequence[StreamingQuery], drain: bool = True) -> None:
    """STR-20: ends streams: what has arrived is worked off first, unless `drain` is off; a failed stream does not keep the others."""
    for q in queries:
        try:
            if drain and q.isActive:
                q.processAllAvailable()
        finally:
            q.stop()


Sink = Callable[[DataFrame, int], None]


def tee(rows: DataFrame, sinks: Sequence[Sink], checkpoint: str) -> StreamingQuery:
    """SNK-06: every micro-batch to every sink, computed once; it fails only if all sinks fail.  At least once: a sink sees a repeated batch id after a failure."""

    def write(batch: DataFrame, number: int) -> None:
        kept, errors = batch.persist(), []
        try:
            for sink in sinks:
                try:
                    sink(kept, number)
                except Exception as e:  # noqa: BLE001 - one sink's failure must not stop the others
                    errors.append(e)
        finally:
            kept.unpersist()
        if errors and len(errors) == len(sinks):
            raise errors[0]

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def buffered(sink: Sink, before: Callable[[DataFrame], DataFrame] | None = None, after: Callable[[DataFrame, int], None] | None = None) -> Sink:
    """SNK-05: a sink with a function before it and one after."""

    def write(batch: DataFrame, number: int) -> None:
        batch = before(batch) if before else batch
        sink(batch, number)
        if after:
            after(batch, number)

    return write


def forwarding(first: Sink, *others: Sink) -> Sink:
    """SNK-08: a sink that passes each batch on to others once it has it; the first that fails ends the batch."""

    def write(batch: DataFrame, number: int) -> None:
        for sink in (first, *others):
            sink(batch, number)

    return write


def json_sink(path: str) -> Sink:
    """SNK-02: one compact JSON line for each row; a repeated batch overwrites itself."""
    return lambda batch, number: batch.write.mode("overwrite").json(f"{path}/batch={number}")


def journal_sink(path: str) -> Sink:
    """SNK-09: processed URLs, appended by batch; at least once."""
    return lambda batch, number: batch.select(F.col("url").alias("value")).write.mode("overwrite").text(f"{path}/batch={number}")


def event_windows(events: DataFrame, late: str = "10 minutes", length: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Windowed counts of a stream with a watermark (an extension): start, event_type, n, total."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    rows = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n", "total")
