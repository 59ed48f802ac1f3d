"""Telemetry as tables (OBS-01 to OBS-11, AGG-20, AGG-21, STR-12 to STR-14, STR-18, SNK-11, SNK-13)."""

from __future__ import annotations

import contextlib
import functools
import json
import threading
import time
import uuid
from collections.abc import Callable, Sequence
from datetime import UTC, datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

EVENT = "time timestamp, category string, type string, severity string, trace_id string, span_id string, labels map<string,string>, fields string"


def samples(df: DataFrame, name: Column, labels: list[str], value: Column, kind: str) -> DataFrame:
    """OBS-01: name, labels, kind, value: counters are sums, gauges the largest, in one aggregate."""
    agg = F.sum("_v") if kind == "counter" else F.max("_v")
    rows = df.select(name.alias("name"), *labels, value.cast("double").alias("_v"))
    shown = F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), F.array(*[F.col(x).cast("string") for x in labels])) if labels else F.create_map().cast("map<string,string>")
    return rows.groupBy("name", *labels).agg(agg.alias("value")).select("name", shown.alias("labels"), F.lit(kind).alias("kind"), "value")


def exposition(metrics: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """SNK-11, OBS-04: one text line for each sample; totals are shown as they are, never added again on a later scrape."""
    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), F.regexp_replace(e["value"], r'([\\"])', r"\\$1"), F.lit('"')))
    return metrics.select(*keep, F.concat("name", F.when(F.size("labels") > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise(""), F.lit(" "), F.col("value").cast("string")).alias("line"))


def scrape(metrics: DataFrame, help_: dict[str, str] | None = None) -> DataFrame:
    """SNK-11, OBS-04: name, pos, line: the whole text of a scrape, in order: `# HELP` and `# TYPE` in front of the samples of each name.

    metrics: name, labels, kind, value, as `samples` and `buckets` make them; the samples of a histogram follow the name they end in.
    """
    shown = F.create_map(*[F.lit(x) for kv in (help_ or {}).items() for x in kv]) if help_ else F.create_map().cast("map<string,string>")
    of = F.when(F.col("kind") == "histogram", F.regexp_replace("name", "_(bucket|sum|count)$", "")).otherwise(F.col("name"))
    rows = metrics.withColumn("family", of)
    heads = rows.select("family", "kind").distinct().select("family", F.array(F.concat(F.lit("# HELP "), "family", F.lit(" "), F.coalesce(shown[F.col("family")], F.col("family"))), F.concat(F.lit("# TYPE "), "family", F.lit(" "), "kind")).alias("lines"))
    heads = heads.select(F.col("family").alias("name"), F.posexplode("lines").alias("pos", "line"))
    samples_ = exposition(rows.withColumn("_family", F.col("family")), keep=("_family",))
    n = F.row_number().over(Window.partitionBy("_family").orderBy("line")) + 1
    return heads.withColumn("pos", F.col("pos").cast("long")).unionByName(samples_.select(F.col("_family").alias("name"), n.cast("long").alias("pos"), "line"))


def buckets(df: DataFrame, name: str, labels: list[str], value: Column, bounds: list[float]) -> DataFrame:
    """OBS-01: a histogram as name, labels, kind, value: a cumulative count for each bound and +Inf, the sum and the count, in one aggregate."""
    counted = [F.count_if(F.col("_v") <= b).alias(f"_{i}") for i, b in enumerate(bounds)]
    agg = df.select(*labels, value.cast("double").alias("_v")).groupBy(*labels).agg(*counted, F.count("_v").alias("_n"), F.sum("_v").alias("_s"))
    own = [F.lit(x) if i % 2 == 0 else F.col(x).cast("string") for x in labels for i in range(2)]
    entry = lambda suffix, v, le=None: F.struct(F.lit(name + suffix).alias("name"), (F.create_map(*own, *([F.lit("le"), F.lit(le)] if le else [])) if own or le else F.create_map().cast("map<string,string>")).alias("labels"), v.cast("double").alias("value"))
    rows = [entry("_bucket", F.col(f"_{i}"), str(float(b))) for i, b in enumerate(bounds)] + [entry("_bucket", F.col("_n"), "+Inf"), entry("_sum", F.col("_s")), entry("_count", F.col("_n"))]
    return agg.select(F.inline(F.array(*rows))).select("name", "labels", F.lit("histogram").alias("kind"), "value")


class Endpoints:
    """SNK-12: /healthz (JSON; 503 when unhealthy) and /metrics (text) of a driver, as long as the context lasts; port 0 takes a free one."""

    def __init__(self, health: Callable[[], dict], lines: Callable[[], Sequence[str]], port: int = 0, host: str = "127.0.0.1"):
        outer = self
        self.health, self.lines = health, lines

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):  # noqa: N802 - the name that the server calls
                if self.path.split("?")[0] == "/healthz":
                    found = outer.health()
                    status, kind, body = (503 if found.get("status") == "unhealthy" else 200), "application/json", json.dumps(found, default=str)
                elif self.path.split("?")[0] == "/metrics":
                    status, kind, body = 200, "text/plain; version=0.0.4", "".join(f"{x}\n" for x in outer.lines())
                else:
                    status, kind, body = 404, "text/plain", "not found\n"
                data = body.encode()
                self.send_response(status)
                self.send_header("Content-Type", kind)
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def log_message(self, *_):
                """Requests are not logged."""

        self.server = ThreadingHTTPServer((host, port), Handler)
        self.port = self.server.server_address[1]

    def __enter__(self) -> Endpoints:
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        return self

    def __exit__(self, *_) -> None:
        self.server.shutdown()
        self.server.server_close()


class Monitor:
    """OBS-06, OBS-09: business operations of the driver as spans: `with monitor.operation(name, key=value)`, or a function that is wrapped once."""

    COLUMNS = "trace_id string, span_id string, parent_id string, name string, attributes map<string,string>, start timestamp, end timestamp, error string"

    def __init__(self, clock: Callable[[], float] = time.time):
        self.clock, self.spans, self._open = clock, [], []

    @contextlib.contextmanager
    def operation(self, name: str, **attributes):
        parent = self._open[-1] if self._open else None
        own = {"trace_id": parent["trace_id"] if parent else uuid.uuid4().hex, "span_id": uuid.uuid4().hex[:16], "parent_id": parent["span_id"] if parent else None, "name": name, "attributes": {k: str(v) for k, v in attributes.items()}, "error": None}
        self._open.append(own)
        began = self.clock()
        try:
            yield own["attributes"]
        except Exception as e:
            own["error"] = f"{type(e).__name__}: {e}"
            raise
        finally:
            self._open.remove(own)
            self.spans.append({**own, "start": datetime.fromtimestamp(began, UTC), "end": datetime.fromtimestamp(self.clock(), UTC)})

    def watched(self, name: str, f: Callable, **attributes) -> Callable:
        """f, every call of which is an operation."""

        @functools.wraps(f)
        def call(*args, **kwargs):
            with self.operation(name, **attributes):
                return f(*args, **kwargs)

        return call

    def table(self, spark) -> DataFrame:
        """The spans so far, for span_tree and the rest."""
        names = [c.split()[0] for c in self.COLUMNS.split(", ")]
        return spark.createDataFrame([tuple(s[n] for n in names) for s in self.spans], self.COLUMNS)


def dotted(name: Column) -> Column:
    """OBS-01: a name for exporters that use dots."""
    return F.regexp_replace(name, "_", ".")


def sampled(rows: DataFrame, trace: str, percent: float) -> DataFrame:
    """STR-18: whole traces, by the MD5 of the trace id, so that every span follows its root's decision, in whatever system it is taken."""
    number = F.conv(F.substring(F.md5(F.col(trace).cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    return rows.filter(number % 10_000 < int(percent * 100))


def span_tree(spans: DataFrame) -> DataFrame:
    """OBS-05: spans (trace_id, span_id, parent_id, start, end) with their parent's start and their own duration in microseconds."""
    up = spans.select(F.col("trace_id"), F.col("span_id").alias("parent_id"), F.col("start").alias("parent_start"))
    return spans.join(up, ["trace_id", "parent_id"], "left").withColumn("micros", F.unix_micros("end") - F.unix_micros("start"))


def correlated_log(events: DataFrame) -> DataFrame:
    """OBS-07: one JSON line for each event, with trace and span."""
    return events.select(F.to_json(F.struct(*events.columns)).alias("value"))


def sink_stats(writes: DataFrame) -> DataFrame:
    """AGG-20: writes, errors, bytes and mean latency by sink."""
    return writes.groupBy("sink").agg(F.count("*").alias("writes"), F.count_if("failed").alias("errors"), F.sum("bytes").alias("bytes"), F.avg("latency").alias("mean_latency"))


def delivered(events: DataFrame, subscribers: DataFrame, order: Sequence[str] = ("time",)) -> DataFrame:
    """STR-12, AGG-21: which events each subscriber (name, category, buffer) gets of a burst: the first `buffer`, later ones are dropped."""
    rows = events.join(subscribers, (subscribers.category == events.category) | (subscribers.category == "*")).drop(subscribers.category)
    n = F.row_number().over(Window.partitionBy("name").orderBy(*order))
    return rows.withColumn("dropped", n > F.col("buffer"))


def bus_stats(delivered_: DataFrame) -> DataFrame:
    """AGG-21."""
    return delivered_.groupBy("name").agg(F.count_if(~F.col("dropped")).alias("delivered"), F.count_if("dropped").alias("dropped"))


class Progress(StreamingQueryListener):
    """STR-13, STR-14, SNK-13: passes the progress of streaming queries to observers; an observer's error stops no query."""

    def __init__(self, *observers: Callable[[dict], None]):
        self.observers, self.errors = list(observers), []

    def _tell(self, kind: str, **fields) -> None:
        for observer in self.observers:
            try:
                observer({"type": kind, **fields})
            except Exception as e:  # noqa: BLE001 - observers are isolated
                self.errors.append(e)

    def onQueryStarted(self, event) -> None:
        self._tell("started", id=str(event.id))

    def onQueryProgress(self, event) -> None:
        self._tell("progress", **json.loads(event.progress.json))

    def onQueryIdle(self, event) -> None:
        self._tell("idle", id=str(event.id))

    def onQueryTerminated(self, event) -> None:
        self._tell("terminated", id=str(event.id), error=event.exception)
