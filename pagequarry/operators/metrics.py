"""Aggregates over operational events (AGG-01 to AGG-25, WIN-08, LIM-01, LIM-02, STR-16, OBS-02).

All are one partial and one final aggregate; hot keys cost a row for each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.operators.ranking import beside

#: Bounds of the page-duration histogram in seconds, and the severity of states
DURATION_BOUNDS = (0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
SEVERITY = {"healthy": 0, "unknown": 1, "degraded": 2, "unhealthy": 3}


def outcome_counts(df: DataFrame, keys: list[str], ok: Column) -> DataFrame:
    """AGG-01, AGG-05, AGG-09: total, ok, failed, success_rate by key."""
    n, good = F.count("*"), F.count_if(ok)
    return df.groupBy(*keys).agg(n.alias("total"), good.alias("succeeded"), (n - good).alias("failed"), (good.cast("double") / n.cast("double")).alias("success_rate"))


def mean_latency(value: Column) -> Column:
    """AGG-07: integer division of whole units."""
    return F.expr("0") if value is None else F.floor(F.sum(value) / F.count(value)).cast("long")


def rule_rollup(df: DataFrame, policy: str, rule: str, micros: Column, ok: Column) -> DataFrame:
    """AGG-09, AGG-10: by (policy, rule), by policy and in all, from one scan; a missing level is `*`."""
    base = df.select(F.col(policy).alias("policy"), F.col(rule).alias("rule"), micros.alias("micros"), ok.alias("ok"))
    agg = base.rollup("policy", "rule").agg(F.count("*").alias("total"), F.count_if("ok").alias("succeeded"), F.sum("micros").alias("micros"), F.grouping_id().alias("level"))
    return agg.select(
        F.when(F.col("level") < 3, F.col("policy")).otherwise("*").alias("policy"), F.when(F.col("level") < 1, F.col("rule")).otherwise("*").alias("rule"), "total", "succeeded", F.floor(F.col("micros") / F.col("total")).cast("long").alias("mean_micros"), (F.col("succeeded").cast("double") / F.col("total").cast("double")).alias("success_rate")
    )


def strategy_metrics(df: DataFrame, strategy: str, items: Column, good: Column) -> DataFrame:
    """AGG-11: runs, items, successes and their percentage (null without items)."""
    return df.groupBy(F.col(strategy).alias("strategy")).agg(F.count("*").alias("runs"), F.sum(items).alias("items"), F.sum(good).alias("successful")).withColumn("success_percent", F.try_divide(F.col("successful").cast("double"), F.col("items").cast("double")) * 100.0)


def latest(df: DataFrame, key: str, ts: str, tie: str, *values: str) -> DataFrame:
    """AGG-12: the last values of each key."""
    return df.groupBy(key).agg(F.max(F.struct(ts, tie, *values)).alias("v")).select(key, F.col(f"v.{ts}").alias(ts), *[F.col(f"v.{c}").alias(c) for c in values])


def histogram(df: DataFrame, keys: list[str], value: Column, bounds=DURATION_BOUNDS) -> DataFrame:
    """AGG-23: cumulative counts by upper bound (`le`), +Inf as infinity."""
    counts = df.groupBy(*keys).agg(*[F.count_if(value <= b).alias(f"b{i}") for i, b in enumerate(bounds)], F.count(value).alias(f"b{len(bounds)}"))
    entries = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate((*bounds, float("inf")))])
    return counts.select(*keys, F.inline(entries))


def cardinality(df: DataFrame, metric: str, label: Column, limit: int = 100) -> DataFrame:
    """AGG-22: distinct label values of each metric and whether they pass the limit."""
    return df.groupBy(metric).agg(F.count_distinct(label).alias("n_labels")).withColumn("exceeded", F.col("n_labels") > limit)


def windowed_ratio(df: DataFrame, ts: str, ok: Column, length: str, slide: str | None = None) -> DataFrame:
    """AGG-24: start, n, failed, ratio of failures in tumbling or sliding windows.

    Events are counted once, by slide; a window adds the counts of its slides, so only those few rows are copied.  A length that is no multiple of the slide counts each event in each
    window it is in.
    """
    rows = df.select(F.col(ts).alias("_ts"), F.lit(1).cast("long").alias("_n"), F.when(~ok, 1).otherwise(0).cast("long").alias("_failed"))
    if slide and _seconds(length) % _seconds(slide) == 0:
        rows = rows.groupBy(F.window("_ts", slide)).agg(F.sum("_n").alias("_n"), F.sum("_failed").alias("_failed")).select(F.col("window.start").alias("_ts"), "_n", "_failed")
    w = F.window("_ts", length, slide) if slide else F.window("_ts", length)
    total = rows.groupBy(w.alias("w")).agg(F.sum("_n").alias("n"), F.sum("_failed").alias("failed"))
    return total.select(F.col("w.start").alias("start"), "n", "failed", (F.col("failed").cast("double") / F.col("n").cast("double")).alias("ratio"))


UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def _seconds(length: str) -> int:
    """Seconds of a length such as `10 minutes`."""
    n, unit = length.split()
    return int(n) * UNITS[unit.rstrip("s")]


def sketched(df: DataFrame, ts: str, keys: list[str], ok: Column, value: str, member: str, step: str = "1 hour", precision: int = 14, k: int = 200) -> DataFrame:
    """AGG-22 to AGG-24 kept by step: keys, start, n, failed, members (a HyperLogLog sketch), values (a KLL sketch).

    A step's row has a bounded size whatever its events, and rows merge (`rolled`), so a table of them is kept and added to as events come in.  Relative
    standard error of members about 1.04 / sqrt(2**precision), of a rank of values about 1.7 / k; nulls are in neither.
    """
    rows = df.select(F.col(ts).alias("_ts"), *keys, ok.alias("_ok"), F.col(value).cast("double").alias("_v"), F.col(member).cast("string").alias("_m"))
    out = rows.groupBy(F.window("_ts", step).alias("w"), *keys).agg(
        F.count("*").alias("n"), F.count_if(~F.col("_ok")).alias("failed"), F.hll_sketch_agg("_m", precision).alias("members"), F.kll_sketch_agg_double("_v", k).alias("values")
    )
    return out.select(*keys, F.col("w.start").alias("start"), "n", "failed", "members", "values")


def rolled(steps: DataFrame, keys: list[str], length: str, slide: str | None = None) -> DataFrame:
    """The rows of `sketched` merged to longer, or sliding, windows: the same columns."""
    w = F.window("start", length, slide) if slide else F.window("start", length)
    out = steps.groupBy(w.alias("w"), *keys).agg(F.sum("n").alias("n"), F.sum("failed").alias("failed"), F.hll_union_agg("members").alias("members"), F.kll_merge_agg_double("values").alias("values"))
    return out.select(*keys, F.col("w.start").alias("start"), "n", "failed", "members", "values")


def read_sketches(steps: DataFrame, keys: list[str], ranks: dict[str, float]) -> DataFrame:
    """keys, start, n, ratio, distinct, and a value for each named rank, from rows of `sketched` or `rolled`; values without one are null."""
    some = F.kll_sketch_get_n_double("values") > 0
    at = [F.when(some, F.kll_sketch_get_quantile_double("values", F.lit(q))).alias(name) for name, q in ranks.items()]
    return steps.select(*keys, "start", "n", (F.col("failed").cast("double") / F.col("n").cast("double")).alias("ratio"), F.hll_sketch_estimate("members").alias("distinct"), *at)


def health(df: DataFrame, key: str, ok: Column, degraded: float = 0.5, unhealthy: float = 0.8, least: int = 10) -> DataFrame:
    """STR-16: state of each key by its failure ratio, once it has `least` rows."""
    n, bad = F.count("*"), F.count_if(~ok)
    ratio = bad.cast("double") / n.cast("double")
    return df.groupBy(F.col(key).alias("probe")).agg(n.alias("n"), bad.alias("failed"), F.when(n < least, "unknown").when(ratio >= unhealthy, "unhealthy").when(ratio >= degraded, "degraded").otherwise("healthy").alias("status"))


def severity(status: Column) -> Column:
    out = F.lit(1)
    for name, rank in SEVERITY.items():
        out = F.when(status == name, rank).otherwise(out)
    return out


def overall(probes: DataFrame) -> DataFrame:
    """AGG-19: the worst state wins; one row with the number of probes in each state."""
    return probes.agg(F.max_by("status", severity(F.col("status"))).alias("status"), F.count("*").alias("probes"), *[F.count_if(F.col("status") == s).alias(s) for s in SEVERITY])


def changes(df: DataFrame, key: str, ts: str, tie: str, status: Column) -> DataFrame:
    """WIN-08: rows at which a key's state differs from the one before; the first is no change.  A key may hold most rows (a segmented scan)."""
    rows = beside(df.withColumn("status", status), [key], [ts, tie], "status", "previous")
    return rows.filter("previous IS NOT NULL AND previous <> status").select(key, ts, tie, "previous", "status")


def sessions(df: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """Session windows by key (an extension)."""
    return df.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def metric_name(*parts: str) -> Column:
    """OBS-02: parts that are not empty, joined by `_`, other characters as `_`."""
    return F.regexp_replace(F.array_join(F.filter(F.array(*[F.col(p) for p in parts]), lambda x: x != ""), "_"), "[^a-zA-Z0-9_:]", "_")


def valid_metric_name(name: Column) -> Column:
    return name.rlike("^[a-zA-Z_:][a-zA-Z0-9_:]*$")


def recent(df: DataFrame, ts: str, tie: str, k: int) -> DataFrame:
    """LIM-01, LIM-02: the last k rows; a top-k in each task, then of those."""
    return df.orderBy(F.desc(ts), F.desc(tie)).limit(k)


def ranges(df: DataFrame, name: str, value: str) -> DataFrame:
    """OBS-01: metric, n, low, high of the values of each name."""
    return df.groupBy(F.col(name).alias("metric")).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
