"""Per-domain rate limiter (STR-05 to STR-07): token bucket, multiplicative rate, circuit breaker.

The same transition serves batches (one sorted pass over each domain) and streams (a state of a few numbers for each domain, dropped when idle).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Fixed values of the limiter
START = (1.0, 1.0, None, "closed", 0, 0, 0.0)  # rate, tokens, last refill, breaker, failures, successes, next attempt
CAP, FLOOR, CEILING, SLOWER, FASTER = 10.0, 0.1, 5.0, 0.8, 1.05
OPEN_AFTER, CLOSE_AFTER, OPEN_FOR, REOPEN_FOR = 5, 3, 5.0, 1.0
STATE = "rate double, tokens double, refilled double, breaker string, failures int, successes int, next_attempt double"
OUTPUT = "domain string, ts timestamp, event_id long, kind string, decision string, wait double, rate double, tokens double, breaker string"


def step(state: tuple, kind: str, now: float, failed: bool) -> tuple[tuple, str, float]:
    """(next state, decision, wait in seconds) for one `acquire` or `feedback` at a time in seconds."""
    rate, tokens, refilled, breaker, failures, successes, attempt = state
    if kind == "acquire":
        if breaker == "open":
            if now <= attempt:
                return state, "rejected", 0.0
            breaker = "half_open"
        if refilled is None:
            refilled = now
        if now > refilled:
            tokens, refilled = min(CAP, tokens + (now - refilled) * rate), now
        if tokens >= 1:
            return (rate, tokens - 1, refilled, breaker, failures, successes, attempt), "granted", 0.0
        return (rate, tokens, refilled, breaker, failures, successes, attempt), "wait", (1 - tokens) / max(rate, FLOOR)
    if failed:
        rate, failures = max(FLOOR, rate * SLOWER), failures + 1
    else:
        rate = min(CEILING, rate * FASTER)
        successes += breaker == "half_open"
    if breaker == "half_open":
        if successes >= CLOSE_AFTER:
            breaker, failures, successes, attempt = "closed", 0, 0, 0.0
        if failures > 0:
            breaker, failures, successes, attempt = "open", 0, 0, now + REOPEN_FOR
    elif breaker == "closed" and failures >= OPEN_AFTER:
        breaker, failures, successes, attempt = "open", 0, 0, now + OPEN_FOR
    return (rate, tokens, refilled, breaker, failures, successes, attempt), "recorded", 0.0


def _apply(domain: str, rows: pd.DataFrame, state: tuple) -> tuple[pd.DataFrame, tuple]:
    out = []
    for ts, i, kind, failed in rows.sort_values(["ts", "event_id"])[["ts", "event_id", "kind", "failed"]].itertuples(index=False):
        state, decision, wait = step(state, kind, ts.timestamp(), bool(failed))
        out.append((domain, ts, i, kind, decision, wait, state[0], state[1], state[3]))
    return pd.DataFrame(out, columns=[f.split()[0] for f in OUTPUT.split(", ")]), state


def trace(events: DataFrame) -> DataFrame:
    """OUTPUT for a batch of domain, ts, event_id, kind (acquire, feedback), failed.  A domain is sequential by nature, so its rows are one task's."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        return _apply(key[0], rows, START)[0]

    return events.select("domain", "ts", "event_id", "kind", "failed").groupBy("domain").applyInPandas(run, OUTPUT)


def stream(events: DataFrame, idle_ms: int = 120_000) -> DataFrame:
    """As trace for a stream; the state of a domain goes after idle_ms without events (STR-07)."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = tuple(state.get) if state.exists else START
        now = tuple(None if isinstance(x, float) and pd.isna(x) else x for x in now)
        rows = pd.concat(list(batches))
        out, now = _apply(key[0], rows, now)
        state.update(now)
        state.setTimeoutDuration(idle_ms)
        yield out

    rows = events.select("domain", "ts", "event_id", "kind", "failed")
    return rows.groupBy("domain").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def snapshot(states: DataFrame) -> DataFrame:
    """AGG-18: domains and breakers by state from the last row of each domain in a trace."""
    last = states.groupBy("domain").agg(F.max_by("breaker", F.struct("ts", "event_id")).alias("breaker"))
    return last.agg(F.count("*").alias("domains"), F.count_if(F.col("breaker") == "open").alias("open"), F.count_if(F.col("breaker") == "half_open").alias("half_open"))
