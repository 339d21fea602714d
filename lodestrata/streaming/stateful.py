"""Streams with state of their own: rate limits, and commits applied as they come."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestrata.operators.timetravel import as_of
from lodestrata.streaming.run import run_available


def token_bucket(seconds: np.ndarray, rate: float, burst: float, tokens: float, last: float) -> tuple[np.ndarray, float, float]:
    """Which requests, in order of time, a bucket lets pass, and its tokens and time afterwards."""
    allowed = np.zeros(len(seconds), bool)
    for i, t in enumerate(seconds):
        tokens = min(burst, tokens + max(0.0, t - last) * rate)
        last = max(last, t)
        if tokens >= 1:
            tokens -= 1
            allowed[i] = True
    return allowed, tokens, last


def rate_limited(requests: DataFrame, key: str, rate: float, burst: float | None = None) -> DataFrame:
    """``key, event_id, allowed`` of a stream of ``key, event_id, ts``: a token bucket per key, of ``burst`` (twice the rate) tokens.

    A key's requests of a batch are taken in order of time and id; the state is two numbers per key, dropped once the watermark (of
    10 minutes) has passed the key's last request by the time that an empty bucket needs to fill: a full bucket is the same as none.
    """
    most = 2 * rate if burst is None else burst
    full_ms = math.ceil(most / rate * 1000) + 1 if rate > 0 else None  # one without a rate never fills
    kind = requests.schema[key].dataType.simpleString()

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values(["sec", "event_id"])
        tokens, last = state.get if state.exists else (most, float(rows["sec"].iloc[0]))
        allowed, tokens, last = token_bucket(rows["sec"].to_numpy(), rate, most, tokens, last)
        state.update((tokens, last))
        if full_ms is not None:
            state.setTimeoutTimestamp(max(int(last * 1000), state.getCurrentWatermarkMs()) + full_ms)
        yield pd.DataFrame({"key": [k[0]] * len(rows), "event_id": rows["event_id"].to_numpy(), "allowed": allowed})

    timed = requests.withWatermark("ts", "10 minutes").select("ts", F.col(key).alias("key"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("sec"))
    return timed.groupBy("key").applyInPandasWithState(step, f"key {kind}, event_id long, allowed boolean", "tokens double, last double", "append", GroupStateTimeout.EventTimeTimeout)


def apply_commits(stream: DataFrame, path: str) -> DataFrame:
    """Append a stream of commits to the log at ``path``, batch by batch, and return the state after it.

    A batch is written under its number, so that one that is repeated after a failure replaces itself.
    """
    run_available(stream, lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}"))
    return as_of(stream.sparkSession.read.schema(stream.schema).option("basePath", path).parquet(path))
