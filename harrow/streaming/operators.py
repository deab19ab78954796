"""Structured Streaming forms of the stateful operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def first_seen(rows: DataFrame, key: str, event_time: str, keep: str = "1 day") -> DataFrame:
    """Each key once within the watermark: seen pages, deduplicated results, cache entries."""
    return rows.withWatermark(event_time, keep).dropDuplicatesWithinWatermark([key])


def counts(rows: DataFrame, event_time: str, window: str, key: str, late: str = "10 minutes") -> DataFrame:
    """Rows by window and key, late ones dropped by the watermark."""
    return rows.withWatermark(event_time, late).groupBy(F.window(event_time, window), key).agg(F.count("*").alias("n"))


def token_bucket(rows: DataFrame, key: str, ts: str, rate: float, capacity: float, *, mode: str = "standard") -> DataFrame:
    """(key, arrive, wait), one state of three numbers a key; rows of a batch are taken in order of time.

    State of keys idle for an hour is dropped: a bucket is full again long before that.
    """
    if rate <= 0:
        raise ValueError("rate must be positive")

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, tokens, free = state.get if state.exists else (None, capacity, float("-inf"))
        arrive = sorted(t for f in frames for t in f["arrive"])
        waits = []
        for t in arrive:
            now = max(t, free)
            have = min(capacity, tokens + (0.0 if last is None else (now - last) * rate))
            wait = 0.0 if have >= 1 else (1 - have) / rate
            tokens, free = (have - 1 if have >= 1 else 0.0), now + wait
            last = free if mode == "standard" else now
            waits.append(round(now + wait - t, 6))
        state.update((last, tokens, free))
        state.setTimeoutDuration(3_600_000)
        yield pd.DataFrame({"key": [k[0]] * len(arrive), "arrive": arrive, "wait": waits})

    seconds = rows.select(F.col(key).cast("string").alias("key"), (F.unix_micros(ts) / 1e6).alias("arrive"))
    return seconds.groupBy("key").applyInPandasWithState(
        run, "key string, arrive double, wait double", "last double, tokens double, free double", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def cache_updates(rows: DataFrame, ttl: float = 86400.0) -> DataFrame:
    """(key, value, ts) after each batch for the keys it changed; a key's state expires ``ttl`` seconds after its last set.

    ``rows``: (key, value, ts in seconds); a NULL value deletes.
    """

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.get if state.exists else (None, float("-inf"))
        for f in frames:
            for t, v in sorted(zip(f["ts"], f["value"].where(f["value"].notna(), None), strict=True), key=lambda x: (x[0], x[1] or "")):
                if t >= now[1]:
                    now = (v, t)
        state.update(now)
        state.setTimeoutDuration(max(1, int(ttl * 1000)))
        yield pd.DataFrame({"key": [k[0]], "value": [now[0]], "ts": [now[1]]})

    return rows.groupBy("key").applyInPandasWithState(
        run, "key string, value string, ts double", "value string, ts double", "update", GroupStateTimeout.ProcessingTimeTimeout
    )


def each_batch(rows: DataFrame, process, checkpoint: str, size: str = "1 minute"):
    """Run ``process(frame, batch number)`` on each micro-batch: the batch processor with its progress callback."""
    return rows.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(processingTime=size).start()
