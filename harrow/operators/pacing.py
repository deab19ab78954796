"""Request pacing over ordered arrivals, and retry schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import copies, ranges, scan

LEAST_RATE = 0.01


def arrivals(rows: DataFrame, key: str | None, ts: Column, step: float) -> DataFrame:
    """Equal arrivals as one row: ``first``, the number of the first of them, and ``late``.

    ``late`` is the greatest arrive_j - j * step so far.  Both are prefix scans over ranges of time, so a key, or the
    whole log, is the work of many tasks.  Rows without an arrival have no place in the sequence and are left out.
    """
    own = rows.select(*([key] if key else []), ts.cast("double").alias("arrive")).where("arrive is not null")
    same = own.groupBy(*own.columns).agg(F.count("*").alias("harrow_n"))
    dealt = ranges(same, *own.columns)
    done = scan(dealt, key, ["arrive"], F.col("harrow_n"), "sum", "harrow_last")
    done = done.withColumn("first", F.col("harrow_last") - F.col("harrow_n"))
    return scan(done, key, ["arrive"], F.col("arrive") - F.col("first") * step, "max", "late").drop("harrow_tag")


def started(rows: DataFrame, key: str | None, ts: Column, step: float, ahead: float) -> DataFrame:
    """(key, n, arrive, start): start_i is the greatest of arrive_i and arrive_j + (i - j) * step - ahead, j before i."""
    each = copies(arrivals(rows, key, ts, step), "harrow_n", "harrow_k")
    n = F.col("first") + F.col("harrow_k")
    start = F.greatest(F.col("arrive"), F.round(n * step + F.col("late") - ahead, 9))
    return each.select(*([key] if key else []), n.cast("int").alias("n") if key else n.alias("n"), "arrive", start.alias("start"))


def min_interval(rows: DataFrame, key: str | None, ts: Column, rate: float = 1.0) -> DataFrame:
    """(key, n, arrive, start, wait): start_i = max(arrive_i, start_(i-1) + 1/rate); without a key one global sequence.

    That is i/rate plus the greatest arrive_j - j/rate so far.
    """
    done = started(rows, key, ts, 1.0 / max(rate, LEAST_RATE), 0.0)
    return done.withColumn("wait", F.round(F.col("start") - F.col("arrive"), 6))


def token_bucket(rows: DataFrame, key: str | None, ts: Column, rate: float, capacity: float, *, mode: str = "standard") -> DataFrame:
    """(key, n, arrive, wait): a request takes one token, or waits for the missing part of it.

    ``standard`` counts the wait as time already credited.  The bucket is full again at F, and a request starts at the
    greatest of its arrival, the start before it and F - (capacity - 1) / rate; it moves F on by 1 / rate, from the start
    if that is later.  Both are sums and maxima only, so they compose: a start is the arrival or the greatest
    arrive_j + (i - j - capacity + 1) / rate, j before i, a prefix scan like the least interval.

    ``reference`` leaves the clock at the arrival, so that the time slept is credited once more by the next request;
    that does not compose in few terms, nor do buckets of less than a token, so a key is a stream through one task there (bounded memory, not bounded time).
    Arrivals queue behind a waiting request; rows without an arrival are left out.
    """
    if rate <= 0:
        raise ValueError("rate must be positive")
    if mode == "standard" and capacity >= 1:
        done = started(rows, key, ts, 1.0 / rate, (capacity - 1) / rate)
        return done.select(*([key] if key else []), "n", "arrive", F.round(F.col("start") - F.col("arrive"), 6).alias("wait"))
    if key is None:
        raise ValueError("this mode needs a key")
    return sequential_bucket(rows, key, ts, rate, capacity, mode)


def sequential_bucket(rows: DataFrame, key: str, ts: Column, rate: float, capacity: float, mode: str) -> DataFrame:
    """The bucket request by request, each key in one task."""
    own = rows.select(key, ts.cast("double").alias("arrive"))
    kind = own.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        last_key, n, clock, tokens, free = object(), 0, 0.0, 0.0, 0.0  # all that a key needs to have remembered
        for batch in batches:
            numbers, waits = [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != last_key:
                    last_key, n, clock, tokens, free = k, 0, None, float(capacity), float("-inf")
                now = max(t, free)
                have = min(float(capacity), tokens + (now - (now if clock is None else clock)) * rate)
                wait = 0.0 if have >= 1 else (1 - have) / rate
                tokens = have - 1 if have >= 1 else 0.0
                free = now + wait
                clock = free if mode == "standard" else now
                numbers.append(n)
                waits.append(round(free - t, 6))
                n += 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(numbers, pa.int32()), batch.column(1), pa.array(waits, pa.float64())], names=[key, "n", "arrive", "wait"])

    dealt = own.where("arrive is not null").repartition(key).sortWithinPartitions(key, "arrive")
    return dealt.mapInArrow(run, f"`{key}` {kind}, n int, arrive double, wait double")


def backoff(attempts: Column, delay: float, factor: float = 2.0) -> Column:
    """array<double>: delay * factor^attempt for attempts 0 to n - 1."""
    return F.when(attempts > 0, F.transform(F.sequence(F.lit(0), attempts - 1), lambda i: F.lit(delay) * F.pow(F.lit(factor), i))).otherwise(F.array().cast("array<double>"))


def quota_backoff(attempts: Column) -> Column:
    """2, 4, 8, ...: doubled before each sleep."""
    return backoff(attempts, 2.0)
