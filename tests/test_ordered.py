import random

import pytest
from pyspark.sql import functions as F

from harrow.operators import ordered, pacing, ranking


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def log(spark, rnd, n=400):
    """One key holds most rows, one arrival is very common; null keys and null arrivals."""
    rows = [(rnd.choice(["hot", "hot", "hot", "b", None]), rnd.choice([7.0, round(rnd.uniform(0, 60), 1), round(rnd.uniform(0, 60), 1)])) for _ in range(n)]
    return [*rows, ("b", None), (None, None)], spark.createDataFrame([*rows, ("b", None), (None, None)], "key string, t double").repartition(3)


def interval(at, step):
    free, out = float("-inf"), []
    for n, t in enumerate(sorted(at)):
        free = max(t, free + step)
        out.append((n, t, round(free - t, 5)))
    return out


def bucket(at, rate, capacity):
    tokens, clock, free, out = capacity, None, float("-inf"), []
    for n, t in enumerate(sorted(at)):
        now = max(t, free)
        tokens = min(capacity, tokens + (0 if clock is None else now - clock) * rate)
        free = now if tokens >= 1 else now + (1 - tokens) / rate
        tokens = tokens - 1 if tokens >= 1 else 0.0
        clock = free
        out.append((n, t, round(free - t, 5)))
    return out


def waits(df, key=None):
    out = {}
    for r in df.collect():
        out.setdefault(r[key] if key else None, []).append((r.n, r.arrive, round(r.wait, 5)))
    return {k: sorted(v) for k, v in out.items()}


def close(got, want):
    assert got.keys() == want.keys()
    for k in want:
        assert [g[:2] for g in got[k]] == [w[:2] for w in want[k]]
        assert all(abs(g[2] - w[2]) < 2e-5 for g, w in zip(got[k], want[k]))


def test_intervals_of_keys_and_of_the_whole_log(spark, many_ranges):
    rows, df = log(spark, random.Random(1))
    at = {}
    for k, t in rows:
        if t is not None:
            at.setdefault(k, []).append(t)
    close(waits(pacing.min_interval(df, "key", F.col("t"), 4.0), "key"), {k: interval(v, 0.25) for k, v in at.items()})
    close(waits(pacing.min_interval(df, None, F.col("t"), 4.0)), {None: interval([t for v in at.values() for t in v], 0.25)})


@pytest.mark.parametrize("rate, capacity", [(4.0, 1.0), (3.0, 2.5), (8.0, 30.0), (2.0, 0.5)])
def test_buckets(spark, many_ranges, rate, capacity):
    rows, df = log(spark, random.Random(2), 250)
    at = {}
    for k, t in rows:
        if t is not None:
            at.setdefault(k, []).append(t)
    close(waits(pacing.token_bucket(df, "key", F.col("t"), rate, capacity), "key"), {k: bucket(v, rate, capacity) for k, v in at.items()})
    if capacity >= 1:
        close(waits(pacing.token_bucket(df, None, F.col("t"), rate, capacity)), {None: bucket([t for v in at.values() for t in v], rate, capacity)})


def test_running_count_of_a_whole_table(spark, many_ranges):
    rnd = random.Random(3)
    rows = [(i, rnd.randint(0, 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, w int").repartition(5)
    got = {r.id: (r.current, r.percent) for r in ranking.running_count(df, ["id"], 1000, step=F.col("w")).collect()}
    total, want = 0, {}
    for i, w in rows:
        total += w
        want[i] = (min(total, 1000), round(min(total, 1000) / 10, 6))
    assert got == want
    assert ranking.running_count(df.limit(0), ["id"], 10).collect() == []


def test_scans_have_no_partition_of_all_rows(spark, many_ranges):
    df = spark.range(2000).select((F.col("id") % 3).alias("k"), "id").repartition(4)
    dealt = ordered.ranges(df, "id")
    assert dealt.select(ordered.PART).distinct().count() > 1
    out = ordered.scan(dealt, None, ["id"], F.col("id"), "sum", "s")
    assert [r.s for r in out.orderBy("id").collect()] == [i * (i + 1) // 2 for i in range(2000)]
    parts = out.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert max(r["count"] for r in parts) < 1500
    top = ordered.scan(dealt, "k", ["id"], -F.col("id"), "max", "m")
    assert {(r.k, r.m) for r in top.select("k", "m").distinct().collect()} == {(0, 0), (1, -1), (2, -2)}


def test_copies(spark):
    df = spark.createDataFrame([("a", 3), ("b", 25_000)], "x string, n long")
    got = ordered.copies(df, "n", "k").groupBy("x").agg(F.count("*").alias("c"), F.countDistinct("k").alias("d"), F.max("k").alias("m")).collect()
    assert {tuple(r) for r in got} == {("a", 3, 3, 2), ("b", 25_000, 25_000, 24_999)}
