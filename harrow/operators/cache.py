"""Time-limited key-value cache over a log of operations (key, value, ts in seconds)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TTL, MAX_SIZE, MAX_BINARY = 86400.0, 10_000, 1_000


def live(ts: Column, now: Column, ttl: float = TTL) -> Column:
    """Not expired; an entry exactly ``ttl`` old still counts."""
    return now - ts <= ttl


def latest(log: DataFrame) -> DataFrame:
    """Last set of each key; a NULL value is a deletion.  Equal times: the larger value, so that the result is fixed."""
    last = log.groupBy("key").agg(F.max(F.struct("ts", "value")).alias("x"))
    return last.select("key", "x.value", "x.ts").where("value is not null")


def get(log: DataFrame, now: Column, ttl: float = TTL) -> DataFrame:
    return latest(log).where(live(F.col("ts"), now, ttl))


def lookup(requests: DataFrame, log: DataFrame, ttl: float = TTL) -> DataFrame:
    """As-of lookup: for each request (key, at) the last value set at or before it and within ``ttl``, else NULL.

    Both are put in one sequence per key and the last set is carried forward, so there is no join on a range.
    """
    sets = log.select("key", F.col("ts").alias("t"), F.lit(0).alias("kind"), F.struct("ts", "value").alias("s"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in requests.schema.fields if f.name not in ("key",)])
    asks = requests.select("key", F.col("at").alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("struct<ts:double,value:string>").alias("s"), *[c for c in requests.columns if c != "key"])
    w = Window.partitionBy("key").orderBy("t", "kind", "s").rowsBetween(Window.unboundedPreceding, 0)
    both = sets.unionByName(asks).withColumn("last", F.last("s", ignorenulls=True).over(w)).where("kind = 1")
    return both.select(*requests.columns, F.when(live(F.col("last.ts"), F.col("at"), ttl), F.col("last.value")).alias("value"))


def prune(entries: DataFrame, now: Column, ttl: float = TTL, max_size: int = MAX_SIZE) -> DataFrame:
    """Live entries, the newest ``max_size`` of them.  A limit over a sort: each task keeps its own newest only."""
    return entries.where(live(F.col("ts"), now, ttl)).orderBy(F.desc("ts"), "key").limit(max_size)


def needs_pruning(entries: DataFrame, max_size: int = MAX_SIZE) -> bool:
    return entries.limit(max_size).count() >= max_size


def binary_name(key: Column) -> Column:
    """A name for a key's file that is the same in every process."""
    return F.concat(F.sha2(key, 256), F.lit(".bin"))


def size(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("n"))


def write(entries: DataFrame, path: str) -> None:
    """JSON lines or Parquet, by the ending of the path."""
    out = entries.write.mode("overwrite")
    out.json(path) if path.endswith((".json", ".jsonl")) else out.parquet(path)
