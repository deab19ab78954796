"""A cache of binary values in a folder: sets are appended, the newest of a key counts, compaction keeps what is alive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cache
from . import schemas

NEW, FIRST = "generation=", 1


class BinaryStore:
    """Entries (key, value BINARY, ts in seconds) under ``path``, any file system Spark knows.

    ``set`` appends files to the present generation.  ``compact`` writes the newest entry of each key, of those that are
    alive the newest ``max_size``, as the next generation, which counts once it is complete; the one before stays for those
    who read it, and goes at the compaction after.  Files of a compacted generation hold ranges of keys in order, so that a
    lookup of few keys skips most row groups.  One writer at a time; any number of readers.
    """

    def __init__(self, spark: SparkSession, path: str, *, ttl: float = cache.TTL, max_size: int = cache.MAX_BINARY):
        self.spark, self.path, self.ttl, self.max_size = spark, path.rstrip("/"), ttl, max_size

    def generations(self) -> list[int]:
        """Numbers of the complete generations."""
        fs, root = self.files(self.path)
        if not fs.exists(root):
            return []
        names = [(s.getPath().getName(), s.getPath()) for s in fs.listStatus(root)]
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(n.removeprefix(NEW)) for n, p in names if n.startswith(NEW) and fs.exists(jvm_path(p, "_SUCCESS")))

    def files(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def folder(self, n: int) -> str:
        return f"{self.path}/{NEW}{n:08d}"

    def log(self) -> DataFrame:
        """All entries of the present generation, deletions (null values) among them."""
        own = self.generations()
        if not own:
            return self.spark.createDataFrame([], schemas.CACHE_BINARY)
        return self.spark.read.schema(schemas.CACHE_BINARY).parquet(self.folder(own[-1]))

    def set(self, entries: DataFrame) -> None:
        """Append (key, value, ts); a null value deletes the key.  Rows without a key or a time are left out."""
        rows = entries.select("key", F.col("value").cast("binary").alias("value"), F.col("ts").cast("double").alias("ts"))
        own = self.generations()
        rows.where("key is not null and ts is not null").write.mode("append").parquet(self.folder(own[-1] if own else FIRST))

    def delete(self, keys: DataFrame, ts: Column) -> None:
        self.set(keys.select("key", F.lit(None).cast("binary").alias("value"), ts.alias("ts")))

    def get(self, now: Column, keys: DataFrame | None = None) -> DataFrame:
        """(key, value, ts) of the live entries, of all keys or of those asked for."""
        rows = self.log()
        rows = rows if keys is None else rows.join(keys.select("key").distinct(), "key", "left_semi")
        return cache.get(rows, now, self.ttl)

    def compact(self, now: Column) -> None:
        own = self.generations()
        if not own:
            return
        kept = cache.prune(cache.latest(self.log()), now, self.ttl, self.max_size)
        kept.repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").parquet(self.folder(own[-1] + 1))
        for n in own[:-1]:
            fs, p = self.files(self.folder(n))
            fs.delete(p, True)

    def prune(self, now: Column) -> bool:
        """Compact if the store is full; whether it was."""
        full = cache.needs_pruning(cache.latest(self.log()), self.max_size)
        if full:
            self.compact(now)
        return full
