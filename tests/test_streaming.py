from pyspark.sql import functions as F

from harrow.operators import pacing
from harrow.streaming import operators


def drain(frame, name, tmp_path, mode="append"):
    q = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return frame.sparkSession.table(name)


def test_first_seen_and_counts(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:05:00"), ("b", "2024-01-01 00:01:00")], "key string, t string").withColumn("ts", F.to_timestamp("t"))
    rows.select("key", "ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, ts timestamp").parquet(str(tmp_path / "in"))
    assert sorted(r.key for r in drain(operators.first_seen(stream, "key", "ts"), "seen", tmp_path).collect()) == ["a", "b"]
    got = drain(operators.counts(stream, "ts", "10 minutes", "key"), "counts", tmp_path, "complete").collect()
    assert {(r.key, r.n) for r in got} == {("a", 2), ("b", 1)}


def test_token_bucket_equals_the_batch_form(spark, tmp_path):
    rows = spark.range(40).select((F.col("id") % 3).cast("string").alias("key"), F.timestamp_millis(F.col("id") * 150).alias("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, ts timestamp").parquet(str(tmp_path / "in"))
    got = drain(operators.token_bucket(stream, "key", "ts", 1.0, 2.0), "bucket", tmp_path).collect()
    want = pacing.token_bucket(rows, "key", F.unix_micros("ts") / 1e6, 1.0, 2.0).collect()
    assert sorted((r.key, round(r.arrive, 3), r.wait) for r in got) == sorted((r.key, round(r.arrive, 3), r.wait) for r in want)


def test_cache_updates(spark, tmp_path):
    spark.createDataFrame([("a", "1", 1.0), ("a", "2", 2.0), ("b", "x", 1.0)], "key string, value string, ts double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, value string, ts double").parquet(str(tmp_path / "in"))
    assert {(r.key, r.value) for r in drain(operators.cache_updates(stream), "cached", tmp_path, "update").collect()} == {("a", "2"), ("b", "x")}
