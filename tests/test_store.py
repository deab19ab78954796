from pyspark.sql import functions as F

from harrow.sources.store import BinaryStore


def entries(spark, rows):
    return spark.createDataFrame([(k, None if v is None else bytearray(v), t) for k, v, t in rows], "key string, value binary, ts double")


def held(df):
    return {r.key: (bytes(r.value), r.ts) for r in df.collect()}


def test_set_get_delete_expire_compact(spark, tmp_path):
    store = BinaryStore(spark, str(tmp_path / "store"), ttl=100.0, max_size=3)
    now = F.lit(150.0)
    assert held(store.get(now)) == {} and store.prune(now) is False
    store.compact(now)
    store.set(entries(spark, [("a", b"\x00\xff1", 60.0), ("b", b"", 49.0), ("c", b"3", 50.0), (None, b"x", 99.0), ("n", b"x", None)]))
    store.set(entries(spark, [("a", b"\x00\xff2", 70.0), ("d", b"4", 80.0)]))
    assert held(store.get(now)) == {"a": (b"\x00\xff2", 70.0), "c": (b"3", 50.0), "d": (b"4", 80.0)}
    assert held(store.get(now, spark.createDataFrame([("a",), ("a",), ("zz",)], "key string"))) == {"a": (b"\x00\xff2", 70.0)}
    store.delete(spark.createDataFrame([("d",)], "key string"), F.lit(90.0))
    assert set(held(store.get(now))) == {"a", "c"}
    store.set(entries(spark, [("e", b"5", 91.0), ("f", b"6", 92.0)]))
    before = store.log()
    assert store.prune(now) is True
    assert held(store.get(now)) == {"a": (b"\x00\xff2", 70.0), "e": (b"5", 91.0), "f": (b"6", 92.0)}  # the newest three
    assert store.log().count() == 3 and before.count() == 8  # readers of the generation before go on
    store.set(entries(spark, [("a", b"new", 95.0)]))
    store.compact(now)
    assert held(store.get(now))["a"] == (b"new", 95.0) and len(store.generations()) == 2


def test_unfinished_generation_does_not_count(spark, tmp_path):
    store = BinaryStore(spark, str(tmp_path / "s"))
    store.set(entries(spark, [("a", b"1", 1.0)]))
    (tmp_path / "s" / "generation=00000002").mkdir()
    assert held(store.get(F.lit(2.0))) == {"a": (b"1", 1.0)}
