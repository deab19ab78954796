import gzip
import random
import time

import pytest
from pyspark.sql import functions as F

from harrow.operators import seen, sitemaps
from harrow.runtime import cut


def sitemap(kind, locs):
    inner = "".join(f"<{'sitemap' if kind == 'sitemapindex' else 'url'}><loc>{u}</loc></{'sitemap' if kind == 'sitemapindex' else 'url'}>" for u in locs)
    return f"<?xml version='1.0'?><{kind}>{inner}</{kind}>".encode()


def bodies(spark, files):
    return spark.createDataFrame([(u, bytearray(gzip.compress(b) if i % 2 else b)) for i, (u, b) in enumerate(files.items())], "url string, body binary")


def walk(files, start, index_locs=False):
    """Pages by recursion with a set of what was seen."""
    out, done = [], set()

    def visit(url):
        if url in done or url not in files:
            return
        done.add(url)
        kind, locs = files[url]
        if kind == "urlset" or index_locs:
            out.extend((url, i, u) for i, u in enumerate(locs))
        if kind == "sitemapindex":
            for u in locs:
                visit(u)

    visit(start)
    return sorted(out)


@pytest.mark.parametrize("index_locs", [False, True])
def test_chain_circle_and_diamond(spark, index_locs):
    s = lambda i: f"https://a.de/s{i}.xml"
    files = {s(i): ("sitemapindex", [s(i + 1), s(i + 1)]) for i in range(12)}  # a chain of twelve indexes
    files[s(11)] = ("sitemapindex", [s(12), s(3), s(11), s(20)])  # back into the chain, to itself, to nothing
    files[s(12)] = ("urlset", ["https://a.de/p1", "https://a.de/p2", "https://a.de/p1"])
    files[s(5)] = ("sitemapindex", [s(6), s(12), s(13)])
    files[s(13)] = ("urlset", ["https://a.de/p3"])
    raw = {u: sitemap(*x) for u, x in files.items()}
    found = spark.createDataFrame([("a.de", s(0)), ("b.de", s(4)), ("c.de", "https://none.de/x.xml")], "domain string, url string")
    got = sitemaps.pages_of(found, bodies(spark, raw), index_locs=index_locs)
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted([("a.de", *t) for t in walk(files, s(0), index_locs)] + [("b.de", *t) for t in walk(files, s(4), index_locs)])


def test_bounds(spark):
    files = {f"https://a.de/{i}": sitemap("sitemapindex", [f"https://a.de/{i + 1}"]) for i in range(6)}
    files["https://a.de/6"] = sitemap("urlset", [f"https://a.de/p{i}" for i in range(9)])
    found = spark.createDataFrame([("a.de", "https://a.de/0")], "domain string, url string")
    with pytest.raises(RuntimeError):
        sitemaps.pages_of(found, bodies(spark, files), most_levels=4)
    assert sitemaps.pages_of(found, bodies(spark, files), most=4).count() == 4
    assert sitemaps.pages_of(found, bodies(spark, files), most=None).count() == 9
    assert sitemaps.pages_of(found.limit(0), bodies(spark, files)).collect() == []


def test_seen_set_with_filter_and_merged_parts(spark, monkeypatch):
    monkeypatch.setattr(seen, "SMALL", 0)
    monkeypatch.setattr(seen, "FANOUT", 3)
    monkeypatch.setattr(seen, "FILTER_BITS", 1 << 16)
    rnd, mine, s = random.Random(4), set(), seen.SeenSet("k", "v")
    for _ in range(8):
        rows = [(rnd.choice(["a", "b", None]), rnd.choice([None, *range(60)])) for _ in range(40)]
        df = spark.createDataFrame(rows, "k string, v int").distinct().withColumn("extra", F.lit(1))
        new = cut(s.unseen(df))
        assert {tuple(r)[:2] for r in new.collect()} == set(rows) - mine
        s.add(new, new.count())
        mine |= set(rows)
    assert s.size == len(mine) and len(s.parts) < 6
    assert sum(p.count() for _, p, _ in s.parts) == len(mine)


def test_filter_keeps_little_else(spark):
    known = spark.range(100_000).withColumnRenamed("id", "k")
    rows = spark.range(99_900, 100_100).withColumnRenamed("id", "k")
    left = {r.k for r in seen.maybe(known, rows, ["k"]).collect()}
    assert left >= set(range(99_900, 100_000)) and len(left) < 110


def test_long_circles_and_blocks_of_one_host(spark, monkeypatch):
    """Circles of hundreds of indexes, within one block and over many."""
    rnd, n, began = random.Random(8), 300, time.perf_counter()
    at = lambda h, i: f"https://{h}.de/i{i}.xml"
    files = {at(h, i): ("sitemapindex", [at(h, (i + 1) % n), f"https://{h}.de/u{i}.xml"]) for h in "ab" for i in range(n)}
    files |= {f"https://{h}.de/u{i}.xml": ("urlset", [f"https://{h}.de/p{i}"]) for h in "ab" for i in range(n)}
    files[at("a", 200)] = ("sitemapindex", [at("a", 201), at("b", 7), "https://none.de/x.xml"])  # into the other host
    raw = bodies(spark, {u: sitemap(*x) for u, x in files.items()})
    starts = [("a.de", at("a", 5)), ("a.de", at("a", 9)), ("b.de", at("b", 0)), ("c.de", "https://b.de/u3.xml")]
    found = spark.createDataFrame(starts, "domain string, url string")
    got = sorted(map(tuple, sitemaps.pages_of(found, raw).collect()))
    assert time.perf_counter() - began < 60
    want = [(d, f"https://{h}.de/u{i}.xml", 0, f"https://{h}.de/p{i}") for d, hs in (("a.de", "ab"), ("b.de", "b")) for h in hs for i in range(n) if (h, i) != ("a", 200)]
    assert got == sorted([*want, ("c.de", "https://b.de/u3.xml", 0, "https://b.de/p3")])
    monkeypatch.setattr(sitemaps, "MOST_STEPS", 10)
    monkeypatch.setattr(sitemaps, "MOST_STARTS", 1)
    small = {f"https://a.de/i{i}.xml": [f"https://a.de/i{j}.xml" for j in {(i + 1) % 40, rnd.randrange(60)}] for i in range(40)}
    indexes = spark.createDataFrame(list(small.items()), "url string, locs array<string>")
    found = spark.createDataFrame([(d, f"https://a.de/i{i}.xml") for d, i in (("a", 3), ("b", 17), ("b", 50))], "domain string, url string")
    one = sorted(map(tuple, sitemaps.reached(found, indexes).collect()))
    assert one == sorted(map(tuple, sitemaps.reached(found, indexes, 1000).collect())) and len(one) == len(set(one))
