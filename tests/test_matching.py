import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from harrow.functions import alike, scoring
from harrow.operators import similarity, suffixes
from harrow.sources import readers


def word(rnd, n, letters):
    return "".join(rnd.choice(letters) for _ in range(n))


def test_native_similarity_equals_the_loop(spark):
    rnd, rows = random.Random(1), [(None, "a"), ("a", None), ("", "a"), ("abc", "abc")]
    for _ in range(250):
        letters = rnd.choice(["ab", "abcde", "abcdefghijk-.é😀"])
        rows.append((word(rnd, rnd.choice([0, 1, 2, 5, 12, 13, 30]), letters), word(rnd, rnd.choice([0, 1, 2, 5, 12, 13, 30]), letters)))
    for m, n in [(61, 61), (62, 62), (62, 63), (63, 62), (63, 63), (64, 64), (64, 90), (125, 124), (130, 140)]:
        rows.append((word(rnd, m, "abcd"), word(rnd, n, "abcd")))
    for r in spark.createDataFrame(rows, "a string, b string").select("a", "b", scoring.similarity(F.col("a"), F.col("b")).alias("s")).collect():
        assert r.s == scoring.partial_similarity(r.a or "", r.b or ""), r


@pytest.mark.parametrize("threshold", [35, 60, 72.5, 80, 90, 100])
def test_similar_pairs_lose_none(spark, threshold):
    rnd = random.Random(int(threshold))
    left = [word(rnd, rnd.choice([1, 2, 3, 4, 8, 12, 15]), "abcdefgh") for _ in range(45)] + ["", "aaaa", "aaaaaaa"]
    right = [word(rnd, rnd.choice([1, 3, 5, 9, 14, 30]), "abcdefgh") for _ in range(25)] + ["", "aaaaa", "a"]
    for x in left[:20]:
        i = rnd.randrange(len(x))
        right += [x, "zz" + x[:i] + x[i + 1 :], x[:i] + "q" + x[i:] + "yy", x[len(x) // 3 :] + "xx"]
    a, b = spark.createDataFrame([(x,) for x in [*left, None, left[0]]], "a string"), spark.createDataFrame([(x,) for x in [*right, None]], "b string")
    got = {(r.a, r.b): r.similarity for r in similarity.similar_pairs(a, b, threshold).collect()}
    every = {(x, y): scoring.partial_similarity(x, y) for x in left if x for y in right if y}
    assert got == {k: v for k, v in every.items() if v >= threshold}


def test_scored_pairs_equal_all_scores(spark):
    names = ["Shop Ltd", "Blue Bolt GmbH", "bluebolt", "Q!", None, "LinkedIn Inc"]
    hosts = ["www.blue-bolt.com", "bluebolt.linkedin.com", "shop.bolt.co.uk", "shopping.de", "localhost", "linkedin.com"]
    companies, sites = spark.createDataFrame([(n,) for n in names], "company string"), spark.createDataFrame([(h,) for h in hosts], "host string")
    got = {(r.company, r.host): r.score for r in similarity.scored_pairs(companies, sites, 60).collect()}
    pairs = spark.createDataFrame([(n, h) for n in names for h in hosts], "company string, host string")
    every = pairs.select("company", F.regexp_replace("host", "^www[.]", "").alias("host"), scoring.score_domain(F.col("company"), F.concat(F.lit("https://"), "host")).alias("s")).collect()
    assert got == {(r.company, r.host): r.s for r in every if r.company and r.company != "Q!" and r.s >= 60}


def split(host, rules):
    """The registry's algorithm: exceptions, else the longest rule that fits from the right."""
    labels = host.lower().split(".")
    best, but = None, None
    for rule in rules:
        parts = rule.lstrip("!").split(".")
        if len(parts) <= len(labels) and all(p in ("*", x) for p, x in zip(parts[::-1], labels[::-1])):
            if rule[0] == "!":
                but = len(parts) - 1
            else:
                best = max(best or 0, len(parts))
    k = but if but is not None else best if best is not None else 1 if len(labels) > 1 else 0
    at = len(labels) - k
    return ".".join(labels[: max(0, at - 1)]), labels[at - 1] if at > 0 else "", ".".join(labels[at:])


def test_suffixes_of_a_registry(spark):
    rules = readers.suffix_rules(spark)
    own = [r.rule for r in rules.collect()]
    assert len(own) > 5000 and {"co.uk", "*.ck", "!www.ck", "github.io", "k12.ca.us"} <= set(own)
    rnd = random.Random(7)
    picked = [*rnd.sample(own, 150), *[r for r in own if r[0] in "*!"], "k12.ca.us", "github.io", "co.uk", "unlisted", "de"]
    hosts = ["localhost", "com"]
    for rule in picked:
        base = rule.replace("*", "any").lstrip("!")
        hosts += [base, f"a.{base}", f"x.y.{base.upper()}"]
    index = {}
    for rule in own:
        index.setdefault(rule.split(".")[-1], []).append(rule)
    got = {r.host: (r.subdomain, r.domain, r.suffix) for r in suffixes.split_hosts(spark.createDataFrame([(h, 1) for h in hosts], "host string, name int"), "host", rules).collect()}
    assert got == {h: split(h, index.get(h.lower().split(".")[-1], [])) for h in hosts}


def test_suffix_edges(spark):
    rules = spark.createDataFrame([("com // a remark", False), ("// none", False), ("  ", False), ("github.io", True), ("io", None), (None, False)], "rule string, private boolean")
    hosts = spark.createDataFrame([(h, i) for i, h in enumerate(["me.github.io", "1.2.3.4", "u@A.com:80", "b.com.", "x.zz", None, "", "me.github.io"])], "host string, kind int")
    got = [tuple(r)[2:] for r in suffixes.split_hosts(hosts, "host", rules, private=False, unlisted=0).orderBy("kind").collect()]
    assert got == [("me", "github", "io"), ("", "1.2.3.4", ""), ("", "a", "com"), ("", "b", "com"), ("x", "zz", ""), (None, None, None), ("", "", ""), ("me", "github", "io")]
    assert suffixes.split_hosts(hosts, "host", rules).where("kind = 0").head()[2:] == ("", "me", "github.io")
    assert suffixes.split_hosts(hosts.limit(0), "host", rules).collect() == []


def test_suffix_file(spark, tmp_path):
    (tmp_path / "list.dat").write_text("// ===BEGIN ICANN DOMAINS===\nuk\nco.uk  // x\n\n// ===BEGIN PRIVATE DOMAINS===\ngithub.io\n")
    assert sorted(map(tuple, readers.suffix_rules(spark, str(tmp_path / "list.dat")).collect())) == [("co.uk", False), ("github.io", True), ("uk", False)]


@pytest.mark.parametrize("threshold", [40, 70, 90])
@pytest.mark.parametrize("held", [1 << 22, 2000])
def test_index_of_subsequences_loses_none(monkeypatch, threshold, held):
    """A cell by the index alone, whole or in halves: each pair once, deductions and hosts of two parts included."""
    monkeypatch.setattr(alike, "PAIR_COST", 10**12)
    monkeypatch.setattr(alike, "HELD", held)
    rnd = random.Random(threshold)
    names = sorted({word(rnd, rnd.choice([2, 3, 5, 9, 11]), "abcdef") for _ in range(60)} | {"a" * 70})
    hosts = [(x[:2] + x[3:], rnd.choice(["", x, x[:5], x[::-1]]), rnd.choice([0.0, 0.0, 25.0])) for x in names]
    hosts += [(word(rnd, rnd.choice([1, 4, 9, 12]), "abcdefg"), word(rnd, 5, "abc"), 0.0) for _ in range(40)] + [("a" * 80, "", 0.0), ("abc", "abc", 0.0)]
    rows = [(0, 0, x, x, None, 0.0) for x in names] + [(0, 1, str(k), p, q, less) for k, (p, q, less) in enumerate(hosts)]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.float64()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["cell", "side", "name", "p", "q", "less"])
    got = [tuple(r.values()) for b in similarity.compare(threshold)(iter([batch])) for r in b.to_pylist()]
    every = {(x, str(k)): max(0.0, max(scoring.partial_similarity(x, p), scoring.partial_similarity(x, q)) - less) for x in names for k, (p, q, less) in enumerate(hosts)}
    assert sorted(got) == sorted((x, k, v) for (x, k), v in every.items() if v >= threshold)


def test_index_costs_less_than_pairs():
    """At many hosts the expected cost of a pair falls; all pairs cost the same each."""
    cost = [alike.cost_of_cell({14: n}, {13: n, 14: n, 18: n}, 70) / n**2 for n in (4096, 65536)]
    assert cost[1] < cost[0] / 5
