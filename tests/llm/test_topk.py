import math
import random

import numpy as np

from harrow.llm import topk


def brute(rows, k=20):
    good, queries = [], {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        f = [math.floor(64 * float(np.float32(x))) for x in v]
        good.append((i, f))
        if i % 20 == 0:
            queries[i] = min(queries.get(i, f), f)
    out = set()
    for q, a in queries.items():
        scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in good if i != q and len(a) == len(b))
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, score string")


def check(spark, rows, **options):
    got = topk.top_k(table(spark, rows), **options).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == brute(rows, options.get("k", 20))
    assert len(got) == len(brute(rows, options.get("k", 20)))


def test_against_brute_force_in_many_shards(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(8)]) for i in range(300)]
    rows += [(1000 + i, [0.5] * 8) for i in range(60)]  # ties
    check(spark, rows, shard_rows=50, query_rows=5, leaf=4)
    check(spark, rows, k=3)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (20, [1.0, 2.0]), (20, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0])]
    rows += [(None, [1.0, 1.0]), (5, [0.0, -1.0]), (40, [1.0]), (41, [2.0]), (60, []), (61, [])]
    check(spark, rows)


def test_repeated_ids_are_candidates_each(spark):
    rows = [(20, [1.0, 0.5]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (1, [0.5, 1.0]), (2, [0.75, 1.5]), (40, [1.0, 1.0]), (40, [0.0, 1.0])] + [(3, [0.25, 0.25])] * 30
    check(spark, rows)
    check(spark, rows, k=3, shard_rows=2, query_rows=1, leaf=1)


def test_empty_and_few(spark):
    assert topk.top_k(table(spark, [])).count() == 0
    assert topk.top_k(table(spark, [(0, [1.0])])).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(0)
    v = rng.integers(-64, 64, (500, 6)).astype(float)
    t = topk.Tree(np.arange(500), v, 8)
    q = rng.integers(-64, 64, 6).astype(float)
    for a, b, lo, hi in zip(t.start, t.end, t.low, t.high, strict=True):
        assert (t.vectors[a:b] @ q).max() <= np.maximum(q, 0) @ hi + np.minimum(q, 0) @ lo


def test_large_values_are_exact_or_refused(spark):
    check(spark, [(0, [2.0**24, 1.0]), (1, [2.0**24, 3.0]), (2, [-(2.0**24), 3.0])])
    try:
        topk.top_k(table(spark, [(0, [1e30]), (1, [1e30])])).collect()
    except Exception as e:  # noqa: BLE001
        assert "64-bit" in str(e) or "overflow" in str(e).lower()
    else:
        raise AssertionError("not refused")
