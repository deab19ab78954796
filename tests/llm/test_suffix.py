import hashlib
import random

import numpy as np
import pytest

from harrow.llm import suffix
from harrow.llm.induced import LaneQueue, range_minima, repeated_windows


def brute(texts, window):
    seen = {}
    raws = [(t or "").encode() for t in texts]
    for i, raw in enumerate(raws):
        for at in range(len(raw) - window + 1):
            seen.setdefault(raw[at : at + window], []).append((i, at))
    cover = [np.zeros(len(r), bool) for r in raws]
    for places in seen.values():
        if len(places) > 1:
            for i, at in places:
                cover[i][at : at + window] = True
    out = []
    for raw, c in zip(raws, cover, strict=True):
        kept = np.frombuffer(raw, np.uint8)[~c].tobytes()
        out.append((len(raw), int(c.sum()), int((np.diff(np.r_[0, c.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("block", [1 << 18, 5])
def test_induced_sorting_finds_all_repeated_windows(block):
    rnd = random.Random(block)
    for _ in range(60):
        width, n = rnd.randint(8, 40), rnd.randint(0, 40)
        window = rnd.randint(3, width)
        alphabet = bytes(rnd.sample(range(256), rnd.choice([1, 2, 3])))
        base, rows = bytes(rnd.choice(alphabet) for _ in range(width)), []
        for _ in range(n):
            s = bytearray(base)
            for _ in range(rnd.randint(0, 3)):
                s[rnd.randrange(width)] = rnd.choice(alphabet)
            lo = rnd.choice([0, rnd.randint(0, width - window)])
            rows.append((lo, bytes(s[lo : rnd.choice([width, rnd.randint(lo + 1, width)])])))
        want = set()
        for x in range(width - window + 1):
            same = {}
            for i, (at, s) in enumerate(rows):
                if at <= x and x + window <= at + len(s):
                    same.setdefault(s[x - at : x - at + window], []).append((i, x))
            want |= {p for v in same.values() if len(v) > 1 for p in v}
        ids, first, last = repeated_windows(width, window, width - window, rows, block)
        assert {(i, x) for i, a, b in zip(ids, first, last, strict=True) for x in range(a, b + 1)} == want


def test_queue_keeps_order_and_values_on_disk():
    rnd = np.random.default_rng(1)
    chars, lcp = rnd.integers(97, 100, 50).astype(np.uint8), rnd.integers(0, 9, 50).astype(np.int32)
    lcp[0] = 0
    got = []
    for block in (1000, 7):
        q = LaneQueue(block)
        for a in range(0, 50, 10):
            q.push(chars[a : a + 10], np.arange(a, a + 10), lcp[a : a + 10])
        parts = list(q.pop())
        q.close()
        got.append([np.concatenate([p[i] for p in parts]).tolist() for i in (0, 1)])
    assert got[0] == got[1]
    assert got[0][0] == np.argsort(chars, kind="stable").tolist()
    assert range_minima(lcp, np.array([3, 4]), np.array([9, 4])).tolist() == [lcp[3:10].min(), lcp[4]]


@pytest.mark.parametrize(("window", "gram", "hot"), [(400, 32, 1 << 16), (40, 8, 1 << 16), (400, 32, 1), (40, 8, 1)])
def test_documents_against_brute_force(odd_docs, window, gram, hot):
    rows = odd_docs.collect()
    want = sorted(brute([r.text for r in rows], window), key=str)
    got = suffix.deduplicate(odd_docs, window=window, gram=gram, shard_strings=16, hot_forms=hot)
    assert sorted(((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()), key=str) == want
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def test_real_rows_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.collect()
    want = dict(zip([r.doc_id for r in rows], brute([r.text for r in rows], 400), strict=True))
    for hot in (1 << 16, 1):
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.deduplicate(docs, hot_forms=hot).collect()} == want


def test_empty_table_and_stage(no_docs, odd_docs):
    assert suffix.deduplicate(no_docs).count() == 0
    kept = suffix.strip_documents(odd_docs)
    assert kept.columns == odd_docs.columns
    for r in kept.collect():
        assert r.text is None or r.harrow_x is not None
        assert r.n_chars == len(r.text or "")


def test_runs_are_real_output(odd_docs):
    for r in suffix.deduplicate(odd_docs, with_runs=True).collect():
        assert sum(b - a for a, b in r.runs) == r.n_removed and len(r.runs) == r.n_spans
