import random

import numpy as np
import pytest
import xxhash

from harrow.llm import simhash


def brute_fp(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lower) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, radius):
    label = {f: f for f in fps}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    known = sorted(set(fps))
    for i, a in enumerate(known):
        for b in known[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                label[find(a)] = find(b)
    low = {}
    for i, f in zip(ids, fps, strict=True):
        if i is not None:
            low[find(f)] = min(low.get(find(f), i), i)
    return [low.get(find(f)) for f in fps]


def test_documents_against_brute_force(odd_docs, no_docs):
    rows = odd_docs.collect()
    fps = [brute_fp(r.text) for r in rows]
    want = sorted(zip((r.doc_id for r in rows), (f"{f:016x}" for f in fps), brute_components([r.doc_id for r in rows], fps, 3), strict=True), key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(odd_docs).collect()), key=str) == want
    assert simhash.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("block", [512, 8])
def test_links_join_all_that_are_near(spark, block):
    rnd = random.Random(block)
    fps = set()
    for _ in range(12):
        base = rnd.getrandbits(64)
        for _ in range(40):  # chains of near fingerprints, so that large buckets are split
            base ^= 1 << rnd.randrange(64)
            fps.add(base)
    fps |= {rnd.getrandbits(64) for _ in range(200)} | {0, (1 << 64) - 1}
    frame = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    links = [(r.src % (1 << 64), r.dst % (1 << 64)) for r in simhash.links(frame, block=block).collect()]
    label = {f: f for f in fps}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        label[find(a)] = find(b)
    own = sorted(fps)
    want = brute_components(list(range(len(own))), own, 3)
    groups = {}
    for f, w in zip(own, want, strict=True):
        groups.setdefault(w, set()).add(find(f))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_pivots_never_discard_a_link():
    refs = simhash.pivots()
    rnd = random.Random(3)
    for _ in range(200):
        a = rnd.getrandbits(64)
        b = a ^ sum(1 << x for x in rnd.sample(range(64), 3))
        x, y = (np.bitwise_count(np.uint64(v) ^ refs).astype(int) for v in (a, b))
        assert abs(x - y).max() <= 3


def test_one_of_each_group_stays(odd_docs, no_docs):
    kept = simhash.keep_one(odd_docs)
    rows, all_rows = kept.collect(), odd_docs.collect()
    assert kept.columns == odd_docs.columns
    comp = brute_components([r.doc_id for r in all_rows], [brute_fp(r.text) for r in all_rows], 3)
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(c) for c in set(comp))
    assert simhash.keep_one(no_docs).count() == 0
