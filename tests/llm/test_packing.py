import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from harrow.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)


def check_bins(placed, capacity):
    """placed: (sequence, offset, length)."""
    bins = {}
    for s, o, n in placed:
        bins.setdefault(s, []).append((o, n))
    for own in bins.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= capacity
    return len(bins)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 60).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=120))))
def test_plan_places_each_item_once(case):
    capacity, items = case
    placed, seen = [], Counter()
    for s, first, n, per, base, off in packing.plan_bins(dict(Counter(items)), capacity):
        for i in range(n):
            placed.append((base + i // per, off + i % per * s, s))
            seen[s, first + i] += 1
    assert sorted(seen) == sorted((s, i) for s, n in Counter(items).items() for i in range(n)) and set(seen.values()) <= {1}
    n_bins = check_bins(placed, capacity)
    assert n_bins <= 11 / 9 * -(-sum(items) // capacity) + 40


def test_large_items_pair_and_bins_are_few():
    rnd = random.Random(1)
    items = [rnd.randint(1, 2048) for _ in range(5000)]
    runs = packing.plan_bins(dict(Counter(items)), 2048)
    n = max(base + items_ // per for _, _, items_, per, base, _ in runs)
    assert n <= 1.06 * sum(items) / 2048 or n <= sum(x > 1024 for x in items) + 1


def test_ids_are_the_librarys():
    enc = packing.Encoder(PATH)
    for c in range(1, 0x250):
        for text in (f"a{chr(c)}b", f" {chr(c)} b", f"1{chr(c)}{chr(c)}2 ", f"\n{chr(c)}.{chr(c)}'s"):
            assert enc.encode(text) == LIB.encode(text, add_special_tokens=False).ids
    for text in ("x<|endoftext|>y", "日本 😀 e\u0301", ""):
        assert enc.encode(text) == LIB.encode(text, add_special_tokens=False).ids


def pieces(text, capacity):
    ids = np.array([*LIB.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
    first, at, out = len(ids) % capacity or capacity, 0, []
    for end in range(first, len(ids) + 1, capacity):
        out.append((len(out), at, end - at, zlib.crc32(ids[at:end].tobytes())))
        at = end
    return out


def test_documents(odd_docs, no_docs):
    for capacity in (64, 2048):
        got = packing.pack_documents(odd_docs, PATH, capacity=capacity, salts=3, with_ids=True).collect()
        want = sorted((p for r in odd_docs.collect() for p in pieces(r.text, capacity)), key=str)
        assert sorted(((r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == want
        check_bins([(r.sequence_id, r.offset, r.length) for r in got], capacity)
        assert all(zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 for r in got)
    assert packing.pack_documents(no_docs, PATH).count() == 0
