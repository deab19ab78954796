import itertools
import random

import pytest

import corpus_pipeline
from harrow.llm import neardup, simhash

WORDS = [f"w{i}" for i in range(4000)]


def brute_kept(rows):
    def shingles(text):
        w = text.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    for a, b in itertools.combinations(sets, 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
            label = {k: label[a] if v == label[b] else v for k, v in label.items()}
    groups = {}
    for i, g in label.items():
        groups.setdefault(g, []).append(i)
    return sorted(min(g) for g in groups.values())


def edited(rnd, words, share):
    return [rnd.choice(WORDS) if rnd.random() < share else w for w in words]


def texts():
    rnd = random.Random(6)
    out = []
    for n, share in itertools.product((60, 300, 1000), (0.01, 0.02, 0.03, 0.05)):
        for _ in range(4):
            base = [rnd.choice(WORDS) for _ in range(n)]
            out += [" ".join(base), " ".join(edited(rnd, base, share))]
    chain = [rnd.choice(WORDS) for _ in range(400)]
    for _ in range(30):  # neighbours are similar, the ends are not
        chain = edited(rnd, chain, 0.01)
        out.append(" ".join(chain))
    line = [rnd.choice(WORDS) for _ in range(40)]
    out += [" ".join(line + [rnd.choice(WORDS) for _ in range(20)]) for _ in range(40)]
    return list(enumerate(out + ["", " ", "One two", "one TWO", "one three"]))


@pytest.mark.parametrize("block", [neardup.BLOCK, 4])
def test_kept_against_brute_force(spark, block):
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in neardup.keep_one(docs, block=block).collect()) == brute_kept(rows)


def test_stage_removes_near_copies_at_the_threshold(spark):
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.simhash_stage(spark, docs, "").collect()) == brute_kept(rows)


def test_odd_rows(odd_docs, no_docs):
    kept = neardup.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert {0, 5, 7} & set(ids) == {0, 5} and len(ids) == len(set(ids)) and not {1, 2, 6} & set(ids)
    assert neardup.keep_one(no_docs).count() == 0


def test_fingerprints_propose_candidates(spark):
    """A band of 400 minima proposes next to nothing: what is found here comes from links of fingerprints, checked exactly."""
    rnd = random.Random(9)
    rows = []
    for _ in range(8):
        base = [rnd.choice(WORDS) for _ in range(1500)]
        rows += [" ".join(base), " ".join([*base[:-1], "other"])]
    near = [bin(simhash.fingerprint(a) ^ simhash.fingerprint(b)).count("1") <= simhash.RADIUS for a, b in zip(rows[::2], rows[1::2], strict=True)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    kept = {r.doc_id for r in neardup.keep_one(docs, bands=1, rows=400).collect()}
    assert sum(near) > 4 and all(2 * i + 1 not in kept for i, x in enumerate(near) if x)
