import re
from collections import Counter

from harrow.llm import rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def test_measures_against_brute_force(odd_docs, no_docs):
    rows = rules.apply_policy(rules.ledger(odd_docs), 2)
    got = sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows.collect())
    assert got == sorted(brute(r.text) for r in odd_docs.collect())
    assert not [r for r in rows.collect() if r.base_failed and r.kept]
    assert rules.ledger(no_docs).count() == 0


def test_many_distinct_words_take_the_exact_path():
    words = [str(i).encode() for i in range(9000)] + [str(i).encode() for i in range(7)]
    assert rules.repeat_words(words) == 14


def test_ablations_are_counts_over_bits(odd_docs):
    rows = rules.ledger(odd_docs)
    all_bits = [r.rule_bits & rules.POLICIES[2] for r in rows.collect()]
    for r in rules.ablations(rows, 2).collect():
        bit = rules.BIT[r["rule"]]
        assert r.failed == sum(bool(b & bit) for b in all_bits)
        assert r.failed_alone == sum(b == bit for b in all_bits)
        assert r.kept_without == sum(not b & ~bit for b in all_bits)


def test_clean_documents_stay(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = rules.apply_policy(rules.ledger(docs), 2).join(labels, "doc_id").where("n_words >= 10")
    good = rows.where("quality = 1")
    assert good.where("kept").count() >= 0.95 * good.count()
