import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from harrow.llm import alignment
from harrow.llm.bpe import byte_symbols

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def groups_of(text, a, b):
    """Groups of the whole text, cut at common ends, and none if the bytes differ."""
    if not text:
        return []
    raw, byte = (" " + text).encode(), {s: i for i, s in enumerate(byte_symbols())}
    x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    xb = [bytes(byte[c] for c in a.id_to_token(i)) for i in x]
    yb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
    if b"".join(xb) != raw or b"".join(yb) != raw:
        return []

    def ends(parts):
        at, out = 0, {}
        for k, p in enumerate(parts):
            at += len(p)
            out[at] = k + 1
        return out

    ex, ey = ends(xb), ends(yb)
    out, i, j = [], 0, 0
    for at in sorted(ex.keys() & ey.keys()):
        out.append((x[i : ex[at]], y[j : ey[at]]))
        i, j = ex[at], ey[at]
    return out


def brute(texts, a, b):
    groups = [groups_of(t, a, b) for t in texts]
    links = [Counter((p, q) for x, y in g for p in x for q in y) for g in groups]
    seen = Counter(pair for found in links for pair in found)
    most = defaultdict(int)
    for (p, _), n in seen.items():
        most[p] = max(most[p], n)
    out = []
    for g, found in zip(groups, links):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((
            sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(found.values()), sum(n for (p, q), n in found.items() if seen[p, q] == most[p]),
            sum(n * seen[k] for k, n in found.items()), hashlib.sha256(text.encode()).hexdigest() if g else "",
        ))
    return out


def rows(df):
    return sorted(((tuple(r)[0], tuple(r)[1:]) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=repr)


def texts():
    rnd = random.Random(2)
    chars = "ab  \n\t.é日😀\x1c\xa0 '_ﬁ<|>▁"
    own = ["".join(rnd.choice(chars[:-1]) for _ in range(rnd.randint(1, 30))) for _ in range(300)] + ["a ▁ b", "▁", "a", "a ", " a", "  ", "a  ", "\n ", "don't  stop", "<|endoftext|> <s> </s> <0x41>", "z" * 5000, "ab  c", "x\x85 y", "q​ w"]
    words = [" ".join(rnd.choice(["the", "of", "token", "überall", "12", "x=1;", "I'll"]) for _ in range(rnd.randint(1, 60))) for _ in range(60)]
    return own + words + words[:7] + [None, ""]


def test_equals_whole_texts_by_brute_force(spark, libraries, monkeypatch):
    own = texts()
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 3000)
    df = spark.createDataFrame([(i if i != 5 else None, t, "x", 1) for i, t in enumerate(own)], "doc_id long, text string, chunk string, codes int")
    want = sorted(((i if i != 5 else None, w) for i, w in enumerate(brute(own, *libraries))), key=repr)
    assert rows(alignment.align_documents(df.repartition(3), A, B)) == want


def test_real_texts(spark, sf_dir, libraries):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = [(r.doc_id, r.text) for r in docs.collect()]
    want = sorted(zip((i for i, _ in own), brute([t for _, t in own], *libraries)), key=repr)
    assert rows(alignment.align_documents(docs, A, B)) == want


def test_cuts_are_ends_of_tokens_for_every_code_point(libraries):
    a, _ = libraries
    odd = []
    for c in (chr(i) for i in range(0x30000) if not 0xD800 <= i < 0xE000):
        if not c.isspace():
            spans = [s for _, (s, _) in a.pre_tokenizer.pre_tokenize_str(f" a{c} b")]
            odd += [c] if 3 not in spans else []
    assert odd == []


def test_components_are_cuts_at_common_ends():
    rnd = random.Random(1)
    for _ in range(300):
        n = rnd.randint(1, 40)
        x, y = (sorted({*rnd.sample(range(1, n + 1), rnd.randint(1, n)), n}) for _ in range(2))
        common = sorted(set(x) & set(y))
        want = [([i for i, e in enumerate(x) if lo < e <= hi], [i for i, e in enumerate(y) if lo < e <= hi]) for lo, hi in zip([0, *common], common)]
        a, b = (g.tolist() for g in alignment.components(np.array(x), np.array(y)))
        assert [([i for i, g in enumerate(a) if g == k], [i for i, g in enumerate(b) if g == k]) for k in range(max(a) + 1)] == want


def test_groups_and_translations(spark, libraries):
    own = [t for t in texts() if t][:120]
    df = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
    got = defaultdict(list)
    for r in alignment.groups(df, A, B).collect():
        got[r.doc_id].append((r.start, r.end, r.a_ids, r.b_ids))
    seen = Counter()
    for i, t in enumerate(own):
        want = groups_of(t, *libraries)
        assert [g[2:] for g in sorted(got[i])] == want
        assert all(p[1] == q[0] for p, q in zip(sorted(got[i]), sorted(got[i])[1:]))
        seen.update({(p, q) for x, y in want for p in x for q in y})
    assert {(r.a_id, r.b_id): r.seen for r in alignment.translations(df, A, B).collect()} == dict(seen)


def test_empty_table_and_odd_rows(no_docs, odd_docs):
    assert alignment.align_documents(no_docs, A, B).collect() == []
    assert alignment.align_documents(odd_docs, A, B).count() == odd_docs.count()
