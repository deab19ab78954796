import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from harrow.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)
SMALL = bpe.Codec(PATH, leaf_chars=48, leaf_symbols=12)


def want(text):
    return LIB.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcdeſthan éÄß's0123.,!\n\t\x1c\x85\xa0Σİ́ﬁ😀中", max_size=300))
def test_any_text_encodes_as_the_library(text):
    assert SMALL.encode([text]) == [want(text)]


def test_long_unsplit_and_special():
    rnd = random.Random(2)
    for alphabet in ("ab", "abcdefghijklmnopqrstuvwxyz", "aeioust", "!?$", "théñ", "日本"):
        for n in (47, 48, 49, 300, 2000):
            word = "".join(rnd.choice(alphabet) for _ in range(n))
            for text in (word, f"x {word} y", word + "<|endoftext|>" + word, f"{word} " * 3):
                assert SMALL.encode([text]) == [want(text)]


def test_merge_and_tree_agree():
    word = "internationalisation" * 40
    symbols = SMALL.word.symbols(word)
    flat = [t for t, _ in SMALL.word.merge(symbols)]
    assert [t for t, _ in SMALL.word.tree(symbols, 8)] == flat
    assert [SMALL.vocab[t] for t in flat] == want(word)


def test_documents(odd_docs, no_docs):
    got = bpe.encode_documents(odd_docs, PATH, leaf_chars=256, with_ids=True).collect()
    texts = sorted((r.text or "" for r in odd_docs.collect()))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = sorted((len(want(t)), sha(" ".join(map(str, want(t)))), sha(LIB.decode(want(t), skip_special_tokens=False))) for t in texts)
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == expected
    assert all(len(r.ids) == r.n_tokens for r in got)
    assert bpe.encode_documents(no_docs, PATH).count() == 0


@pytest.mark.parametrize("leaf", [64, 8192])
def test_real_rows(spark, sf_dir, leaf):
    codec = bpe.Codec(PATH, leaf_chars=leaf)
    texts = [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert codec.encode(texts) == [want(t) for t in texts]
