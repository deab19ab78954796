import random
import re

import pytest
import regex

from harrow.llm import licenses

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def base(text):
    words, found = WORD.findall(lowered(text)), []
    for phrase, label in licenses.BASE:
        p = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    places, labels = [i for i, _ in found], ",".join(sorted({x for _, x in found}))
    return len(words), len(places), min(places, default=None), max(places, default=None), labels


def fuzzy(text):
    """Every notice sought in the whole text, without pieces."""
    joined, out = " ".join(WORD.findall(lowered(text))), []
    for notice, label in licenses.NOTICES:
        pattern = regex.compile(f"(?e)(?<![^ ])(?:{regex.escape(notice)}){{e<={len(notice) // 10}}}(?![^ ])")
        out += [(label, notice, m.start(), m.end(), sum(m.fuzzy_counts)) for m in pattern.finditer(joined)]
    return sorted(out, key=lambda f: (f[2], [n for n, _ in licenses.NOTICES].index(f[1]))), joined


def planted(rnd, notice, n):
    s = list(notice)
    for _ in range(n):
        i, what = rnd.randrange(len(s)), rnd.choice("rid")
        if what == "r":
            s[i] = rnd.choice("abcxyz é")
        elif what == "i":
            s.insert(i, rnd.choice("abcxyz é"))
        elif len(s) > 1:
            del s[i]
    return "".join(s)


def texts():
    rnd, out = random.Random(4), [None, "", " .,;", "mit license", "MIT-License! cc by, CC BY; Cc\nBy", "permit license mit licenses", "cc by cc by cc", "ÄMIT LICENSE", "licensed under the é apache licénse version 2 0"]
    filler = "licensed under the public terms of a version mit all rights in general use granted copy é 4 0 source".split()
    for notice, _ in licenses.NOTICES:
        for n in range(0, len(notice) // 10 + 3):
            body = [" ".join(rnd.choice(filler) for _ in range(rnd.randint(0, 12))) for _ in range(3)]
            out.append(f"{body[0]} {planted(rnd, notice, n)}{rnd.choice(['. ', ' ', ', '])}{body[1]} {planted(rnd, notice.upper(), n).replace(' ', rnd.choice([' ', '-', chr(10)]))} {body[2]}")
            out.append(planted(rnd, notice, n) * 2 + " " + planted(rnd, notice, n // 2))
    return out + [" ".join(rnd.choice(filler) for _ in range(3_000)) + " released under teh mit license " + "x" * 50_000]


@pytest.fixture(scope="module")
def found(spark):
    own = texts()
    df = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string").selectExpr("*", "text AS labels", "doc_id AS score", "'a' AS spans", "1 AS joined")
    return own, {r.doc_id: r for r in licenses.scan(df.repartition(3)).collect()}


def test_base_equals_brute_force(found):
    own, rows = found
    assert len(rows) == len(own)
    for i, text in enumerate(own):
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(text), text


def test_pieces_find_what_a_search_of_the_whole_text_finds(found):
    own, rows = found
    n = 0
    for i, text in enumerate(own):
        want, joined = fuzzy(text)
        got = licenses.Notices().search(joined)
        assert [(licenses.NOTICES[k][1], licenses.NOTICES[k][0], a, b, e) for k, a, b, e in got] == want, text
        assert [(s.label, s.notice, s.edits) for s in rows[i].spans] == [(x[0], x[1], x[4]) for x in want]
        for s, x in zip(rows[i].spans, want):
            assert " ".join(WORD.findall(lowered(text[s.start : s.end]))) == joined[x[2] : x[3]]
        labels = set(filter(None, rows[i].base_labels.split(","))) | {x[0] for x in want}
        assert rows[i].labels == ",".join(sorted(labels))
        assert rows[i].score == (1.0 if rows[i].n_base else max((1 - x[4] / len(x[1]) for x in want), default=0.0))
        n += len(want)
    assert n > 150


def test_planted_notices_within_their_edits_are_found(found):
    rnd = random.Random(6)
    search = licenses.Notices().search
    for i, (notice, _) in enumerate(licenses.NOTICES):
        for n in range(len(notice) // 10 + 1):
            for _ in range(10):
                inner = notice[0] + planted(rnd, notice[1:-1], n) + notice[-1]
                joined = licenses.words_of(f"some words {inner} and more")
                if f" {inner} " in f" {joined} ":  # spaces put in twice are not words
                    assert any(k == i for k, *_ in search(joined)), inner


def test_regions_of_a_notice_are_apart():
    rnd, notices = random.Random(8), licenses.Notices()
    bits = [p for n, _ in licenses.NOTICES[:4] for _, p in licenses.pieces(n)]
    for _ in range(400):
        joined = licenses.words_of("".join(rnd.choice([*bits, " x ", "y"]) for _ in range(rnd.randint(2, 14))))
        last = {}
        for i, a, b in notices.regions(joined):
            assert a < b and a > last.get(i, -2) + 1
            last[i] = b
        assert [f for f in notices.search(joined) if notices.notices[f[0]] in licenses.NOTICES[:4]] == sorted(
            ((i, m.start(), m.end(), sum(m.fuzzy_counts)) for i in range(4) for m in notices.patterns[i].finditer(joined)), key=lambda f: (f[1], f[0])
        )


def test_real_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = {r.doc_id: r.text for r in docs.collect()}
    rows = {r.doc_id: r for r in licenses.scan_documents(docs).collect()}
    assert len(rows) == len(own)
    for i, text in own.items():
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(text)
        want = fuzzy(text)[0]
        assert [s.split(":")[0] for s in r.spans.split(",") if s] == [x[0] for x in want]


def test_odd_and_empty_tables(odd_docs, no_docs):
    assert licenses.scan_documents(odd_docs).count() == odd_docs.count()
    assert licenses.scan_documents(no_docs).collect() == []
