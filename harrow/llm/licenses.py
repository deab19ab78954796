"""License scan: exact phrases, and short notices with bounded errors.

A text is seen as its words: A-Z lower-cased, runs of a-z, 0-9 and of all characters beyond ASCII, joined by one space.
The base phrases are looked up exactly, word for word.  A notice of L characters may be missed by L // 10 edits of
characters (``EDIT_EVERY``).  It is split into one more piece than edits, so one piece at least stands exactly in any place
that counts (pigeonhole).  One pass over the text finds all pieces of all notices; where one stands, the words around it are
searched by the ``regex`` library with bounded errors, best fit, between ends of words.  Searched regions of a notice
that touch are one region, so the result is that of a search of the whole text.

Null and empty texts have no words, no labels and score 0.  Each row is judged by itself: repeated rows repeat their result,
empty tables give no rows, other columns are ignored.  Very long texts are searched in one piece, in time linear in their
length.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, ship

#: Phrases of the base and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Short notices in words, and their labels.
NOTICES = (
    ("gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("licensed under the apache license version 2 0", "apache"),
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("permission to use copy modify and or distribute this software", "isc"),
    ("licensed under the mozilla public license", "mpl"),
    ("licensed under the eclipse public license", "epl"),
    ("released into the public domain", "public-domain"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("creative commons attribution", "cc-by"),
    ("all rights reserved", "all-rights-reserved"),
)
EDIT_EVERY = 10
SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double,"
    " spans array<struct<label: string, notice: string, start: long, end: long, edits: int>>"
)
#: Bytes to bytes: A-Z become a-z, all else of ASCII but letters and digits a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def edits(notice: str) -> int:
    return len(notice) // EDIT_EVERY


def pieces(notice: str) -> list[tuple[int, str]]:
    """The notice cut into edits + 1 pieces of about equal length, with their offsets."""
    n = edits(notice) + 1
    at = [len(notice) * i // n for i in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(at, at[1:])]


def words_of(text: str) -> str:
    """The words, joined by one space."""
    return b" ".join(text.encode().translate(FOLD).split()).decode()


def places(joined: str, phrase: str) -> list[int]:
    """Numbers of the words at which the phrase's words stand."""
    padded, found = f" {joined} ", []
    at, word, seen = padded.find(f" {phrase} "), 0, 0
    while at >= 0:
        word += padded.count(" ", seen, at)
        seen = at
        found.append(word)
        at = padded.find(f" {phrase} ", at + 1)
    return found


class Notices:
    """The notices with their pieces in one automaton and their patterns."""

    def __init__(self, notices=NOTICES):
        import ahocorasick
        import regex

        self.notices, self.patterns, found = notices, [], {}
        for i, (notice, _) in enumerate(notices):
            self.patterns.append(regex.compile(f"(?e)(?<![^ ])(?:{regex.escape(notice)}){{e<={edits(notice)}}}(?![^ ])"))
            for at, piece in pieces(notice):
                found.setdefault(piece, []).append((i, at))
        self.pieces = ahocorasick.Automaton()
        for piece, of in found.items():
            self.pieces.add_word(piece, (len(piece), of))
        self.pieces.make_automaton()

    def regions(self, joined: str) -> list[tuple[int, int, int]]:
        """(notice, start, end): where a place of the notice can be, out to ends of words; regions of a notice are apart."""
        found: dict[int, list[tuple[int, int]]] = {}
        for end, (size, of) in self.pieces.iter(joined):
            for i, at in of:
                k, begin = edits(self.notices[i][0]), end + 1 - size - at
                a, b = begin - k, begin + len(self.notices[i][0]) + k
                a, b = joined.rfind(" ", 0, a) + 1 if a > 0 else 0, joined.find(" ", b) if b < len(joined) else -1
                found.setdefault(i, []).append((a, len(joined) if b < 0 else b))
        out = []
        for i, spans in found.items():
            spans.sort()
            first = len(out)
            for a, b in spans:
                if len(out) > first and a <= out[-1][2] + 1:
                    out[-1] = (i, out[-1][1], max(b, out[-1][2]))
                else:
                    out.append((i, a, b))
        return out

    def search(self, joined: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, edits) of every place in the joined words, not overlapping for one notice."""
        found = []
        for i, a, b in self.regions(joined):
            for m in self.patterns[i].finditer(joined, a, b):
                found.append((i, m.start(), m.end(), sum(m.fuzzy_counts)))
        return sorted(found, key=lambda f: (f[1], f[0]))


def spans_in_text(text: str, joined: str, found: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """Places in the joined words as code points of the text, end exclusive."""
    if not found:
        return []
    words = [m.span() for m in re.finditer("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text)]
    out, seen, word = {}, 0, 0
    for at in sorted({p for _, a, b, _ in found for p in (a, b)}):
        word += joined.count(" ", seen, at)
        seen, out[at] = at, word
    return [(words[out[a]][0], words[out[b]][1]) for _, a, b, _ in found]


def judge(notices: Notices) -> Callable[[dict[str, list]], dict[str, list]]:
    def run(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {c.split()[0]: [] for c in SCHEMA.split(" spans ")[0].rstrip(",").split(", ")} | {"spans": []}
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            text = text or ""
            joined = words_of(text)
            base = {(phrase, label): places(joined, phrase) for phrase, label in BASE if phrase in joined}
            starts = [p for found in base.values() for p in found]
            base_labels = {label for (_, label), found in base.items() if found}
            found = notices.search(joined)
            fits = [1 - e / len(notices.notices[i][0]) for i, _, _, e in found]
            out["doc_id"].append(doc_id)
            out["n_words"].append(joined.count(" ") + 1 if joined else 0)
            out["n_base"].append(len(starts))
            out["first_word"].append(min(starts, default=None))
            out["last_word"].append(max(starts, default=None))
            out["base_labels"].append(",".join(sorted(base_labels)))
            out["labels"].append(",".join(sorted(base_labels | {notices.notices[i][1] for i, *_ in found})))
            out["score"].append(1.0 if starts else max(fits, default=0.0))
            out["spans"].append([
                {"label": notices.notices[i][1], "notice": notices.notices[i][0], "start": a, "end": b, "edits": e}
                for (i, _, _, e), (a, b) in zip(found, spans_in_text(text, joined, found))
            ])
        return out

    return run


def scan(docs: DataFrame, notices: tuple[tuple[str, str], ...] = NOTICES) -> DataFrame:
    """Per document: words, places of base phrases, labels, the best fit (1 for an exact base phrase) and the notices' spans.

    Spans are code points of the text, end exclusive, with their edits.  Notices are words joined by one space.
    """
    ship(docs.sparkSession)
    return map_columns(docs.select("doc_id", "text"), SCHEMA, lambda: judge(Notices(notices)))


def scan_documents(docs: DataFrame) -> DataFrame:
    """``scan`` with the spans as text: label:start:end:edits, comma-joined."""
    one = lambda s: F.concat_ws(":", s["label"], s["start"].cast("string"), s["end"].cast("string"), s["edits"].cast("string"))
    return scan(docs).withColumn("spans", F.array_join(F.transform("spans", one), ","))
