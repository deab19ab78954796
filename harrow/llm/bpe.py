"""BPE encoding and decoding with tree concatenation of long texts.

Short texts go to the tokenizer whole. A text longer than ``leaf_chars`` is cut into halves, recursively and at
arbitrary places; all leaves are encoded together (the tokenizer's thread pool may run them in parallel) and then
concatenated pairwise up the tree. At each join a window around the seam is encoded again and grows until both sides
agree exactly:

* where white space surrounds the seam, the window runs over a few words of each half.  No pre-token and no
  normalisation of this tokenizer family crosses white space (so a word's ids can be remembered), and the window must
  reproduce, word for word and id for id, what each half had at the window's edges;
* inside one unsplit word, the window is a slice of the word's symbols.  It must reproduce the first of its tokens
  from the left half and the last from the right half.  A sequence of tokens is the BPE encoding of a word exactly if
  each adjacent pair is (Berglund and van der Merwe; the property is checked by tests against the library), and each
  pair of the joined sequence then lies within one valid encoding.

If a window would reach the ends of both parts, it is their whole text, which is exact by definition.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain

from pyspark.sql import DataFrame

from .common import map_columns

#: White space to Python, but not to the tokenizers' patterns.
CONTROLS = re.compile("[\x1c-\x1f]")
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 is itself, others follow 255."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in keep)}
    return [chr(rest.get(b, b)) for b in range(256)]


class WordBPE:
    """Merges inside one word, as symbols; joins halves by growing windows."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = ""):
        self.vocab, self.suffix = vocab, suffix
        self.rank = {}
        for i, pair in enumerate(merges):
            a, b = pair if isinstance(pair, list | tuple) else pair.split(" ")
            self.rank.setdefault((a, b), i)
        self.bytes = byte_symbols()

    def symbols(self, word: str) -> list[str]:
        out = [self.bytes[b] for b in word.encode()]
        if out and self.suffix:
            out[-1] += self.suffix
        return out

    def merge(self, symbols: list[str]) -> list[tuple[str, int]]:
        """(token, number of symbols) of the sequence: lowest rank first, leftmost first."""
        n, rank = len(symbols), self.rank
        token, size = list(symbols), [1] * n
        after, before = [*range(1, n), -1] if n else [], list(range(-1, n - 1))
        heap = [(r, i, token[i], token[i + 1]) for i in range(n - 1) if (r := rank.get((token[i], token[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not size[i] or j < 0 or token[i] != a or token[j] != b:
                continue
            token[i], size[i], size[j], after[i] = a + b, size[i] + size[j], 0, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := rank.get((token[x], token[y]))) is not None:
                    heapq.heappush(heap, (r, x, token[x], token[y]))
        return [(token[i], size[i]) for i in range(n) if size[i]]

    def join(self, symbols: list[str], lo: int, mid: int, left: list, right: list) -> list:
        """The encoding of symbols[lo:] from those of symbols[lo:mid] and of what follows."""
        width = 4
        while True:
            a, b = min(width, len(left)), min(width, len(right))
            start, end = mid - sum(s for _, s in left[len(left) - a :]), mid + sum(s for _, s in right[:b])
            window = self.merge(symbols[start:end])
            whole_left, whole_right = a == len(left), b == len(right)
            fits_left = whole_left or window[0] == left[len(left) - a]
            fits_right = whole_right or window[-1] == right[b - 1]
            if fits_left and fits_right and (len(window) > 1 or whole_left or whole_right):
                return left[: len(left) - a] + window + right[b:]
            width *= 2

    def tree(self, symbols: list[str], leaf: int) -> list:
        """Halves up to ``leaf`` symbols, joined upward without recursion."""
        level = [(lo, self.merge(symbols[lo : lo + leaf])) for lo in range(0, len(symbols), leaf)]
        while len(level) > 1:
            level = [
                (level[i][0], self.join(symbols, level[i][0], level[i + 1][0], level[i][1], level[i + 1][1]))
                if i + 1 < len(level)
                else level[i]
                for i in range(0, len(level), 2)
            ]
        return level[0][1] if level else []


class Codec:
    """Encodes and decodes as the tokenizers library does with the given file."""

    def __init__(self, path: str, leaf_chars: int = 8192, leaf_symbols: int = 1024, memo: int = 200_000):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.lib = Tokenizer.from_file(path)
        self.lib.no_padding()
        self.lib.no_truncation()
        self.leaf, self.leaf_symbols = leaf_chars, leaf_symbols
        self.memo: dict[str, tuple[int, ...]] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.most = memo
        model = spec["model"]
        self.vocab = model["vocab"]
        self.word = WordBPE(self.vocab, model["merges"], model.get("end_of_word_suffix") or "")
        self.added = [x["content"] for x in spec["added_tokens"]]
        #: White space is dropped before the merges; only then are windows between white space exact.
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        found = [x["pattern"]["Regex"] for x in steps if x["type"] == "Split" and x.get("invert") and "\\s" in x["pattern"].get("Regex", "")]
        self.splits = bool(found)
        lowers = '"Lowercase"' in json.dumps(spec.get("normalizer"))
        self.split = regex.compile(found[0]) if found and lowers else None

    def encode(self, texts: list[str]) -> list[list[int]]:
        out: list = [None] * len(texts)
        plain = []
        for i, t in enumerate(texts):
            if len(t) > self.leaf and self.splits:
                out[i] = self.encode_long(t)
            elif self.splits and not CONTROLS.search(t) and not any(x in t for x in self.added):
                plain.append(i)
        words = {i: texts[i].split() for i in plain}
        self.learn(w for i in plain for w in words[i])
        for i in plain:
            out[i] = list(chain.from_iterable(map(self.memo.__getitem__, words[i])))
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, self.lib.encode_batch([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def learn(self, words: Iterable[str]) -> None:
        """Have the ids of each word in the memo: white space bounds normalisation, pre-tokens and merges."""
        if len(self.memo) > self.most:
            self.memo = {}
        memo, pieces = self.memo, self.pieces
        if len(pieces) > self.most:
            pieces = self.pieces = {}
        for w in set(words).difference(memo):
            if self.split is None or not (w.isascii() or max(w) < "\u0250"):
                memo[w] = tuple(self.lib.encode(w, add_special_tokens=False).ids)
                continue
            found = self.split.findall(w.lower())  # Latin letters: lower case and classes as the tokenizer has them
            for p in found:
                if p not in pieces:
                    shown = p if p.isascii() else "".join([self.word.bytes[b] for b in p.encode()])
                    pieces[p] = tuple([t.id for t in self.lib.model.tokenize(shown)])
            memo[w] = pieces[found[0]] if len(found) == 1 else tuple(chain.from_iterable([pieces[p] for p in found]))

    def leaves(self, text: str) -> list[tuple[int, int]]:
        """Leaves of the tree of halves, cut at arbitrary places."""
        out, todo = [], [(0, len(text))]
        while todo:
            lo, hi = todo.pop()
            if hi - lo <= self.leaf:
                out.append((lo, hi))
            else:
                mid = (lo + hi) // 2
                todo += [(mid, hi), (lo, mid)]
        return out

    def encode_long(self, text: str) -> list[int]:
        if any(x in text for x in self.added):  # strings of special tokens cut the text before anything else
            return self.around_added(text)
        if CONTROLS.search(text):  # white space to Python only
            return self.lib.encode(text, add_special_tokens=False).ids
        runs = self.long_words(text)
        if runs:
            ids, at = [], 0
            for lo, hi in runs:
                ids += self.encode([text[at:lo]])[0] if lo > at else []
                ids += self.encode_run(text[lo:hi])
                at = hi
            return ids + (self.encode([text[at:]])[0] if at < len(text) else [])
        spans = self.leaves(text)
        words = [text[a:b].split() for a, b in spans]
        self.learn(w for own in words for w in own)
        level = [(a, b, own, [self.memo[w] for w in own]) for (a, b), own in zip(spans, words, strict=True)]
        while len(level) > 1:
            level = [
                self.join(text, level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)
            ]
        return list(chain.from_iterable(level[0][3]))

    def around_added(self, text: str) -> list[int]:
        parts, at = [], 0
        while True:
            hits = [(text.find(x, at), -len(x), x) for x in self.added if text.find(x, at) >= 0]
            if not hits:
                break
            lo, _, x = min(hits)
            parts += [text[at:lo], x]
            at = lo + len(x)
        parts.append(text[at:])
        return [i for ids in self.encode([p for p in parts if p]) for i in ids]

    def long_words(self, text: str) -> list[tuple[int, int]]:
        """Stretches without white space of over half a leaf: windows between white space would not fit there."""
        out, at = [], 0
        for w in text.split():
            if len(w) > self.leaf // 2:
                lo = text.index(w, at)
                out.append((lo, lo + len(w)))
                at = lo + len(w)
        return out

    def encode_run(self, run: str) -> list[int]:
        """A stretch without white space: pre-tokens by the library, long ones by the tree over their symbols."""
        norm = self.lib.normalizer.normalize_str(run) if self.lib.normalizer else run
        ids: list[int] = []
        small: list[str] = []
        known = {s: b for b, s in enumerate(self.word.bytes)}
        for piece, _ in self.lib.pre_tokenizer.pre_tokenize_str(norm):
            if len(piece) <= self.leaf_symbols:
                small.append(piece)
                continue
            ids += self.flush(small, known)
            small = []
            symbols = list(piece)
            symbols[-1] += self.word.suffix
            ids += [self.vocab[t] for t, _ in self.word.tree(symbols, self.leaf_symbols)]
        return ids + self.flush(small, known)

    def flush(self, pieces: list[str], known: dict[str, int]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            symbols = list(p)
            symbols[-1] += self.word.suffix
            out += [self.vocab[t] for t, _ in self.word.merge(symbols)]
        return out

    def join(self, text: str, left: tuple, right: tuple) -> tuple:
        """Encode growing windows around the seam until both halves agree with the window at its edges.

        The window runs over ``width`` words of each half; it agrees if its first word and ids are the left half's
        there and its last ones the right half's, which fails while a word that the seam cuts is at an edge.
        """
        lo, mid, words, ids = left
        _, hi, words2, ids2 = right
        width = 2
        while True:
            a, b = min(width, len(words)), min(width, len(words2))
            start = self.back(text, lo, mid, a) if a < len(words) else lo
            end = self.forth(text, mid, hi, b) if b < len(words2) else hi
            own = text[start:end].split()
            self.learn(own)
            got = [self.memo[w] for w in own]
            i, j = len(words) - a, b
            agree_left = start == lo or (own and own[0] == words[i] and got[0] == ids[i])
            agree_right = end == hi or (own and own[-1] == words2[j - 1] and got[-1] == ids2[j - 1])
            if agree_left and agree_right and (len(own) > 1 or (start, end) == (lo, hi)):
                return lo, hi, words[:i] + own + words2[j:], ids[:i] + got + ids2[j:]
            width *= 2

    @staticmethod
    def back(text: str, lo: int, mid: int, n: int) -> int:
        """Place where the n-th word before the seam starts."""
        at = mid
        for _ in range(n):
            while at > lo and text[at - 1].isspace():
                at -= 1
            while at > lo and not text[at - 1].isspace():
                at -= 1
        return at

    @staticmethod
    def forth(text: str, mid: int, hi: int, n: int) -> int:
        """Place where the n-th word after the seam ends."""
        at = mid
        for _ in range(n):
            while at < hi and text[at].isspace():
                at += 1
            while at < hi and not text[at].isspace():
                at += 1
        return at

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.lib.decode_batch(ids, skip_special_tokens=False)


@lru_cache(maxsize=2)
def shared_codec(path: str, leaf_chars: int) -> Codec:
    """One codec, with its memo, for all tasks of a worker process."""
    return Codec(path, leaf_chars)


def make(path: str, leaf_chars: int):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one core a task; Spark runs the tasks in parallel
    codec = shared_codec(path, leaf_chars)

    def run(cols: dict[str, list]) -> dict[str, list]:
        gc.disable()  # nothing here is cyclic, and the memo is large to walk
        try:
            ids = codec.encode([t or "" for t in cols["text"]])
        finally:
            gc.enable()
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return {
            "doc_id": cols["doc_id"],
            "n_tokens": [len(x) for x in ids],
            "ids_sha256": [sha(" ".join(map(str, x))) for x in ids],
            "decoded_sha256": [sha(x) for x in codec.decode(ids)],
            "ids": ids,
        }

    return run


def encode_documents(docs: DataFrame, path: str, *, leaf_chars: int = 8192, with_ids: bool = False) -> DataFrame:
    """A row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, if asked for).

    Null text counts as empty: no tokens, digests of the empty string.  Null doc_id stays null; repeated rows give
    repeated results; other columns are ignored; an empty table gives an empty one.  A whole text is encoded in the
    task that reads it: memory is bounded by the longest text.
    """
    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    return map_columns(docs.select("doc_id", "text"), schema, make, path, leaf_chars)
