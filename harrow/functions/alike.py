"""Partial similarity of many pairs of strings at once, in numpy: the work of the Arrow steps of scores and joins.

Strings are rows of a matrix of character numbers; the longest common subsequence of a pair is the bit-parallel row of
``scoring.lcs``, for all pairs in one go.  Where a row is more than one word, beyond 64 characters, pairs go
through ``scoring.partial_similarity``.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, comb

import numpy as np

#: Characters of a row of the table: one word.
WORD = 64
#: Longer strings are not in the matrices, but compared one by one.
LONGEST = 512
#: Pairs worked on at once.
CHUNK = 1 << 14


def letters(a: list[str], b: list[str]) -> np.ndarray:
    """Code points that both lists have, ascending; no other can be common."""
    return np.intersect1d(code_points(a), code_points(b))


def code_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)


class Strings:
    """Strings by number, as matrices: characters of each, and the places at which each character stands in each."""

    def __init__(self, texts: list[str], known: np.ndarray):
        self.texts = texts
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.kinds = len(known) + 1
        flat = code_points(texts)
        number = np.searchsorted(known, flat)
        number[number == len(known)] = 0
        self.flat = np.where(known[number] == flat, number + 1, 0).astype(np.int32) if len(known) else np.zeros(len(flat), np.int32)  # 0: no character
        self.row = np.repeat(np.arange(len(texts)), self.lengths)
        self.at = np.arange(len(flat)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        fits = self.lengths[self.row] <= LONGEST
        self.chars = np.zeros((len(texts), min(int(self.lengths.max(initial=0)), LONGEST) + 1), np.int32)
        self.chars[self.row[fits], self.at[fits]] = self.flat[fits]

    def marks(self, rows: np.ndarray) -> np.ndarray:
        """For these strings of at most 64 characters: a bit for each place of each character; none for number 0."""
        out = np.zeros((len(rows), self.kinds), np.uint64)
        new = np.full(len(self.texts), -1)
        new[rows] = np.arange(len(rows))
        own = np.flatnonzero((new[self.row] >= 0) & (self.flat > 0))
        np.bitwise_or.at(out, (new[self.row[own]], self.flat[own]), np.uint64(1) << self.at[own].astype(np.uint64))
        return out

    def signs(self) -> np.ndarray:
        """64 bits for each string: those of its characters, the k-th of a kind being a kind of its own."""
        order = np.lexsort((self.at, self.flat, self.row))
        r, c = self.row[order], self.flat[order]
        new = np.r_[True, (r[1:] != r[:-1]) | (c[1:] != c[:-1])] if len(r) else np.zeros(0, bool)
        first = np.maximum.accumulate(np.where(new, np.arange(len(r)), 0))
        kth = np.arange(len(r)) - first
        bit = (c + kth * max(16, self.kinds)) % 64
        out = np.zeros(len(self.texts), np.uint64)
        np.bitwise_or.at(out, r, np.uint64(1) << bit.astype(np.uint64))
        return out


def full_rows(m: np.ndarray) -> np.ndarray:
    """Words whose lowest m bits are set, m from 1 to 64."""
    return np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(WORD) - m.astype(np.uint64))


def common(marks: np.ndarray, i: np.ndarray, m: np.ndarray, chars: np.ndarray, j: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Length of the longest common subsequence of strings i (by marks) and characters lo to hi of rows j of chars."""
    full = full_rows(m)
    row = full.copy()
    flat, base = marks.reshape(-1), i * marks.shape[1]
    for p in range(lo, min(hi, chars.shape[1])):
        u = row & flat[base + chars[j, p]]
        row = (row + u) | (row - u)
    return m - np.bitwise_count(row & full)


def best(s: Strings, i: np.ndarray, t: Strings, j: np.ndarray) -> np.ndarray:
    """The best ratio of strings i of s, none the longer of its pair nor over 64, to stretches of strings j of t."""
    out = np.zeros(len(i))
    rows = np.unique(i)
    marks, place = s.marks(rows), np.searchsorted(rows, i)
    order = np.lexsort((t.lengths[j], s.lengths[i]))
    sizes = s.lengths[i][order]
    edges = np.flatnonzero(np.r_[True, sizes[1:] != sizes[:-1], True]) if len(order) else []
    for a, b in zip(edges, edges[1:], strict=False):
        m = int(sizes[a])
        for begin in range(a, b, CHUNK):
            pairs = order[begin : min(b, begin + CHUNK)]  # by length of t: those that end before a stretch come first
            n, k, row = t.lengths[j[pairs]], place[pairs], j[pairs]
            top, ms = np.zeros(len(pairs)), np.full(len(pairs), m)
            for lo in range(1 - m, int(n[-1])):
                f = int(np.searchsorted(n, lo, side="right"))
                c = common(marks, k[f:], ms[f:], t.chars, row[f:], max(lo, 0), lo + m)
                size = np.minimum(lo + m, n[f:]) - max(lo, 0)
                np.maximum(top[f:], 200.0 * c / (m + size), out=top[f:])
            out[pairs] = top
    return out


def ratios(s: Strings, i: np.ndarray, t: Strings, j: np.ndarray) -> np.ndarray:
    """``partial_similarity`` of the pairs of strings i of s and j of t; both know the same characters."""
    from .scoring import partial_similarity

    m, n = s.lengths[i], t.lengths[j]
    out = np.zeros(len(i))
    some, short = (m > 0) & (n > 0), (np.minimum(m, n) <= WORD) & (np.maximum(m, n) <= LONGEST)
    p = np.flatnonzero(some & short & (m <= n))
    out[p] = best(s, i[p], t, j[p])
    p = np.flatnonzero(some & short & (n <= m))  # of equal length: each in the other
    out[p] = np.maximum(out[p], best(t, j[p], s, i[p]))
    for p in np.flatnonzero(some & ~short).tolist():
        out[p] = partial_similarity(s.texts[i[p]], t.texts[j[p]])
    return out


def lost(m: np.ndarray, r: float) -> np.ndarray:
    """The most characters of a string of m that a pair of similarity r or more may fail to share, in order."""
    return np.floor(m * (2 - 2 * r) / (2 - r) + 1e-9).astype(np.int64)


def similar(a: list[str], b: list[str], threshold: float, rows: int = 64):
    """Pairs (i, j, similarity) of non-empty strings at the threshold or above, some rows of a at a time.

    All pairs are looked at, most of them by one word each: the characters that the shorter string has and the other has
    not are at least the bits that it has and the other has not.  What is left is asked for its longest common
    subsequence, and what then can reach the threshold is compared stretch by stretch.
    """
    r = threshold / 100
    known = letters(a, b)
    s, t = Strings(a, known), Strings(b, known)
    sa, sb, ma, mb = s.signs(), t.signs(), s.lengths, t.lengths
    da, db = lost(ma, r), lost(mb, r)
    low_a, low_b = np.flatnonzero(ma <= WORD), np.flatnonzero(mb <= WORD)
    marks_a, marks_b = s.marks(low_a), t.marks(low_b)
    in_a, in_b = np.searchsorted(low_a, np.arange(len(a))), np.searchsorted(low_b, np.arange(len(b)))
    for lo in range(0, len(a), rows):
        hi = min(lo + rows, len(a))
        shorter = ma[lo:hi, None] <= mb
        own = np.where(shorter, sa[lo:hi, None] & ~sb, sb & ~sa[lo:hi, None])
        i, j = np.nonzero(np.bitwise_count(own) <= np.where(shorter, da[lo:hi, None], db))
        i += lo
        first = ma[i] <= mb[j]
        stays = np.zeros(len(i), bool)
        for begin in range(0, len(i), CHUNK):
            part = np.arange(begin, min(begin + CHUNK, len(i)))
            for side, (x, y, m, ok, marks, at, other, d) in ((True, (i, j, ma, ma <= WORD, marks_a, in_a, t, da)), (False, (j, i, mb, mb <= WORD, marks_b, in_b, s, db))):
                p = part[first[part] == side]
                fits = ok[x[p]] & (other.lengths[y[p]] <= LONGEST)
                stays[p[~fits]] = True
                p = p[fits]
                if len(p):
                    size = int(other.lengths[y[p]].max())
                    stays[p] = common(marks, at[x[p]], m[x[p]], other.chars, y[p], 0, size) >= m[x[p]] - d[x[p]]
        i, j = i[stays], j[stays]
        v = ratios(s, i, t, j)
        good = v >= threshold
        yield i[good], j[good], v[good]


#: Keys, candidates or hits held at once, and slots of the filter of keys.
HELD, SLOTS = 1 << 22, 1 << 22
#: What a key, a pair, and a choice of the first two places for one beginning cost, in nanoseconds; beginnings assumed before they are known.
KEY_COST, PAIR_COST, PIECE_COST, BEGINNINGS = 130, 200, 110_000, 300
#: Rows of a side that may be compared by pairs alone, where strings are longer than a word.
ROWS = 4096


class Many(Exception):
    """More than ``HELD`` keys, candidates or hits."""


def ways(n: int, k: int, span: int) -> int:
    """Choices of k of n places that lie within ``span``."""
    return sum(comb(min(span, n - i) - 1, k - 1) for i in range(n - k + 1))


def index_cost(n: float, size: int, k: int, span: int, beginnings: int = BEGINNINGS) -> float:
    """Nanoseconds for the keys of n strings of one length."""
    pieces = sum(max(0, min(size - k + 2, i + span) - i - 1) for i in range(size - k + 1))
    return KEY_COST * n * ways(size, k, span) + PIECE_COST * pieces * beginnings


def by_index(n: float, m: int, others: dict[int, float], r: float, beginnings: int = BEGINNINGS) -> tuple[set[int], float]:
    """Lengths of the others that n strings of m characters are laid against by an index, and what all of them cost."""
    k = m - int(lost(np.array([m]), r)[0])
    pairs = {size: PAIR_COST * n * c for size, c in others.items()}
    if k < 2 or m > WORD:
        return set(), sum(pairs.values())
    span = min(m, k + m - ceil(r * m - 1e-9))
    keys = {size: index_cost(c, size, k, span, beginnings) for size, c in others.items() if size <= WORD}
    good = {size for size, c in keys.items() if c < pairs[size]}
    own = index_cost(n, m, k, m, beginnings) + sum(keys[x] for x in good)
    if own >= sum(pairs[x] for x in good):
        return set(), sum(pairs.values())
    return good, own + sum(c for x, c in pairs.items() if x not in good)


class Parts:
    """All subsequences of k characters within ``span`` of strings of one length n, those that begin with two characters at a time."""

    def __init__(self, chars: np.ndarray, rows: np.ndarray, kinds: int, k: int, span: int):
        self.chars, self.rows, n = chars[rows], rows, chars.shape[1]
        self.weights = np.array([pow(kinds, i, 1 << 63) for i in range(k)], dtype=np.uint64).view(np.int64)
        self.first, self.places = [], []
        for i in range(n - k + 1):
            for j in range(i + 1, min(n - k + 2, i + span)) if k > 1 else [i]:
                rest = np.array(list(combinations(range(j + 1, min(n, i + span)), max(k - 2, 0))), dtype=np.int64)
                if len(rest):
                    code = self.chars[:, i] * kinds + (self.chars[:, j] if k > 1 else 0)
                    order = np.argsort(code, kind="stable")
                    self.first.append((code[order], order))
                    self.places.append(rest)

    def keys(self, code: int):
        """(keys, rows) of the subsequences that begin so, some at a time."""
        for (codes, order), rest in zip(self.first, self.places, strict=True):
            lo, hi = np.searchsorted(codes, [code, code + 1])
            step = max(1, (HELD >> 3) // len(rest))
            for at in range(lo, hi, step):
                rows = order[at : min(hi, at + step)]
                own = self.chars[rows].astype(np.int64)
                key = np.zeros((len(rows), len(rest)), np.int64)
                for q in range(rest.shape[1]):
                    key += np.take(own * self.weights[q], rest[:, q], axis=1)
                yield key.reshape(-1), np.repeat(self.rows[rows], len(rest))


def candidates(x: Strings, own: np.ndarray, m: int, y: Strings, others: np.ndarray, r: float):
    """Pairs of strings own of x, all of m characters, and others of y, none shorter, that have a subsequence in common.

    A pair that reaches r shares k = m - lost(m) characters in order with a stretch.  Of a stretch, the first k of them lie
    within its length less what comes after: within k + (m less the fewest that a whole stretch must share) places.
    """
    k = m - int(lost(np.array([m]), r)[0])
    span = min(m, k + m - ceil(r * m - 1e-9))
    mine = Parts(x.chars[:, :m], own, x.kinds, k, m)
    theirs = [Parts(y.chars[:, :n], others[y.lengths[others] == n], x.kinds, k, span) for n in np.unique(y.lengths[others]).tolist()]
    for code in np.unique(np.concatenate([np.unique(c) for c, _ in mine.first])).tolist():
        parts, n = [], 0
        for their in theirs:  # they have fewer keys: these are sorted
            for part in their.keys(code):
                parts.append(part)
                n += len(part[0])
                if n > HELD:
                    raise Many
        if not parts:
            continue
        key, row = (np.concatenate(p) for p in zip(*parts, strict=True))
        order = np.argsort(key)
        key, row = key[order], row[order]
        known = np.zeros(SLOTS, bool)
        known[key & (SLOTS - 1)] = True
        for other, i in mine.keys(code):
            may = np.flatnonzero(known[other & (SLOTS - 1)])
            other, i = other[may], i[may]
            lo, hi = np.searchsorted(key, other, side="left"), np.searchsorted(key, other, side="right")
            size = hi - lo
            if size.sum() > HELD:
                raise Many
            if size.sum():
                at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
                yield np.repeat(i, size), row[at]


def by_subsequences(a: list[str], b: list[str], threshold: float):
    """As ``similar``, for many strings of at most 64 characters: by common subsequences where that is less than all pairs.

    The strings of one length that are the shorter ones are laid against all others of that length or more: either by an
    index of their subsequences, in parts if there is too much to hold, or pair by pair.  No pair is lost.
    """
    r = threshold / 100
    known = letters(a, b)
    s, t = Strings(a, known), Strings(b, known)
    signs = {id(s): s.signs(), id(t): t.signs()}

    def checked(x: Strings, own: np.ndarray, m: int, y: Strings, p: np.ndarray, q: np.ndarray, turned: bool):
        """Of candidates those that count; a pair of equal length belongs to the side by which it counts, the first if both."""
        d, marks, place = int(lost(np.array([m]), r)[0]), x.marks(own), np.searchsorted(own, p)
        stays = np.zeros(len(p), bool)
        for at in range(0, len(p), CHUNK):
            c = slice(at, at + CHUNK)
            stays[c] = common(marks, place[c], np.full(len(p[c]), m), y.chars, q[c], 0, int(y.lengths[q[c]].max())) >= m - d
        p, q = p[stays], q[stays]
        v = best(x, p, y, q)
        good = v >= threshold
        p, q, v = p[good], q[good], v[good]
        same = np.flatnonzero(y.lengths[q] == m)
        back = best(y, q[same], x, p[same])
        v[same] = np.maximum(v[same], back)
        good = np.ones(len(p), bool)
        good[same] = (back < threshold) | (not turned)
        return p[good], q[good], v[good]

    def indexed(x, own, m, y, others, turned):
        held, n, hits, found = [], 0, [], 0
        for p, q in candidates(x, own, m, y, others, r):
            held.append(p * len(y.texts) + q)
            n += len(p)
            if n > HELD >> 1:
                hits.append(flushed(held, x, own, m, y, turned))
                held, n, found = [], 0, found + len(hits[-1][0])
                if found > HELD:
                    raise Many
        hits.append(flushed(held, x, own, m, y, turned))
        pair, v = (np.concatenate(z) for z in zip(*hits, strict=True))
        pair, at = np.unique(pair, return_index=True)
        return pair // len(y.texts), pair % len(y.texts), v[at]

    def flushed(held, x, own, m, y, turned):
        pair = np.unique(np.concatenate(held)) if held else np.zeros(0, np.int64)
        p, q, v = checked(x, own, m, y, pair // len(y.texts), pair % len(y.texts), turned)
        return p * len(y.texts) + q, v

    def paired(x, own, m, y, others, turned):
        d, step = int(lost(np.array([m]), r)[0]), max(1, (HELD >> 2) // len(others))
        for at in range(0, len(own), step):
            rows = own[at : at + step]
            p, q = np.nonzero(np.bitwise_count(signs[id(x)][rows][:, None] & ~signs[id(y)][others]) <= d)
            yield checked(x, rows, m, y, rows[p], others[q], turned)

    def of_length(x, own, m, y, others, turned):
        todo = [(own, others)]
        while todo:
            mine, theirs = todo.pop()
            sizes, counts = np.unique(y.lengths[theirs], return_counts=True)
            good, _ = by_index(len(mine), m, dict(zip(sizes.tolist(), counts.tolist(), strict=True)), r, x.kinds**2)
            some = np.isin(y.lengths[theirs], sorted(good))
            rest, theirs = theirs[~some], theirs[some]
            if len(rest):
                yield from paired(x, mine, m, y, rest, turned)
            if len(theirs):
                try:
                    yield indexed(x, mine, m, y, theirs, turned)
                except Many:  # in halves, at last pair by pair
                    half, half2 = (len(mine) + 1) // 2, (len(theirs) + 1) // 2
                    todo += [(i, j) for i in (mine[:half], mine[half:]) for j in (theirs[:half2], theirs[half2:]) if len(i) and len(j)]

    for x, y, turned in ((s, t, False), (t, s, True)):
        for m in np.unique(x.lengths).tolist():
            own, others = np.flatnonzero(x.lengths == m), np.flatnonzero(y.lengths >= m)
            if m and len(others):
                for p, q, v in of_length(x, own, m, y, others, turned):
                    yield (q, p, v) if turned else (p, q, v)


def all_similar(a: list[str], b: list[str], threshold: float):
    """As ``similar``, however many strings: those over 64 characters by pairs, in blocks, the others also by subsequences."""
    parts = []
    for x in (a, b):
        size = np.fromiter(map(len, x), np.int64, len(x))
        long = np.flatnonzero(size > WORD)
        parts.append([np.flatnonzero(size <= WORD), *(long[i : i + ROWS] for i in range(0, len(long), ROWS))])
    for k, i in enumerate(parts[0]):
        for h, j in enumerate(parts[1]):
            if not len(i) or not len(j):
                continue
            if not k and not h:
                yield from ((i[p], j[q], v) for p, q, v in by_subsequences([a[p] for p in i.tolist()], [b[q] for q in j.tolist()], threshold))
                continue
            for lo in range(0, len(i), ROWS):
                for lo2 in range(0, len(j), ROWS):
                    own, other = i[lo : lo + ROWS], j[lo2 : lo2 + ROWS]
                    yield from ((own[p], other[q], v) for p, q, v in similar([a[p] for p in own.tolist()], [b[q] for q in other.tolist()], threshold))


def cost_of_cell(a: dict[int, float], b: dict[int, float], threshold: float) -> float:
    """Nanoseconds that ``all_similar`` is expected to take for so many strings of each length."""
    r, out = threshold / 100, 0.0
    for x, y in ((a, b), (b, a)):
        for m, n in x.items():
            out += by_index(n, m, {size: c for size, c in y.items() if size >= m}, r)[1]
    return out
