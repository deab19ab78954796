"""External induced sorting of aligned strings, with common-prefix values.

Strings are laid side by side so that equal windows have equal places.  Sorting runs from right to left: the tuples
(string, common prefix with its predecessor) of the suffixes at place x + 1, in order, are pushed into a priority queue
under the character at place x, which the suffix at x puts in front.  Popping the queue, by character and within it in
order of arrival, gives the suffixes at x in order.  The common prefix of two neighbours under one character is one
more than the least value between them in the source, so the values are carried through the induction as well; no
text is compared.  The step then recurs one place further left, on the induced order.  Strings that end early
enter as empty suffixes at their end, as the smallest ones.

The queue's priorities are bytes, so it is 256 first-in, first-out lanes.  A block of tuples at a time is in memory;
what the lanes hold goes to a spool file on disk once it exceeds the block, as does the text.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np


def range_minima(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Least of values[first..last] for each query, by a sparse table."""
    if not len(first):
        return values[:0]
    width = last - first + 1
    level = np.frexp(width.astype(np.float64))[1] - 1
    out = np.empty(len(first), dtype=values.dtype)
    table, size = values, 1
    for k in range(int(level.max()) + 1):
        if k:
            table = np.minimum(table[:-size], table[size:])
            size *= 2
        own = np.flatnonzero(level == k)
        if len(own):
            out[own] = np.minimum(table[first[own]], table[last[own] - size + 1])
    return out


class LaneQueue:
    """Priority queue over byte priorities, first in, first out within one; spools to disk beyond ``block`` tuples."""

    def __init__(self, block: int):
        self.block, self.runs, self.spool, self.size = block, [], None, 0
        self.carry = np.full(256, -1, dtype=np.int32)  # least value since a lane's last tuple; -1: the lane is empty

    def push(self, chars: np.ndarray, ids: np.ndarray, lcp: np.ndarray) -> None:
        """Tuples in order of their source, with the character that each puts in front."""
        n = len(ids)
        perm = np.argsort(chars, kind="stable")
        keys = chars[perm]
        new = np.empty(n, dtype=np.int32)
        same = np.flatnonzero(keys[1:] == keys[:-1]) + 1
        new[same] = range_minima(lcp, perm[same - 1] + 1, perm[same]) + 1
        heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        lanes, tails = keys[heads], np.r_[heads[1:], n] - 1
        before = np.minimum.accumulate(lcp)[perm[heads]]
        new[heads] = np.where(self.carry[lanes] < 0, 0, np.minimum(self.carry[lanes], before) + 1)
        after = np.r_[np.minimum.accumulate(lcp[::-1])[::-1], np.iinfo(np.int32).max][perm[tails] + 1]
        held = self.carry >= 0
        self.carry[held] = np.minimum(self.carry[held], lcp.min())
        self.carry[lanes] = after
        bounds = np.searchsorted(keys, np.arange(257))
        self.size += n
        ids = ids[perm]
        if self.spool is not None or self.size > self.block:
            self.to_disk(bounds, ids, new)
        else:
            self.runs.append((bounds, ids, new))

    def to_disk(self, bounds: np.ndarray, ids: np.ndarray, lcp: np.ndarray) -> None:
        if self.spool is None:
            self.spool = tempfile.TemporaryFile(prefix="harrow-lanes-")  # noqa: SIM115  closed by pop
            held, self.runs = self.runs, []
            for run in held:
                self.to_disk(*run)
        at = self.spool.seek(0, 2)
        self.spool.write(np.stack([ids.astype(np.int32), lcp.astype(np.int32)], axis=1).tobytes())
        self.runs.append((bounds, at, len(ids)))

    def pop(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All tuples in order, in blocks."""
        if self.spool is None:
            if len(self.runs) > 1:
                lanes = np.concatenate([np.repeat(np.arange(256, dtype=np.uint8), np.diff(b)) for b, _, _ in self.runs])
                order = np.argsort(lanes, kind="stable")
                yield tuple(np.concatenate([run[i] for run in self.runs])[order] for i in (1, 2))
            elif self.runs:
                yield self.runs[0][1:]
            return
        parts, held = [], 0
        for lane in range(256):
            for bounds, at, _ in self.runs:
                lo, hi = int(bounds[lane]), int(bounds[lane + 1])
                for a in range(lo, hi, self.block):
                    b = min(hi, a + self.block)
                    self.spool.seek(at + 8 * a)
                    part = np.frombuffer(self.spool.read(8 * (b - a)), dtype=np.int32).reshape(-1, 2)
                    parts.append(part)
                    held += len(part)
                    if held >= self.block:
                        whole = np.concatenate(parts)
                        yield whole[:, 0].copy(), whole[:, 1].copy()
                        parts, held = [], 0
        if parts:
            whole = np.concatenate(parts)
            yield whole[:, 0].copy(), whole[:, 1].copy()

    def close(self) -> None:
        self.runs = []
        if self.spool is not None:
            self.spool.close()


class Strings:
    """Aligned strings, a column for each place; on disk beyond ``most_bytes``."""

    def __init__(self, width: int, rows: list[tuple[int, bytes]], most_bytes: int = 96 << 20):
        n = len(rows)
        self.lo = np.fromiter((at for at, _ in rows), dtype=np.int32, count=n)
        self.hi = self.lo + np.fromiter((len(s) for _, s in rows), dtype=np.int32, count=n)
        self.file = None
        if width * n > most_bytes:
            self.file = tempfile.TemporaryFile(prefix="harrow-text-")  # noqa: SIM115  closed by close
            self.columns = np.memmap(self.file, dtype=np.uint8, mode="w+", shape=(width, n))
        else:
            self.columns = np.empty((width, n), dtype=np.uint8)
        step = 4096
        for a in range(0, n, step):
            part = b"".join(b"\0" * at + s + b"\0" * (width - at - len(s)) for at, s in rows[a : a + step])
            self.columns[:, a : a + step] = np.frombuffer(part, dtype=np.uint8).reshape(-1, width).T

    def close(self) -> None:
        del self.columns
        if self.file:
            self.file.close()


def repeated_windows(width: int, window: int, last_start: int, rows: list[tuple[int, bytes]], block: int = 1 << 18):
    """(string, first start, last start) of each run of starts whose windows another string has at the same place.

    ``rows``: (place of the first byte, bytes).  Windows start at places 0 to ``last_start``.
    """
    text = Strings(width, rows)
    n = len(rows)
    queue = LaneQueue(block)
    ends = np.argsort(-text.hi, kind="stable").astype(np.int32)
    ending = text.hi[ends]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    opened = np.full(n, -1, dtype=np.int32)
    taken = 0
    for x in range(width - 1, -1, -1):
        upto = int(np.searchsorted(-ending, -(x + 1), side="right"))
        seeds, taken = ends[taken:upto], upto
        source = queue
        queue = LaneQueue(block)
        column = text.columns[x]
        for a in range(0, len(seeds), block):
            own = seeds[a : a + block]
            queue.push(column[own], own, np.zeros(len(own), dtype=np.int32))
        hit = np.zeros(n, dtype=bool) if x <= last_start else None
        for ids, lcp in with_next(source.pop()):
            lcp, after = lcp[:-1], lcp[-1]
            if x < last_start:  # what can no longer reach a window, or has no more text, leaves the queue
                best = np.maximum(lcp, np.r_[lcp[1:], after])
                keep = np.flatnonzero((best >= window - (x + 1)) & (text.lo[ids] <= x))
                if len(keep) < len(ids):
                    if not len(keep):
                        queue.carry = np.where(queue.carry < 0, -1, np.minimum(queue.carry, lcp.min())).astype(np.int32)
                        continue
                    tail = lcp[keep[-1] + 1 :]
                    lcp = np.minimum.reduceat(lcp[: keep[-1] + 1], np.r_[0, keep[:-1] + 1])
                    ids = ids[keep]
                else:
                    tail = lcp[:0]
                queue.push(column[ids], ids, lcp)
                if len(tail):
                    queue.carry = np.where(queue.carry < 0, -1, np.minimum(queue.carry, tail.min())).astype(np.int32)
            else:
                queue.push(column[ids], ids, lcp)
        source.close()
        if hit is None:
            continue
        if x == last_start or queue.size:
            mark(queue, hit, window)
        live = opened >= 0
        start = hit & ~live
        opened[start] = x
        stop = np.flatnonzero(live & ~hit)
        if len(stop):
            found.append((stop, np.full(len(stop), x + 1), opened[stop]))
            opened[stop] = -1
        if not queue.size and taken == n and not hit.any():
            break
    stop = np.flatnonzero(opened >= 0)
    found.append((stop, np.zeros(len(stop), dtype=np.int64), opened[stop]))
    queue.close()
    text.close()
    return tuple(np.concatenate([f[i] for f in found]).astype(np.int64) for i in range(3))


def with_next(blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each block, its values followed by the first value of the next one (0 after the last)."""
    held = None
    for ids, lcp in blocks:
        if not len(ids):
            continue
        if held is not None:
            yield held[0], np.r_[held[1], lcp[0]]
        held = ids, lcp
    if held is not None:
        yield held[0], np.r_[held[1], 0]


def mark(queue: LaneQueue, hit: np.ndarray, window: int) -> None:
    """Note the strings whose neighbour shares a window."""
    for ids, lcp in with_next(queue.pop()):
        hit[ids[np.maximum(lcp[:-1], lcp[1:]) >= window]] = True
