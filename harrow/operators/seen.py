"""A set of keys that only grows: parts are written once, and a lookup shuffles little more than it asks for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, discard

#: A filter has at most 2**26 bits, 8 MB in bitmaps of 4 KB: a fixed bound, so it may be broadcast.
FILTER_BITS = 1 << 26
BITMAP_BITS = 1 << 15
#: Sets up to this many keys are joined without a filter.
SMALL = 200_000
#: So many parts of one tier become one part of the next, so that plans stay short.
FANOUT = 12


class SeenSet:
    """Keys seen so far, over the columns ``keys``; nulls are keys like any other value.

    ``add`` takes a frame that is written already (``cut``) and keeps it as a part; nothing is rewritten but for merging
    parts of one tier, so what is written grows with the new keys (times the logarithm of the number of parts).
    """

    def __init__(self, *keys: str):
        self.keys, self.parts, self.size = list(keys), [], 0

    def add(self, new: DataFrame, n: int, own: bool = False) -> None:
        """``n``: rows of ``new``.  ``own``: whether the files of ``new`` belong to the set alone."""
        self.size += n
        self.parts.append((0, new.select(*self.keys), new if own else None))
        while len(self.parts) >= FANOUT and len({t for t, _, _ in self.parts[-FANOUT:]}) == 1:
            last, self.parts = self.parts[-FANOUT:], self.parts[:-FANOUT]
            merged = cut(reduce(DataFrame.unionByName, [p for _, p, _ in last]))
            discard(*[f for _, _, f in last if f is not None])
            self.parts.append((last[0][0] + 1, merged, merged))

    def unseen(self, rows: DataFrame) -> DataFrame:
        """Rows whose key is not in the set.

        Of a large set only keys that may be among those of ``rows`` are shuffled: a bitmap of the hashes of the rows' keys
        goes to the parts, which drop what cannot match before the join.
        """
        if not self.parts:
            return rows
        known = reduce(DataFrame.unionByName, [p for _, p, _ in self.parts])
        if self.size > SMALL:
            known = maybe(known, rows, self.keys)
        match = reduce(Column.__and__, [rows[k].eqNullSafe(known[k]) for k in self.keys])
        return rows.join(known, match, "left_anti")


def hashed(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(FILTER_BITS))


def maybe(known: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Those of ``known`` whose hash is one of the rows' hashes: all that are equal to a row, and few others."""
    h = hashed(keys)
    bits = rows.select(h.alias("h")).groupBy(F.floor(F.col("h") / BITMAP_BITS).alias("harrow_bucket")).agg(F.bitmap_construct_agg(F.col("h") % BITMAP_BITS).alias("harrow_bits"))
    at = h % BITMAP_BITS
    byte = F.conv(F.hex(F.substring("harrow_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(1) == 1
    found = known.withColumn("harrow_bucket", F.floor(h / BITMAP_BITS)).join(F.broadcast(bits), "harrow_bucket").where(hit)
    return found.select(*keys)
