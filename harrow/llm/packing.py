"""Best-fit packing of documents into token sequences of bounded length.

Lengths are integers from 1 to the capacity, so the whole packing is decided on the histogram of lengths (at most
``capacity`` rows, whatever the corpus): large items, above a third of the capacity, are matched greedily in pairs, at
most two to a bin; smaller items then go, longest first, to the fullest bin that still takes them.  Equal bins are
handled together.  The plan is a list of runs "items number a to b of length s go k to a bin, from bin x on, at offset
o"; each item finds its run by its length and its number among the items of that length.  Those numbers are given in
salted groups whose counts are summed beforehand, so that no length, however common, meets in one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, map_columns

CAPACITY = 2048
END_ID = 0
SALTS = 256


class Encoder:
    """Ids as the tokenizers library gives them; a faster library with the same ranks where both surely agree.

    The rank library is used for texts of ASCII and Latin letters only (code points below U+0250, where the split
    patterns of both libraries were compared one by one in the tests); any other text, and any text with the string
    of a special token, goes to the tokenizers library itself.
    """

    def __init__(self, path: str):
        import json
        import os

        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.lib = Tokenizer.from_file(path)
        self.lib.no_padding()
        self.lib.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        from .bpe import byte_symbols

        byte = {s: b for b, s in enumerate(byte_symbols())}
        self.added = [x["content"] for x in spec["added_tokens"]]
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.added}
        # The byte-level pre-tokenizer's own pattern.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if text.isascii() or max(text) < "ɐ":
            if not any(x in text for x in self.added):
                return self.fast.encode_ordinary(text)
        return self.lib.encode(text, add_special_tokens=False).ids


@lru_cache(maxsize=2)
def shared_encoder(path: str) -> Encoder:
    """One encoder for all tasks of a worker process."""
    return Encoder(path)


def make_pieces(path: str, capacity: int, with_ids: bool):
    enc = shared_encoder(path)

    def run(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
        for doc_id, text in zip(cols["doc_id"], cols["text"], strict=True):
            ids = np.array([*enc.encode(text or ""), END_ID], dtype="<u4")
            first = len(ids) % capacity or capacity
            at = 0
            for piece, end in enumerate(range(first, len(ids) + 1, capacity)):
                own = ids[at:end]
                out["doc_id"].append(doc_id)
                out["piece"].append(piece)
                out["start"].append(at)
                out["length"].append(len(own))
                out["ids_crc32"].append(zlib.crc32(own.tobytes()))
                out["ids"].append(own.astype("int32") if with_ids else None)
                at = end
        return out

    return run


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first item, items, items a bin, first bin, offset) for a histogram of lengths."""
    left = {s: n for s, n in counts.items() if n > 0}
    groups: list[list] = []  # [bins, used, [(length, first item, items a bin, offset)]]
    taken: dict[int, int] = defaultdict(int)

    def take(s: int, n: int) -> int:
        first = taken[s]
        taken[s] += n
        left[s] -= n
        if not left[s]:
            del left[s]
        return first

    large = sorted(s for s in left if 3 * s > capacity)
    while large:  # the longest with the longest that still fits beside it
        a = large[-1]
        at = bisect_left(large, capacity - a + 1) - 1
        if at < 0:
            n = left[a]
            groups.append([n, a, [(a, take(a, n), 1, 0)]])
        else:
            b = large[at]
            n = left[a] // 2 if a == b else min(left[a], left[b])
            if a == b and not n:
                groups.append([1, a, [(a, take(a, 1), 1, 0)]])
            elif a == b:
                groups.append([n, 2 * a, [(a, take(a, 2 * n), 2, 0)]])
            else:
                groups.append([n, a + b, [(a, take(a, n), 1, 0), (b, take(b, n), 1, a)]])
        large = [s for s in large if s in left]
    by_gap: dict[int, list[list]] = defaultdict(list)
    gaps: list[int] = []

    def put(group: list) -> None:
        gap = capacity - group[1]
        if gap not in by_gap or not by_gap[gap]:
            insort(gaps, gap)
        by_gap[gap].append(group)

    for g in groups:
        put(g)
    done: list[list] = []

    def split(group: list, n: int) -> list:
        """Take the first n bins of a group away from it."""
        head = [n, group[1], list(group[2])]
        group[0] -= n
        group[2] = [(s, first + n * k, k, off) for s, first, k, off in group[2]]
        return head

    for s in sorted(left, reverse=True):
        while s in left:
            at = bisect_left(gaps, s)
            if at == len(gaps):  # no bin takes it: new bins, as many to a bin as fit
                k = min(capacity // s, left[s])
                n = left[s] // k
                put([n, k * s, [(s, take(s, n * k), k, 0)]])
                continue
            gap = gaps[at]
            group = by_gap[gap][-1]
            k = min(gap // s, left[s])
            n = min(group[0], left[s] // k)
            head = split(group, n)
            if not group[0]:
                by_gap[gap].pop()
                if not by_gap[gap]:
                    gaps.pop(at)
            head[2].append((s, take(s, n * k), k, head[1]))
            head[1] += k * s
            put(head)
    done += [g for rest in by_gap.values() for g in rest]
    runs, base = [], 0
    for n, _, items in sorted(done, key=lambda g: (-g[1], g[2])):
        runs += [(s, first, n * k, k, base, off) for s, first, k, off in items]
        base += n
    return runs


def pack_documents(
    docs: DataFrame, path: str, *, capacity: int = CAPACITY, salts: int = SALTS, with_ids: bool = False
) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for).

    Null text counts as empty: one piece holding only the end id.  Null doc_id stays null; repeated rows are packed
    each on its own; other columns are ignored; an empty table gives an empty one.  Sequences are gapless from
    offset 0 and never longer than ``capacity``.
    """
    spark = docs.sparkSession
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>"
    pieces = map_columns(docs.select("doc_id", "text"), schema, make_pieces, path, capacity, with_ids)
    pieces = pieces if with_ids else pieces.drop("ids")
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int")
    pieces = cut(pieces.withColumn("salt", salt))
    sizes = pieces.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut(sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))))
    # At most one row for each length up to the capacity comes to the driver.
    counts = {r.length: r.n for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = spark.createDataFrame(
        plan_bins(counts, capacity), "length long, first long, items long, per long, base long, off long"
    )
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    numbered = (
        pieces.withColumn("rn", F.row_number().over(own))
        .join(sizes.select("length", "salt", "before"), ["length", "salt"])
        .withColumn("no", F.col("before") + F.col("rn") - 1)
    )
    # The plan has a few runs for each length: its size is bounded by the capacity, not by the corpus.
    placed = numbered.join(
        F.broadcast(runs.withColumnRenamed("length", "run_length")),
        (F.col("length") == F.col("run_length"))
        & (F.col("no") >= F.col("first"))
        & (F.col("no") < F.col("first") + F.col("items")),
    )
    rel = F.col("no") - F.col("first")
    out = placed.withColumn("sequence_id", F.col("base") + F.expr("(no - first) div per")).withColumn(
        "offset", F.col("off") + F.pmod(rel, F.col("per")) * F.col("length")
    )
    keep = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return out.select(*keep, *(["ids"] if with_ids else []))
