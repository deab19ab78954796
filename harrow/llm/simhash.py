"""SimHash near-duplicates: word shingles to 64-bit fingerprints, linked at a few differing bits.

Distinct fingerprints are dealt into buckets by bands of bits: if at most ``radius`` bits differ, one of
``radius + 1`` bands is equal, so no link is lost.  Large buckets are dealt again by bands of the remaining bits (the
same argument holds within a bucket), and what is still large is compared in blocks against blocks, each pair of blocks
in a task of its own.  Within a bucket, a table of Hamming distances to reference fingerprints (pivots) is precomputed;
by the triangle inequality a pair whose coordinates differ by more than ``radius`` anywhere is discarded, and only the
survivors are verified.  A bucket passes on a spanning forest of its links, never all pairs, and components are found
by distributed stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, map_columns
from .graph import components

SEED = 42
RADIUS = 3
SHINGLE = 3
PIVOTS = 24
#: Fingerprints of a bucket that are compared at once; larger buckets are split.
BLOCK = 512

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str, width: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a text's shingles, repeats included; 0 without words."""
    from xxhash import xxh64_intdigest

    words = text.encode().translate(LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    if len(words) <= width:
        shingles = [b" ".join(words)]
    elif width == 3:
        shingles = [b"%b %b %b" % x for x in zip(words, words[1:], words[2:], strict=False)]
    else:
        shingles = [b" ".join(words[i : i + width]) for i in range(n)]
    h = np.fromiter((xxh64_intdigest(s, seed) for s in shingles), dtype=np.uint64, count=n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 14):
        bits = np.unpackbits(h[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    out = 0
    for b in 2 * ones > n:
        out = out << 1 | int(b)
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def make(width: int, seed: int):
    def run(cols: dict[str, list]) -> dict[str, list]:
        return cols | {"fp": [signed(fingerprint(t or "", width, seed)) for t in cols["text"]]}

    return run


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints, the same everywhere."""
    return np.random.default_rng(11).integers(0, 1 << 64, n, dtype=np.uint64)


def forest(fps: np.ndarray, first: int, refs: np.ndarray, radius: int) -> np.ndarray:
    """Label of each fingerprint within one group: equal for those joined by links.

    Pairs are compared row against later rows; if ``first`` is positive the group is two blocks, and only pairs across
    them count.
    """
    n = len(fps)
    label = np.arange(n)
    table = np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int8)  # the pivot distance table
    order = np.argsort(table[:, 0], kind="stable")
    near = []
    # Sorted by the first coordinate, partners of a row lie in a window of that coordinate.
    reach = np.searchsorted(table[order, 0], table[order, 0] + radius, side="right")
    for i in range(n - 1):
        j = order[i + 1 : reach[i]]
        if not len(j):
            continue
        a = order[i]
        if first:
            j = j[(j < first) != (a < first)]
        j = j[np.abs(table[j] - table[a]).max(axis=1, initial=0) <= radius]
        j = j[np.bitwise_count(fps[j] ^ fps[a]) <= radius]
        if len(j):
            near.append(np.stack([np.full(len(j), a), j]))
    if not near:
        return label
    a, b = np.concatenate(near, axis=1)
    while True:  # smallest label over links, with jumps, until nothing changes
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def small_groups(keys: np.ndarray, fps: np.ndarray, refs: np.ndarray, radius: int):
    """Links of many small groups at once: pairs at each distance within the runs of equal keys."""
    src, dst = [], []
    step = 1
    table = np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int8)
    alive = np.arange(len(fps) - 1)
    while len(alive):
        alive = alive[alive + step < len(fps)]
        alive = alive[keys[alive] == keys[alive + step]]
        a, b = alive, alive + step
        near = np.abs(table[a] - table[b]).max(axis=1, initial=0) <= radius
        a, b = a[near], b[near]
        ok = np.bitwise_count(fps[a] ^ fps[b]) <= radius
        src.append(fps[a[ok]])
        dst.append(fps[b[ok]])
        step += 1
    return src, dst


def bucket_links(radius: int, n_pivots: int):
    """Over rows sorted by (key, side): a spanning forest of each group's links."""
    refs = pivots(n_pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        names = ["src", "dst"]

        def work(keys: np.ndarray, sides: np.ndarray, fps: np.ndarray):
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            ends = np.r_[starts[1:], len(keys)]
            sizes = ends - starts
            big = (sizes > 24) | (sides[starts] != sides[ends - 1])
            small = np.repeat(~big, sizes)
            src, dst = small_groups(keys[small], fps[small], refs, radius) if small.any() else ([], [])
            for lo, hi in zip(starts[big], ends[big], strict=True):
                own = fps[lo:hi]
                first = int((sides[lo:hi] == sides[lo]).sum())
                label = forest(own, first if first < len(own) else 0, refs, radius)
                moved = label != np.arange(len(own))
                src.append(own[moved])
                dst.append(own[label[moved]])
            if src:
                a, b = np.concatenate(src).view(np.int64), np.concatenate(dst).view(np.int64)
                return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=names)
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if held[0].column(0)[0] == batch.column(0)[batch.num_rows - 1]:
                continue  # one group so far
            t = pa.Table.from_batches(held).combine_chunks()
            keys = t.column(0).to_numpy()
            cut_at = int(np.argmax(keys == keys[-1]))
            out = t.slice(0, cut_at)
            held = t.slice(cut_at).to_batches()
            yield work(*(out.column(i).to_numpy() for i in range(2)), out.column(2).to_numpy().view(np.uint64))
        if held:
            t = pa.Table.from_batches(held)
            yield work(*(t.column(i).to_numpy() for i in range(2)), t.column(2).to_numpy().view(np.uint64))

    return run


def bands(total: int, parts: int) -> list[tuple[int, int]]:
    """(shift, width) of each band of ``total`` bits."""
    edges = [total * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def band_key(col, which: int, radius: int):
    shift, width = bands(64, radius + 1)[which]
    return F.shiftrightunsigned(col, shift).bitwiseAND((1 << width) - 1)


def sub_keys(radius: int):
    """For a row with band ``b``: keys over bands of the bits outside it."""
    outer = bands(64, radius + 1)
    choices = []
    for which, (shift, width) in enumerate(outer):
        low = F.col("fp").bitwiseAND((1 << shift) - 1) if shift else F.lit(0).cast("long")
        high = F.shiftrightunsigned(F.col("fp"), shift + width) if shift + width < 64 else F.lit(0).cast("long")
        rest = F.shiftleft(high, shift).bitwiseOR(low)
        inner = bands(64 - width, radius + 1)
        keys = [F.xxhash64(F.col("key"), F.lit(k), F.shiftrightunsigned(rest, s).bitwiseAND((1 << w) - 1)) for k, (s, w) in enumerate(inner)]
        choices.append((which, F.array(*keys)))
    out = choices[-1][1]
    for which, keys in choices[:-1]:
        out = F.when(F.col("band") == which, keys).otherwise(out)
    return out


def links(fps: DataFrame, *, radius: int = RADIUS, n_pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """(src, dst): a spanning forest of the links among the distinct fingerprints in column fp."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("band"), band_key(F.col("fp"), i, radius).alias("v")) for i in range(radius + 1)]))
    rows = fps.select("fp", each.alias("x")).select("fp", "x.band", F.xxhash64("x.band", "x.v").alias("key"))
    counts = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rows = cut(rows.join(counts, "key"))
    fine = rows.where(F.col("n") > block).select("fp", F.explode(sub_keys(radius)).alias("key"))
    fine_counts = fine.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.where(F.col("n") <= block).select("fp", "key", "n").unionByName(fine.join(fine_counts, "key").select("fp", "key", "n"))
    # Still larger ones: rows of block i meet those of every block, each pair of blocks under a key of its own.
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(5)), blocks.cast("long")).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("own", own)
    rows = rows.withColumn("other", F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
    pair = F.when(F.col("blocks") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
    side = F.when(F.col("blocks") == 1, F.lit(0)).otherwise(F.col("own"))
    dealt = rows.select(pair.alias("key"), side.alias("side"), "fp").repartition("key").sortWithinPartitions("key", "side")
    return dealt.mapInArrow(bucket_links(radius, n_pivots), "src long, dst long")


def near_duplicates(docs: DataFrame, *, width: int = SHINGLE, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links): a row per input row.

    Null and wordless texts have fingerprint zero, which links like any other; a null doc_id gets the component of its
    fingerprint and counts as no doc_id when the smallest is taken.  Repeated rows and other columns change nothing.

    An empty table gives no rows; a very long text has one fingerprint like any other.
    """
    fp = cut(map_columns(docs.select("doc_id", "text"), "doc_id long, fp long", make, width, seed))
    return fp.join(classes(fp, radius), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def classes(fp: DataFrame, radius: int) -> DataFrame:
    """(fp, root, component_id) of every distinct fingerprint."""
    least = cut(fp.groupBy("fp").agg(F.min("doc_id").alias("low")))
    comp = components(links(least.select("fp"), radius=radius))
    own = least.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    low = own.groupBy("root").agg(F.min("low").alias("component_id"))
    return own.select("fp", "root").join(low, "root")


def keep_one(docs: DataFrame, *, width: int = SHINGLE, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """One row of each group of near duplicates, all columns: that of the smallest doc_id, then of the smallest text hash.

    Rows without doc_id come last; of rows equal in doc_id and text one stays.
    """
    text_key = F.xxhash64(F.coalesce("text", F.lit("")))
    slim = docs.select("doc_id", "text", text_key.alias("text_key"))
    fp = cut(map_columns(slim, "doc_id long, text_key long, fp long", make, width, seed))
    return keep_first(docs, fp.join(classes(fp, radius), "fp"))


def keep_first(docs: DataFrame, own: DataFrame) -> DataFrame:
    """The row of each root that comes first; ``own`` has doc_id, text_key and root of every row."""
    first = own.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("x"))
    first = first.select(F.col("x.doc_id").alias("keep_id"), F.col("x.text_key").alias("keep_key"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))  # in one column: no name can clash
    rows = rows.withColumn("key", F.xxhash64(F.coalesce("row.text", F.lit(""))))
    kept = rows.join(first, F.col("row.doc_id").eqNullSafe(F.col("keep_id")) & (F.col("key") == F.col("keep_key")))
    rank = Window.partitionBy("keep_id", "keep_key").orderBy(F.xxhash64("row"))
    return kept.withColumn("rank", F.row_number().over(rank)).where("rank = 1").select("row.*")
