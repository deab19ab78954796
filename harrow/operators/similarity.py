"""Similarity joins: pairs of strings whose partial similarity reaches a threshold, all pairs, in cells of bounded size.

Both sides are dealt into blocks by hash, and every block of one meets every block of the other in a cell of its own: a
cell has so many rows whatever the strings are, so none is larger for a common letter or name.  Within a cell the strings of
one length are laid against the others by an index of their common subsequences, or where all pairs cost less, nearly all
of them are ruled out by a word of 64 bits for each string (``alike.all_similar``); what is left is compared exactly.  No
pair that counts is lost.  The pairs that count may grow with the product of both sides, by nature of the job.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import alike, scoring, urls
from ..runtime import cut

#: Rows of a block, and below which number of rows more blocks do not pay.
BLOCK, LEAST = 4096, 256
#: Rows at most of a block of each side where subsequences are indexed.
MOST = (1 << 16, 1 << 18)
#: Tasks at most that cells are dealt to.
TASKS = 8192


def compare(threshold: float):
    """Over rows (cell, side, name, p, q, less) sorted by cell: names of both sides with their score, at the threshold or above.

    The score is the best similarity of p of side 0 to p or q of side 1, less what side 1 has as ``less``.
    """

    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        side = rows.column(1).to_numpy()
        left, right = rows.filter(pa.array(side == 0)), rows.filter(pa.array(side == 1))
        if not left.num_rows or not right.num_rows:
            return
        a, of_a = np.unique(left.column(3).to_numpy(zero_copy_only=False).astype(object), return_inverse=True)
        p, q = (right.column(k).to_pylist() for k in (3, 4))
        parts = [(x, k, 0) for k, x in enumerate(p) if x] + [(x, k, 1) for k, x in enumerate(q) if x and x != p[k]]
        b, of_b = np.unique(np.array([x for x, _, _ in parts], dtype=object), return_inverse=True)
        host, side, less = np.array([k for _, k, _ in parts], np.int64), np.array([k for _, _, k in parts], np.int64), right.column(5).to_numpy()
        parts_of = np.full((2, right.num_rows), -1)
        parts_of[side, host] = of_b
        by_a, by_b = np.argsort(of_a, kind="stable"), np.argsort(of_b, kind="stable")
        first_a, first_b = np.searchsorted(of_a[by_a], np.arange(len(a) + 1)), np.searchsorted(of_b[by_b], np.arange(len(b) + 1))
        a, b, every = a.tolist(), b.tolist(), []

        def other_parts(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            if not every:
                known = alike.letters(a, b)
                every.extend((alike.Strings(a, known), alike.Strings(b, known)))
            return alike.ratios(every[0], i, every[1], j)

        def found() -> Iterator[tuple]:
            for x in np.unique(less).tolist():  # what is taken off a host's score raises what its parts must reach
                own, bound = np.unique(of_b[less[host] == x]), threshold + x - (1e-9 if x else 0)
                if len(own) and bound <= 100:
                    for i, j, v in alike.all_similar(a, [b[k] for k in own.tolist()], bound):
                        pair, at = spread(first_b, own[j])
                        at = by_b[at]
                        same = less[host[at]] == x
                        yield host[at[same]], side[at[same]], i[pair[same]], v[pair[same]], bound

        for h, k, i, v, bound in found():
            beside = parts_of[1 - k, h]
            two = np.flatnonzero(beside >= 0)
            v_beside = other_parts(i[two], beside[two]) if len(two) else np.zeros(0)
            v[two] = np.maximum(v[two], v_beside)
            score = np.maximum(0.0, v - less[h])
            good = score >= threshold
            good[two] &= (k[two] == 0) | (v_beside < bound)  # a host found by both parts comes with the first
            pair, at = spread(first_a, i[good])
            yield pa.RecordBatch.from_arrays(
                [left.column(2).take(pa.array(by_a[at])).combine_chunks(), right.column(2).take(pa.array(h[good][pair])).combine_chunks(), pa.array(score[good][pair])],
                names=["name", "other", "score"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            cells = batch.column(0).to_numpy()
            edges = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1], True]) if len(cells) else []
            for lo, hi in zip(edges, edges[1:], strict=False):
                if held and held[0].column(0)[0].as_py() != cells[lo]:
                    yield from work(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from work(pa.Table.from_batches(held))

    return run


def spread(first: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each j all places from first[j] to first[j + 1]: which of j, and the place."""
    n = first[j + 1] - first[j]
    pair = np.repeat(np.arange(len(j)), n)
    return pair, np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n) + first[j][pair]


def blocks(left: DataFrame, right: DataFrame, threshold: float, least: int) -> tuple[int, int]:
    """Numbers of blocks of both sides: of ``BLOCK`` rows, or of more where an index of subsequences then makes up for it."""
    n, m = left.count(), right.count()
    small = tuple(max(math.ceil(x / BLOCK), min(least, math.ceil(x / LEAST)), 1) for x in (n, m))
    if n * m <= BLOCK * BLOCK * least:
        return small
    na = max(math.ceil(n / MOST[0]), min(2 * least, math.ceil(math.sqrt(4 * least * n / m))))
    large = na, max(math.ceil(m / MOST[1]), math.ceil(2 * least / na))
    rows = right.withColumn("part", F.explode(F.array_distinct(F.array(F.coalesce("p", F.lit("")), F.coalesce("q", F.lit(""))))))
    own = {x.m: x.n for x in left.groupBy(F.length("p").alias("m")).agg(F.count("*").alias("n")).collect() if x.m}
    others: dict[float, dict[int, int]] = {}
    for x in rows.where("part != ''").groupBy("less", F.length("part").alias("m")).agg(F.countDistinct("part").alias("n")).collect():
        others.setdefault(x.less, {})[x.m] = x.n

    def cost(na: int, nb: int) -> float:
        cells = ((threshold + less, {k: c / nb for k, c in sizes.items()}) for less, sizes in others.items() if threshold + less <= 100)
        return na * nb * sum(alike.cost_of_cell({k: c / na for k, c in own.items()}, sizes, bound) for bound, sizes in cells)

    return large if 2 * cost(*large) < cost(*small) else small


def met(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(name, other, score) of left (name, p) and right (name, p, q, less): each block of one in a cell with each of the other."""
    if not 0 < threshold <= 100:
        raise ValueError("threshold must be above 0 and at most 100")
    least = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = cut(left), cut(right)
    na, nb = blocks(left, right, threshold, least)

    def dealt(rows: DataFrame, side: int, blocks: int, others: int) -> DataFrame:
        rows = rows.withColumn("own", F.pmod(F.xxhash64("name", "p"), F.lit(blocks))).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
        cell = F.col("other") * nb + F.col("own") if side else F.col("own") * nb + F.col("other")
        return rows.select(cell.cast("long").alias("cell"), F.lit(side).alias("side"), "name", "p", "q", "less")

    left = left.select("name", "p", F.lit(None).cast("string").alias("q"), F.lit(0.0).alias("less"))
    cells = dealt(left, 0, na, nb).unionByName(dealt(right, 1, nb, na))
    # by number, so that few bytes of pairs still are the work of many tasks
    cells = cells.repartition(min(max(least, na * nb), TASKS), "cell").sortWithinPartitions("cell")
    return cells.mapInArrow(compare(threshold), "name string, other string, score double")


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of all different strings a of ``left`` (column a) and b of ``right`` (column b) at the threshold or above.

    Null and empty strings take no part.
    """
    a, b = left.where("a != ''").select("a").distinct(), right.where("b != ''").select("b").distinct()
    own = b.select(F.col("b").alias("name"), F.col("b").alias("p"), F.lit(None).cast("string").alias("q"), F.lit(0.0).alias("less"))
    return met(a.select(F.col("a").alias("name"), F.col("a").alias("p")), own, threshold).toDF("a", "b", "similarity")


def scored_pairs(companies: DataFrame, hosts: DataFrame, threshold: float = scoring.THRESHOLD) -> DataFrame:
    """(company, host, score) of all different companies and hosts whose ``score_domain`` reaches the threshold.

    Names too short to be compared score the same everywhere and are left out.
    """
    names = companies.select(F.col("company").alias("name")).distinct().withColumn("p", scoring.clean_company_name(F.col("name"))).where(F.length("p") >= scoring.SHORTEST)
    parts = scoring.split_domain(F.col("name"))
    own = hosts.select(urls.normalise_domain(F.col("host")).alias("name")).where("name is not null").distinct()
    own = own.select("name", parts["domain"].alias("p"), parts["subdomain"].alias("q"), scoring.penalty(F.col("name")).cast("double").alias("less"))
    return met(names, own, threshold).toDF("company", "host", "score")
