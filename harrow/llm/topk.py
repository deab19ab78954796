"""Exact top-k by inner product: a KD-tree per shard, searched best first.

Vectors become integers, so scores are exact.  Rows are dealt into shards of bounded size and queries into blocks of
bounded size; a task holds one shard and one block.  Each shard builds a KD-tree by median splits with tight bounding
boxes; the largest inner product a box can reach bounds everything below it.  Every query first searches one shard, its
home; the k-th score found there is propagated to all other shards, which skip boxes and rows below it.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

SCALE = 64
K = 20
SHARD_ROWS = 16384
QUERY_ROWS = 4096
LEAF = 128


class Tree:
    """Median splits on the widest side; nodes in arrays, with tight boxes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF, copies: np.ndarray | None = None):
        order = np.arange(len(ids))
        self.start, self.end, self.child = [0], [len(ids)], [-1]
        todo = [0]
        while todo:
            node = todo.pop()
            lo, hi = self.start[node], self.end[node]
            if hi - lo <= leaf:
                continue
            own = vectors[order[lo:hi]]
            side = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            mid = (hi - lo) // 2
            order[lo:hi] = order[lo:hi][np.argpartition(own[:, side], mid)]
            self.child[node] = len(self.start)
            for a, b in ((lo, lo + mid), (lo + mid, hi)):
                todo.append(len(self.start))
                self.start.append(a)
                self.end.append(b)
                self.child.append(-1)
        self.ids, self.vectors = ids[order], vectors[order]
        self.copies = (np.ones(len(ids), np.int64) if copies is None else copies)[order]
        self.low = np.stack([self.vectors[a:b].min(axis=0) for a, b in zip(self.start, self.end, strict=True)])
        self.high = np.stack([self.vectors[a:b].max(axis=0) for a, b in zip(self.start, self.end, strict=True)])

    def search(self, queries: np.ndarray, query_ids: np.ndarray, bounds: np.ndarray, k: int):
        """For each query its k best (score, -id, copies) of at least its bound; ties to the smaller id, itself left out."""
        reach = np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T
        for q in range(len(queries)):
            best: list[tuple] = []  # heap of (score, -id, copies); its first is the k-th
            least, own = bounds[q], reach[q]
            todo = [(-own[0], 0)]
            while todo:
                bound, node = heapq.heappop(todo)
                if -bound < least:
                    break  # nothing left reaches the k-th score
                child = self.child[node]
                if child >= 0:
                    heapq.heappush(todo, (-own[child], child))
                    heapq.heappush(todo, (-own[child + 1], child + 1))
                    continue
                lo, hi = self.start[node], self.end[node]
                scores = self.vectors[lo:hi] @ queries[q]
                for i in np.flatnonzero(scores >= least):
                    if self.ids[lo + i] == query_ids[q]:
                        continue
                    item = (scores[i], -self.ids[lo + i], self.copies[lo + i])
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
                if len(best) == k:
                    least = max(least, best[0][0])
            yield best


def exact(rows: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in a type whose sums of products are exact."""
    most = float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * rows.shape[1]
    if most < 1 << 52:
        return rows.astype(np.float64), queries.astype(np.float64)
    if most < 1 << 62:
        return rows.astype(np.int64), queries.astype(np.int64)
    raise ArithmeticError("inner products of these vectors may exceed 64-bit integers")


def search_group(k: int, leaf: int):
    names = ["query_id", "vec_id", "score", "copies"]

    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(queries):
            return pd.DataFrame({n: np.zeros(0, np.int64) for n in names})
        vectors, wanted = exact(np.stack(rows["v"].to_numpy()), np.stack(queries["v"].to_numpy()))
        tree = Tree(rows["vec_id"].to_numpy(), vectors, leaf, rows["copies"].to_numpy())
        bounds = queries["least"].fillna(-math.inf).to_numpy()
        out = []
        for q, best in zip(queries["query_id"].to_numpy(), tree.search(wanted, queries["query_id"].to_numpy(), bounds, k), strict=True):
            out += [(int(q), -int(i), int(s), int(c)) for s, i, c in best]
        return pd.DataFrame(out, columns=names).astype("int64")

    return run


def top_k(
    vectors: DataFrame, *, k: int = K, every: int = 20, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS, leaf: int = LEAF
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose vec_id is divisible by ``every``.

    Components become floor(64 x).  Rows with a null vec_id, a null vector, or null or non-finite components take no
    part; an empty vector scores 0 with other empty ones.  Only vectors of the query's own length are candidates.  
    Rows repeating a vec_id are candidates each, equal ones are kept once with their number; as a query an id counts once
    (of different vectors the smallest), and rows of its own id are no candidates of it.  Ties go to the smaller vec_id.  Vectors so
    large that a score may not fit 64 bits raise an error.

    An empty table gives no rows.
    """
    x = F.transform("embedding", lambda e: e.cast("double"))
    sound = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select("vec_id", x.alias("x"), sound.alias("ok"))
    rows = rows.where("ok").select("vec_id", F.expr(f"transform(x, e -> cast(floor({SCALE} * e) as bigint))").alias("v"))
    rows = cut(rows.groupBy("vec_id", "v").agg(F.count("*").alias("copies")).withColumn("dims", F.size("v")))
    # A few numbers for each length of vector, at most; lengths are a property of the models, not of the corpus.
    sizes = rows.groupBy("dims").agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q"))
    sizes = sizes.select("dims", F.ceil(F.col("n") / shard_rows).cast("int").alias("shards"), F.greatest(F.lit(1), F.ceil(F.col("q") / query_rows)).cast("int").alias("blocks"))
    rows = rows.join(F.broadcast(sizes), "dims")
    part = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col(n).cast("long")).cast("int")
    rows = rows.withColumn("shard", part("shards", 1))
    asked = rows.where(F.col("vec_id") % every == 0)
    own = ["v", "dims", "shards", "blocks", "shard"]
    queries = asked.groupBy("vec_id").agg(F.min(F.struct(*own)).alias("q")).select("vec_id", "q.*").withColumn("block", part("blocks", 2))
    queries = queries.select(
        F.col("vec_id").alias("query_id"), F.col("shard").alias("home"), *[F.col(c).alias(c) for c in ("v", "dims", "shards", "block")]
    )
    key = ["dims", "shard", "block"]
    # A shard goes once to each block of queries: bounded tasks, and no pair of rows is ever written.
    dealt = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*key, "vec_id", "v", "copies")

    def searched(q: DataFrame) -> DataFrame:
        return dealt.groupBy(*key).cogroup(q.select(*key, "query_id", "v", "least").groupBy(*key)).applyInPandas(
            search_group(k, leaf), "query_id long, vec_id long, score long, copies long"
        )

    home = cut(searched(queries.withColumn("shard", F.col("home")).withColumn("least", F.lit(None).cast("double"))))
    kth = home.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("low"))
    kth = kth.select("query_id", F.when(F.col("n") >= k, F.col("low").cast("double")).alias("least"))
    others = queries.join(kth, "query_id", "left").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    rest = searched(others.where("shard != home"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        home.unionByName(rest)
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("copies", F.lit(k).cast("long")))))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


TOP_K_SQL = """
WITH ok AS (
  SELECT vec_id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM ok q JOIN ok c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
