"""Bounded breadth-first traversal: a job for each level, joins within it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import cut
from .seen import SeenSet


def crawl(seeds: DataFrame, links: DataFrame, *, limit: int | None = None, limits: DataFrame | None = None, max_depth: int | None = None, ok: DataFrame | None = None, count_failed: bool = False, most_levels: int = 100_000) -> DataFrame:
    """(domain, url, depth, visit): pages in first-in, first-out order, at most ``limit`` fetched for each domain.

    ``seeds``: (domain, url); ``links``: (src, link_pos, dst), targets already resolved and filtered; ``ok``: pages
    that answer (all, if not given) - others are seen but neither counted nor followed; ``limits``: (domain, limit).
    ``count_failed`` counts pages before they are fetched, so that failures use up the limit as well.
    Without ``max_depth`` the crawl goes on until a level is empty; beyond ``most_levels`` it fails, it never stops short.
    Order within a level is that of the parent and of the link in it.  Each level is checkpointed, so plans stay
    short; a level costs one join with the links and one anti join with what was seen.  What was seen is not written again:
    it consists of the levels themselves (``SeenSet``).
    """
    rank = Window.partitionBy("domain").orderBy("url")
    level = seeds.distinct().withColumn("ord", F.row_number().over(rank).cast("long"))
    level = cut(level)
    seen = SeenSet("domain", "url")
    seen.add(level, level.count())
    fetched = None
    counts = seeds.select("domain").distinct().withColumn("n", F.lit(0).cast("long"))
    if limits is not None:
        counts = counts.join(limits.select("domain", F.col("limit").cast("long").alias("most")), "domain", "left")
    else:
        counts = counts.withColumn("most", F.lit(None).cast("long"))
    counts = cut(counts.withColumn("most", F.coalesce("most", F.lit(limit).cast("long"), F.lit(1 << 40))))
    for depth in range(most_levels):
        good = level.join(ok.select("url"), "url", "left_semi") if ok is not None and not count_failed else level
        numbered = good.withColumn("k", F.row_number().over(Window.partitionBy("domain").orderBy("ord")))
        got = numbered.join(counts, "domain").where(F.col("k") + F.col("n") <= F.col("most"))
        got = cut(got.select("domain", "url", F.lit(depth).alias("depth"), (F.col("k") + F.col("n")).alias("visit"), "ord"))
        counts = cut(counts.join(got.groupBy("domain").agg(F.max("visit").alias("v")), "domain", "left").select("domain", F.coalesce("v", "n").alias("n"), "most"))
        if ok is not None and count_failed:
            got = got.join(ok.select("url"), "url", "left_semi").select(*got.columns)
        fetched = got if fetched is None else fetched.unionByName(got)
        if depth == max_depth:
            break
        if depth % 20 == 19:
            fetched = cut(fetched)  # a union of many levels is too deep a plan
        targets = got.join(links, got["url"] == links["src"]).select("domain", F.col("dst").alias("url"), "ord", "link_pos")
        first = targets.groupBy("domain", "url").agg(F.min(F.struct("ord", "link_pos")).alias("at"))
        fresh = seen.unseen(first)
        order = Window.partitionBy("domain").orderBy("at", "url")
        level = cut(fresh.select("domain", "url", F.row_number().over(order).cast("long").alias("ord")))
        n = level.count()
        if not n:
            break
        seen.add(level, n)
    else:
        raise RuntimeError(f"the crawl did not end within {most_levels} levels")
    return fetched.select("domain", "url", "depth", "visit")
