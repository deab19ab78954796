"""Ordered work over more rows than one task should see: ranges of the order instead of one window partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import cut

PART = "harrow_part"


def ranges(df: DataFrame, *order: Column | str, part: str = PART) -> DataFrame:
    """The rows dealt into ranges of ``order``; ``part`` numbers the ranges in that order.  Written once.

    All rows of a range precede all rows of the next.  Rows that are equal in ``order`` share a range, so make the
    order fine enough, or aggregate equal rows first.  Bounds come from samples, so the result is checkpointed: work
    that is done again after a loss sees the same ranges.
    """
    return cut(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))


def scan(dealt: DataFrame, key: str | None, order: Sequence[Column | str], value: Column, how: str, name: str, part: str = PART) -> DataFrame:
    """``name``: the running ``sum`` or ``max`` of ``value`` in each key, up to and with each row of ``ranges``.

    A prefix scan: each range of a key is summed up by itself, the sums of earlier ranges (a row for each range) are put
    together, and the rows of a range go on from there.  Without a key the table is one sequence.  No task sees more of a
    key than a range, however many rows it has.  The rows are shuffled by key and range once for all scans over them.
    """
    of = {"sum": F.sum, "max": F.max}[how]
    both = {"sum": lambda a, b: F.coalesce(a + b, a, b), "max": F.greatest}[how]
    tag = F.struct(*[F.col(c) for c in ([key] if key else []) + [part]])  # equal to itself even where the key is null
    rows = dealt.withColumn("harrow_tag", tag) if "harrow_tag" not in dealt.columns else dealt
    here = Window.partitionBy("harrow_tag").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy("harrow_tag").agg(of(value).alias("harrow_sum"))
    earlier = Window.partitionBy(*([f"harrow_tag.{key}"] if key else [])).orderBy(f"harrow_tag.{part}").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("harrow_tag", of("harrow_sum").over(earlier).alias("harrow_before"))
    out = rows.withColumn("harrow_here", of(value).over(here)).join(sums, "harrow_tag")
    return out.withColumn(name, both(F.col("harrow_before"), F.col("harrow_here"))).drop("harrow_before", "harrow_here")


def copies(rows: DataFrame, n: str, at: str, most: int = 10_000) -> DataFrame:
    """Each row ``n`` times, numbered from 0 in ``at``; a row with very many copies is dealt to many tasks first."""
    long = lambda x: F.lit(x).cast("long")
    some = rows.withColumn("harrow_from", F.explode(F.sequence(long(0), F.col(n) - 1, long(most))))
    dealt = some.repartition(*[F.col(c) for c in some.columns])
    return dealt.withColumn(at, F.explode(F.sequence(F.col("harrow_from"), F.least(F.col("harrow_from") + most, F.col(n)) - 1))).drop("harrow_from")
