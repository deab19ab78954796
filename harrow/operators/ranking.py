"""First-of, top-k, dedupe and running values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordered import ranges, scan


def first_per(rows: DataFrame, key: str | Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row for each key, the first in order: a domain's first company, a page's first visit."""
    return top_per(rows, key, order, 1)


def top_per(rows: DataFrame, key: str | Sequence[str], order: Sequence[Column | str], n: int | Column) -> DataFrame:
    """At most n rows for each key.  Spark limits groups before the shuffle (WindowGroupLimit)."""
    keys = [key] if isinstance(key, str) else list(key)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("harrow_rn", rank).where(F.col("harrow_rn") <= n).drop("harrow_rn")


def best_by(rows: DataFrame, key: str, score: str, rank: str, value: str) -> DataFrame:
    """(key, score, value) of the highest score, ties to the lowest rank; an aggregate, so no sort of the rows."""
    best = F.max_by(F.struct(score, value), F.struct(F.col(score), -F.col(rank)))
    return rows.groupBy(key).agg(best.alias("b")).select(key, f"b.{score}", f"b.{value}")


def distinct_rows(rows: DataFrame) -> DataFrame:
    return rows.dropDuplicates()


def running_count(rows: DataFrame, order: Sequence[Column | str], total: int, key: str | None = None, step: Column | None = None) -> DataFrame:
    """``current``: progress after each row, no more than the total; ``percent``.

    Without a key the whole table is one sequence: a prefix scan over ranges of the order, not one task.
    """
    add = (step if step is not None else F.lit(1)).cast("long")
    if key:
        w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        out = rows.withColumn("current", F.sum(add).over(w))
    else:
        out = scan(ranges(rows, *order), None, order, add, "sum", "current").select(*[c for c in rows.columns if c != "current"], "current")
    current = F.least(F.col("current"), F.lit(total).cast("long"))
    return out.withColumn("current", current).withColumn("percent", F.round(100.0 * F.col("current") / total, 6))


def batch_number(rows: DataFrame, key: str, order: Sequence[Column | str], size: int) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("batch", F.floor((rn - 1) / size).cast("long"))


def since_last(rows: DataFrame, key: str, ts: str) -> DataFrame:
    """Seconds since the key's last row."""
    w = Window.partitionBy(key).orderBy(ts)
    return rows.withColumn("harrow_last", F.lag(ts).over(w)).withColumn(
        "gap", F.expr(f"timestampdiff(MICROSECOND, harrow_last, {ts})") / 1e6
    ).drop("harrow_last")
