"""Joins of the discovery pipeline, as DataFrame operations; Catalyst picks the strategy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import urls


def with_results(companies: DataFrame, results: DataFrame) -> DataFrame:
    """Every company with its search results, those without any kept."""
    return companies.join(results, "company", "left")


def first_engine(hits: DataFrame) -> DataFrame:
    """Of several engines' hits (query, engine_pos, ...), those of the first engine that has any."""
    first = hits.groupBy("query").agg(F.min("engine_pos").alias("engine_pos"))
    return hits.join(first, ["query", "engine_pos"], "left_semi")


def first_response(pages: DataFrame, responses: DataFrame, url: str = "url") -> DataFrame:
    """The first candidate address with a 2xx response: as given, with www., over http."""
    tried = pages.select("*", F.explode(urls.fetch_candidates(F.col(url))).alias("harrow_c"))
    tried = tried.select(*pages.columns, F.col("harrow_c.pos").alias("pos"), F.col("harrow_c.url").alias("fetched"))
    ok = responses.where(F.col("status").between(200, 299)).withColumnRenamed("url", "fetched")
    found = tried.join(ok, "fetched")
    rank = Window.partitionBy(*pages.columns).orderBy("pos", "fetched")
    return found.withColumn("harrow_rn", F.row_number().over(rank)).where("harrow_rn = 1").drop("harrow_rn")


def unless(rows: DataFrame, known: DataFrame, on: Sequence[str] | str) -> DataFrame:
    """Anti join: rows whose key is not known yet (frontier less seen, domains less processed)."""
    return rows.join(known, on, "left_anti")


def or_default(rows: DataFrame, overrides: DataFrame, key: str, value: str, default) -> DataFrame:
    """Per-key override with a default (page limits, request rates)."""
    return rows.join(overrides, key, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def cached(queries: DataFrame, cache: DataFrame, fresh: Column, key: str = "query") -> DataFrame:
    """Cached value of the normalised key where there is one, else the fresh one; ``hit`` tells which."""
    k = queries.withColumn("key", urls.cache_key(F.col(key)))
    out = k.join(cache.select("key", F.col("value").alias("harrow_cached")), "key", "left")
    return out.withColumn("hit", F.col("harrow_cached").isNotNull()).withColumn("value", F.coalesce("harrow_cached", fresh)).drop("harrow_cached")


def merge_kth(base: DataFrame, found: DataFrame, key: str, base_order: Sequence[str], found_order: Sequence[str], value: str) -> DataFrame:
    """The k-th row of a key gets the k-th result of that key where its own value is blank; results left over follow.

    A result is used up by its row even if the row had a value.  ``source`` tells where a row comes from.
    """
    rank = lambda order: F.row_number().over(Window.partitionBy(key).orderBy(*order))
    b = base.withColumn("harrow_k", rank(base_order))
    f = found.withColumn("harrow_k", rank(found_order))
    blank = F.col(value).isNull() | (F.col(value) == "")
    new = f.select(key, "harrow_k", F.col(value).alias("harrow_new"))
    merged = b.join(new, [key, "harrow_k"], "left").withColumn(value, F.when(blank, F.coalesce("harrow_new", F.col(value))).otherwise(F.col(value)))
    rest = f.join(b.select(key, "harrow_k"), [key, "harrow_k"], "left_anti")
    out = merged.drop("harrow_new").withColumn("source", F.lit("input")).unionByName(rest.withColumn("source", F.lit("result")), allowMissingColumns=True)
    return out.drop("harrow_k")


def append_rows(base: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of both, columns of either."""
    return base.unionByName(found, allowMissingColumns=True)
