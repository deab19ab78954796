"""Counters, histograms and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLAGS = [
    "leads", "no_google", "google_error", "domain_unclear", "domain_error", "skipped_domain",
    "domain", "sitemap", "with_email", "without_email", "processing_error",
]
#: Counted, but not part of the printed summary.
NOT_PRINTED = ("domain_error", "skipped_domain")


def sum_flags(rows: DataFrame, flags: Sequence[str] = tuple(FLAGS)) -> DataFrame:
    return rows.agg(*[F.coalesce(F.sum(F.col(f).cast("long")), F.lit(0)).alias(f) for f in flags])


def status_histogram(responses: DataFrame) -> DataFrame:
    """Responses by status; those without one as ``no_response``."""
    name = F.when(F.col("status").isNull(), "no_response").otherwise(F.concat(F.lit("status_"), F.col("status").cast("string")))
    return responses.groupBy(name.alias("key")).agg(F.count("*").alias("n"))


def request_totals(responses: DataFrame, skipped: Column | None = None) -> DataFrame:
    return responses.agg(
        F.count("*").alias("total_requests"),
        F.count_if(skipped if skipped is not None else F.lit(False)).alias("skipped_urls"),
        F.count_if(F.col("status").between(400, 599)).alias("errors"),
    )


def emails_per_url(rows: DataFrame) -> DataFrame:
    """Addresses of a URL, sorted and joined by semicolons."""
    return rows.groupBy("url").agg(F.array_join(F.array_sort(F.collect_set("email")), ";").alias("emails"))


def distinct_emails(rows: DataFrame, column: str = "Email", exact: bool = True) -> DataFrame:
    f = F.count_distinct if exact else F.approx_count_distinct
    return rows.agg(f(column).alias("n_emails"))


def pool_stats(tasks: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Processed, errors, success rate and tasks a second of busy time."""
    done = F.count("*")
    return tasks.groupBy(*group).agg(
        done.alias("processed"),
        F.count_if(~F.col("success")).alias("errors"),
        F.round(100.0 * F.try_divide(F.count_if("success"), done), 6).alias("success_rate"),
        F.round(F.try_divide(done, F.sum("duration")), 6).alias("tasks_per_second"),
    )


def split_tasks(tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tasks.where("success"), tasks.where("not success")


def format_seconds(seconds: Column) -> Column:
    """59.9s, 1m 15s, 1h 5m."""
    whole = F.floor(seconds).cast("long")
    return (
        F.when(seconds < 60, F.format_string("%.1fs", seconds.cast("double")))
        .when(seconds < 3600, F.format_string("%dm %ds", F.floor(whole / 60), whole % 60))
        .otherwise(F.format_string("%dh %dm", F.floor(whole / 3600), F.floor((whole % 3600) / 60)))
    )


def progress_stats(rows: DataFrame) -> DataFrame:
    """From current, total, elapsed: percent, rate, remaining seconds, and their texts."""
    rate = F.try_divide(F.col("current"), F.col("elapsed"))
    out = rows.withColumn("percent", F.coalesce(100.0 * F.try_divide(F.col("current"), F.col("total")), F.lit(0.0))).withColumn("rate", F.coalesce(rate, F.lit(0.0)))
    out = out.withColumn("eta", F.try_divide(F.col("total") - F.col("current"), rate))
    return out.withColumn("elapsed_text", format_seconds(F.col("elapsed"))).withColumn("eta_text", format_seconds(F.col("eta"))).withColumn("completed", F.col("current") >= F.col("total"))


def total_progress(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.sum("total").alias("total"), F.sum("current").alias("current"),
        F.coalesce(100.0 * F.try_divide(F.sum("current"), F.sum("total")), F.lit(0.0)).alias("percent"),
        F.bool_and(F.col("current") >= F.col("total")).alias("completed"),
    )


def row_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    a, b = before.agg(F.count("*").alias("n_before")), after.agg(F.count("*").alias("n_after"))
    return a.join(b).withColumn("delta", F.col("n_after") - F.col("n_before"))  # one row each


def proxy_stats(proxies: DataFrame, now: Column) -> DataFrame:
    """Counts of known and available proxies and the mean success rate of used ones."""
    used = F.col("success_count") + F.col("failure_count")
    return proxies.agg(
        F.count("*").alias("total"),
        F.count_if(available(now)).alias("available"),
        F.count_if(~available(now)).alias("banned"),
        F.coalesce(F.avg(F.when(used > 0, F.col("success_count") / used)), F.lit(0.0)).alias("mean_rate"),
    )


def available(now: Column) -> Column:
    return now > F.col("banned_until")


def success_rate() -> Column:
    return F.coalesce(F.try_divide(F.col("success_count"), F.col("success_count") + F.col("failure_count")), F.lit(0.0))


def best_proxy(proxies: DataFrame, now: Column) -> DataFrame:
    return proxies.where(available(now)).orderBy(success_rate().desc(), "pos").limit(1)


def random_proxy(proxies: DataFrame, now: Column, seed: int) -> DataFrame:
    return proxies.where(available(now)).orderBy(F.rand(seed)).limit(1)


def check_report(checks: DataFrame) -> DataFrame:
    """Working ones first, by latency; then failures."""
    return checks.orderBy(F.desc("ok"), "ms", "url")


def check_outcome(checks: DataFrame) -> DataFrame:
    return checks.agg(F.count_if("ok").alias("working"), F.count("*").alias("total"))


def bans(failures: DataFrame, seconds: float = 300.0) -> DataFrame:
    """(url, banned_until) from failures (url, ts in seconds)."""
    return failures.groupBy("url").agg((F.max("ts") + seconds).alias("banned_until"))


def summary(flags: DataFrame, responses: DataFrame, results: DataFrame, runtime: float | None = None) -> DataFrame:
    """One wide row: flag sums, request totals, distinct addresses, runtime."""
    out = sum_flags(flags).join(request_totals(responses)).join(distinct_emails(results)).drop(*NOT_PRINTED)  # one row each
    return out.withColumn("runtime", F.lit(runtime).cast("double"))
