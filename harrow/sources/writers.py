"""Sinks for results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..operators.stats import emails_per_url


def results(rows: DataFrame, path: str) -> None:
    """Results by the path's ending: a sheet (small results only), CSV, JSON lines, else Parquet.  Replaces what is there."""
    low = path.lower()
    if low.endswith((".xlsx", ".xls")):
        rows.toPandas().to_excel(path, index=False)
    elif low.endswith(".csv"):
        rows.write.mode("overwrite").option("header", True).csv(path)
    elif low.endswith((".json", ".jsonl")):
        rows.write.mode("overwrite").json(path)
    else:
        rows.write.mode("overwrite").parquet(path)


def url_emails(rows: DataFrame, path: str) -> None:
    emails_per_url(rows).write.mode("overwrite").option("header", True).csv(path)


def in_place(rows: DataFrame, path: str) -> None:
    """Replace a Parquet table that ``rows`` may be read from: written beside it, then renamed by the file system."""
    spark = rows.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    rows.write.mode("overwrite").parquet(path + ".new")
    old, new = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".new")
    fs = old.getFileSystem(conf)
    aside = jvm.org.apache.hadoop.fs.Path(path + ".old")
    fs.delete(aside, True)
    if fs.exists(old) and not fs.rename(old, aside):  # one whole table is there at any time, if under another name
        raise OSError(f"cannot rename {path}")
    if not fs.rename(new, old):
        raise OSError(f"cannot rename {path}.new; the table as it was is {path}.old")
    fs.delete(aside, True)


def debug_pages(responses: DataFrame) -> DataFrame:
    """(name, text) of pages to keep for debugging."""
    return responses.select(urls.debug_filename(F.col("url")).alias("name"), "text")
