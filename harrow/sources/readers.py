"""Readers of the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import urls
from . import schemas


class InputError(ValueError):
    pass


def companies(spark: SparkSession, path: str, column: str = "Company") -> DataFrame:
    """(input_pos, company) of a company list: Parquet, CSV, JSON, or a sheet where pandas can read one.

    Blank and missing names are dropped.  ``input_pos`` is the position in the file, which makes "first" well defined:
    a column of that name is used if there is one, else the order of Spark's read.
    """
    low = path.lower()
    if low.endswith((".xlsx", ".xls")):
        import pandas as pd

        frame = pd.read_excel(path, dtype=str)  # a sheet is one small file by nature
        rows = spark.createDataFrame(frame.where(frame.notna(), None).assign(input_pos=range(len(frame))))
    elif low.endswith(".csv"):
        rows = spark.read.option("header", True).csv(path)
    elif low.endswith((".json", ".jsonl")):
        rows = spark.read.json(path)
    else:
        rows = spark.read.parquet(path)
    if column not in rows.columns:
        raise InputError(f"{path} has no column {column}")
    if "input_pos" not in rows.columns:
        rows = rows.withColumn("input_pos", F.monotonically_increasing_id())
    name = F.col(column).cast("string")
    out = rows.select("input_pos", name.alias("company")).where(F.length(F.trim(name)) > 0)
    if out.isEmpty():
        raise InputError(f"{path} has no rows")
    return out


def check_input(spark: SparkSession, path: str) -> tuple[bool, str | None]:
    try:
        companies(spark, path)
    except Exception as e:  # noqa: BLE001  any reason is reported
        return False, str(e)
    return True, None


def suffix_rules(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(rule, private) of a public suffix list: a file in the registry's format, else the list in Spark's HTTP client.

    Rules after the mark of private domains are private.  The list is small by nature (about ten thousand rules).
    """
    if path is None:
        jvm = spark._jvm
        stream = jvm.java.lang.Thread.currentThread().getContextClassLoader().getResourceAsStream("mozilla/public-suffix-list.txt")
        if stream is None:
            raise InputError("no public suffix list on the class path: give the path of one")
        text = bytes(stream.readAllBytes()).decode()
    else:
        text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    rows, private = [], False
    for line in text.splitlines():
        private |= "BEGIN PRIVATE DOMAINS" in line
        rule = line.split("//")[0].strip().split(" ")[0]
        if rule:
            rows.append((rule, private))
    return spark.createDataFrame(rows, "rule string, private boolean")


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """One URL a line; blank lines dropped, order kept in ``pos``."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("pos"), F.trim("value").alias("url"))
    return rows.where("url != ''")


def proxy_list(spark: SparkSession, path: str) -> DataFrame:
    """Proxies, one a line; blanks and # comments dropped."""
    rows = url_list(spark, path).where(~F.startswith("url", F.lit("#")))
    zero = F.lit(0).cast("long")
    return rows.select("pos", "url", zero.alias("success_count"), zero.alias("failure_count"), F.lit(0.0).alias("banned_until"))


def search_results(spark: SparkSession, path: str, most: int = 10) -> DataFrame:
    """Ranked hits, nested (company, hits array) or flat, the first ``most`` of each company."""
    rows = spark.read.parquet(path)
    if "hits" in rows.columns:
        rows = rows.select("company", F.posexplode("hits").alias("pos", "h")).select("company", (F.col("pos") + 1).alias("rank"), "h.title", "h.link", F.col("h.displayLink").alias("display_link"))
    return rows.where(F.col("rank") <= most)


def hits_from_page(pages: DataFrame, most: int = 10) -> DataFrame:
    """Links of result pages (query, html) as hits (query, rank, title, link, display_link): valid URLs, the first ``most``."""
    anchors = F.regexp_extract_all("html", F.lit(r"(?is)<a\b[^>]*>.*?</a\s*>"), F.lit(0))
    each = pages.select("query", F.posexplode(anchors).alias("pos", "a")).select("query", "pos", F.get(H.hrefs(F.col("a")), F.lit(0)).alias("link"), F.trim(H.text_of(F.col("a"))).alias("title"))
    good = each.where(urls.validate_url(F.col("link")))
    ranked = good.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct("pos", "title", "link"))), 1, most).alias("l"))  # one page's links
    out = ranked.select("query", F.posexplode("l").alias("i", "x")).select("query", (F.col("i") + 1).alias("rank"), "x.title", "x.link")
    return out.withColumn("display_link", urls.display_link(F.col("link")))


def cache(spark: SparkSession, path: str) -> DataFrame:
    """A cache table from Parquet or JSON lines."""
    return spark.read.schema(schemas.CACHE).json(path) if path.endswith((".json", ".jsonl")) else spark.read.parquet(path)
