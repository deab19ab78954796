"""Public suffixes by a table of rules: labels of a host joined with the rules, longest match, wildcards, exceptions.

Rules are one a row, as registries publish them: ``co.uk``, ``*.ck`` (any label before ck), ``!www.ck`` (not a suffix after
all).  A lone label that no rule names is a domain, not a suffix; so is an address of four numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A rule table up to this size is sent to all executors; it is counted first.
BROADCAST_RULES = 100_000


def parsed(rules: DataFrame) -> DataFrame:
    """(name, kind, private) of a table with a column ``rule`` (and ``private``, if it has one): comments and blanks go."""
    text = F.lower(F.regexp_extract("rule", r"^\s*([^\s/]\S*)", 1))
    private = F.coalesce(F.col("private"), F.lit(False)) if "private" in rules.columns else F.lit(False)
    kind = F.when(F.startswith("text", F.lit("!")), "exception").when(F.startswith("text", F.lit("*.")), "wildcard").otherwise("exact")
    rows = rules.select(text.alias("text"), private.alias("private")).where("text != ''").withColumn("kind", kind)
    name = F.regexp_replace("text", r"^(?:!|\*\.)", "")
    return rows.select(name.alias("name"), "kind", "private").groupBy("name", "kind").agg(F.min("private").alias("private"))


def split_hosts(rows: DataFrame, host: str, rules: DataFrame, *, private: bool = True, unlisted: int = 1) -> DataFrame:
    """``rows`` with subdomain, domain and suffix of ``host``.

    ``private``: whether rules marked private count (``github.io``).  ``unlisted``: labels of suffix where no rule fits
    (0: the last label is the domain).  Each different host is worked out once; null hosts have nulls.
    """
    known = parsed(rules)
    known = (known if private else known.where("not private")).drop("private")
    if known.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        known = F.broadcast(known)
    hosts = rows.select(F.col(host).alias("harrow_host")).where(F.col(host).isNotNull()).distinct()
    bare = F.regexp_replace(F.lower("harrow_host"), r"^.*@|:[0-9]*$|\.$", "")
    hosts = hosts.select("harrow_host", F.split(bare, r"\.").alias("labels"))
    ends = hosts.select("harrow_host", F.size("labels").alias("n"), F.explode(F.sequence(F.lit(1), F.size("labels"))).alias("k"), "labels")
    ends = ends.select("harrow_host", "n", "k", F.array_join(F.slice("labels", F.col("n") - F.col("k") + 1, F.col("k")), ".").alias("name"))
    hits = ends.join(known, "name")
    size = F.when(F.col("kind") == "wildcard", F.col("k") + 1).otherwise(F.col("k"))
    best = hits.where((F.col("kind") != "wildcard") | (F.col("k") < F.col("n"))).groupBy("harrow_host").agg(
        F.max(F.when(F.col("kind") == "exception", F.col("k") - 1)).alias("but"), F.max(F.when(F.col("kind") != "exception", size)).alias("most")
    )
    n, labels = F.size("labels"), F.col("labels")
    number = F.array_join("labels", ".").rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$")
    default = F.when(n > unlisted, unlisted).otherwise(0)
    cut_at = n - F.when(number, 0).otherwise(F.coalesce("but", "most", default))
    found = hosts.join(best, "harrow_host", "left").withColumn("harrow_at", cut_at)
    at = F.col("harrow_at")
    found = found.select(
        "harrow_host",
        F.when(number, "").otherwise(F.array_join(F.slice(labels, F.lit(1), F.greatest(at - 1, F.lit(0))), ".")).alias("subdomain"),
        F.when(number, F.array_join(labels, ".")).when(at > 0, F.get(labels, at - 1)).otherwise("").alias("domain"),
        F.array_join(F.slice(labels, at + 1, F.greatest(n - at, F.lit(0))), ".").alias("suffix"),
    )
    return rows.join(found, F.col(host) == F.col("harrow_host"), "left").drop("harrow_host")
