"""Sitemaps: discovery, robots.txt, parsing, nesting, priority pages."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SITEMAP_NAMES, PRIORITY_PARTS, words
from ..functions import urls
from ..runtime import cut
from . import ranking
from .seen import SeenSet

MOST_BYTES = 50 * 1024 * 1024
#: Steps between indexes that one task holds, and starts that it walks from.
MOST_STEPS, MOST_STARTS = 250_000, 50_000
LOC = r"(?is)<(?:[A-Za-z0-9_-]+:)?loc\b[^>]*>\s*(?:<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>)?\s*</(?:[A-Za-z0-9_-]+:)?loc\s*>"


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """(domain, pos, url) of Sitemap lines in robots.txt (domain, text), those of the domain itself only."""
    lines = robots.select("domain", F.posexplode(F.split("text", "\\R")).alias("pos", "line"))
    named = lines.where(F.startswith(F.lower(F.trim("line")), F.lit("sitemap:")))
    found = named.select("domain", "pos", F.trim(F.expr("substring(trim(line), instr(trim(line), ':') + 1)")).alias("url"))
    return found.where(urls.without_www(F.lower(urls.netloc(F.col("url")))) == F.col("domain"))


def gunzip():
    """Arrow UDF: bytes unpacked where they are gzip; NULL where that fails."""

    @F.pandas_udf("binary")
    def run(body: pd.Series) -> pd.Series:
        import gzip

        def one(b):
            if b is None or b[:2] != b"\x1f\x8b":
                return b
            try:
                return gzip.decompress(b)
            except (OSError, EOFError):
                return None

        return body.map(one)

    return run


def unpacked(bodies: DataFrame) -> DataFrame:
    """(url, body), gzip bodies unpacked; only these go through the Python step."""
    packed = F.coalesce(F.substring("body", 1, 2) == F.lit(b"\x1f\x8b"), F.lit(False))
    return bodies.where(~packed).select("url", "body").unionByName(bodies.where(packed).select("url", gunzip()("body").alias("body")))


def as_text(body: Column) -> Column:
    return F.make_valid_utf8(body.cast("string"))


def looks_like_xml(body: Column) -> Column:
    head = F.lower(F.substring(F.ltrim(as_text(body)), 1, 200))
    return F.startswith(head, F.lit("<?xml")) | F.contains(head, F.lit("<urlset")) | F.contains(head, F.lit("<sitemapindex"))


def within_size(body: Column, most_bytes: int | None = MOST_BYTES) -> Column:
    n = F.octet_length(body)
    return n > 0 if most_bytes is None else n.between(1, most_bytes)


def head_allows(content_type: Column, content_length: Column) -> Column:
    """The older check before a fetch: some kind of text or XML, and not too long where a length is given."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    named = F.exists(F.array(F.lit("xml"), F.lit("text"), F.lit("application")), lambda k: F.contains(kind, k))
    return named & (F.coalesce(content_length, F.lit(0)) <= MOST_BYTES)


def is_index(text: Column) -> Column:
    return text.rlike(r"(?is)<(?:[A-Za-z0-9_-]+:)?sitemapindex\b")


def locations(text: Column) -> Column:
    """array<string> of <loc> values in order; an element that is never closed counts as none."""
    found = F.transform(F.regexp_extract_all(text, F.lit(LOC), F.lit(1)), lambda u: F.replace(F.trim(u), F.lit("&amp;"), F.lit("&")))
    return F.filter(found, lambda u: u != "")


def locations_xml(text: Column, most: int = 10_000) -> Column:
    """The same by Spark's XML reader, NULL for malformed documents."""
    parsed = F.from_xml(text, "sitemap array<struct<loc:string>>, url array<struct<loc:string>>")
    return F.slice(F.concat(F.coalesce(parsed["sitemap"]["loc"], F.array()), F.coalesce(parsed["url"]["loc"], F.array())), 1, most)


def candidates(domains: DataFrame, names: Sequence[str] = SITEMAP_NAMES) -> DataFrame:
    """(domain, pos, url): hosts times file names, the plain host first."""
    hosts = domains.select("domain", F.posexplode(urls.sitemap_hosts(F.col("domain"))).alias("h", "host"))
    each = hosts.select("domain", "h", "host", F.posexplode(F.array(*[F.lit(n) for n in names])).alias("n", "name"))
    return each.select("domain", (F.col("h") * len(names) + F.col("n")).alias("pos"), F.concat(F.lit("https://"), "host", F.lit("/"), "name").alias("url"))


def discover(domains: DataFrame, bodies: DataFrame, robots: DataFrame, names: Sequence[str] = SITEMAP_NAMES, *, every: bool = False, most_bytes: int | None = MOST_BYTES) -> DataFrame:
    """(domain, url): the first candidate that is a sitemap (all of them: ``every``), else those of robots.txt."""
    good = unpacked(bodies).where(within_size(F.col("body"), most_bytes) & looks_like_xml(F.col("body"))).select("url")
    hits = candidates(domains, names).join(good.select("url"), "url", "left_semi")
    hits = hits if every else ranking.first_per(hits, "domain", ["pos"])
    named = robots_sitemaps(robots).join(hits, "domain", "left_anti").join(good.select("url"), "url", "left_semi")
    return hits.select("domain", "url").unionByName(named.select("domain", "url")).distinct()


def listings(bodies: DataFrame, most: int | None = 10_000, most_bytes: int | None = MOST_BYTES) -> DataFrame:
    """(url, index, locs) of the bodies that are sitemaps, gzip unpacked; the first ``most`` locations of each, or all."""
    docs = unpacked(bodies).where(within_size(F.col("body"), most_bytes) & looks_like_xml(F.col("body"))).select("url", as_text(F.col("body")).alias("text"))
    locs = locations(F.col("text"))
    return docs.select("url", is_index(F.col("text")).alias("index"), (locs if most is None else F.slice(locs, 1, most)).alias("locs"))


def walk():
    """Over rows (cell, side, a, b) sorted by cell and side: (domain, url, expanded) of what is reached within each cell.

    Side 0 are steps from sitemap a to b, side 1 domains a that start at sitemap b.  What has no steps in its cell comes
    out as not expanded.
    """

    def closures(steps: dict[str, list[str]], starts: dict[str, list[str]]) -> Iterator[tuple[str, str, bool]]:
        for domain, begin in starts.items():
            known, ahead = set(begin), list(begin)
            while ahead:
                url = ahead.pop()
                yield domain, url, url in steps
                more = [u for u in steps.get(url, ()) if u not in known]
                known.update(more)
                ahead += more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: Iterator[tuple[str, str, bool]]) -> Iterator[pa.RecordBatch]:
            while part := list(islice(rows, 8192)):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names=["domain", "url", "expanded"])

        kinds, last = [pa.string(), pa.string(), pa.bool_()], None
        sides: tuple[dict[str, list[str]], dict[str, list[str]]] = ({}, {})
        for batch in batches:
            for cell, side, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if cell != last:
                    yield from out(closures(*sides))
                    sides, last = ({}, {}), cell
                sides[side].setdefault(a, []).append(b)
        yield from out(closures(*sides))

    return run


def reached(found: DataFrame, indexes: DataFrame, most_levels: int | None = None) -> DataFrame:
    """(domain, sitemap_url): sitemaps reached from those found through index files (url, locs), each once for a domain.

    To any depth; circles of indexes end by themselves.  Steps from index to index are dealt into blocks, those of a host
    together up to ``MOST_STEPS``, and a round walks each block to its end: rounds are as many as a path changes blocks.
    With ``most_levels`` it goes level by level and fails beyond so many; it never stops short.
    """
    found = found.select("domain", F.col("url").alias("sitemap_url")).distinct()
    edges = indexes.select(F.col("url").alias("sitemap_url"), F.explode(F.array_distinct("locs")).alias("child"))
    if most_levels is not None:
        return reached_by_levels(found, edges, most_levels)
    steps = edges.join(indexes.select(F.col("url").alias("child")).distinct(), "child", "left_semi")
    steps = steps.withColumn("host", F.coalesce(F.lower(urls.netloc(F.col("sitemap_url"))), F.lit("")))
    sizes = steps.groupBy("host").agg(F.ceil(F.count("*") / MOST_STEPS).alias("blocks"))
    steps = steps.join(sizes, "host")
    steps = cut(steps.select(F.xxhash64("host", F.pmod(F.xxhash64("sitemap_url"), "blocks")).alias("block"), "sitemap_url", "child"))
    places = cut(steps.select("sitemap_url", "block").distinct())
    seen = SeenSet("domain", "sitemap_url")
    level = cut(found.join(indexes.select(F.col("url").alias("sitemap_url")).distinct(), "sitemap_url", "left_semi").select("domain", "sitemap_url"))
    seen.add(level, level.count())
    ahead = cut(level.join(places, "sitemap_url"))
    while ahead.head() is not None:
        salts = ahead.groupBy("block").agg(F.ceil(F.count("*") / MOST_STARTS).alias("salts"))
        left = steps.join(salts, "block").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
        right = ahead.join(salts, "block").withColumn("salt", F.pmod(F.xxhash64("domain"), "salts"))
        cell = F.xxhash64("block", "salt").alias("cell")
        rows = left.select(cell, F.lit(0).alias("side"), F.col("sitemap_url").alias("a"), F.col("child").alias("b"))
        rows = rows.unionByName(right.select(cell, F.lit(1).alias("side"), F.col("domain").alias("a"), F.col("sitemap_url").alias("b")))
        rows = rows.repartition("cell").sortWithinPartitions("cell", "side").mapInArrow(walk(), "domain string, url string, expanded boolean")
        met = rows.groupBy("domain", F.col("url").alias("sitemap_url")).agg(F.max("expanded").alias("expanded"))
        new = cut(seen.unseen(met))
        seen.add(new, new.count())
        ahead = cut(new.where("not expanded").join(places, "sitemap_url").select("domain", "sitemap_url", "block"))
    own = reduce(DataFrame.unionByName, [part for _, part, _ in seen.parts])
    below = own.join(edges, "sitemap_url").select("domain", F.col("child").alias("sitemap_url"))
    return found.unionByName(own).unionByName(below).distinct()


def reached_by_levels(found: DataFrame, edges: DataFrame, most_levels: int) -> DataFrame:
    """``reached`` with a job for each level."""
    level = cut(found)
    seen, levels, n = SeenSet("domain", "sitemap_url"), 0, level.count()
    while n:
        if levels >= most_levels:
            raise RuntimeError(f"sitemaps are nested deeper than {most_levels} levels")
        levels += 1
        seen.add(level, n)
        below = level.join(edges, "sitemap_url").select("domain", F.col("child").alias("sitemap_url")).distinct()
        level = cut(seen.unseen(below))
        n = level.count()
    return reduce(DataFrame.unionByName, [part for _, part, _ in seen.parts]) if levels else level


def pages_of(found: DataFrame, bodies: DataFrame, *, most: int | None = 10_000, index_locs: bool = False, most_levels: int | None = None, most_bytes: int | None = MOST_BYTES) -> DataFrame:
    """(domain, sitemap_url, pos, url): pages listed in sitemaps and in those their indexes name, to any depth.

    ``most``: the first locations of a sitemap that count, None for all.  ``most_bytes``: longer sitemaps do not count,
    None for any length.  ``index_locs``: entries of indexes are pages too,
    as the older form has it.  Bodies are parsed once; levels join only the entries of indexes.
    """
    known = cut(listings(bodies, most, most_bytes))
    every = reached(found, known.where("index"), most_levels).join(known, F.col("sitemap_url") == F.col("url"))
    every = every if index_locs else every.where("not index")
    pages = every.select("domain", "sitemap_url", F.posexplode("locs").alias("pos", "url"))
    return pages.where(urls.validate_url(F.col("url"))) if index_locs else pages


def priority_pages(pages: DataFrame, parts: Sequence[str] = words(PRIORITY_PARTS), limit: int = 12) -> DataFrame:
    """At most ``limit`` priority pages for each domain, each once, in order of sitemap and place."""
    good = pages.where(urls.is_priority(F.col("url"), parts))
    once = good.groupBy("domain", "url").agg(F.min(F.struct("sitemap_url", "pos")).alias("at"))
    return ranking.top_per(once, "domain", ["at", "url"], limit).select("domain", "url")
