"""URL and domain functions, Column to Column, all inside code generation.

Three identities of a URL are kept apart: ``canonicalise`` (visited guard), ``canonicalise_query`` (crawl frontier) and
``normalise_domain`` (one row per site).  Parsing is one regular expression: ``parse_url`` raises on bad URLs, gives
NULL for hosts with underscores and drops ports.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
MAX_URL_LENGTH = 2000


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, PARTS, 1))


def netloc(url: Column) -> Column:
    """Authority as written, with user, port and case."""
    return F.regexp_extract(url, PARTS, 2)


def path(url: Column) -> Column:
    return F.regexp_extract(url, PARTS, 3)


def query(url: Column) -> Column:
    return F.regexp_extract(url, PARTS, 4)


def split_url(url: Column) -> Column:
    """struct<scheme, netloc, path, query, fragment>."""
    return F.struct(
        scheme(url).alias("scheme"), netloc(url).alias("netloc"), path(url).alias("path"), query(url).alias("query"), F.regexp_extract(url, PARTS, 5).alias("fragment")
    )


def without_www(host: Column) -> Column:
    return F.regexp_replace(host, "^www\\.", "")


def join_parts(sch: Column, host: Column, rest: Column) -> Column:
    front = F.when(host != "", F.concat(F.when(sch != "", F.concat(sch, F.lit("://"))).otherwise("//"), host))
    return F.concat(front.otherwise(F.when(sch != "", F.concat(sch, F.lit(":"))).otherwise("")), rest)


def canonicalise(url: Column) -> Column:
    """Lower-case scheme and host without ``www.``, path without trailing slashes; parameters, query, fragment dropped."""
    trimmed = F.regexp_replace(F.regexp_replace(path(url), ";[^/]*$", ""), "/+$", "")
    return join_parts(scheme(url), without_www(F.lower(netloc(url))), F.when(trimmed == "", "/").otherwise(trimmed))


def quote_plus(text: Column) -> Column:
    """Percent-encoding with + for blanks; Spark's own leaves * and writes ~ as %7E."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def unquote_plus(text: Column) -> Column:
    """Decoded text; as written if its escapes are broken."""
    return F.coalesce(F.try_url_decode(text), text)


def query_pairs(q: Column) -> Column:
    """array<struct<k, v>> in order, blank values kept, empty items dropped."""
    items = F.filter(F.split(q, "&"), lambda x: x != "")
    return F.transform(
        items,
        lambda x: F.struct(
            unquote_plus(F.substring_index(x, "=", 1)).alias("k"),
            F.when(F.contains(x, F.lit("=")), unquote_plus(F.substring(x, F.instr(x, "=") + 1, F.length(x)))).otherwise("").alias("v"),
        ),
    )


def canonicalise_query(url: Column) -> Column:
    """Tracking parameters (``utm_``) and fragment dropped, others sorted; host and path kept as written."""
    kept = F.array_sort(F.filter(query_pairs(query(url)), lambda p: ~F.startswith(p["k"], F.lit("utm_"))))
    text = F.array_join(F.transform(kept, lambda p: F.concat(quote_plus(p["k"]), F.lit("="), quote_plus(p["v"]))), "&")
    return join_parts(scheme(url), netloc(url), F.concat(path(url), F.when(text != "", F.concat(F.lit("?"), text)).otherwise("")))


def normalise_domain(url: Column) -> Column:
    """Host of a URL, lower-case, without ``www.``; anything without a literal http(s):// prefix is taken whole."""
    plain = F.startswith(url, F.lit("http://")) | F.startswith(url, F.lit("https://"))
    return without_www(F.lower(F.when(plain, netloc(url)).otherwise(url)))


def validate_url(url: Column, max_length: int = MAX_URL_LENGTH) -> Column:
    return F.coalesce((F.length(url) <= max_length) & url.rlike(r"^(?i)https?://[^/?#]+"), F.lit(False))


def validate_url_strict(url: Column, max_length: int = MAX_URL_LENGTH) -> Column:
    """The older rule: file:, data: and javascript: are refused anywhere in the URL."""
    return validate_url(url, max_length) & ~F.coalesce(url.rlike("(?i)(file|data|javascript):"), F.lit(False))


def blocked(url: Column, patterns: Sequence[str]) -> Column:
    """A pattern with a leading dot is a suffix of the path, any other a suffix of the host."""
    host, p = F.lower(netloc(url)), F.lower(path(url))
    out = F.lit(False)
    for x in patterns:
        out = out | (F.endswith(p, F.lit(x)) if x.startswith(".") else F.endswith(host, F.lit(x)))
    return out


def domain_blocked(url: Column, domains: Sequence[str]) -> Column:
    """Exact match of the host without ``www.``."""
    return F.coalesce(without_www(F.lower(netloc(url))).isin(*domains), F.lit(False)) if domains else F.lit(False)


def is_priority(url: Column, parts: Sequence[str]) -> Column:
    """Any of the parts anywhere in the lower-cased URL, host included."""
    return F.exists(F.array(*[F.lit(p) for p in parts]), lambda p: F.contains(F.lower(url), p))


def same_site(url: Column, domain: Column) -> Column:
    """The domain is contained in the link's host: sub-domains pass, and so does x.com.evil.org."""
    return F.contains(normalise_domain(netloc(url)), domain)


def is_mailto(href: Column) -> Column:
    return F.startswith(F.lower(F.trim(href)), F.lit("mailto:"))


def is_pdf(url: Column) -> Column:
    return F.endswith(F.lower(url), F.lit(".pdf"))


def naive_same_site(href: Column, domain: Column) -> Column:
    """The older link filter: root-relative, or naming the domain."""
    return F.startswith(href, F.lit("/")) | F.contains(href, domain)


def display_link(url: Column) -> Column:
    return F.get(F.split(url, "/"), F.lit(2))


def search_url(template: str, query_text: Column) -> Column:
    """A search address: blanks become +, put in place of ``{}``."""
    before, _, after = template.partition("{}")
    return F.concat(F.lit(before), F.replace(query_text, F.lit(" "), F.lit("+")), F.lit(after))


def cache_key(text: Column) -> Column:
    return F.trim(F.lower(text))


def debug_filename(url: Column) -> Column:
    """<host>_<path>.html with everything else than letters, digits, dot, dash as underscore."""
    name = F.concat(netloc(url), F.lit("_"), F.regexp_replace(F.regexp_replace(path(url), "^/+|/+$", ""), "^$", "index"))
    return F.concat(F.regexp_replace(name, "[^A-Za-z0-9._-]", "_"), F.lit(".html"))


def fetch_candidates(url: Column) -> Column:
    """array<struct<pos, url>> in order of trial: as given, with ``www.``, over plain http."""
    rest = F.regexp_extract(url, r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://(.*)$", 1)
    www = F.when(F.startswith(rest, F.lit("www.")), rest).otherwise(F.concat(F.lit("www."), rest))
    options = [url, F.concat(scheme(url), F.lit("://"), www), F.concat(F.lit("http://"), rest)]
    return F.array(*[F.struct(F.lit(i).alias("pos"), u.alias("url")) for i, u in enumerate(options)])


def sitemap_hosts(domain: Column) -> Column:
    """The domain alone if it has over two labels, else also with ``www.``."""
    return F.when(F.size(F.split(domain, "\\.")) > 2, F.array(domain)).otherwise(F.array(domain, F.concat(F.lit("www."), domain)))


def resolve_simple(base: Column, href: Column) -> Column:
    """Reference resolution for all links but relative paths and dot segments, which give NULL (see ``resolve``)."""
    h = F.trim(href)
    root = F.concat(scheme(base), F.lit("://"), netloc(base))
    dots = path(h).rlike(r"(^|/)\.\.?(/|$)")
    return (
        F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.when(dots, F.lit(None)).otherwise(h))
        .when(dots, F.lit(None))
        .when(F.startswith(h, F.lit("//")), F.concat(scheme(base), F.lit(":"), h))
        .when(F.startswith(h, F.lit("/")), F.concat(root, h))
        .when(h == "", F.regexp_replace(base, "#.*$", ""))
        .when(F.startswith(h, F.lit("?")), F.concat(root, path(base), h))
        .when(F.startswith(h, F.lit("#")), F.concat(F.regexp_replace(base, "#.*$", ""), h))
    )


def resolve_exact():
    """Arrow UDF over the standard library's urljoin."""
    @F.pandas_udf("string")
    def join(base: pd.Series, href: pd.Series) -> pd.Series:
        from urllib.parse import urljoin

        def one(b, h):
            try:
                return None if b is None or h is None else urljoin(b, h.strip())
            except ValueError:
                return None

        return pd.Series([one(b, h) for b, h in zip(base, href, strict=True)])

    return join


def join_url(base: Column, rel: Column) -> Column:
    """Absolute links as they are, others below the base (https by default); leading slashes of the link are dropped."""
    has = lambda c: F.startswith(c, F.lit("http://")) | F.startswith(c, F.lit("https://"))
    full = F.when(has(base), base).otherwise(F.concat(F.lit("https://"), base))
    folder = F.concat(scheme(full), F.lit("://"), netloc(full), F.when(path(full) == "", "/").otherwise(F.regexp_replace(path(full), "[^/]*$", "")))
    return F.when(has(rel), rel).otherwise(F.concat(folder, F.regexp_replace(rel, "^/+", "")))
