"""The whole discovery run as one plan: companies to (Company, Domain, Email)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PRIORITY_PARTS, words
from ..functions import decoders, emails, html, scoring, urls
from ..operators import frontier, ranking, sitemaps, suffixes
from ..runtime import cut


def resolve_domains(companies: DataFrame, results: DataFrame, *, threshold: float = scoring.THRESHOLD, most: int = 10, rules: DataFrame | None = None) -> DataFrame:
    """companies with best link, score, domain and status: no_google, domain_unclear, skipped_domain or domain.

    The first company by ``input_pos`` that reaches a domain keeps it; later ones are skipped.  ``rules``: a table of
    public suffixes (``suffixes.split_hosts``); without one, suffixes of two labels are told by a rule.
    """
    ranked = results.where((F.col("rank") <= most) & (F.coalesce(F.length("link"), F.lit(0)) > 0))
    pairs = companies.join(ranked, "company").select("input_pos", "company", "rank", "link")
    if rules is None:
        scored = pairs.withColumn("score", scoring.score_domain(F.col("company"), F.col("link")))
    else:
        split = suffixes.split_hosts(pairs.withColumn("host", urls.normalise_domain(F.col("link"))), "host", rules, private=False, unlisted=0)
        scored = split.withColumn("score", scoring.score_parts(F.col("company"), F.col("link"), F.struct("domain", "subdomain"))).select(*pairs.columns, "score")
    best = ranking.best_by(scored, "input_pos", "score", "rank", "link")
    any_hit = results.select("company").distinct().withColumn("found", F.lit(True))
    out = companies.join(best, "input_pos", "left").join(any_hit, "company", "left")
    out = out.withColumn("domain", F.when(F.col("score") >= threshold, urls.normalise_domain(F.col("link"))))
    first = out.where("domain is not null").groupBy("domain").agg(F.min("input_pos").alias("winner"))
    out = out.join(first, "domain", "left")
    status = (
        F.when(F.col("found").isNull(), "no_google")
        .when(F.col("domain").isNull(), "domain_unclear")
        .when(F.col("winner") != F.col("input_pos"), "skipped_domain")
        .otherwise("domain")
    )
    return out.select("input_pos", "company", "link", F.coalesce("score", F.lit(0.0)).alias("score"), "domain", status.alias("status"))


def page_addresses(responses: DataFrame, *, mode: str = "first", process_pdfs: bool = False) -> DataFrame:
    """(url, email) of responses that answered: HTML by the cascade, all else as plain text; PDF files only if wanted.

    The page itself is projected away before any shuffle; only addresses go through the Python step for xn-- hosts.
    """
    ok = responses.where(F.col("status").between(200, 299))
    if not process_pdfs:
        ok = ok.where(~urls.is_pdf(F.col("url")))
    is_html = F.contains(F.coalesce("content_type", F.lit("")), F.lit("html"))
    read = F.when(is_html, decoders.cascade(F.col("text"), F.col("rendered_html"), mode=mode)).otherwise(emails.addresses_in(F.col("text")))
    found = ok.select("url", F.explode(read).alias("email")).distinct()
    return found.select("url", emails.unicode_address(F.col("email")).alias("email")).distinct()


def page_links(responses: DataFrame) -> DataFrame:
    """(src, link_pos, dst): links of pages, resolved, canonical, of the same site, mail addresses left out."""
    each = responses.select(F.col("url").alias("src"), F.posexplode(html.hrefs(F.col("text"))).alias("link_pos", "href"))
    each = each.where(~urls.is_mailto(F.col("href")))
    simple = each.withColumn("dst", urls.resolve_simple(F.col("src"), F.col("href")))
    easy = simple.where("dst is not null")
    hard = simple.where("dst is null").withColumn("dst", urls.resolve_exact()(F.col("src"), F.col("href")))
    out = easy.unionByName(hard).where(urls.validate_url(F.col("dst")))
    out = out.where(urls.same_site(F.col("dst"), urls.normalise_domain(F.col("src"))))
    return out.select("src", "link_pos", urls.canonicalise_query(F.col("dst")).alias("dst"))


def run(
    companies: DataFrame,
    results: DataFrame,
    responses: DataFrame,
    bodies: DataFrame,
    robots: DataFrame,
    *,
    threshold: float = scoring.THRESHOLD,
    parts: Sequence[str] = words(PRIORITY_PARTS),
    page_limit: int = 12,
    save_domain_only: bool = False,
    mode: str = "first",
    process_pdfs: bool = False,
    rules: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(results, flags): distinct (Company, Domain, Email) rows in order of the input, and a row of 0/1 flags for each company.

    Home page and priority pages of the sitemap first; only domains that gave nothing are crawled.
    """
    resolved = cut(resolve_domains(companies, results, threshold=threshold, rules=rules))
    own = resolved.where("status = 'domain'").select("input_pos", "company", "domain")
    pages = responses.withColumn("key", urls.canonicalise_query(F.col("url")))
    addresses = cut(page_addresses(pages.withColumn("url", F.col("key")), mode=mode, process_pdfs=process_pdfs))
    home = own.select("domain", urls.canonicalise_query(F.concat(F.lit("https://"), "domain")).alias("url"))
    found = sitemaps.discover(own.select("domain"), bodies, robots)
    listed = sitemaps.pages_of(found, bodies)
    priority = sitemaps.priority_pages(listed, parts, page_limit).select("domain", urls.canonicalise_query(F.col("url")).alias("url"))
    first = cut(home.unionByName(priority).distinct().join(addresses, "url").select("domain", "email").distinct())
    empty = own.join(first, "domain", "left_anti").select("domain")
    start = empty.select("domain", urls.canonicalise_query(F.concat(F.lit("https://"), "domain")).alias("url"))
    answering = pages.where(F.col("status").between(200, 299)).select(F.col("key").alias("url")).distinct()
    crawled = frontier.crawl(start, page_links(pages.withColumn("url", F.col("key"))), limit=page_limit, ok=answering)
    found_emails = first.unionByName(crawled.join(addresses, "url").select("domain", "email")).distinct()
    rows = own.join(found_emails, "domain", "left" if save_domain_only else "inner")
    named = rows.select("input_pos", F.col("company").alias("Company"), F.col("domain").alias("Domain"), F.col("email").alias("Email"))
    out = named.groupBy("Company", "Domain", "Email").agg(F.min("input_pos").alias("input_pos")).orderBy("input_pos", "Email").drop("input_pos")
    has_email = found_emails.select("domain").distinct().withColumn("has_email", F.lit(True))
    has_map = priority.select("domain").distinct().withColumn("has_map", F.lit(True))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    status = lambda s: flag(F.col("status") == s)
    wide = resolved.join(has_email, "domain", "left").join(has_map, "domain", "left")
    is_domain = F.col("status") == "domain"
    flags = wide.select(
        "input_pos", F.lit(1).alias("leads"), status("no_google").alias("no_google"), F.lit(0).alias("google_error"), status("domain_unclear").alias("domain_unclear"),
        F.lit(0).alias("domain_error"), status("skipped_domain").alias("skipped_domain"), status("domain").alias("domain"), flag(is_domain & F.col("has_map")).alias("sitemap"),
        flag(is_domain & F.col("has_email")).alias("with_email"), flag(is_domain & F.col("has_email").isNull()).alias("without_email"), F.lit(0).alias("processing_error"),
    )
    return out, flags
