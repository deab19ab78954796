"""A query for each family of operators over the driver's tables, and the same in SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import clamp_column, words_column
from ..functions import decoders, emails, html, scoring, sql, urls
from ..operators import cache, frontier, joins, pacing, ranking, similarity, sitemaps, stats, suffixes
from ..runtime import ship
from . import discovery

BLOCKED = ["example.org", ".html"]


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


def micros(ts: str = "ts"):
    """Microseconds since 2024, whatever the session's time zone and whichever kind of timestamp."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', cast({ts} as timestamp_ntz))")


def seconds(ts: str = "ts"):
    return micros(ts) / 1e6


# Addresses


def emails_from_text(s, d):
    rows = read(s, d, "documents").select("doc_id", F.explode(emails.addresses_in(F.col("text"))).alias("email"))
    return rows.distinct()


def emails_validate(s, d):
    raw = read(s, d, "documents").select("doc_id", F.explode(emails.find_emails(F.col("text"))).alias("raw")).distinct()
    return raw.select("doc_id", "raw", emails.is_valid_email(F.lower("raw")).alias("valid"))


def emails_strict(s, d):
    return read(s, d, "documents").select("doc_id", F.explode(emails.addresses_in_strict(F.col("text"))).alias("email")).distinct()


def emails_from_pages(s, d):
    return read(s, d, "pages").select("page_id", F.explode(decoders.cascade(F.col("html"))).alias("email"))


def emails_per_url_joined(s, d):
    return stats.emails_per_url(read(s, d, "pages").select("url", F.explode(decoders.cascade(F.col("html"))).alias("email")))


def emails_distinct_count(s, d):
    return stats.distinct_emails(emails_from_text(s, d), "email")


def emails_blacklist_anti(s, d):
    banned = s.createDataFrame([("mail1.example.com",), ("mail2.example.com",)], "host string")
    rows = emails_from_text(s, d).withColumn("host", F.substring_index("email", "@", -1))
    return joins.unless(rows, F.broadcast(banned), "host").select("doc_id", "email")


def emails_masked(s, d):
    return emails_from_text(s, d).select("doc_id", emails.mask(F.col("email")).alias("masked"), emails.pseudonym(F.col("email")).alias("pseudonym"))


def deobf_at_dot(s, d):
    i = F.col("doc_id").cast("string")
    text = F.concat(F.lit("Write to user"), i, F.lit(" [at] host"), i, F.lit(" (dot) sub [ dot ] de today, or x"), i, F.lit(" at mail dot org now"))
    return read(s, d, "documents").select("doc_id", F.explode(emails.addresses_in(text)).alias("email"))


def _address():
    return F.concat(F.lit("name"), F.col("doc_id").cast("string"), F.lit("@mail.example.de"))


def deobf_cfemail(s, d):
    key = F.col("doc_id") % 200 + 17
    codes = F.transform(F.split(F.col("a"), ""), lambda c: F.ascii(c))
    hexed = F.lower(F.array_join(F.transform(codes, lambda n: F.lpad(F.hex(n.cast("bigint").bitwiseXOR(F.col("k"))), 2, "0")), ""))
    rows = read(s, d, "documents").select("doc_id", _address().alias("a"), key.alias("k"))
    rows = rows.select("doc_id", F.concat(F.lower(F.lpad(F.hex("k"), 2, "0")), hexed).alias("cf"))
    return rows.select("doc_id", "cf", decoders.decode_cfemail(F.col("cf")).alias("email")).drop("cf")


def deobf_charcode(s, d):
    codes = F.array_join(F.transform(F.split(F.col("a"), ""), lambda c: F.ascii(c).cast("string")), ",")
    rows = read(s, d, "documents").select("doc_id", _address().alias("a"))
    return rows.select("doc_id", decoders.decode_charcodes(F.concat(F.lit("x=String.fromCharCode("), codes, F.lit(");"))).alias("email"))


def deobf_base64(s, d):
    text = F.concat(F.lit("please write to the desk: "), F.col("a"), F.lit(" thanks"))
    rows = read(s, d, "documents").select("doc_id", _address().alias("a"))
    block = F.regexp_replace(F.base64(F.encode(text, "UTF-8")), "\\s", "")  # Spark breaks lines after 76 characters, a script's string has none
    return rows.select("doc_id", decoders.decode_base64_blocks(F.concat(F.lit("v='"), block, F.lit("'"))).alias("text"))


def deobf_rot13(s, d):
    return read(s, d, "documents").select("doc_id", decoders.rot13(F.col("text")).alias("text"))


def extract_cascade(s, d):
    a = _address()
    kind = F.col("doc_id") % 3
    page = (
        F.when(kind == 0, F.concat(F.lit('<p>see <a href="mailto:'), a, F.lit('?subject=x">us</a></p>')))
        .when(kind == 1, F.concat(F.lit('<p>visible@site.de</p><a href="mailto:'), a, F.lit('">us</a>')))
        .otherwise(F.concat(F.lit('<span data-cfemail="4223620a20"></span><p>'), a, F.lit("</p><script>var z='hidden@site.de'</script>")))
    )
    return read(s, d, "documents").select("doc_id", F.explode(decoders.cascade(page)).alias("email"))


# URLs


def url_normalise_domain(s, d):
    return read(s, d, "pages").select("page_id", urls.normalise_domain(F.col("url")).alias("domain"))


def url_canonicalise(s, d):
    return read(s, d, "pages").select("page_id", urls.canonicalise(F.col("url")).alias("canonical"))


def url_canonicalise_query(s, d):
    return read(s, d, "pages").select("page_id", urls.canonicalise_query(F.col("url")).alias("canonical"))


def url_validate(s, d):
    cases = F.array("url", F.replace("url", F.lit("http"), F.lit("ftp")), F.replace("url", F.lit("://"), F.lit(":///")), F.concat("url", F.repeat(F.lit("a"), 2000)))
    rows = read(s, d, "pages").select("page_id", F.posexplode(cases).alias("n", "u"))
    return rows.select("page_id", "n", urls.validate_url(F.col("u")).alias("valid"))


def url_dedupe_first(s, d):
    rows = read(s, d, "pages").select("page_id", urls.canonicalise(F.col("url")).alias("canonical"))
    return ranking.first_per(rows, "canonical", ["page_id"])


def url_domain_counts(s, d):
    return read(s, d, "pages").groupBy(urls.normalise_domain(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))


def url_domain_topk(s, d):
    rows = read(s, d, "pages").select("page_id", urls.normalise_domain(F.col("url")).alias("domain"))
    return ranking.top_per(rows, "domain", ["page_id"], 12)


def url_blocked_filter(s, d):
    return read(s, d, "pages").where(~urls.blocked(F.col("url"), BLOCKED)).select("page_id", "url")


def url_priority_filter(s, d):
    return read(s, d, "pages").where(urls.is_priority(F.col("url"), ["casino", "/de/"])).select("page_id", "url")


def url_candidates(s, d):
    rows = read(s, d, "pages").select("page_id", F.explode(urls.fetch_candidates(F.col("url"))).alias("c"))
    return rows.select("page_id", "c.pos", "c.url")


def url_fetch_first(s, d):
    """Pages asked for without www. and answered where the table has them, by the first candidate that is there."""
    pages = read(s, d, "pages").select("page_id", "url")
    asked = pages.select("page_id", F.replace("url", F.lit("://www."), F.lit("://")).alias("url"))
    return joins.first_response(asked, pages.select("url", F.lit(200).alias("status")).distinct()).select("page_id", "pos", "fetched")


def links_extract(s, d):
    return read(s, d, "pages").select("page_id", F.posexplode(html.hrefs(F.col("html"))).alias("link_pos", "href"))


def links_resolve_same_site(s, d):
    pages = read(s, d, "pages").select("url", F.col("html").alias("text"))
    return discovery.page_links(pages)


# Companies and domains


def company_clean(s, d):
    suffix = F.element_at(F.array(*[F.lit(x) for x in (" GmbH", " Inc.", " & Co.", " Limited", "")]), (F.col("s_suppkey") % 5 + 1).cast("int"))
    return read(s, d, "supplier").select("s_suppkey", scoring.clean_company_name(F.concat("s_name", suffix)).alias("base"))


def domain_split(s, d):
    hosts = F.array(urls.normalise_domain(F.col("url")), F.lit("shop.firm.co.uk"), F.lit("localhost"))
    rows = read(s, d, "pages").select("page_id", F.posexplode(hosts).alias("n", "host"))
    p = scoring.split_domain(F.col("host"))
    return rows.select("page_id", "n", p["subdomain"].alias("subdomain"), p["domain"].alias("domain"), p["suffix"].alias("suffix"))


def _leads(s, d):
    """Companies named after hosts, and results that hold the right host second; some names are too short."""
    pages = read(s, d, "pages")
    host = urls.normalise_domain(F.col("url"))
    label = scoring.split_domain(host)["domain"]
    lead = pages.select(F.col("page_id").alias("input_pos"), host.alias("host"), label.alias("label"))
    companies = lead.select("input_pos", F.when(F.col("input_pos") % 7 == 0, F.lit("Q!")).otherwise(F.concat(F.initcap("label"), F.lit(" GmbH"))).alias("company"), "host")
    links = F.array(F.concat(F.lit("https://www.linkedin.com/company/"), F.col("input_pos").cast("string")), F.concat(F.lit("https://www."), "host", F.lit("/")))
    results = companies.select("input_pos", "company", F.posexplode(links).alias("p", "link")).select("input_pos", "company", (F.col("p") + 1).alias("rank"), "link")
    return companies, results


def domain_score(s, d):
    companies, results = _leads(s, d)
    rows = results.where("rank = 2")
    return rows.select("input_pos", scoring.score_domain(F.col("company"), F.col("link")).alias("score"))


def domain_best(s, d):
    _, results = _leads(s, d)
    scored = results.withColumn("score", scoring.score_domain(F.col("company"), F.col("link")))
    return ranking.best_by(scored, "input_pos", "score", "rank", "link")


def domain_score_fuzzy(s, d):
    """Suppliers and hosts that are similar to 40 and more: through the index of q-grams, not by all pairs."""
    hosts = read(s, d, "pages").select(urls.normalise_domain(F.col("url")).alias("host"))
    found = similarity.scored_pairs(read(s, d, "supplier").select(F.col("s_name").alias("company")), hosts, 40)
    rows = read(s, d, "supplier").join(found, F.col("s_name") == F.col("company"))
    return rows.select("s_suppkey", "host", F.round("score", 6).alias("score"))


def _named(s, d):
    """Companies called by digests of the suppliers' names, so that they differ."""
    return read(s, d, "supplier").select("s_suppkey", F.concat(F.substring(F.md5("s_name"), 1, 14), F.lit(" GmbH")).alias("company"))


def domain_score_join(s, d):
    """Companies and similar hosts, out of the hosts of pages and of hosts that lack, repeat or turn letters of names."""
    named = _named(s, d).withColumn("b", F.substring("company", 1, 14))
    made = F.array(
        F.concat(F.lit("www."), F.substring("b", 1, 5), F.substring("b", 7, 8), F.lit(".com")), F.concat("b", F.lit("-"), F.substring("b", 1, 3), F.lit(".co.uk")),
        F.concat(F.reverse("b"), F.lit(".net")), F.concat(F.substring("b", 1, 12), F.lit(".linkedin.com")), F.concat(F.substring("b", 3, 4), F.lit(".de")),
    )
    hosts = named.select(F.explode(made).alias("host")).unionByName(read(s, d, "pages").select(urls.normalise_domain(F.col("url")).alias("host")))
    return similarity.scored_pairs(named, hosts, 70).select("company", "host", F.round("score", 6).alias("score"))


def _hits(s, d):
    """Five hits for each part by name and brand: letters missing, a portal, letters turned, a beginning, the same again."""
    part = read(s, d, "part").repartition(int(s.conf.get("spark.sql.shuffle.partitions")), "p_partkey")  # few bytes, much work
    p = part.select("p_partkey", F.concat("p_name", F.lit(" "), "p_brand", F.lit(" Ltd.")).alias("company"))
    base = F.regexp_replace(F.lower("company"), " ltd[.]$|[^a-z0-9]", "")
    short = F.substring(base, F.lit(1), 4 + F.col("p_partkey") % 9)
    links = F.array(
        F.concat(F.lit("https://www."), F.regexp_replace(base, "[aeiou]", ""), F.lit(".com/")), F.concat(F.lit("https://"), base, F.lit(".linkedin.com/in")),
        F.concat(F.lit("http://"), F.reverse(base), F.lit(".example.co.uk/x")), F.concat(F.lit("https://shop."), short, F.lit("x.de/")), F.concat(F.lit("https://b."), short, F.lit("x.fr/")),
    )
    return p.select("p_partkey", "company", F.posexplode(links).alias("rank", "link"))


def domain_score_names(s, d):
    return _hits(s, d).select("p_partkey", "rank", F.round(scoring.score_domain(F.col("company"), F.col("link")), 6).alias("score"))


def domain_best_names(s, d):
    """The best hit of each part; hits of equal score go by rank."""
    scored = _hits(s, d).withColumn("score", F.round(scoring.score_domain(F.col("company"), F.col("link")), 6))
    return ranking.best_by(scored, "p_partkey", "score", "rank", "link")


#: Rules of the kinds that a registry's list has.
SUFFIX_RULES = ["com", "org", "net", "de", "uk", "co.uk", "us", "ca.us", "k12.ca.us", "io", "github.io", "*.ck", "!www.ck", "jp", "*.kawasaki.jp", "!city.kawasaki.jp"]


def domain_split_rules(s, d):
    """Hosts of pages under endings of every kind, split by a table of rules."""
    ends = ["", ".co.uk", ".k12.ca.us", ".ca.us", ".github.io", ".shop.ck", ".www.ck", ".ck", ".town.kawasaki.jp", ".city.kawasaki.jp", ".unlisted"]
    host = urls.normalise_domain(F.col("url"))
    rows = read(s, d, "pages").select("page_id", F.posexplode(F.transform(F.array(*map(F.lit, ends)), lambda e: F.concat(host, e))).alias("n", "host"))
    return suffixes.split_hosts(rows, "host", s.createDataFrame([(r,) for r in SUFFIX_RULES], "rule string"))


def resolve_first_wins(s, d):
    companies, results = _leads(s, d)
    named = companies.select("input_pos", F.concat("company", F.when(F.col("input_pos") % 11 == 0, F.lit(" unknown")).otherwise("")).alias("company"))
    hits = results.where("rank = 2 and input_pos % 11 != 0").groupBy("company", "link").agg(F.lit(1).alias("rank"), F.min("input_pos").alias("p"))
    one = ranking.first_per(hits, "company", ["p"]).select("company", "rank", "link")
    return discovery.resolve_domains(named, one).select("input_pos", "score", "domain", "status")


def result_rows(s, d):
    """Results of the documents read as sites: a row for each address, a NULL for sites without any."""
    docs = read(s, d, "documents")
    sites = docs.groupBy("source").agg(F.min("doc_id").alias("first_doc"))
    found = docs.select("source", F.explode(emails.addresses_in(F.col("text"))).alias("Email")).distinct()
    rows = sites.join(found, "source", "left")
    return ranking.distinct_rows(rows.select(F.concat(F.lit("Company "), F.col("first_doc").cast("string")).alias("Company"), F.col("source").alias("Domain"), "Email"))


def run_summary(s, d):
    rows = result_rows(s, d)
    per = rows.groupBy("Domain").agg(F.count("Email").alias("n"))
    flags = per.select(*[F.lit(1 if f in ("leads", "domain") else 0).alias(f) for f in stats.FLAGS if f not in ("with_email", "without_email")], (F.col("n") > 0).cast("int").alias("with_email"), (F.col("n") == 0).cast("int").alias("without_email"))
    responses = read(s, d, "events").select((F.floor("value") % 500 + 100).cast("int").alias("status"))
    return stats.summary(flags, responses, rows).drop("runtime")


# Crawl and sitemaps


def _site_links(s, d):
    pages = read(s, d, "pages").select("page_id")
    n = pages.agg(F.count("*").alias("n"))
    rows = pages.join(F.broadcast(n))  # one row
    to = F.array((F.col("page_id") * 2 + 1) % F.col("n"), (F.col("page_id") * 2 + 2) % F.col("n"))  # from page 0 all are reached
    return rows.select(F.col("page_id").cast("string").alias("src"), F.posexplode(to).alias("link_pos", "t")).select("src", "link_pos", F.col("t").cast("string").alias("dst"))


def crawl_bfs(s, d):
    seeds = s.createDataFrame([("site", "0")], "domain string, url string")
    return frontier.crawl(seeds, _site_links(s, d)).select("domain", F.col("url").cast("long").alias("page_id"), "depth")


def crawl_bfs_limited(s, d):
    seeds = s.createDataFrame([("site", "0")], "domain string, url string")
    return frontier.crawl(seeds, _site_links(s, d), limit=40).select("domain", F.col("url").cast("long").alias("page_id"), "depth", "visit")


def _sitemap_bodies(s, d):
    rows = read(s, d, "pages").select(urls.normalise_domain(F.col("url")).alias("domain"), "page_id", "url")
    listed = rows.groupBy("domain").agg(F.array_sort(F.collect_list(F.struct("page_id", "url"))).alias("l"))
    entry = F.transform("l", lambda x: F.concat(F.lit("<url><loc> "), F.replace(x["url"], F.lit("&"), F.lit("&amp;")), F.lit(" </loc></url>")))
    text = F.concat(F.lit('<?xml version="1.0"?><urlset>'), F.array_join(entry, ""), F.lit("</urlset>"))
    return listed.select(F.concat(F.lit("https://"), "domain", F.lit("/sitemap.xml")).alias("url"), F.encode(text, "UTF-8").alias("body"))


def _sitemap_pages(s, d):
    domains = read(s, d, "pages").select(urls.normalise_domain(F.col("url")).alias("domain")).distinct()
    bodies = _sitemap_bodies(s, d)
    robots = s.createDataFrame([], "domain string, text string")
    return sitemaps.pages_of(sitemaps.discover(domains, bodies, robots, most_bytes=None), bodies, most=None, most_bytes=None)


def sitemap_locs(s, d):
    return _sitemap_pages(s, d).select("domain", "pos", "url")


def sitemap_priority(s, d):
    return sitemaps.priority_pages(_sitemap_pages(s, d), ["/en/", "/de/"], 12)


def sitemap_nested(s, d):
    """Pages behind circles of indexes: index i of a site names index i + 1 and the sitemaps of three pages."""
    rows = read(s, d, "pages").select(urls.normalise_domain(F.col("url")).alias("domain"), "page_id", "url")
    k = F.row_number().over(Window.partitionBy("domain").orderBy("page_id", "url")) - 1
    pages = rows.select("domain", "url", k.alias("k"), F.floor(k / 3).cast("int").alias("i"))
    listed = pages.groupBy("domain").agg((F.max("i") + 1).alias("n"))
    at = lambda kind, i: F.concat(F.lit("https://"), F.col("domain"), F.lit(f"/{kind}"), i.cast("string"), F.lit(".xml"))
    entry = lambda tag, u: F.concat(F.lit(f"<{tag}><loc>"), F.replace(u, F.lit("&"), F.lit("&amp;")), F.lit(f"</loc></{tag}>"))
    index = pages.groupBy("domain", "i").agg(F.max("k").alias("last")).join(listed, "domain")
    own = F.transform(F.sequence(F.col("i") * 3, F.col("last")), lambda k: at("u", k))
    inner = F.array_join(F.transform(F.concat(F.array(at("i", (F.col("i") + 1) % F.col("n"))), own), lambda u: entry("sitemap", u)), "")
    indexes = index.select(at("i", F.col("i")).alias("url"), F.concat(F.lit("<sitemapindex>"), inner, F.lit("</sitemapindex>")).alias("text"))
    leaves = pages.select(at("u", F.col("k")).alias("url"), F.concat(F.lit("<urlset>"), entry("url", F.col("url")), F.lit("</urlset>")).alias("text"))
    bodies = indexes.unionByName(leaves).select("url", F.encode("text", "UTF-8").alias("body"))
    return sitemaps.pages_of(listed.select("domain", at("i", F.lit(0)).alias("url")), bodies).select("domain", "sitemap_url", "url")


# State and pacing


def _cache_log(s, d):
    e = read(s, d, "events")
    return e.select(F.concat(F.lit("k"), (F.col("user_id") % 100).cast("string")).alias("key"), F.when(F.col("event_type") != "purchase", F.concat("event_type", F.lit("-"), F.col("event_id").cast("string"))).alias("value"), seconds().alias("ts"))


def cache_latest(s, d):
    return cache.latest(_cache_log(s, d)).select("key", "value")


def cache_prune(s, d):
    log = _cache_log(s, d)
    now = log.agg(F.max("ts").alias("now"))
    rows = cache.latest(log).join(F.broadcast(now))  # one row
    return cache.prune(rows, F.col("now"), ttl=864000.0, max_size=20).select("key", "value")


def cache_ttl_lookup(s, d):
    log = _cache_log(s, d)
    asks = read(s, d, "events").select(F.col("event_id"), F.concat(F.lit("k"), ((F.col("user_id") + 1) % 100).cast("string")).alias("key"), seconds().alias("at"))
    return cache.lookup(asks, log, ttl=86400.0).select("event_id", "key", "value")


def rate_min_interval(s, d):
    e = read(s, d, "events").withColumn("key", F.col("user_id") % 50)
    out = pacing.min_interval(e, "key", F.floor(seconds()).cast("double"), rate=0.01)
    return out.select("key", "n", F.round("wait", 2).alias("wait"))


def rate_global_interval(s, d):
    """The whole log as one sequence, paced by a prefix scan over ranges of time."""
    out = pacing.min_interval(read(s, d, "events"), None, F.floor(seconds()).cast("double"), rate=0.01)
    return out.select("n", "arrive", F.round("wait", 2).alias("wait"))


def token_bucket_global(s, d):
    out = pacing.token_bucket(read(s, d, "events"), None, F.floor(seconds()).cast("double"), rate=1 / 256, capacity=40)
    return out.select("n", "arrive", F.round("wait", 2).alias("wait"))


def progress_global(s, d):
    """Progress over all order lines, weighted by quantity, in order of shipping."""
    rows = read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", F.col("l_quantity").cast("long").alias("q"))
    out = ranking.running_count(rows, ["l_shipdate", "l_orderkey", "l_linenumber", "q"], 1_000_000, step=F.col("q"))
    return out.select("l_orderkey", "l_linenumber", "current", "percent")


def token_bucket_wait(s, d):
    e = read(s, d, "events").withColumn("key", F.col("user_id") % 50)
    out = pacing.token_bucket(e, "key", F.floor(seconds()).cast("double"), rate=1 / 8192, capacity=3)
    return out.select("key", "n", F.round("wait", 2).alias("wait"))


def backoff_schedule(s, d):
    rows = read(s, d, "nation").select("n_nationkey", (F.col("n_nationkey") % 6).alias("attempts"))
    return rows.select("n_nationkey", F.posexplode(pacing.quota_backoff(F.col("attempts"))).alias("attempt", "sleep"))


def _responses(s, d):
    v = F.floor(F.abs("value")) % 600
    return read(s, d, "events").select("event_id", F.when(v >= 100, v.cast("int")).alias("status"))


def status_histogram(s, d):
    return stats.status_histogram(_responses(s, d))


def request_totals(s, d):
    return stats.request_totals(_responses(s, d), F.col("event_id") % 9 == 0)


def worker_stats(s, d):
    tasks = read(s, d, "events").select("event_type", (F.floor(F.abs("value")) % 5 != 0).alias("success"), (F.col("event_id") % 4 + 1).cast("double").alias("duration"))
    return stats.pool_stats(tasks, ["event_type"])


def progress_running(s, d):
    rows = read(s, d, "events").select("event_id", "user_id")
    return ranking.running_count(rows, ["event_id"], 5, key="user_id")


def progress_stats(s, d):
    rows = read(s, d, "orders").groupBy("o_orderstatus").agg(F.count_if(F.col("o_orderkey") % 3 == 0).alias("current"), F.count("*").alias("total")).withColumn("elapsed", F.col("current") / 10.0)
    return stats.progress_stats(rows).select("o_orderstatus", F.round("percent", 4).alias("percent"), F.round("eta", 4).alias("eta"), "elapsed_text", "completed")


def batch_numbers(s, d):
    return ranking.batch_number(read(s, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", ["o_orderkey"], 3)


def request_gaps(s, d):
    from pyspark.sql.window import Window

    e = read(s, d, "events").select("event_id", "user_id", "ts")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = (micros() - F.lag(micros()).over(w)) / 1e6
    return e.select("event_id", F.round(gap, 3).alias("gap"))


def _proxies(s, d):
    e = read(s, d, "events")
    ok = F.col("event_type") == "click"
    rows = e.groupBy(F.col("user_id").alias("pos")).agg(F.count_if(ok).alias("success_count"), F.count_if(~ok).alias("failure_count"), F.coalesce(F.max(F.when(~ok, F.floor(seconds()))) + 300, F.lit(0)).cast("double").alias("banned_until"))
    return rows.withColumn("url", F.concat(F.lit("proxy-"), F.col("pos").cast("string")))


def proxy_rank(s, d):
    rows = _proxies(s, d).withColumn("rate", F.round(stats.success_rate(), 6))
    return rows.orderBy(F.desc("rate"), "pos").limit(5).select("url", "rate")


def proxy_stats(s, d):
    p = _proxies(s, d)
    mid = 86400.0 * 20
    return stats.proxy_stats(p, F.lit(mid)).select("total", "available", "banned", F.round("mean_rate", 6).alias("mean_rate"))


# Assembly


def merge_kth(s, d):
    base = read(s, d, "orders").where("o_orderkey % 2 = 0").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit("")).otherwise(F.lit("own")).alias("v"))
    found = read(s, d, "orders").where("o_orderkey % 2 = 1").select("o_custkey", "o_orderkey", F.concat(F.lit("new"), F.col("o_orderkey").cast("string")).alias("v"))
    return joins.merge_kth(base, found, "o_custkey", ["o_orderkey"], ["o_orderkey"], "v").select("o_custkey", "o_orderkey", "v", "source")


def append_union(s, d):
    a = read(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    b = read(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return joins.append_rows(a, b)


def stats_flags_sum(s, d):
    kinds = ["click", "view", "purchase", "signup"]
    rows = read(s, d, "events").select(*[(F.col("event_type") == k).cast("int").alias(k) for k in kinds])
    return stats.sum_flags(rows, kinds)


def drop_duplicates_full(s, d):
    return ranking.distinct_rows(read(s, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber"))


def limit_overrides(s, d):
    domains = read(s, d, "nation").select(F.col("n_name").alias("domain"))
    over = read(s, d, "nation").where("n_nationkey % 4 = 0").select(F.col("n_name").alias("domain"), F.col("n_nationkey").alias("limit"))
    return joins.or_default(domains, over, "domain", "limit", 12)


def query_cache(s, d):
    asks = read(s, d, "supplier").select("s_suppkey", F.concat(F.lit("  "), F.upper("s_name"), F.lit(" ")).alias("query"))
    known = read(s, d, "supplier").where("s_suppkey % 3 = 0").select(F.lower("s_name").alias("key"), F.concat(F.lit("cached "), F.col("s_suppkey").cast("string")).alias("value"))
    return joins.cached(asks, known, F.lit("fresh")).select("s_suppkey", "value", "hit")


def time_texts(s, d):
    sec = (F.col("l_orderkey") * 7 % 9000 + F.col("l_linenumber") / 10).cast("double")
    rows = read(s, d, "lineitem").select(F.round(sec, 1).alias("seconds")).distinct()
    return rows.select("seconds", stats.format_seconds(F.col("seconds")).alias("text"))


def config_clamps(s, d):
    raw = F.when(F.col("n_nationkey") % 5 == 0, "x").otherwise((F.col("n_nationkey") * 40 - 100).cast("string"))
    rows = read(s, d, "nation").select("n_nationkey", clamp_column(raw, 12, 1, 500).alias("pages"), F.array_join(words_column(F.concat(F.lit(" A, ,"), "n_name", F.lit(" ,"))), "|").alias("parts"))
    return rows


def search_topk(s, d):
    """The first three hits of each searcher: hosts ranked by page."""
    rows = read(s, d, "pages").select(urls.normalise_domain(F.col("url")).alias("query"), "page_id", "url", urls.display_link(F.col("url")).alias("display_link"))
    return ranking.top_per(rows, "query", ["page_id"], 3)


def engine_first(s, d):
    hits = read(s, d, "events").select(F.concat(F.lit("q"), (F.col("user_id") % 40).cast("string")).alias("query"), (F.col("event_id") % 3 + (F.col("user_id") % 2)).cast("int").alias("engine_pos"), F.col("event_id").alias("link"))
    return joins.first_engine(hits)


def url_join(s, d):
    base = F.when(F.col("page_id") % 2 == 0, "shop.de").otherwise("http://shop.de/a/b")
    rel = F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(F.concat(F.lit("//x/"), F.col("page_id").cast("string")))
    return read(s, d, "pages").select("page_id", urls.join_url(base, rel).alias("joined"))


def robots_lines(s, d):
    host = urls.normalise_domain(F.col("url"))
    text = F.concat(F.lit("User-agent: *\nSITEMAP: https://www."), F.col("domain"), F.lit("/s.xml\r\n sitemap:https://other.de/s.xml\nSitemap: https://"), F.col("domain"), F.lit("/t.xml"))
    rows = read(s, d, "pages").select(host.alias("domain")).distinct().select("domain", text.alias("text"))
    return sitemaps.robots_sitemaps(rows.where("domain not like 'www.%'"))


def sitemap_candidates(s, d):
    return sitemaps.candidates(read(s, d, "pages").select(urls.normalise_domain(F.col("url")).alias("domain")).distinct())


def xml_sniff(s, d):
    body = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("  <?XML version='1.0'?>"), "html")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("<urlset>"), "html")).otherwise(F.col("html"))
    raw = F.encode(body, "UTF-8")
    return read(s, d, "pages").select("page_id", (sitemaps.within_size(raw) & sitemaps.looks_like_xml(raw)).alias("xml"))


def frontier_new_links(s, d):
    """Link targets that are no page of the table themselves."""
    pages = read(s, d, "pages")
    links = discovery.page_links(pages.select("url", F.col("html").alias("text"))).select("dst").distinct()
    return joins.unless(links, pages.select(urls.canonicalise_query(F.col("url")).alias("dst")).distinct(), "dst")


def proxy_bans(s, d):
    failures = read(s, d, "events").where("event_type = 'error'").select(F.concat(F.lit("proxy-"), F.col("user_id").cast("string")).alias("url"), F.floor(seconds()).cast("double").alias("ts"))
    return stats.bans(failures)


def task_batches(s, d):
    """Failed tasks by batch of a hundred."""
    tasks = read(s, d, "events").select("event_id", (F.col("event_id") % 7).alias("g"), (F.floor(F.abs("value")) % 5 != 0).alias("success"))
    _, failed = stats.split_tasks(ranking.batch_number(tasks, "g", ["event_id"], 100))
    return failed.groupBy("g", "batch").agg(F.count("*").alias("n"))


def debug_names(s, d):
    return read(s, d, "pages").select("page_id", urls.debug_filename(F.col("url")).alias("name"))


# Rules and reports that have no place in the queries above


def responses_plain(s, d):
    """Addresses of responses that are no HTML: read as plain text, unless they failed or are PDF files."""
    i = F.col("doc_id")
    url = F.concat(F.lit("https://site.de/"), i.cast("string"), F.when(i % 7 == 0, ".PDF").otherwise(".txt"))
    kind = F.when(i % 3 == 0, "text/plain").when(i % 3 == 1, "application/json")
    rows = read(s, d, "documents").select(url.alias("url"), F.when(i % 5 == 0, 404).otherwise(200 + i % 100).cast("int").alias("status"), kind.alias("content_type"), "text", F.lit(None).cast("string").alias("rendered_html"))
    return discovery.page_addresses(rows)


def contact_nested(s, d):
    """Addresses of nested contact elements; those before and after them do not count."""
    host = urls.normalise_domain(F.col("url"))
    rows = read(s, d, "pages").select("page_id", F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit("@"), host).alias("a"), F.concat(F.lit("q@"), host).alias("b"), F.concat(F.lit("out@"), host).alias("c"))
    page = F.concat(
        F.lit('<div class="page"><!-- <i id="contact"> --><p>'), "c", F.lit('</p><br><div id="Contact-box"><div><p>Ask <b>'), "a",
        F.lit('</b></p><img src="x"></div><ul><li>or '), "b", F.lit("</li></ul> </div><div>not "), "c", F.lit(" </div></div></section>"),
    )
    return rows.select("page_id", F.explode(emails.addresses_in(html.contact_text(page))).alias("email"))


#: Entities and what they stand for: names, also without a semicolon or with more behind them, numbers, none.
ENTITY_CASES = [
    ("&eacute;", "é"), ("&copy", "©"), ("&NotEqualTilde;", "\u2242\u0338"), ("&amp;lt;", "&lt;"), ("&#8364;", "€"), ("&#x80;", "€"), ("&notit;", "¬it;"),
    ("&frac12", "½"), ("&nosuch;", "&nosuch;"), ("&#0;", "\ufffd"), ("&#x1;", ""),
]


def entities_named(s, d):
    """Entities of every kind within addresses of pages."""
    case = F.get(F.array(*[F.lit(e) for e, _ in ENTITY_CASES]), (F.col("page_id") % len(ENTITY_CASES)).cast("int"))
    text = F.concat(urls.normalise_domain(F.col("url")), case, F.lit("-"), F.col("page_id").cast("string"))
    return sql.with_function(read(s, d, "pages").select("page_id", text.alias("raw")), "unescape_html", "raw", "text")


def links_rules(s, d):
    """Links by the older filter and by the rule for mail links, over hrefs of every kind made from those of pages."""
    host = urls.normalise_domain(F.col("url"))
    rows = read(s, d, "pages").select("page_id", host.alias("domain"), F.posexplode(html.hrefs(F.col("html"))).alias("link_pos", "href"))
    kind = F.col("link_pos") % 4
    href = F.when(kind == 0, F.col("href")).when(kind == 1, F.concat(F.lit(" MAILTO:x@"), "domain")).when(kind == 2, F.concat(F.lit("https://"), "domain", "href")).otherwise("https://else.org")
    rows = rows.withColumn("href", href)
    return rows.select("page_id", "link_pos", "href", urls.is_mailto(F.col("href")).alias("mail"), urls.naive_same_site(F.col("href"), F.col("domain")).alias("same"))


def url_rules(s, d):
    """The older rule for URLs, exactly blocked hosts, and search addresses."""
    odd = F.when(F.col("page_id") % 4 == 1, F.concat("url", F.lit("#javascript:x"))).when(F.col("page_id") % 4 == 2, F.concat(F.lit("ftp"), "url")).otherwise(F.col("url"))
    rows = read(s, d, "pages").select("page_id", odd.alias("u"))
    return rows.select(
        "page_id", urls.validate_url_strict(F.col("u")).alias("valid"), urls.domain_blocked(F.col("u"), ["therin.example.net", "thther.example.org"]).alias("blocked"),
        urls.search_url("https://find.example/?q={}&n=10", F.concat(F.lit("Firm  "), F.col("page_id").cast("string"))).alias("search"),
    )


def names_relevant(s, d):
    return _hits(s, d).select("p_partkey", "rank", scoring.is_relevant(F.col("company"), F.col("link"), 70).alias("relevant"))


def head_checks(s, d):
    kind = F.when(F.col("event_id") % 4 == 0, "Text/XML").when(F.col("event_id") % 4 == 1, "image/png").when(F.col("event_id") % 4 == 2, "application/x-gzip")
    rows = read(s, d, "events").select("event_id", kind.alias("kind"), F.when(F.col("event_id") % 3 > 0, F.col("event_id") * 9000).alias("n"))
    return rows.select("event_id", sitemaps.head_allows(F.col("kind"), F.col("n")).alias("allowed"))


def progress_total(s, d):
    rows = read(s, d, "orders").groupBy("o_orderstatus").agg(F.count_if(F.col("o_orderkey") % 3 == 0).alias("current"), F.count("*").alias("total"))
    return stats.total_progress(rows).withColumn("percent", F.round("percent", 6))


def row_delta(s, d):
    orders = read(s, d, "orders")
    return stats.row_delta(orders, joins.append_rows(orders, orders.where("o_orderstatus = 'F'")))


def proxy_checks(s, d):
    """Outcome of checks of proxies: one row, from their events."""
    checks = read(s, d, "events").select(F.concat(F.lit("proxy-"), F.col("user_id").cast("string")).alias("url"), (F.col("event_type") == "click").alias("ok"), F.abs("value").alias("ms"))
    return stats.check_outcome(stats.check_report(checks))


def proxy_best(s, d):
    return stats.best_proxy(_proxies(s, d), F.lit(86400.0 * 366)).select("url", "pos")


def cache_names(s, d):
    """Names of files for the keys of the log, and the number of live entries."""
    live = cache.latest(_cache_log(s, d))
    return live.select("key", cache.binary_name(F.col("key")).alias("name")).join(cache.size(live).withColumnRenamed("n", "entries"))


def since_last(s, d):
    """Seconds since a user's last event; of events at one time all but one have none."""
    out = ranking.since_last(read(s, d, "events").select("user_id", "ts"), "user_id", "ts")
    return out.select("user_id", F.round("gap", 3).alias("gap"))


QUERIES = [
    emails_from_text, emails_validate, emails_strict, emails_from_pages, emails_per_url_joined, emails_distinct_count,
    emails_blacklist_anti, emails_masked, deobf_at_dot, deobf_cfemail, deobf_charcode, deobf_base64, deobf_rot13,
    extract_cascade, url_normalise_domain, url_canonicalise, url_canonicalise_query, url_validate, url_dedupe_first,
    url_domain_counts, url_domain_topk, url_blocked_filter, url_priority_filter, url_candidates, url_fetch_first,
    links_extract, links_resolve_same_site, company_clean, domain_split, domain_score, domain_best, domain_score_fuzzy,
    domain_score_join, domain_score_names, domain_best_names, domain_split_rules,
    resolve_first_wins, result_rows, run_summary, crawl_bfs, crawl_bfs_limited, sitemap_locs, sitemap_priority, sitemap_nested,
    cache_latest, cache_prune, cache_ttl_lookup, rate_min_interval, token_bucket_wait, rate_global_interval, token_bucket_global, progress_global, backoff_schedule,
    status_histogram, request_totals, worker_stats, progress_running, progress_stats, batch_numbers, request_gaps,
    proxy_rank, proxy_stats, merge_kth, append_union, stats_flags_sum, drop_duplicates_full, limit_overrides,
    query_cache, time_texts, config_clamps, search_topk, engine_first, url_join, robots_lines, sitemap_candidates,
    xml_sniff, frontier_new_links, proxy_bans, task_batches, debug_names, responses_plain, contact_nested, entities_named, links_rules, url_rules,
    names_relevant, head_checks, progress_total, row_delta, proxy_checks, proxy_best, cache_names, since_last,
]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}
