import gzip

import pytest
from pyspark.sql import functions as F

from harrow.operators import cache, frontier, joins, pacing, ranking, sitemaps, stats
from harrow.plans import discovery
from harrow.sources import readers, writers


def test_crawl_is_breadth_first_and_bounded(spark):
    links = [("r", 0, "a"), ("r", 1, "b"), ("a", 0, "c"), ("a", 1, "r"), ("b", 0, "c"), ("b", 1, "d"), ("c", 0, "e"), ("d", 0, "f"), ("e", 0, "a"), ("x", 0, "y")]
    frame = spark.createDataFrame(links, "src string, link_pos int, dst string")
    seeds = spark.createDataFrame([("s", "r"), ("t", "x")], "domain string, url string")
    run = lambda **k: {(r.domain, r.url): (r.depth, r.visit) for r in frontier.crawl(seeds, frame, **k).collect()}
    assert run() == {("s", "r"): (0, 1), ("s", "a"): (1, 2), ("s", "b"): (1, 3), ("s", "c"): (2, 4), ("s", "d"): (2, 5), ("s", "e"): (3, 6), ("s", "f"): (3, 7), ("t", "x"): (0, 1), ("t", "y"): (1, 2)}
    assert sorted(k[1] for k in run(limit=4) if k[0] == "s") == ["a", "b", "c", "r"]
    for n in range(1, 8):  # a larger limit never loses a page
        assert set(run(limit=n)) <= set(run(limit=n + 1))
    ok = spark.createDataFrame([(u,) for u in "rbcdx"], "url string")
    assert {k[1] for k in run(ok=ok) if k[0] == "s"} == {"r", "b", "c", "d"}
    assert {k[1] for k in run(ok=ok, limit=3) if k[0] == "s"} == {"r", "b", "c"}
    assert {k[1] for k in run(ok=ok, limit=3, count_failed=True) if k[0] == "s"} == {"r", "b"}
    limits = spark.createDataFrame([("s", 2)], "domain string, limit int")
    assert len(run(limit=1, limits=limits)) == 3


def test_sitemaps(spark):
    index = b"<?xml version='1.0'?><sitemapindex><sitemap><loc>https://a.de/s1.xml</loc></sitemap></sitemapindex>"
    pages = b"<urlset xmlns='x'><url><loc> https://a.de/contact </loc></url><url><loc>https://a.de/b?x=1&amp;y=2</loc></url><url><loc>https://a.de/contact</loc></url></urlset>"
    bodies = spark.createDataFrame(
        [("https://a.de/sitemap.xml", bytearray(index)), ("https://a.de/s1.xml", bytearray(gzip.compress(pages))), ("https://b.de/own.xml", bytearray(pages)), ("https://c.de/sitemap.xml", bytearray(b"<html>"))],
        "url string, body binary",
    ).select("url", sitemaps.gunzip()("body").alias("body"))
    domains = spark.createDataFrame([("a.de",), ("b.de",), ("c.de",), ("x.d.de",)], "domain string")
    robots = spark.createDataFrame([("b.de", "User-agent: *\nSITEMAP: https://www.b.de/own.xml\nsitemap: https://b.de/own.xml\nsitemap: https://evil.de/own.xml")], "domain string, text string")
    found = sitemaps.discover(domains, bodies, robots)
    assert {tuple(r) for r in found.collect()} == {("a.de", "https://a.de/sitemap.xml"), ("b.de", "https://b.de/own.xml")}
    listed = sitemaps.pages_of(found, bodies)
    assert [r.url for r in listed.where("domain = 'a.de'").orderBy("pos").collect()] == ["https://a.de/contact", "https://a.de/b?x=1&y=2", "https://a.de/contact"]
    assert {tuple(r) for r in sitemaps.priority_pages(listed).collect()} == {("a.de", "https://a.de/contact"), ("b.de", "https://a.de/contact")}
    assert sitemaps.candidates(domains.where("domain = 'x.d.de'")).count() == 4
    xml = bodies.where("url like '%s1.xml'").select(sitemaps.locations_xml(F.col("body").cast("string")).alias("l")).head().l
    assert len(xml) == 3


def test_head_check(spark):
    rows = spark.createDataFrame([("text/xml", 10), ("image/png", 10), ("application/gzip", None), ("text/html", 60 << 20), (None, 1)], "t string, n long")
    assert [r.ok for r in rows.select(sitemaps.head_allows(F.col("t"), F.col("n")).alias("ok")).collect()] == [True, False, True, False, False]


def test_cache(spark):
    log = spark.createDataFrame([("a", "1", 0.0), ("a", "2", 50.0), ("b", "x", 10.0), ("b", None, 20.0), ("c", "old", -100.0)], "key string, value string, ts double")
    assert {tuple(r) for r in cache.get(log, F.lit(100.0), ttl=100).select("key", "value").collect()} == {("a", "2")}
    asks = spark.createDataFrame([(1, "a", 49.0), (2, "a", 50.0), (3, "b", 15.0), (4, "b", 25.0), (5, "c", 1.0), (6, "z", 1.0)], "id int, key string, at double")
    got = {r.id: r.value for r in cache.lookup(asks, log, ttl=100).collect()}
    assert got == {1: "1", 2: "2", 3: "x", 4: None, 5: None, 6: None}
    assert [r.key for r in cache.prune(cache.latest(log), F.lit(0.0), max_size=1).collect()] == ["a"]


def test_pacing_against_loops(spark):
    at = [0.0, 0.0, 0.1, 0.2, 5.0, 5.0, 5.1, 9.0]
    rows = spark.createDataFrame([("k", t) for t in at], "key string, t double")
    free, want = float("-inf"), []
    for t in at:
        free = max(t, free + 0.5)
        want.append(round(free - t, 6))
    assert [r.wait for r in pacing.min_interval(rows, "key", F.col("t"), 2.0).orderBy("n").collect()] == want
    for mode in ("standard", "reference"):
        tokens, last, free, want = 2.0, None, float("-inf"), []
        for t in at:
            now = max(t, free)
            tokens = min(2.0, tokens + (0 if last is None else (now - last) * 2.0))
            last = now
            if tokens >= 1:
                tokens, free = tokens - 1, now
            else:
                free, tokens = now + (1 - tokens) / 2.0, 0.0
                last = free if mode == "standard" else now
            want.append(round(free - t, 6))
        got = [r.wait for r in pacing.token_bucket(rows, "key", F.col("t"), 2.0, 2.0, mode=mode).orderBy("n").collect()]
        assert got == want
    with pytest.raises(ValueError):
        pacing.token_bucket(rows, "key", F.col("t"), 0, 1)


def test_merge_and_progress(spark):
    base = spark.createDataFrame([("c", 1, ""), ("c", 2, None), ("d", 1, "own")], "company string, pos int, Email string")
    found = spark.createDataFrame([("c", 1, "a"), ("c", 2, "b"), ("c", 3, "x"), ("d", 1, "y")], "company string, pos int, Email string")
    got = {(r.company, r.Email, r.source) for r in joins.merge_kth(base, found, "company", ["pos"], ["pos"], "Email").collect()}
    assert got == {("c", "a", "input"), ("c", "b", "input"), ("d", "own", "input"), ("c", "x", "result")}
    steps = spark.range(10).withColumn("g", F.lit(1))
    run = ranking.running_count(steps, ["id"], 10, key="g").orderBy("id").collect()
    assert [r.current for r in run] == list(range(1, 11)) and run[3].percent == 40.0
    texts = spark.createDataFrame([(59.94,), (75.0,), (3900.0,)], "s double").select(stats.format_seconds(F.col("s")).alias("t")).collect()
    assert [r.t for r in texts] == ["59.9s", "1m 15s", "1h 5m"]


def test_first_engine_and_response(spark):
    hits = spark.createDataFrame([("q", 1, "b"), ("q", 0, "a"), ("r", 2, "c")], "query string, engine_pos int, link string")
    assert {r.link for r in joins.first_engine(hits).collect()} == {"a", "c"}
    pages = spark.createDataFrame([("https://a.de/x",), ("https://b.de/",), ("https://c.de/",)], "url string")
    answers = spark.createDataFrame([("https://a.de/x", 404), ("https://www.a.de/x", 200), ("http://b.de/", 200)], "url string, status int")
    assert {(r.url, r.fetched) for r in joins.first_response(pages, answers).collect()} == {("https://a.de/x", "https://www.a.de/x"), ("https://b.de/", "http://b.de/")}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "c.csv").write_text("Company,n\nA,1\n  ,2\n,3\nB,4\n")
    assert [r.company for r in readers.companies(spark, str(tmp_path / "c.csv")).orderBy("input_pos").collect()] == ["A", "B"]
    (tmp_path / "d.csv").write_text("Name\nA\n")
    assert readers.check_input(spark, str(tmp_path / "d.csv"))[0] is False
    (tmp_path / "u.txt").write_text("https://a.de\n\n#c\n")
    assert readers.url_list(spark, str(tmp_path / "u.txt")).count() == 2 and readers.proxy_list(spark, str(tmp_path / "u.txt")).count() == 1
    page = spark.createDataFrame([("q", '<a href="https://a.de/x">One</a><a href="/rel">no</a><a href="https://b.de">Two</a>')], "query string, html string")
    assert [(r["rank"], r.title, r.display_link) for r in readers.hits_from_page(page).orderBy("rank").collect()] == [(1, "One", "a.de"), (2, "Two", "b.de")]
    rows = spark.createDataFrame([("u", "b@x.de"), ("u", "a@x.de")], "url string, email string")
    writers.url_emails(rows, str(tmp_path / "o"))
    assert spark.read.option("header", True).csv(str(tmp_path / "o")).head().emails == "a@x.de;b@x.de"
    path = str(tmp_path / "t")
    writers.results(rows, path)
    writers.in_place(spark.read.parquet(path).limit(1), path)
    assert spark.read.parquet(path).count() == 1


def test_whole_run(spark):
    companies = spark.createDataFrame([(0, "Alpha GmbH"), (1, "Beta Ltd"), (2, "Alpha Inc"), (3, "Nothing"), (4, "Unrelated Words"), (5, "Gamma")], "input_pos long, company string")
    hits = [("Alpha GmbH", 1, "https://linkedin.com/alpha"), ("Alpha GmbH", 2, "https://www.alpha.de/"), ("Beta Ltd", 1, "https://beta.com/x"), ("Alpha Inc", 1, "https://alpha.de"), ("Unrelated Words", 1, "https://qqq.zz"), ("Gamma", 1, "http://gamma.org")]
    results = spark.createDataFrame(hits, "company string, rank int, link string")
    pages = [
        ("https://alpha.de", "<p>mail office@alpha.de now</p>"),
        ("https://beta.com", '<a href="/team">t</a><a href="https://other.com/">o</a>'), ("https://beta.com/team", '<a href="mailto:who@beta.com">m</a>'),
        ("https://gamma.org", "<p>none</p>"),
    ]
    responses = spark.createDataFrame([(u, 200, "text/html", t, None) for u, t in pages], "url string, status int, content_type string, text string, rendered_html string")
    bodies = spark.createDataFrame([("https://alpha.de/sitemap.xml", bytearray(b"<urlset><url><loc>https://alpha.de/contact</loc></url></urlset>"))], "url string, body binary")
    robots = spark.createDataFrame([], "domain string, text string")
    out, flags = discovery.run(companies, results, responses, bodies, robots, save_domain_only=True)
    assert {tuple(r) for r in out.collect()} == {("Alpha GmbH", "alpha.de", "office@alpha.de"), ("Beta Ltd", "beta.com", "who@beta.com"), ("Gamma", "gamma.org", None)}
    total = stats.sum_flags(flags).head().asDict()
    assert (total["leads"], total["no_google"], total["domain_unclear"], total["skipped_domain"], total["domain"], total["with_email"], total["without_email"], total["sitemap"]) == (6, 1, 1, 1, 3, 2, 1, 1)


def test_responses_by_kind(spark):
    rows = [
        ("https://a.de/x.txt", 200, "text/plain", "write to a@a.de today", None),
        ("https://a.de/y", 200, None, "or to <b@a.de> today", None),
        ("https://a.de/Z.PDF", 200, "application/pdf", "p@a.de", None),
        ("https://a.de/idna", 200, "text/html", "<p>m@xn--mnchen-3ya.de</p>", None),
        ("https://a.de/gone", 404, "text/plain", "g@a.de", None),
        ("https://a.de/null", 200, "text/plain", None, None),
    ]
    frame = spark.createDataFrame(rows, "url string, status int, content_type string, text string, rendered_html string")
    assert {r.email for r in discovery.page_addresses(frame).collect()} == {"a@a.de", "b@a.de", "m@münchen.de"}
    assert {r.email for r in discovery.page_addresses(frame, process_pdfs=True).collect()} == {"a@a.de", "b@a.de", "p@a.de", "m@münchen.de"}


def test_crawl_ends_when_a_level_is_empty_or_fails(spark):
    import inspect

    seeds = spark.createDataFrame([("d", "p0")], "domain string, url string")
    links = spark.createDataFrame([(f"p{i}", 0, f"p{i + 1}") for i in range(3)], "src string, link_pos int, dst string").coalesce(1)
    assert sorted((r.depth, r.url) for r in frontier.crawl(seeds, links, most_levels=4).collect()) == [(i, f"p{i}") for i in range(4)]
    with pytest.raises(RuntimeError):
        frontier.crawl(seeds, links, most_levels=2)
    assert sorted(r.depth for r in frontier.crawl(seeds, links, max_depth=1, most_levels=9).collect()) == [0, 1]
    assert inspect.signature(frontier.crawl).parameters["max_depth"].default is None
