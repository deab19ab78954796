from harrow.llm import urlfilter


def brute(rows):
    def parts(url):
        if url is None or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        host = rest
        for c in "/?#":
            host = host.split(c, 1)[0]
        path = rest[len(host) :].split("?", 1)[0].split("#", 1)[0]
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path

    out = []
    for i, url in rows:
        host, path = parts(url)
        fits = []
        for rule, verdict in urlfilter.RULES:
            h, slash, p = rule.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
                fits.append((len(rule), rule, verdict))
        out.append((i, host, path, *(max(fits)[1:] if fits else (None, None))))
    return out


URLS = [
    None, "", "no scheme", "http://", "http://A.Example.NET/en/x?q#f", "http://example.net/en", "https://b.net", "https://b.net/", "x://example.com/de/1",
    "http://notexample.com/de/1", "http://sub.example.com/de/", "http://a.org/fr/?x", "http://a.org?fr/", "http://a.org#/fr/", "a://b://c.net/", "http://ÄB.net/é", "http://u:p@h.org:80/fr/",
]


def test_rules_against_brute_force(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(None, "http://x.net/"), (4, URLS[4])]
    pages = spark.createDataFrame([(i, u, None, "v", "h") for i, u in rows], "page_id long, url string, html string, verdict string, host string")
    got = urlfilter.judge_pages(pages).collect()
    want = brute(rows)
    assert sorted(((r.page_id, r.host, r.path, r["rule"]) for r in got), key=str) == sorted((w[:4] for w in want), key=str)
    by_rule = {(w[0], w[1], w[2]): w[4] for w in want if w[4]}
    assert all(by_rule.get((r.page_id, r.host, r.path), r.verdict) == r.verdict for r in got)
    assert {r.verdict for r in got} <= {"allow", "block"}
    assert urlfilter.judge_pages(pages.where("false")).count() == 0


def test_distrust_runs_against_links_and_trust_along_them(spark):
    link = lambda *hosts: "".join(f'<a href="https://{h}/">x</a>' for h in hosts)
    rows = [
        (0, "http://bad.net/", ""), (1, "http://good.org/fr/", link("friend.com")), (2, "http://farm.com/", link("bad.net")),
        (3, "http://farm2.com/", link("farm.com")), (4, "http://friend.com/", ""), (5, "http://alone.com/", None), (6, "http://mixed.com/", link("bad.net", "friend.com")),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    verdict = {r.page_id: r.verdict for r in urlfilter.judge_pages(pages).collect()}
    assert verdict == {r.page_id: r.verdict for r in urlfilter.judge_pages(pages, most_broadcast=0).collect()}
    assert verdict == {0: "block", 1: "allow", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "block"}


def test_scores_against_brute_force(spark):
    import random

    rnd = random.Random(2)
    hosts = [f"h{i}.com" for i in range(12)] + ["a.net", "b.net"]
    rows = [(i, f"http://{rnd.choice(hosts)}/{rnd.choice(['de/', 'x'])}", "".join(f"<a href=//{rnd.choice(hosts)}/>" for _ in range(3))) for i in range(60)]
    rows += [(100, "http://good.org/fr/", '<a href="//h1.com/">')]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    import re
    from collections import Counter

    parsed = {i: b for i, *b in brute([(i, u) for i, u, _ in rows])}
    size = Counter(b[0] for b in parsed.values())
    edges = Counter((parsed[i][0], t) for i, _, h in rows for t in re.findall(r"href=\"?//([^/\"]+)/", h) if t != parsed[i][0] and t in size)
    for kind, verdict, flip in (("trust", "allow", False), ("distrust", "block", True)):
        w = {((d, s) if flip else (s, d)): n for (s, d), n in edges.items()}
        total = Counter()
        for (s, _), n in w.items():
            total[s] += n
        seed = Counter(b[0] for b in parsed.values() if b[3] == verdict)
        seeds = {h: 0.15 * n / sum(seed.values()) for h, n in seed.items()}
        now = dict(seeds)
        for _ in range(10):
            new = Counter(seeds)
            for (s, d), n in w.items():
                new[d] += 0.85 * now.get(s, 0) * n / total[s]
            now = new
        host, path = urlfilter.host_and_path(pages["url"])
        frame = pages.select("html", host.alias("host"), path.alias("path")).withColumn("r", urlfilter.by_rules(urlfilter.RULES)).select("html", "host", "r.verdict")
        got = {r.host: r[kind] for r in urlfilter.propagate(frame).collect()}
        assert all(abs(got[h] - now.get(h, 0)) < 1e-9 for h in size)


def test_hosts_without_pages_are_nodes_and_seeds(spark):
    link = lambda *urls: "".join(f'<a href="{u}">x</a>' for u in urls)
    rows = [(0, "http://blog.example.org/a", link("https://SPAM.net/offer")), (1, "http://via.com/", link("//between.com/x"))]
    rows += [(2, "http://other.com/", ""), (3, "http://other.com/b", link("http://between.com/")), (4, "http://good.com/", link("http://a.org/fr/?q"))]
    rows += [(i, f"http://quiet{i}.com/", None) for i in range(10, 30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    verdict = {r.page_id: r.verdict for r in urlfilter.judge_pages(pages).collect()}
    assert verdict.pop(0) == "block" and set(verdict.values()) == {"allow"}
    host, path = urlfilter.host_and_path(pages["url"])
    frame = pages.select("html", host.alias("host"), path.alias("path")).withColumn("verdict", urlfilter.by_rules(urlfilter.RULES)["verdict"])
    got = {r.host: r for r in urlfilter.propagate(frame, rounds=None).collect()}
    assert (got["spam.net"].pages, got["a.org"].pages) == (0, 0)
    assert abs(got["spam.net"].distrust - 0.15) < 1e-9 and abs(got["blog.example.org"].distrust - 0.15 * 0.85) < 1e-9
    assert abs(got["a.org"].trust - 0.15) < 1e-9


def test_scores_reach_far_hosts(spark):
    n = 24
    rows = [(i, f"http://h{i}.com/", f'<a href="http://h{i + 1}.com/">') for i in range(n)] + [(n, f"http://h{n}.com/", '<a href="http://bad.net/">')]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    host, path = urlfilter.host_and_path(pages["url"])
    frame = pages.select("html", host.alias("host"), path.alias("path")).withColumn("verdict", urlfilter.by_rules(urlfilter.RULES)["verdict"])
    got = {r.host: r.distrust for r in urlfilter.propagate(frame, rounds=None).collect()}
    assert all(abs(got[f"h{i}.com"] - 0.15 * 0.85 ** (n + 1 - i)) < 1e-9 for i in range(n + 1))
