"""URL filters: rules by host and path, and trust propagated over the link graph of hosts.

A url gets the verdict of the longest rule that fits it.  For all others the host decides: trust spreads by
personalised PageRank from hosts with allowed pages along links, distrust from hosts with blocked pages against them
(who links to a bad host is suspect).  Hosts that are only linked to are nodes as well, and seeds if the urls of their
links fit a rule.  A host is blocked if its share of all distrust exceeds both its share of all
pages and its share of all trust.  The graph is hosts only: links are counted per pair of hosts before anything else,
so a host with a third of all pages is one node, and its pages are never grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
DAMPING = 0.85
ROUNDS = 10
#: Share of a score's seeds that the rounds to come may still move when the iteration stops.
TOLERANCE = 1e-10
LIFT = 1.0
#: Blocked hosts that are sent to every task; more are joined by host and salt.
MOST_BROADCAST = 100_000
SALTS = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same with the path after the host.
LINK_URL = r"""(?i)\bhref\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^/?#"'\s<>]+[^?#"'\s<>]*)"""
LINK = r"""(?i)\bhref\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null and for urls without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def by_rules(rules: list[tuple[str, str]]) -> Column:
    """struct<rule, verdict> of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda x: len(x[0])):  # later ones, being longer, go first
        host, slash, path = rule.partition("/")
        fits = (F.col("host") == host) | F.endswith("host", F.lit("." + host))
        out = F.when(fits & F.startswith("path", F.lit(slash + path)), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def linked_seeds(pages: DataFrame, hosts: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(host, good, bad) of hosts without pages: distinct urls that pages link to, by the verdict of their rule."""
    found = pages.where("host != ''").select(F.explode(F.regexp_extract_all("html", F.lit(LINK_URL), F.lit(1))).alias("url"))
    host, path = host_and_path(F.regexp_replace("url", "^[^/]*//", "http://"))
    urls = found.select(host.alias("host"), path.alias("path")).distinct().join(hosts.select("host"), "host", "left_anti")
    urls = urls.withColumn("verdict", by_rules(rules)["verdict"]).where("verdict is not null")
    return urls.groupBy("host").agg(F.count_if(F.col("verdict") == "allow").alias("good"), F.count_if(F.col("verdict") == "block").alias("bad"))


def propagate(pages: DataFrame, *, damping: float = DAMPING, rounds: int | None = ROUNDS, rules: list[tuple[str, str]] = RULES, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, pages, trust, distrust) from pages with host, verdict and html; each score sums to at most one.

    Hosts that are only linked to have no pages.  ``rounds`` of None iterates until what is still to come of both
    scores is less than ``tolerance``.
    """
    hosts = cut(
        pages.where("host != ''").groupBy("host").agg(
            F.count("*").alias("pages"), F.count_if(F.col("verdict") == "allow").alias("good"), F.count_if(F.col("verdict") == "block").alias("bad")
        )
    )
    found = pages.where("host != ''").select("host", F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("to"))
    found = found.select(F.col("host").alias("src"), F.translate("to", UPPER, LOWER).alias("dst")).where("src != dst")
    counted = cut(found.groupBy("src", "dst").agg(F.count("*").alias("n")))
    ways = counted.select(F.explode(F.array(
        F.struct(F.col("src"), F.col("dst"), F.lit("trust").alias("kind"), F.col("n")),
        F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("distrust").alias("kind"), F.col("n")),
    )).alias("e")).select("e.*")
    total = ways.groupBy("src", "kind").agg(F.sum("n").alias("total"))
    edges = cut(ways.join(total, ["src", "kind"]).select(F.col("src").alias("host"), "kind", "dst", (F.col("n") / F.col("total")).alias("w")))
    linked = not edges.isEmpty()
    known = hosts.select("host", "good", "bad")
    if linked:
        known = known.unionByName(linked_seeds(pages, hosts, rules))
    seeds = known.select("host", F.explode(F.array(
        F.struct(F.lit("trust").alias("kind"), F.col("good").alias("n")), F.struct(F.lit("distrust").alias("kind"), F.col("bad").alias("n"))
    )).alias("x")).select("host", "x.kind", "x.n").where("n > 0")
    sums = seeds.groupBy("kind").agg(F.sum("n").alias("total"))
    seeds = cut(seeds.join(F.broadcast(sums), "kind").select("host", "kind", ((1 - damping) * F.col("n") / F.col("total")).alias("score")))
    mass = lambda x: x.agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("m")).head().m
    now, done = seeds, 0
    before = mass(now) if linked and rounds is None else 0.0
    while linked and done != rounds:
        moved = now.join(edges, ["host", "kind"]).select(F.col("dst").alias("host"), "kind", (damping * F.col("score") * F.col("w")).alias("score"))
        now = cut(moved.unionByName(seeds).groupBy("host", "kind").agg(F.sum("score").alias("score")))
        done += 1
        if rounds is None:  # no score ever falls, and each round adds at most damping times what the last one added
            after = mass(now)
            if (after - before) * damping < tolerance * (1 - damping):
                break
            before = after
    score = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0)).alias(kind)
    scores = now.groupBy("host").agg(score("trust"), score("distrust"))
    return hosts.select("host", "pages").join(scores, "host", "full").na.fill(0.0, ["trust", "distrust"]).na.fill(0, ["pages"])


def judge_pages(pages: DataFrame, *, rules: list[tuple[str, str]] = RULES, damping: float = DAMPING, rounds: int | None = None, lift: float = LIFT, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """page_id, host, path, rule, verdict: one row per input row.

    A null url, or one without ``://``, has an empty host and path, fits no rule and is allowed.  Null html has no
    links.  Null page_id stays null, repeated rows count each, other columns are ignored.

    An empty table gives no rows; a very long page is read whole, in one task.
    """
    host, path = host_and_path(F.col("url"))
    own = pages.select("page_id", "html", host.alias("host"), path.alias("path")).withColumn("by_rule", by_rules(rules))
    own = own.select("page_id", "html", "host", "path", "by_rule.rule", "by_rule.verdict")
    scores = propagate(own, damping=damping, rounds=rounds, rules=rules)
    sums = scores.agg(F.sum("pages").alias("p"), F.sum("trust").alias("t"), F.sum("distrust").alias("d"))
    share = lambda a, b: F.coalesce(F.round(F.try_divide(F.col(a), F.col(b)), 9), F.lit(0.0))
    bad = scores.crossJoin(F.broadcast(sums)).where(  # one row of sums
        (share("distrust", "d") > lift * share("pages", "p")) & (share("distrust", "d") > share("trust", "t"))
    )
    bad = cut(bad.select("host", F.lit(True).alias("bad")))
    pages_only = own.drop("html")
    if bad.count() <= most_broadcast:  # a host may hold a third of all pages: they need not move
        out = pages_only.join(F.broadcast(bad), "host", "left")
    else:
        copies = bad.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = pages_only.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int"))
        out = dealt.join(copies, ["host", "salt"], "left")
    verdict = F.coalesce("verdict", F.when(F.col("bad"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def judge_sql(damping: float = DAMPING, rounds: int = ROUNDS, lift: float = LIFT) -> str:
    """The same in SQL, for the rules above and links within a host only: it has ten rounds, and hosts with pages only."""
    fits, cases = [], []
    for rule, verdict in sorted(RULES, key=lambda x: -len(x[0])):
        host, slash, path = rule.partition("/")
        cond = f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash + path}')"
        fits.append(f"WHEN {cond} THEN '{rule}'")
        cases.append(f"WHEN {cond} THEN '{verdict}'")
    link = LINK.replace("'", "''")
    steps = "".join(
        f""", s{i} AS (
  SELECT host, kind, sum(score) AS score FROM (
    SELECT e.dst AS host, e.kind, {damping} * s.score * e.w AS score FROM s{i - 1} s JOIN edges e ON s.host = e.src AND s.kind = e.kind
    UNION ALL SELECT host, kind, score FROM s0
  ) GROUP BY host, kind)"""
        for i in range(1, rounds + 1)
    )
    return f"""
WITH rest AS (
  SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages
), parts AS (
  SELECT page_id, html, translate(regexp_extract(r, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), own AS (
  SELECT *, CASE {' '.join(fits)} END AS rule, CASE {' '.join(cases)} END AS verdict FROM parts
), hosts AS (
  SELECT host, count(*) AS pages, count(*) FILTER (verdict = 'allow') AS good, count(*) FILTER (verdict = 'block') AS bad FROM own WHERE host <> '' GROUP BY host
), found AS (
  SELECT host AS src, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{UPPER}', '{LOWER}') AS dst FROM own WHERE host <> ''
), counted AS (
  SELECT src, dst, count(*) AS n FROM found WHERE src <> dst AND dst IN (SELECT host FROM hosts) GROUP BY src, dst
), ways AS (
  SELECT src, dst, 'trust' AS kind, n FROM counted UNION ALL SELECT dst, src, 'distrust', n FROM counted
), edges AS (
  SELECT src, dst, kind, n / sum(n) OVER (PARTITION BY src, kind) AS w FROM ways
), s0 AS (
  SELECT host, kind, {1 - damping} * n / sum(n) OVER (PARTITION BY kind) AS score FROM (
    SELECT host, 'trust' AS kind, good AS n FROM hosts WHERE good > 0 UNION ALL SELECT host, 'distrust', bad FROM hosts WHERE bad > 0)
){steps}, scores AS (
  SELECT h.host, h.pages, coalesce(sum(s.score) FILTER (s.kind = 'trust'), 0) AS trust, coalesce(sum(s.score) FILTER (s.kind = 'distrust'), 0) AS distrust
  FROM hosts h LEFT JOIN s{rounds} s ON h.host = s.host GROUP BY h.host, h.pages
), shares AS (
  SELECT host, coalesce(round(distrust / nullif(sum(distrust) OVER (), 0), 9), 0) AS d, coalesce(round(trust / nullif(sum(trust) OVER (), 0), 9), 0) AS t,
    round(pages / sum(pages) OVER (), 9) AS p FROM scores
)
SELECT o.page_id, o.host, o.path, o.rule, coalesce(o.verdict, CASE WHEN s.d > {lift} * s.p AND s.d > s.t THEN 'block' ELSE 'allow' END) AS verdict
FROM own o LEFT JOIN shares s ON o.host = s.host
"""
