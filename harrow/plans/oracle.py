"""The catalog's queries in SQL, for DuckDB over the same tables."""

from __future__ import annotations

from ..functions.emails import BLACKLIST, FILE_EXTENSIONS, GENERIC_TLDS, ROLES
from ..functions.scoring import COMPANY_SUFFIXES, PENALTY_DOMAINS, SECOND_LEVEL
from .catalog import ENTITY_CASES, SUFFIX_RULES


def scores(pairs: str, threshold: float = 0) -> str:
    """Common table expressions down to scored(company, host, score) of pairs(company, host): every stretch is compared.

    The similarity of two strings is that of the shorter one to its best stretch of the other, by the length of the
    longest common subsequence, a bit for each character.
    """
    base = f"regexp_replace(regexp_replace(lower(company), '({'|'.join(x.replace('.', '[.]') for x in COMPANY_SUFFIXES)})$', ''), '[^a-z0-9]', '', 'g')"
    portals = " OR ".join(f"contains(host, '{p}')" for p in PENALTY_DOMAINS)
    return f"""pairs AS ({pairs}),
split_up AS (SELECT *, {base} AS base, string_split(host, '.') AS l FROM (SELECT DISTINCT company, host FROM pairs)),
parted AS (SELECT *, {SPLIT} AS k FROM split_up),
parts AS (SELECT company, host, base, unnest([l[len(l) - k], coalesce(list_aggregate(l[1:len(l) - k - 1], 'string_agg', '.'), '')]) AS part FROM parted),
short_long AS (SELECT DISTINCT base, part, CASE WHEN length(base) > length(part) THEN part ELSE base END AS s, CASE WHEN length(base) > length(part) THEN base ELSE part END AS t FROM parts),
ways AS (SELECT base, part, s, t FROM short_long WHERE s <> '' UNION ALL SELECT base, part, t, s FROM short_long WHERE s <> '' AND length(s) = length(t)),
stretches AS (SELECT *, length(s) AS m, unnest(range(1 - length(s), length(t))) AS lo FROM ways),
cuts AS (SELECT base, part, s, m, t[greatest(lo, 0) + 1:least(lo + m, length(t))] AS w FROM stretches),
commons AS (SELECT base, part, m, length(w) AS n, m - bit_count(list_reduce(list_prepend((1::BIGINT << m) - 1,
    list_transform(string_split(w, ''), lambda c: list_sum(list_transform(range(1, m + 1), lambda i: CASE WHEN s[i] = c THEN 1::BIGINT << (i - 1) ELSE 0 END))::BIGINT)),
    lambda r, x: ((r + (r & x)) | (r - (r & x))) & ((1::BIGINT << m) - 1))) AS c FROM cuts),
alike AS (SELECT base, part, max(200.0::DOUBLE * c / (m + n)) AS v FROM commons GROUP BY 1, 2),
scored AS (SELECT company, host, CASE WHEN length(any_value(base)) < 3 THEN 50.0::DOUBLE
    ELSE greatest(0.0::DOUBLE, max(coalesce(v, 0.0)) - CASE WHEN {portals} THEN 25 ELSE 0 END) END AS score
  FROM parts LEFT JOIN alike USING (base, part) GROUP BY company, host HAVING score >= {threshold})"""


def quoted(items) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in items)


# A token of address characters with one @ is an address exactly if it fits as a whole.
TOKENS = "SELECT {id}, unnest(string_split_regex({text}, '[^A-Za-z0-9._%+@-]+')) AS t FROM {table}"
FITS = r"regexp_full_match(t, '[A-Za-z0-9._%+-]+@([A-Za-z0-9-]+\.)+[A-Za-z]{2,63}')"
USER, HOST = "string_split(e, '@')[1]", "string_split(e, '@')[2]"
VALID = f"""(length({USER}) BETWEEN 1 AND 64 AND length({HOST}) <= 255 AND lower({HOST}) NOT IN ({quoted(BLACKLIST)})
  AND NOT regexp_matches(e, '(?i)({'|'.join(ROLES)})')
  AND NOT regexp_matches({USER}, '(?i)[.](png|jpe?g|gif)$') AND NOT regexp_matches({HOST}, '(?i)[.](png|jpe?g|gif)$')
  AND NOT regexp_matches({USER}, '(?i)^[0-9a-f]{{20,}}$') AND NOT regexp_matches({HOST}, '(?i)^[0-9a-f]{{20,}}$'))"""
DOC_EMAILS = f"""tok AS ({TOKENS.format(id='doc_id', text='text', table='documents')}),
raw AS (SELECT DISTINCT doc_id, t FROM tok WHERE {FITS}), found AS (SELECT DISTINCT doc_id, lower(t) AS e FROM raw),
mails AS (SELECT doc_id, e AS email FROM found WHERE {VALID})"""
PAGE_TEXT = r"regexp_replace(regexp_replace(html, '<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'gis'), '<[^>]*>', ' ', 'gs')"
PAGE_EMAILS = f"""txt AS (SELECT page_id, url, replace(replace({PAGE_TEXT}, '&nbsp;', ' '), '&#64;', '@') AS t0 FROM pages),
tok AS ({TOKENS.format(id='page_id, url', text='t0', table='txt')}),
found AS (SELECT DISTINCT page_id, url, lower(t) AS e FROM tok WHERE {FITS}), mails AS (SELECT page_id, url, e AS email FROM found WHERE {VALID})"""
TLD = f"(string_split(h, '.')[-1] IN ({quoted(GENERIC_TLDS)}) OR regexp_full_match(string_split(h, '.')[-1], '[a-z]{{2}}'))"
NETLOC = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
DOMAIN = f"regexp_replace(lower({NETLOC}), '^www\\.', '')"
PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
QUERY = "regexp_extract(url, '^[^?#]*[?]([^#]*)', 1)"
SCHEME = "lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"
SECONDS = "(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1e6"
CANONICAL = f"""{SCHEME} || '://' || {DOMAIN} || CASE WHEN regexp_replace(regexp_replace({PATH}, ';[^/]*$', ''), '/+$', '') = '' THEN '/'
  ELSE regexp_replace(regexp_replace({PATH}, ';[^/]*$', ''), '/+$', '') END"""
CODE = "replace(replace(url_encode({}), '%20', '+'), '*', '%2A')"
DECODE = "url_decode(replace({}, '+', ' '))"
PAIRS = f"""list_sort(list_filter(list_transform(list_filter(string_split({QUERY}, '&'), lambda x: x <> ''),
  lambda x: {{'k': {DECODE.format("split_part(x, '=', 1)")}, 'v': CASE WHEN contains(x, '=') THEN {DECODE.format("substr(x, instr(x, '=') + 1)")} ELSE '' END}}),
  lambda p: NOT starts_with(p.k, 'utm_')))"""
CANONICAL_QUERY = f"""(WITH q AS (SELECT page_id, {SCHEME} || '://' || {NETLOC} || {PATH} AS front,
  list_aggregate(list_transform({PAIRS}, lambda p: {CODE.format('p.k')} || '=' || {CODE.format('p.v')}), 'string_agg', '&') AS tail FROM pages)
  SELECT page_id, front || CASE WHEN coalesce(tail, '') <> '' THEN '?' || tail ELSE '' END AS canonical FROM q)"""
SUFFIX_CASE = "CASE " + " ".join(f"WHEN ends_with(low, '{s}') THEN left(low, length(low) - {len(s)})" for s in COMPANY_SUFFIXES) + " ELSE low END"
SPLIT = f"""CASE WHEN len(l) > 2 AND regexp_full_match(list_aggregate(l[-2:], 'string_agg', '.'), '{SECOND_LEVEL}') THEN 2 WHEN len(l) > 1 THEN 1 ELSE 0 END"""
LEADS = f"""h AS (SELECT page_id AS input_pos, {DOMAIN} AS host FROM pages),
l AS (SELECT input_pos, host, string_split(host, '.')[-2] AS label FROM h)"""
RESULT_ROWS = f"""{DOC_EMAILS}, sites AS (SELECT source, min(doc_id) AS first_doc FROM documents GROUP BY source),
hits AS (SELECT DISTINCT d.source, m.email FROM mails m JOIN documents d USING (doc_id)),
rows AS (SELECT DISTINCT 'Company ' || first_doc AS "Company", s.source AS "Domain", h.email AS "Email" FROM sites s LEFT JOIN hits h ON s.source = h.source)"""
WALK = """n AS (SELECT count(*) AS n FROM pages), walk AS (
  SELECT 0::BIGINT AS page, 0 AS depth, '' AS way
  UNION ALL SELECT (page * 2 + 1 + pos) % n, depth + 1, way || pos::VARCHAR
  FROM walk, n, (SELECT unnest([0, 1]) AS pos) WHERE depth < 6),
firsts AS (SELECT page, min({'d': depth, 'w': way}) AS f FROM walk GROUP BY page),
ranked AS (SELECT page, f.d AS depth, row_number() OVER (ORDER BY f.d, f.w) AS visit FROM firsts)"""
LISTED = f"l AS (SELECT {DOMAIN} AS domain, page_id, url FROM pages)"
LOG = f"""log AS (SELECT 'k' || (user_id % 100) AS key, CASE WHEN event_type <> 'purchase' THEN event_type || '-' || event_id END AS value, {SECONDS} AS ts FROM events)"""
LATEST = "latest AS (SELECT key, max({'ts': ts, 'has': value IS NOT NULL, 'value': value}) AS m FROM log GROUP BY key), alive AS (SELECT key, m.value AS value, m.ts AS ts FROM latest WHERE m.value IS NOT NULL)"
ARRIVE = f"a AS (SELECT user_id % 50 AS key, floor({SECONDS}) AS t FROM events), o AS (SELECT key, t, row_number() OVER (PARTITION BY key ORDER BY t) - 1 AS n FROM a)"
STATUS = "r AS (SELECT event_id, CASE WHEN floor(abs(value))::BIGINT % 600 >= 100 THEN (floor(abs(value))::BIGINT % 600)::INTEGER END AS status FROM events)"
PROXIES = f"""p AS (SELECT user_id AS pos, count(*) FILTER (event_type = 'click') AS s, count(*) FILTER (event_type <> 'click') AS f,
  coalesce(max(floor({SECONDS})) FILTER (event_type <> 'click') + 300, 0) AS banned FROM events GROUP BY user_id)"""

NAMED = """named AS (SELECT s_suppkey, substr(md5(s_name), 1, 14) || ' GmbH' AS company, substr(md5(s_name), 1, 14) AS b FROM supplier)"""
MADE = f"""made AS (SELECT unnest(['www.' || b[1:5] || b[7:14] || '.com', b || '-' || b[1:3] || '.co.uk', reverse(b) || '.net', b[1:12] || '.linkedin.com', b[3:6] || '.de']) AS host FROM named
  UNION ALL SELECT {DOMAIN} FROM pages),
hosts AS (SELECT DISTINCT regexp_replace(host, '^www\\.', '') AS host FROM made)"""
HITS = """p AS (SELECT p_partkey, p_name || ' ' || p_brand || ' Ltd.' AS company, regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]', '', 'g') AS b FROM part),
q AS (SELECT *, b[1:4 + p_partkey % 9] AS c FROM p),
hits AS (SELECT p_partkey, company, unnest(range(5))::INTEGER AS rank, unnest([regexp_replace(b, '[aeiou]', '', 'g') || '.com', b || '.linkedin.com', reverse(b) || '.example.co.uk',
    'shop.' || c || 'x.de', 'b.' || c || 'x.fr']) AS host,
  unnest(['https://www.' || regexp_replace(b, '[aeiou]', '', 'g') || '.com/', 'https://' || b || '.linkedin.com/in', 'http://' || reverse(b) || '.example.co.uk/x',
    'https://shop.' || c || 'x.de/', 'https://b.' || c || 'x.fr/']) AS link FROM q)"""
SQL = {
    "domain_score_fuzzy": f"""WITH {scores(f"SELECT DISTINCT s_name AS company, host FROM supplier, (SELECT DISTINCT {DOMAIN} AS host FROM pages)", 40)}
SELECT s_suppkey, host, round(score, 6) AS score FROM scored JOIN supplier ON s_name = company""",
    "domain_score_join": f"WITH {NAMED}, {MADE}, {scores('SELECT company, host FROM named, hosts', 70)} SELECT company, host, round(score, 6) AS score FROM scored",
    "domain_score_names": f"""WITH {HITS}, {scores('SELECT company, host FROM hits')}
SELECT p_partkey, rank, round(score, 6) AS score FROM hits JOIN scored USING (company, host)""",
    "domain_best_names": f"""WITH {HITS}, {scores('SELECT company, host FROM hits')}
SELECT p_partkey, round(score, 6) AS score, link FROM hits JOIN scored USING (company, host) QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY round(score, 6) DESC, rank) = 1""",
    "domain_split_rules": f"""WITH r AS (SELECT unnest([{quoted(SUFFIX_RULES)}]) AS rule),
h AS (SELECT page_id, unnest(range(11))::INTEGER AS n, {DOMAIN} || unnest(['', '.co.uk', '.k12.ca.us', '.ca.us', '.github.io', '.shop.ck', '.www.ck', '.ck', '.town.kawasaki.jp', '.city.kawasaki.jp', '.unlisted']) AS host FROM pages),
l AS (SELECT *, string_split(host, '.') AS l FROM h),
k AS (SELECT page_id, n, host, l, coalesce(max(CASE WHEN rule[1] = '!' AND ('.' || host).ends_with('.' || rule[2:]) THEN len(string_split(rule, '.')) - 1 END),
    max(CASE WHEN rule[1] NOT IN ('!', '*') AND ('.' || host).ends_with('.' || rule) OR rule[1] = '*' AND host.ends_with(rule[2:]) AND len(l) >= len(string_split(rule, '.')) THEN len(string_split(rule, '.')) END), 1) AS k FROM l, r GROUP BY ALL)
SELECT page_id, n, host, coalesce(list_aggregate(l[1:len(l) - k - 1], 'string_agg', '.'), '') AS subdomain, l[len(l) - k] AS domain, list_aggregate(l[len(l) - k + 1:], 'string_agg', '.') AS suffix FROM k""",
    "emails_from_text": f"WITH {DOC_EMAILS} SELECT doc_id, email FROM mails",
    "emails_validate": f"WITH {DOC_EMAILS}, r AS (SELECT doc_id, t AS raw, lower(t) AS e FROM raw) SELECT doc_id, raw, {VALID} AS valid FROM r",
    "emails_strict": f"""WITH tok AS ({TOKENS.format(id='doc_id', text='text', table='documents')}),
f AS (SELECT DISTINCT doc_id, t, lower(t) AS e FROM tok WHERE regexp_full_match(t, '[A-Za-z0-9._%+-]*[A-Za-z0-9_%+]@[A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?(\\.[A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?)+')),
g AS (SELECT doc_id, t, e, {USER} AS u, {HOST} AS h FROM f)
SELECT DISTINCT doc_id, e AS email FROM g WHERE length(u) <= 30 AND NOT regexp_matches(u, '^[.-]|[.-]$|\\.\\.') AND {TLD} AND h NOT IN ({quoted(BLACKLIST)})
  AND NOT regexp_matches(e, '[.]({'|'.join(FILE_EXTENSIONS)})$') AND NOT regexp_matches(t, '\\d{{4}}-\\d{{2}}-\\d{{2}}[@-]\\d') AND NOT regexp_matches(t, '\\d+x\\d+')
  AND NOT regexp_matches(t, 'is-layout-|has-background|wp-block-|cookielawinfo-|elementor-|fa-|woocommerce-|e\\d{{4,}}')""",
    "emails_from_pages": f"WITH {PAGE_EMAILS} SELECT page_id, email FROM mails",
    "emails_per_url_joined": f"WITH {PAGE_EMAILS} SELECT url, string_agg(DISTINCT email, ';' ORDER BY email) AS emails FROM mails GROUP BY url",
    "emails_distinct_count": f"WITH {DOC_EMAILS} SELECT count(DISTINCT email) AS n_emails FROM mails",
    "emails_blacklist_anti": f"WITH {DOC_EMAILS} SELECT doc_id, email FROM mails WHERE string_split(email, '@')[2] NOT IN ('mail1.example.com', 'mail2.example.com')",
    "emails_masked": f"WITH {DOC_EMAILS} SELECT doc_id, left(email, 1) || '***@' || string_split(email, '@')[2] AS masked, sha256(email) AS pseudonym FROM mails",
    "deobf_at_dot": "SELECT doc_id, unnest(['user' || doc_id || '@host' || doc_id || '.sub.de', 'x' || doc_id || '@mail.org']) AS email FROM documents",
    "deobf_cfemail": "SELECT doc_id, 'name' || doc_id || '@mail.example.de' AS email FROM documents",
    "deobf_charcode": "SELECT doc_id, 'name' || doc_id || '@mail.example.de' AS email FROM documents",
    "deobf_base64": "SELECT doc_id, 'please write to the desk: name' || doc_id || '@mail.example.de thanks' AS text FROM documents",
    "deobf_rot13": "SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm') AS text FROM documents",
    "extract_cascade": """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'name' || doc_id || '@mail.example.de' WHEN 1 THEN 'visible@site.de'
  ELSE 'name' || doc_id || '@mail.example.de' END AS email FROM documents""",
    "url_normalise_domain": f"SELECT page_id, {DOMAIN} AS domain FROM pages",
    "url_canonicalise": f"SELECT page_id, {CANONICAL} AS canonical FROM pages",
    "url_canonicalise_query": f"SELECT * FROM {CANONICAL_QUERY}",
    "url_validate": """WITH u AS (SELECT page_id, unnest([0, 1, 2, 3]) AS n, unnest([url, replace(url, 'http', 'ftp'), replace(url, '://', ':///'), url || repeat('a', 2000)]) AS u FROM pages)
SELECT page_id, n::INTEGER AS n, length(u) <= 2000 AND regexp_matches(u, '^(?i)https?://[^/?#]+') AS valid FROM u""",
    "url_dedupe_first": f"SELECT min(page_id) AS page_id, {CANONICAL} AS canonical FROM pages GROUP BY 2",
    "url_domain_counts": f"SELECT {DOMAIN} AS domain, count(*) AS n FROM pages GROUP BY 1",
    "url_domain_topk": f"SELECT page_id, {DOMAIN} AS domain FROM pages QUALIFY row_number() OVER (PARTITION BY {DOMAIN} ORDER BY page_id) <= 12",
    "url_blocked_filter": f"SELECT page_id, url FROM pages WHERE NOT (ends_with(lower({NETLOC}), 'example.org') OR ends_with(lower({PATH}), '.html'))",
    "url_priority_filter": "SELECT page_id, url FROM pages WHERE contains(lower(url), 'casino') OR contains(lower(url), '/de/')",
    "url_candidates": f"""WITH r AS (SELECT page_id, url, {SCHEME} AS s, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(.*)$', 1, 's') AS r FROM pages)
SELECT page_id, unnest([0, 1, 2])::INTEGER AS pos, unnest([url, s || '://' || CASE WHEN starts_with(r, 'www.') THEN r ELSE 'www.' || r END, 'http://' || r]) AS url FROM r""",
    "url_fetch_first": f"""WITH a AS (SELECT page_id, replace(url, '://www.', '://') AS url FROM pages),
r AS (SELECT page_id, url, {SCHEME} AS s, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(.*)$', 1, 's') AS r FROM a),
c AS (SELECT page_id, unnest([0, 1, 2])::INTEGER AS pos, unnest([url, s || '://www.' || r, 'http://' || r]) AS fetched FROM r)
SELECT page_id, pos, fetched FROM c WHERE fetched IN (SELECT url FROM pages) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) = 1""",
    "links_extract": """WITH h AS (SELECT page_id, regexp_extract_all(html, '<a\\b[^>]*?\\bhref\\s*=\\s*"([^"]*)"', 1, 'is') AS l FROM pages)
SELECT page_id, (unnest(range(1, len(l) + 1)) - 1)::INTEGER AS link_pos, replace(unnest(l), '&amp;', '&') AS href FROM h""",
    "links_resolve_same_site": f"""WITH h AS (SELECT url, {SCHEME} || '://' || {NETLOC} AS root, regexp_extract_all(html, '<a\\b[^>]*?\\bhref\\s*=\\s*"([^"]*)"', 1, 'is') AS l FROM pages)
SELECT url AS src, (unnest(range(1, len(l) + 1)) - 1)::INTEGER AS link_pos, root || replace(unnest(l), '&amp;', '&') AS dst FROM h""",
    "company_clean": f"""WITH c AS (SELECT s_suppkey, lower(s_name || [' GmbH', ' Inc.', ' & Co.', ' Limited', ''][s_suppkey % 5 + 1]) AS low FROM supplier)
SELECT s_suppkey, regexp_replace({SUFFIX_CASE}, '[^a-z0-9]', '', 'g') AS base FROM c""",
    "domain_split": f"""WITH h AS (SELECT page_id, unnest([0, 1, 2])::INTEGER AS n, string_split(unnest([{DOMAIN}, 'shop.firm.co.uk', 'localhost']), '.') AS l FROM pages),
k AS (SELECT *, {SPLIT} AS k FROM h)
SELECT page_id, n, coalesce(list_aggregate(l[1:len(l) - k - 1], 'string_agg', '.'), '') AS subdomain, l[len(l) - k] AS domain,
  CASE WHEN k = 0 THEN '' ELSE list_aggregate(l[len(l) - k + 1:], 'string_agg', '.') END AS suffix FROM k""",
    "domain_score": f"WITH {LEADS} SELECT input_pos, CASE WHEN input_pos % 7 = 0 THEN 50.0::DOUBLE ELSE 100.0::DOUBLE END AS score FROM l",
    "domain_best": f"WITH {LEADS} SELECT input_pos, CASE WHEN input_pos % 7 = 0 THEN 50.0::DOUBLE ELSE 100.0::DOUBLE END AS score, CASE WHEN input_pos % 7 = 0 THEN 'https://www.linkedin.com/company/' || input_pos ELSE 'https://www.' || host || '/' END AS link FROM l",
    "resolve_first_wins": f"""WITH {LEADS}, c AS (SELECT input_pos, host, CASE WHEN input_pos % 7 = 0 THEN 'Q!' ELSE upper(left(label, 1)) || substr(label, 2) || ' GmbH' END AS company FROM l),
hit AS (SELECT company, arg_min(host, input_pos) AS host FROM c WHERE input_pos % 11 <> 0 GROUP BY company),
j AS (SELECT c.input_pos, CASE WHEN c.input_pos % 11 = 0 THEN NULL ELSE hit.host END AS host, c.input_pos % 7 = 0 AS short FROM c LEFT JOIN hit USING (company)),
k AS (SELECT input_pos, CASE WHEN host IS NULL THEN 0 WHEN short THEN 50 ELSE 100 END::DOUBLE AS score,
  CASE WHEN NOT short THEN regexp_replace(host, '^www\\.', '') END AS domain, host IS NULL AS missing FROM j)
SELECT input_pos, score, domain, CASE WHEN missing THEN 'no_google' WHEN domain IS NULL THEN 'domain_unclear'
  WHEN min(input_pos) OVER (PARTITION BY domain) <> input_pos THEN 'skipped_domain' ELSE 'domain' END AS status FROM k""",
    "result_rows": f"WITH {RESULT_ROWS} SELECT * FROM rows",
    "run_summary": f"""WITH {RESULT_ROWS}, per AS (SELECT "Domain", count("Email") AS n FROM rows GROUP BY 1), k AS (SELECT count(*) AS k, count(*) FILTER (n > 0) AS w FROM per),
e AS (SELECT floor(value)::BIGINT % 500 + 100 AS s FROM events)
SELECT k AS leads, 0::BIGINT AS no_google, 0::BIGINT AS google_error, 0::BIGINT AS domain_unclear, k AS domain, 0::BIGINT AS sitemap, w AS with_email, k - w AS without_email,
  0::BIGINT AS processing_error, (SELECT count(*) FROM e) AS total_requests, 0::BIGINT AS skipped_urls, (SELECT count(*) FROM e WHERE s BETWEEN 400 AND 599) AS errors,
  (SELECT count(DISTINCT "Email") FROM rows) AS n_emails FROM k""",
    "crawl_bfs": """WITH RECURSIVE n AS (SELECT count(*) AS n FROM pages), walk(page, depth) USING KEY (page) AS (
  SELECT 0::BIGINT, 0
  UNION SELECT t, (min(depth) + 1)::INTEGER FROM (SELECT unnest([(page * 2 + 1) % n, (page * 2 + 2) % n]) AS t, depth FROM walk, n) AS x
  WHERE NOT EXISTS (SELECT 1 FROM recurring.walk AS r WHERE r.page = t) GROUP BY t)
SELECT 'site' AS domain, page AS page_id, depth FROM walk""",
    "crawl_bfs_limited": f"WITH RECURSIVE {WALK} SELECT 'site' AS domain, page AS page_id, depth, visit FROM ranked WHERE visit <= 40",
    "sitemap_locs": f"WITH {LISTED} SELECT domain, (row_number() OVER (PARTITION BY domain ORDER BY page_id) - 1)::INTEGER AS pos, url FROM l",
    "sitemap_priority": f"""WITH {LISTED}, g AS (SELECT domain, url, min(page_id) AS p FROM l WHERE contains(lower(url), '/en/') OR contains(lower(url), '/de/') GROUP BY 1, 2)
SELECT domain, url FROM g QUALIFY row_number() OVER (PARTITION BY domain ORDER BY p) <= 12""",
    "sitemap_nested": f"""WITH RECURSIVE {LISTED}, k AS (SELECT domain, url, row_number() OVER (PARTITION BY domain ORDER BY page_id) - 1 AS k, count(*) OVER (PARTITION BY domain) AS c FROM l),
m AS (SELECT domain, max((c + 2) // 3) AS n FROM k GROUP BY domain),
r AS (SELECT domain, 0::BIGINT AS i FROM m UNION SELECT r.domain, (r.i + 1) % m.n FROM r JOIN m ON r.domain = m.domain)
SELECT k.domain, 'https://' || k.domain || '/u' || k || '.xml' AS sitemap_url, url FROM k JOIN r ON r.domain = k.domain AND r.i = k.k // 3""",
    "cache_latest": f"WITH {LOG}, {LATEST} SELECT key, value FROM alive",
    "cache_prune": f"WITH {LOG}, {LATEST} SELECT key, value FROM alive WHERE (SELECT max(ts) FROM log) - ts <= 864000 ORDER BY ts DESC, key LIMIT 20",
    "cache_ttl_lookup": f"""WITH {LOG}, asks AS (SELECT event_id, 'k' || ((user_id + 1) % 100) AS key, {SECONDS} AS asked FROM events),
j AS (SELECT a.event_id, a.key, a.asked, max({{'ts': l.ts, 'has': l.value IS NOT NULL, 'value': l.value}}) AS m FROM asks a LEFT JOIN log l ON a.key = l.key AND l.ts <= a.asked GROUP BY 1, 2, 3)
SELECT event_id, key, CASE WHEN asked - m.ts <= 86400 THEN m.value END AS value FROM j""",
    "rate_min_interval": f"""WITH {ARRIVE}, s AS (SELECT key, n, t, n * 100.0 + max(t - n * 100.0) OVER (PARTITION BY key ORDER BY n) AS start FROM o)
SELECT key, n::INTEGER AS n, round(start - t, 2) AS wait FROM s""",
    "rate_global_interval": f"""WITH o AS (SELECT floor({SECONDS}) AS t, row_number() OVER (ORDER BY floor({SECONDS})) - 1 AS n FROM events)
SELECT n, t AS arrive, round(n * 100.0 + max(t - n * 100.0) OVER (ORDER BY n) - t, 2) AS wait FROM o""",
    "token_bucket_global": f"""WITH RECURSIVE o AS (SELECT floor({SECONDS}) AS t, row_number() OVER (ORDER BY floor({SECONDS})) - 1 AS n FROM events), b AS (
  SELECT n, t, t AS now, 40.0::DOUBLE AS have FROM o WHERE n = 0
  UNION ALL SELECT o.n, o.t, greatest(o.t, b.now + CASE WHEN b.have >= 1 THEN 0 ELSE (1 - b.have) * 256 END),
    least(40.0, CASE WHEN b.have >= 1 THEN b.have - 1 ELSE 0 END + (greatest(o.t, b.now + CASE WHEN b.have >= 1 THEN 0 ELSE (1 - b.have) * 256 END)
      - (b.now + CASE WHEN b.have >= 1 THEN 0 ELSE (1 - b.have) * 256 END)) / 256)
  FROM b JOIN o ON o.n = b.n + 1)
SELECT n, t AS arrive, round(now + CASE WHEN have >= 1 THEN 0 ELSE (1 - have) * 256 END - t, 2) AS wait FROM b""",
    "progress_global": """WITH r AS (SELECT l_orderkey, l_linenumber, least(CAST(sum(CAST(l_quantity AS BIGINT)) OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) ROWS UNBOUNDED PRECEDING) AS BIGINT), 1000000) AS current FROM lineitem)
SELECT l_orderkey, l_linenumber, current, round(100.0::DOUBLE * current / 1000000, 6) AS percent FROM r""",
    "token_bucket_wait": f"""WITH RECURSIVE {ARRIVE}, b AS (
  SELECT key, n, t, t AS now, 3.0::DOUBLE AS have FROM o WHERE n = 0
  UNION ALL SELECT o.key, o.n, o.t, greatest(o.t, b.now + CASE WHEN b.have >= 1 THEN 0 ELSE (1 - b.have) * 8192 END),
    least(3.0, CASE WHEN b.have >= 1 THEN b.have - 1 ELSE 0 END + (greatest(o.t, b.now + CASE WHEN b.have >= 1 THEN 0 ELSE (1 - b.have) * 8192 END)
      - (b.now + CASE WHEN b.have >= 1 THEN 0 ELSE (1 - b.have) * 8192 END)) / 8192)
  FROM b JOIN o ON o.key = b.key AND o.n = b.n + 1)
SELECT key, n::INTEGER AS n, round(now + CASE WHEN have >= 1 THEN 0 ELSE (1 - have) * 8192 END - t, 2) AS wait FROM b""",
    "backoff_schedule": """SELECT n_nationkey, unnest(range(0, n_nationkey % 6))::INTEGER AS attempt, 2.0::DOUBLE * pow(2.0, unnest(range(0, n_nationkey % 6))) AS sleep FROM nation""",
    "status_histogram": f"WITH {STATUS} SELECT CASE WHEN status IS NULL THEN 'no_response' ELSE 'status_' || status END AS key, count(*) AS n FROM r GROUP BY 1",
    "request_totals": f"WITH {STATUS} SELECT count(*) AS total_requests, count(*) FILTER (event_id % 9 = 0) AS skipped_urls, count(*) FILTER (status BETWEEN 400 AND 599) AS errors FROM r",
    "worker_stats": """WITH t AS (SELECT event_type, floor(abs(value))::BIGINT % 5 <> 0 AS ok, (event_id % 4 + 1)::DOUBLE AS d FROM events)
SELECT event_type, count(*) AS processed, count(*) FILTER (NOT ok) AS errors, round(100.0::DOUBLE * count(*) FILTER (ok) / count(*), 6) AS success_rate, round(count(*) / sum(d), 6) AS tasks_per_second FROM t GROUP BY 1""",
    "progress_running": """WITH r AS (SELECT event_id, user_id, least(count(*) OVER (PARTITION BY user_id ORDER BY event_id), 5) AS current FROM events)
SELECT event_id, user_id, current, round(100.0::DOUBLE * current / 5, 6) AS percent FROM r""",
    "progress_stats": """WITH g AS (SELECT o_orderstatus, count(*) FILTER (o_orderkey % 3 = 0) AS c, count(*) AS t FROM orders GROUP BY 1), h AS (SELECT *, c / 10.0::DOUBLE AS s FROM g)
SELECT o_orderstatus, round(100.0::DOUBLE * c / t, 4) AS percent, round((t - c) / (c / s), 4) AS eta, CASE WHEN s < 60 THEN printf('%.1fs', s)
  WHEN s < 3600 THEN (floor(s / 60)::BIGINT) || 'm ' || (floor(s)::BIGINT % 60) || 's' ELSE (floor(s / 3600)::BIGINT) || 'h ' || (floor(s)::BIGINT % 3600 // 60) || 'm' END AS elapsed_text, c >= t AS completed FROM h""",
    "batch_numbers": "SELECT o_orderkey, o_custkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 3 AS batch FROM orders",
    "request_gaps": "SELECT event_id, round((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6, 3) AS gap FROM events",
    "proxy_rank": f"WITH {PROXIES}, r AS (SELECT pos, round(s / (s + f), 6) AS rate FROM p) SELECT 'proxy-' || pos AS url, rate FROM r ORDER BY rate DESC, pos LIMIT 5",
    "proxy_stats": f"WITH {PROXIES} SELECT count(*) AS total, count(*) FILTER (1728000 > banned) AS available, count(*) FILTER (NOT 1728000 > banned) AS banned, round(avg(s / (s + f)), 6) AS mean_rate FROM p",
    "merge_kth": """WITH b AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'own' END AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders WHERE o_orderkey % 2 = 0),
f AS (SELECT o_custkey, o_orderkey, 'new' || o_orderkey AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders WHERE o_orderkey % 2 = 1)
SELECT b.o_custkey, b.o_orderkey, CASE WHEN b.v = '' THEN coalesce(f.v, b.v) ELSE b.v END AS v, 'input' AS source FROM b LEFT JOIN f USING (o_custkey, k)
UNION ALL SELECT f.o_custkey, f.o_orderkey, f.v, 'result' FROM f ANTI JOIN b USING (o_custkey, k)""",
    "append_union": "SELECT c_custkey AS id, c_name AS name, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier",
    "stats_flags_sum": "SELECT " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS {k}" for k in ("click", "view", "purchase", "signup")) + " FROM events",
    "drop_duplicates_full": "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem",
    "limit_overrides": "SELECT n_name AS domain, CASE WHEN n_nationkey % 4 = 0 THEN n_nationkey ELSE 12 END AS \"limit\" FROM nation",
    "query_cache": "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'cached ' || s_suppkey ELSE 'fresh' END AS value, s_suppkey % 3 = 0 AS hit FROM supplier",
    "time_texts": """WITH s AS (SELECT DISTINCT round((l_orderkey * 7 % 9000 + l_linenumber / 10)::DOUBLE, 1) AS seconds FROM lineitem)
SELECT seconds, CASE WHEN seconds < 60 THEN printf('%.1fs', seconds) WHEN seconds < 3600 THEN (floor(seconds / 60)::BIGINT) || 'm ' || (floor(seconds)::BIGINT % 60) || 's'
  ELSE (floor(seconds / 3600)::BIGINT) || 'h ' || (floor(seconds)::BIGINT % 3600 // 60) || 'm' END AS text FROM s""",
    "config_clamps": """SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 12.0::DOUBLE ELSE greatest(1, least(500, n_nationkey * 40 - 100))::DOUBLE END AS pages, 'a|' || lower(n_name) AS parts FROM nation""",
    "search_topk": f"SELECT {DOMAIN} AS query, page_id, url, string_split(url, '/')[3] AS display_link FROM pages QUALIFY row_number() OVER (PARTITION BY {DOMAIN} ORDER BY page_id) <= 3",
    "engine_first": """WITH h AS (SELECT 'q' || (user_id % 40) AS query, (event_id % 3 + user_id % 2)::INTEGER AS engine_pos, event_id AS link FROM events)
SELECT query, engine_pos, link FROM h QUALIFY engine_pos = min(engine_pos) OVER (PARTITION BY query)""",
    "url_join": """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url WHEN page_id % 2 = 0 THEN 'https://shop.de/x/' || page_id ELSE 'http://shop.de/a/x/' || page_id END AS joined FROM pages""",
    "robots_lines": f"""WITH h AS (SELECT DISTINCT {DOMAIN} AS domain FROM pages)
SELECT domain, unnest([1, 3])::INTEGER AS pos, unnest(['https://www.' || domain || '/s.xml', 'https://' || domain || '/t.xml']) AS url FROM h""",
    "sitemap_candidates": f"""WITH h AS (SELECT DISTINCT {DOMAIN} AS domain FROM pages), f AS (SELECT domain, unnest(CASE WHEN len(string_split(domain, '.')) > 2 THEN [0] ELSE [0, 1] END) AS h FROM h),
g AS (SELECT domain, h, unnest([0, 1, 2, 3]) AS n, unnest(['sitemap.xml', 'sitemap_index.xml', 'sitemap-index.xml', 'sitemap1.xml']) AS name FROM f)
SELECT domain, (h * 4 + n)::INTEGER AS pos, 'https://' || CASE WHEN h = 1 THEN 'www.' ELSE '' END || domain || '/' || name AS url FROM g""",
    "xml_sniff": "SELECT page_id, page_id % 3 <> 2 AS xml FROM pages",
    "frontier_new_links": f"""WITH h AS (SELECT {SCHEME} || '://' || {NETLOC} AS root, regexp_extract_all(html, '<a\\b[^>]*?\\bhref\\s*=\\s*"([^"]*)"', 1, 'is') AS l FROM pages),
t AS (SELECT DISTINCT root || replace(unnest(l), '&amp;', '&') AS dst FROM h) SELECT dst FROM t WHERE dst NOT IN (SELECT canonical FROM {CANONICAL_QUERY})""",
    "proxy_bans": f"SELECT 'proxy-' || user_id AS url, max(floor({SECONDS})) + 300 AS banned_until FROM events WHERE event_type = 'error' GROUP BY 1",
    "task_batches": """WITH t AS (SELECT event_id % 7 AS g, (row_number() OVER (PARTITION BY event_id % 7 ORDER BY event_id) - 1) // 100 AS batch, floor(abs(value))::BIGINT % 5 <> 0 AS ok FROM events)
SELECT g, batch, count(*) AS n FROM t WHERE NOT ok GROUP BY 1, 2""",
    "debug_names": f"""SELECT page_id, regexp_replace({NETLOC} || '_' || CASE WHEN regexp_replace({PATH}, '^/+|/+$', '', 'g') = '' THEN 'index' ELSE regexp_replace({PATH}, '^/+|/+$', '', 'g') END, '[^A-Za-z0-9._-]', '_', 'g') || '.html' AS name FROM pages""",
    "responses_plain": f"""WITH {DOC_EMAILS} SELECT DISTINCT 'https://site.de/' || doc_id || '.txt' AS url, email FROM mails
  WHERE doc_id % 3 < 3 AND doc_id % 7 <> 0 AND doc_id % 5 <> 0""",
    "entities_named": f"""WITH p AS (SELECT page_id, {DOMAIN} AS h, [{quoted(e for e, _ in ENTITY_CASES)}][page_id % {len(ENTITY_CASES)} + 1] AS e, [{quoted(c for _, c in ENTITY_CASES)}][page_id % {len(ENTITY_CASES)} + 1] AS c FROM pages)
SELECT page_id, h || e || '-' || page_id AS raw, h || c || '-' || page_id AS text FROM p""",
    "contact_nested": f"""WITH p AS (SELECT page_id, {DOMAIN} AS h FROM pages), f AS (SELECT page_id, unnest(['p' || page_id || '@' || h, 'q@' || h]) AS e FROM p)
SELECT page_id, e AS email FROM f WHERE {VALID}""",
    "links_rules": f"""WITH h AS (SELECT page_id, {DOMAIN} AS domain, regexp_extract_all(html, '<a\\b[^>]*?\\bhref\\s*=\\s*"([^"]*)"', 1, 'is') AS l FROM pages),
e AS (SELECT page_id, domain, (unnest(range(1, len(l) + 1)) - 1)::INTEGER AS link_pos, replace(unnest(l), '&amp;', '&') AS raw FROM h),
r AS (SELECT page_id, domain, link_pos, CASE link_pos % 4 WHEN 0 THEN raw WHEN 1 THEN ' MAILTO:x@' || domain WHEN 2 THEN 'https://' || domain || raw ELSE 'https://else.org' END AS href FROM e)
SELECT page_id, link_pos, href, lower(trim(href)).starts_with('mailto:') AS mail, href.starts_with('/') OR contains(href, domain) AS same FROM r""",
    "url_rules": f"""SELECT page_id, page_id % 4 NOT IN (1, 2) AS valid, {DOMAIN} IN ('therin.example.net', 'thther.example.org') AS blocked,
  'https://find.example/?q=Firm++' || page_id || '&n=10' AS search FROM pages""",
    "names_relevant": f"""WITH {HITS}, {scores('SELECT company, host FROM hits')} SELECT p_partkey, rank, score >= 70 AS relevant FROM hits JOIN scored USING (company, host)""",
    "head_checks": "SELECT event_id, event_id % 4 IN (0, 2) AND (event_id % 3 = 0 OR event_id * 9000 <= 52428800) AS allowed FROM events",
    "progress_total": """WITH g AS (SELECT o_orderstatus, count(*) FILTER (o_orderkey % 3 = 0) AS c, count(*) AS t FROM orders GROUP BY 1)
SELECT sum(t)::BIGINT AS total, sum(c)::BIGINT AS current, round(100.0::DOUBLE * sum(c) / sum(t), 6) AS percent, bool_and(c >= t) AS completed FROM g""",
    "row_delta": "SELECT count(*) AS n_before, count(*) + count(*) FILTER (o_orderstatus = 'F') AS n_after, count(*) FILTER (o_orderstatus = 'F') AS delta FROM orders",
    "proxy_checks": "SELECT count(*) FILTER (event_type = 'click') AS working, count(*) AS total FROM events",
    "proxy_best": f"WITH {PROXIES} SELECT 'proxy-' || pos AS url, pos FROM p WHERE 31622400 > banned ORDER BY s / (s + f) DESC, pos LIMIT 1",
    "cache_names": f"WITH {LOG}, {LATEST} SELECT key, sha256(key) || '.bin' AS name, (SELECT count(*) FROM alive) AS entries FROM alive",
    "since_last": "SELECT user_id, round((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts)) / 1e6, 3) AS gap FROM events",
}
