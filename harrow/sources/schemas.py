"""Schemas of the logical input and output tables."""

from __future__ import annotations

COMPANIES = "input_pos long, company string"
SEARCH_RESULTS = "company string, rank int, title string, link string, display_link string"
RESPONSES = (
    "url string, final_url string, method string, status int, content_type string, body binary, text string, "
    "rendered_html string, fetched_at timestamp"
)
SITEMAPS = "domain string, sitemap_url string, sitemap_pos int, body binary"
ROBOTS = "domain string, text string"
LINKS = "src string, link_pos int, href string"
LIMITS = "domain string, limit int"
RATES = "domain string, rate double"
CACHE = "key string, value string, ts double"
CACHE_BINARY = "key string, value binary, ts double"
TASKS = "task string, result string, error string, success boolean, duration double"
PROXIES = "pos long, url string, success_count long, failure_count long, banned_until double"
RESULTS = "Company string, Domain string, Email string"
URL_EMAILS = "url string, emails string"
