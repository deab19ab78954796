import pytest
from pyspark.sql import functions as F

from harrow import config
from harrow.functions import decoders, emails, html, scoring, sql, urls


def one(spark, f, *values):
    row = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return row.select(f(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).head().x


@pytest.mark.parametrize(
    ("f", "text", "want"),
    [
        (urls.validate_url, "https://example.com", True),
        (urls.validate_url, "http://example.com/path", True),
        (urls.validate_url, "", False),
        (urls.validate_url, "example.com", False),
        (urls.validate_url, "https://", False),
        (urls.validate_url, "ftp://example.com", False),
        (urls.validate_url, "https://example.com/" + "a" * 2000, False),
        (urls.validate_url, None, False),
        (urls.validate_url_strict, "https://example.com/?x=data:1", False),
        (urls.normalise_domain, "https://www.example.com", "example.com"),
        (urls.normalise_domain, "EXAMPLE.COM", "example.com"),
        (urls.normalise_domain, "HTTPS://X.com/a", "https://x.com/a"),
        (urls.canonicalise, "HTTPS://WWW.A.com/b/?x=1#f", "https://a.com/b"),
        (urls.canonicalise, "https://a.com", "https://a.com/"),
        (urls.canonicalise_query, "https://A.com/p/?b=2&utm_x=1&a=1&a=0#f", "https://A.com/p/?a=0&a=1&b=2"),
        (urls.canonicalise_query, "https://a.com/p?q=a+b*~%zz", "https://a.com/p?q=a%2Bb%2A~%25zz"),
        (urls.display_link, "https://a.com/b", "a.com"),
        (emails.clean_email, "mailto:Test@Mail.Example.com?subject=x", "test@mail.example.com"),
        (emails.clean_email, "a@example.com", None),
        (emails.clean_email, "x@a.de)>,", "x@a.de"),
        (emails.is_valid_email, "a@mail.example.com", True),
        (emails.is_valid_email, "team-noreply@a.de", False),
        (emails.is_valid_email, "logo@2x.png", False),
        (emails.is_valid_email, "test@", False),
        (emails.is_valid_email, "@a.com", False),
        (emails.is_valid_email, "test", False),
        (emails.is_valid_email, "0123456789abcdef0123@a.de", False),
        (emails.find_emails, "write x@a.de now", ["x@a.de"]),
        (emails.find_emails, "write x@a.de.", []),
        (emails.deobfuscate, "x [at] a [dot] de", "x@a.de"),
        (emails.deobfuscate, "x [at] a.de", "x [at] a.de"),
        (emails.deobfuscate, "m at b (dot) c dot org\nand y(at)z[dot]de!", "m@b.c.org\nand y@z.de!"),
        (emails.is_valid_email_strict, "jane2024@firm.de", False),
        (emails.is_valid_email_strict, "jane@firm.de", True),
        (emails.is_valid_email_strict, "a..b@firm.de", False),
        (emails.is_valid_email_strict, "jane@firm.notatld", False),
        (emails.clean_email_strict, "Jane@Firm.de#x;", "jane@firm.de"),
        (lambda e: emails.is_suspicious(e, ["sales", "info"]), "sales@a.de", True),
        (lambda e: emails.is_suspicious(e, ["sales", "info"]), "jane@a.de", False),
        (emails.mask, "jane@a.de", "j***@a.de"),
        (decoders.decode_cfemail, "4223620a20", "a Hb"),
        (decoders.decode_cfemail, "42zz", None),
        (decoders.decode_charcodes, "fromCharCode(120,64, 97,46,100,101)", "x@a.de"),
        (decoders.decode_charcodes, "fromCharCode(...codes)", ""),
        (decoders.rot13, "Uryyb", "Hello"),
        (decoders.decode_base64, "aGVsbG8=", "hello"),
        (decoders.decode_base64, "!!", None),
        (html.hrefs, "<a class=x href='/a?b&amp;c'>1</a><A HREF=\"#t\">2</A><a>3</a><a href=/z>4</a>", ["/a?b&c", "#t", "/z"]),
        (html.text_of, "<p>a<b>b</b></p><script>no()</script><!-- no -->&amp;c", " a b  &c"),
        (scoring.clean_company_name, "Example GmbH", "example"),
        (scoring.clean_company_name, "Example Ltd", "example"),
        (scoring.clean_company_name, "Example-Company", "examplecompany"),
        (scoring.clean_company_name, None, ""),
    ],
)
def test_golden(spark, f, text, want):
    got = one(spark, f, text)
    if f is html.text_of:
        got, want = got.split(), want.split()
    assert got == want


def test_cascade_stops_at_the_first_stage_that_finds(spark):
    shown = '<p>x@site.de</p><a href="mailto:y@site.de">m</a>'
    assert one(spark, decoders.cascade, shown) == ["x@site.de"]
    assert one(spark, lambda c: decoders.cascade(c, mode="all"), shown) == ["x@site.de", "y@site.de"]
    assert one(spark, decoders.cascade, '<a href="mailto:y@site.de?subject=1">m</a>') == ["y@site.de"]
    key = 0x42
    coded = f"{key:02x}" + "".join(f"{ord(c) ^ key:02x}" for c in "z@site.de")
    assert one(spark, decoders.cascade, f'<i data-cfemail="{coded}"></i>{shown}') == ["z@site.de"]
    script = "<script>a([...'user@jsfallback.example'].map(f))</script>"
    assert one(spark, decoders.cascade, script) == []
    assert one(spark, decoders.cascade, None) == []
    assert one(spark, lambda a, b: decoders.cascade(a, b), script, "<p>user@jsfallback.example</p>") == ["user@jsfallback.example"]


def test_scores(spark):
    score = lambda c, u: one(spark, scoring.score_domain, c, u)
    assert score("Example", "example.com") >= 80
    assert score("Example Company", "example.com") >= 70
    assert score("Example", "linkedin.com/company/example") < 80
    assert score("Example", "unrelated.com") < 50
    assert score("AB", "ab.com") == 50
    assert score("", "ab.com") == 0
    assert one(spark, scoring.is_relevant, "Example", "https://example.com")


def test_partial_similarity():
    assert scoring.partial_similarity("abc", "xxabcxx") == 100
    assert scoring.partial_similarity("", "abc") == 0
    assert abs(scoring.partial_similarity("abcd", "xxabzd") - 75) < 1e-9
    assert scoring.lcs("abcbdab", "bdcaba") == 4


def test_simple_resolution_agrees_with_the_library(spark):
    from urllib.parse import urljoin

    base = "https://a.com/x/y?z=1"
    for href in ("/b", "//c.com/d", "http://e.com/f", "?q=2", "#g", "mailto:x@y.z"):
        assert one(spark, urls.resolve_simple, base, href) == urljoin(base, href)
    for href in ("b", "../b", "./b"):
        assert one(spark, urls.resolve_simple, base, href) is None
        assert one(spark, lambda b, h: urls.resolve_exact()(b, h), base, href) == urljoin(base, href)


def test_other_python_steps(spark):
    assert one(spark, lambda c: emails.clean_email(c, idna=True), "x@xn--mnchen-3ya.de") == "x@münchen.de"
    assert one(spark, lambda c: html.unescape()(c), "&eacute;&#64;") == "é@"
    parsed = one(spark, lambda c: html.parse_exact()(c), "<p>a</p><style>no</style><a href='/x'>b</a>")
    assert parsed.text.split() == ["a", "b"] and parsed.hrefs == ["/x"]


def test_sql_functions(spark):
    sql.register(spark)
    row = spark.sql("select normalise_domain('https://www.A.de/x') d, valid_url('x') v, rot13('Uryyb') r, partial_ratio('abc', 'xabcx') p").head()
    assert tuple(row) == ("a.de", False, "Hello", 100.0)
    spark.udtf.register("extract_emails", sql.extract_emails_udtf())
    assert [r.email for r in spark.sql("select * from extract_emails('A@b.de, c@d.org x')").collect()] == ["a@b.de", "c@d.org"]


def test_options():
    o = config.Options.from_env({"MAX_WORKERS": "999", "MAX_CRAWL_DELAY": "x", "PROCESS_PDFS": "Yes", "BLOCKED_DOMAINS": " A.de, ,b.de"})
    assert o["MAX_WORKERS"] == 64 and o["MAX_CRAWL_DELAY"] == 2.0 and o.process_pdfs and o.blocked_domains == ("a.de", "b.de")
    assert len(o.priority_parts) == 14 and len(o.problems()) == 2
    with pytest.raises(ValueError):
        o.check()
    assert o.updated({"max_workers": 3, "api_key": "k", "unknown": 1})["MAX_WORKERS"] == 3


def test_entities_hide_no_address(spark):
    for text in ("j&#64;firm&#46;de", "j&#x40;firm&#X2e;de", "j&commat;firm&period;de", "<b>j</b>&#0064;firm.de".replace("<b>j</b>", "j")):
        assert one(spark, decoders.cascade, f"<p>{text}</p>") == ["j@firm.de"]
    for text in ("&amp;#64;", "&#0;&#xD800;&#1114112;", "&#8364; &#x1F600;", "&;&#;&#x;"):
        import html as lib

        assert one(spark, html.unescape_common, text) == lib.unescape(text)


def test_strict_page_composes_all_parts(spark):
    page = '<p>a@firm.de</p><a href="MAILTO:B@firm.org?subject=x">m</a><i class="my-contact">c@firm.com</i><img src="x@2x.png"><a href="mailto:d@firm.shop">d</a>'
    assert one(spark, decoders.cascade_strict, page) == ["a@firm.de", "b@firm.org", "c@firm.com"]
    assert one(spark, lambda c: decoders.cascade_strict(c, tlds=["shop"]), page) == ["d@firm.shop"]
    assert one(spark, decoders.cascade_strict, None) == []


def nested_contacts(page):
    """The texts within contact elements by the standard library's parser and a stack."""
    import re
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=False)
            self.stack, self.out = [], []

        def handle_starttag(self, tag, attrs):
            if tag not in html.VOID:
                named = any(k in ("class", "id") and re.search(r"contact|email|\bmail\b", v or "", re.I) for k, v in attrs)
                self.stack.append((tag, named))

        def handle_startendtag(self, tag, attrs):
            pass

        def handle_endtag(self, tag):
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] == tag:
                    del self.stack[i:]
                    break

        def handle_data(self, data):
            if any(n for _, n in self.stack) and not (self.stack and self.stack[-1][0] in ("script", "style")):
                self.out += data.split()

    r = Reader()
    r.feed(page)
    r.close()
    return r.out


def test_nested_contact_elements_equal_a_parser(spark):
    import random

    rnd, pages = random.Random(5), ["", "plain", '<div class="contact">open <p>end', '<DIV ID="email">a<br/>b</DIV>c</div>', '<p class="mailing">no</p><p class="x mail y">yes</p>']
    parts = ["<div>", "</div>", '<div class="my-contact x">', '<p id="email">', "</p>", "<p>", "<span class='contacts'>", "<span>", "</span>", "<br>", '<img src="a>b">'.replace(">b", "b"), "<b/>", "<!-- </div> -->", "<script>var x = '</p>';</script>"]
    for _ in range(150):
        pages.append("".join(rnd.choice(parts) + f" w{rnd.randrange(99)} " for _ in range(rnd.randint(1, 25))))
    got = spark.createDataFrame(list(enumerate(pages)), "i int, page string").select("i", html.contact_text(F.col("page")).alias("t")).collect()
    for r in got:
        assert r.t.split() == nested_contacts(pages[r.i]), pages[r.i]


def test_native_entities_equal_the_standard_library(spark):
    import html as lib
    import random
    from html.entities import html5

    rnd = random.Random(3)
    texts = [None, "", "none", "&", "&&", "&;", "&#;", "&#x;", "&amp;lt;", "&amp;amp;#64;", "&notit;", "&notin;", "&NotAnEntity;", "&#00064", "&#x0000000040z", "&#99999999999999999999;", "x&copy2&reg", "&ampamp"]
    for name in html5:
        texts += [f"a&{name}b", f"&{name.rstrip(';')}x;", f"&{name.rstrip(';')}"]
    for n in [*range(0, 170), 55295, 55296, 57343, 57344, 64975, 64976, 65007, 65008, 65533, 65534, 65535, 65536, 131070, 1114109, 1114111, 1114112]:
        texts += [f"&#{n};", f"&#x{n:X}g", f"&#{n}"]
    for _ in range(300):
        texts.append("".join(rnd.choice(["&", "&amp", ";", "lt", "#6", "4", "x40", "é", " ", "Gt", "eacute", "\n"]) for _ in range(rnd.randint(1, 9))))
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4).select("i", html.unescape_all(F.col("t")).alias("u")).collect()
    for r in rows:
        want = None if texts[r.i] is None else lib.unescape(texts[r.i])
        assert r.u == want, (texts[r.i], r.u, want)
