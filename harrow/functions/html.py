"""HTML to text, links and attributes: native regular expressions, and one exact Arrow UDF over html.parser."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .emails import splice

HREF = r"""(?is)<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
#: Names that the native text form knows beside all numeric entities; the exact form knows all names.
ENTITIES = [
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&commat;", "@"), ("&period;", "."),
    ("&lowbar;", "_"), ("&plus;", "+"), ("&percnt;", "%"), ("&amp;", "&"),
]
NUMERIC = "&#(?:[xX][0-9A-Fa-f]{1,6}|[0-9]{1,7});"


def character(entity: Column) -> Column:
    """The character of a numeric entity; U+FFFD for 0, surrogates and numbers beyond Unicode, as browsers do."""
    digits = F.regexp_extract(entity, "([0-9A-Fa-f]+);", 1)
    n = F.when(F.lower(entity).startswith("&#x"), F.conv(digits, 16, 10)).otherwise(digits).cast("bigint")
    known = n.between(1, 1114111) & ~n.between(55296, 57343)
    return F.when(known, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise(F.lit("\ufffd"))


def unescape_common(text: Column) -> Column:
    """Numeric entities, then the names of ENTITIES, &amp; last.  The lambda names the text, so that it is worked out once."""

    def named(t: Column) -> Column:
        t = F.when(F.contains(t, F.lit("&#")), splice(t, NUMERIC, character)).otherwise(t)
        for name, char in ENTITIES:
            t = F.replace(t, F.lit(name), F.lit(char))
        return t

    return F.get(F.transform(F.array(text), named), F.lit(0))


def name_tables() -> tuple[Column, Column, int]:
    """Maps of the standard library's entity names, by first letter, and of those that need no semicolon; the longest of these."""
    from html.entities import html5

    by_letter: dict[str, dict[str, str]] = {}
    for name, chars in html5.items():
        by_letter.setdefault(name[0], {})[name] = chars
    bare = {n: c for n, c in html5.items() if not n.endswith(";")}
    table = lambda m, kind: F.from_json(F.lit(json.dumps(m)), kind)  # noqa: E731  a constant: worked out once for a plan
    return table(by_letter, "map<string,map<string,string>>"), table(bare, "map<string,string>"), max(map(len, bare))


def numbered_character(digits: Column, base: int) -> Column:
    """What a number stands for: as Windows-1252 from 128 to 159, nothing for control characters and non-characters."""
    plain = F.regexp_replace(digits, "^0+", "")
    n = F.when(F.length(plain) > 7, 1 << 30).otherwise(F.conv(F.when(plain == "", "0").otherwise(plain), base, 10).cast("bigint"))
    windows = [bytes([b]).decode("cp1252", errors="ignore") or chr(b) for b in range(128, 160)]
    nothing = n.between(1, 8) | (n == 11) | n.between(14, 31) | (n == 127) | n.between(64976, 65007) | (n % 65536 >= 65534)
    char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return (
        F.when((n == 0) | n.between(55296, 57343) | (n > 1114111), F.lit("\ufffd"))
        .when(n.between(128, 159), F.get(F.array(*map(F.lit, windows)), (n - 128).cast("int")))
        .when(nothing, F.lit(""))
        .otherwise(char)
    )


def unescape_all(text: Column) -> Column:
    """``html.unescape`` natively: every named entity, the longest name that fits where the semicolon is missing, numbers.

    One pass over the pieces after each ``&``, so nothing is unescaped twice.
    """
    names, bare, longest = name_tables()

    def piece(p: Column) -> Column:
        number, name = F.regexp_extract(p, r"^#(?:[0-9]+|[xX][0-9a-fA-F]+);?", 0), F.regexp_extract(p, r"^[^\t\n\f <&#;]{1,32};?", 0)
        found = F.try_element_at(F.try_element_at(names, F.substring(name, 1, 1)), name)
        starts = F.transform(F.sequence(F.lit(longest), F.lit(2), F.lit(-1)), lambda k: F.when(k < F.length(name), F.substring(name, F.lit(1), k)))
        short = F.get(F.filter(starts, lambda x: F.try_element_at(bare, F.coalesce(x, F.lit(""))).isNotNull()), F.lit(0))
        rest = lambda m: F.substring(p, F.length(m) + 1, F.length(p))
        digits = F.regexp_extract(number, "([0-9a-fA-F]+);?$", 1)
        is_hex = F.lower(number).startswith("#x")
        return (
            F.when(number != "", F.concat(F.when(is_hex, numbered_character(digits, 16)).otherwise(numbered_character(digits, 10)), rest(number)))
            .when(found.isNotNull(), F.concat(found, rest(name)))
            .when(short.isNotNull(), F.concat(F.try_element_at(bare, short), rest(short)))
            .otherwise(F.concat(F.lit("&"), p))
        )

    def whole(t: Column) -> Column:
        parts = F.split(t, "&")
        return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), piece), ""))

    return F.get(F.transform(F.array(text), lambda t: F.when(F.contains(t, F.lit("&")), whole(t)).otherwise(t)), F.lit(0))


def text_of(html: Column) -> Column:
    """Text without comments, scripts, styles and tags; tags become one blank."""
    plain = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    return unescape_common(F.regexp_replace(plain, r"(?s)<[^>]*>", " "))


def hrefs(html: Column) -> Column:
    """array<string> of link targets of <a> elements, in order."""
    each = F.transform(F.regexp_extract_all(html, F.lit(HREF), F.lit(0)), lambda m: F.concat(*[F.regexp_extract(m, HREF, i) for i in (1, 2, 3)]))
    return F.transform(each, unescape_common)


def attribute_values(html: Column, name: str) -> Column:
    """array<string> of the values of an attribute, on any element."""
    pattern = rf"""(?is)\b{name}\s*=\s*(?:"([^"]*)"|'([^']*)')"""
    return F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(0)), lambda m: F.concat(F.regexp_extract(m, pattern, 1), F.regexp_extract(m, pattern, 2)))


# Elements without an end tag.
VOID = "area base br col embed hr img input link meta source track wbr".split()
NAMES_CONTACT = r"""(?is)\b(?:class|id)\s*=\s*["'][^"']*(?:contact|email|\bmail\b)[^"']*["']"""


def contact_text(html: Column) -> Column:
    """Text of elements whose class or id names a contact or an address, with all elements within them.

    A fold over tags and texts that keeps the stack of open elements: an end tag closes the last element of its name and
    what is open within it, or nothing.  Text counts while any open element names a contact.  Elements without end tags
    and those closed in themselves are not opened; comments, scripts and styles are left out.
    """
    clean = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    tokens = F.regexp_extract_all(clean, F.lit(r"<[^<>]*>|[^<]+|<"), F.lit(0))
    kind = "array<struct<tag:string,own:boolean>>"
    begin = F.struct(F.array().cast(kind).alias("open"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        stack, out = acc["open"], acc["out"]
        name = F.lower(F.regexp_extract(x, r"^</?([A-Za-z][^\s/>]*)", 1))
        alone = name.isin(*VOID) | F.endswith(x, F.lit("/>"))
        back = F.array_position(F.reverse(F.transform(stack, lambda o: o["tag"])), name)
        closed = F.when(back > 0, F.slice(stack, F.lit(1), F.size(stack) - back.cast("int"))).otherwise(stack)
        opened = F.when(alone, stack).otherwise(F.array_append(stack, F.struct(name.alias("tag"), x.rlike(NAMES_CONTACT).alias("own"))))
        is_open, is_end = x.rlike("^<[A-Za-z]"), x.rlike("^</[A-Za-z]")
        after = F.when(is_open, opened).when(is_end, closed).otherwise(stack)
        text = ~is_open & ~is_end & ~F.startswith(x, F.lit("<!")) & F.exists(stack, lambda o: o["own"])
        return F.struct(after.alias("open"), F.when(text, F.array_append(out, x)).otherwise(out).alias("out"))

    found = F.aggregate(tokens, begin, step, lambda acc: F.array_join(acc["out"], " "))
    return F.when(html.rlike(NAMES_CONTACT), text_of(found)).otherwise("")


def unescape():
    """Arrow UDF for every named and numeric entity."""
    import html as lib

    @F.pandas_udf("string")
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else lib.unescape(t))

    return run


def parse_exact():
    """Arrow UDF: struct<text, hrefs> by the standard library's parser."""

    @F.pandas_udf("text string, hrefs array<string>")
    def run(html: pd.Series) -> pd.DataFrame:
        from html.parser import HTMLParser

        class Reader(HTMLParser):
            def __init__(self):
                super().__init__(convert_charrefs=True)
                self.parts, self.links, self.skip = [], [], 0

            def handle_starttag(self, tag, attrs):
                self.skip += tag in ("script", "style")
                if tag == "a":
                    self.links += [v for k, v in attrs if k == "href" and v is not None][:1]

            def handle_endtag(self, tag):
                self.skip -= tag in ("script", "style") and self.skip > 0

            def handle_data(self, data):
                if not self.skip:
                    self.parts.append(data)

        rows = []
        for h in html:
            r = Reader()
            r.feed(h or "")
            r.close()
            rows.append((" ".join(r.parts), r.links))
        return pd.DataFrame(rows, columns=["text", "hrefs"])

    return run
