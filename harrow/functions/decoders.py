"""Decoders of obfuscated addresses, and the cascade over a page."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import emails, html

NO_STRINGS = "cast(array() as array<string>)"
PLAIN, TURNED = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm"


def text_of_codes(codes: Column) -> Column:
    """Characters of code points (array<bigint>); Spark's own chr() is modulo 256."""
    return F.array_join(F.transform(codes, lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")), "")


def decode_cfemail(hex_text: Column) -> Column:
    """Hexadecimal, its first byte the XOR key of the others; NULL if malformed."""
    byte = lambda i: F.conv(F.substring(hex_text, i, F.lit(2)), 16, 10).cast("bigint")
    at = F.sequence(F.lit(3), F.length(hex_text) - 1, F.lit(2))
    codes = F.transform(at, lambda i: byte(i).bitwiseXOR(byte(F.lit(1))))
    return F.when(hex_text.rlike("^(?:[0-9a-fA-F]{2}){2,}$"), text_of_codes(codes))


def decode_charcodes(script: Column) -> Column:
    """Texts of fromCharCode(...) calls, joined by blanks; items that are no numbers are skipped."""
    lists = F.regexp_extract_all(script, F.lit(r"fromCharCode\(([^)]+)\)"), F.lit(1))

    def one(items: Column) -> Column:
        digits = F.filter(F.transform(F.split(items, ","), lambda x: F.trim(x)), lambda x: x.rlike("^[0-9]{1,7}$"))
        return text_of_codes(F.filter(F.transform(digits, lambda x: x.cast("bigint")), lambda n: (n < 1114112) & ~n.between(55296, 57343)))

    return F.array_join(F.transform(lists, one), " ")


def rot13(text: Column) -> Column:
    return F.translate(text, PLAIN, TURNED)


def decode_rot13_blocks(text: Column) -> Column:
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z]{30,}"), F.lit(0)), rot13), " ")


def decode_base64(text: Column) -> Column:
    """UTF-8 text of Base64, bad bytes dropped; NULL if it is no Base64."""
    return F.replace(F.make_valid_utf8(F.try_to_binary(text, F.lit("base64")).cast("string")), F.lit("�"), F.lit(""))


def decode_base64_blocks(text: Column) -> Column:
    blocks = F.regexp_extract_all(text, F.lit("'([A-Za-z0-9+/=]{40,})'"), F.lit(1))
    return F.array_join(F.filter(F.transform(blocks, decode_base64), lambda x: x.isNotNull()), " ")


def cascade_stages(page: Column, blacklist: Sequence[str] = tuple(emails.BLACKLIST)) -> list[Column]:
    """Stages of sorted address arrays: protected attributes; all text, with decoded parts; mailto links as well."""
    page = F.coalesce(page, F.lit(""))
    protected = F.transform(html.attribute_values(page, "data-cfemail"), lambda x: emails.clean_email(decode_cfemail(x), blacklist))
    text = F.concat_ws(" ", html.text_of(page), decode_charcodes(page), decode_rot13_blocks(page), decode_base64_blocks(page))
    mailto = F.transform(F.filter(html.hrefs(page), lambda h: F.startswith(F.lower(h), F.lit("mailto:"))), lambda h: emails.clean_email(h, blacklist))
    tidy = lambda a: F.array_sort(F.array_distinct(F.filter(a, lambda e: e.isNotNull())))
    plain = emails.addresses_in(html.text_of(page), blacklist)
    return [tidy(protected), emails.addresses_in(text, blacklist), tidy(F.concat(plain, mailto))]


def cascade(page: Column, rendered: Column | None = None, *, mode: str = "first", blacklist: Sequence[str] = tuple(emails.BLACKLIST)) -> Column:
    """Addresses of a page: the first stage that finds any (``mode='all'``: all stages together).

    A rendered form of the page is looked at only if the static one gives nothing.
    """
    stages = cascade_stages(page, blacklist) + (cascade_stages(rendered, blacklist) if rendered is not None else [])
    if mode == "all":
        return F.array_sort(F.array_distinct(F.flatten(F.array(*stages))))
    out = F.expr(NO_STRINGS)
    for s in reversed(stages):
        out = F.when(F.size(s) > 0, s).otherwise(out)
    return out


def cascade_raw(page: Column, rendered: Column | None = None) -> Column:
    """The variant for lists of URLs: raw page text, then the rendered page's text, then its HTML."""
    stages = [emails.addresses_in(page)]
    if rendered is not None:
        stages += [emails.addresses_in(rendered), cascade_stages(rendered)[2]]
    out = F.expr(NO_STRINGS)
    for s in reversed(stages):
        out = F.when(F.size(s) > 0, s).otherwise(out)
    return out


def cascade_strict(page: Column, blacklist: Sequence[str] = tuple(emails.BLACKLIST), tlds: Sequence[str] | None = None) -> Column:
    """Strict profile over a page: its markup as it is, mail links, and elements that name a contact, all together."""
    page = F.coalesce(page, F.lit(""))
    links = F.filter(html.hrefs(page), lambda h: F.startswith(F.lower(h), F.lit("mailto:")))
    cleaned = F.transform(links, lambda h: emails.clean_email_strict(F.trim(F.substring(h, F.lit(8), F.length(h)))))
    linked = F.filter(cleaned, lambda e: emails.is_valid_email_strict(e, blacklist, tlds))
    shown = [emails.addresses_in_strict(x, blacklist, tlds) for x in (page, html.contact_text(page))]
    return F.array_sort(F.array_distinct(F.concat(linked, *shown)))
