"""The scalar functions under SQL names: ``register(spark)``, then use them in ``spark.sql``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decoders, emails, html, scoring, urls

NATIVE: dict[str, tuple[Callable[[Column], Column], str]] = {
    "canonicalise_url": (urls.canonicalise, "string"),
    "canonicalise_url_query": (urls.canonicalise_query, "string"),
    "normalise_domain": (urls.normalise_domain, "string"),
    "valid_url": (urls.validate_url, "boolean"),
    "find_emails": (emails.find_emails, "array<string>"),
    "deobfuscate_emails": (emails.deobfuscate, "string"),
    "clean_email": (emails.clean_email, "string"),
    "valid_email": (emails.is_valid_email, "boolean"),
    "valid_email_strict": (emails.is_valid_email_strict, "boolean"),
    "addresses_in": (emails.addresses_in, "array<string>"),
    "decode_cfemail": (decoders.decode_cfemail, "string"),
    "decode_charcodes": (decoders.decode_charcodes, "string"),
    "decode_base64_text": (decoders.decode_base64, "string"),
    "rot13": (decoders.rot13, "string"),
    "page_addresses": (decoders.cascade, "array<string>"),
    "page_addresses_strict": (decoders.cascade_strict, "array<string>"),
    "html_text": (html.text_of, "string"),
    "unescape_html": (html.unescape_all, "string"),
    "html_links": (html.hrefs, "array<string>"),
    "clean_company_name": (scoring.clean_company_name, "string"),
}


def with_function(rows: DataFrame, name: str, source: str, target: str) -> DataFrame:
    """Apply a function of the list by name."""
    return rows.withColumn(target, NATIVE[name][0](F.col(source)))


def register(spark: SparkSession) -> list[str]:
    """Register SQL functions; a few need Python and are Arrow UDFs, the rest are SQL bodies that Catalyst inlines."""
    done = []
    body = {
        "normalise_domain": r"regexp_replace(lower(case when startswith(x, 'http://') or startswith(x, 'https://') then regexp_extract(x, '^[A-Za-z]+://([^/?#]*)', 1) else x end), '^www[.]', '')",
        "valid_url": r"coalesce(length(x) <= 2000 and x rlike '^(?i)https?://[^/?#]+', false)",
        "rot13": f"translate(x, '{decoders.PLAIN}', '{decoders.TURNED}')",
        "cache_key": "trim(lower(x))",
    }
    kinds = {"valid_url": "BOOLEAN"}
    for name, text in body.items():
        text = text.replace("\\", "\\\\")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS {kinds.get(name, 'STRING')} RETURN {text}")
        done.append(name)
    spark.udf.register("partial_ratio", scoring.partial_ratio())
    spark.udf.register("decode_idna", emails.decode_idna())
    spark.udf.register("html_unescape", html.unescape())
    return [*done, "partial_ratio", "decode_idna", "html_unescape"]


def extract_emails_udtf():
    """Table function extract_emails(text): a row per raw address (Python; for ad-hoc SQL)."""
    from pyspark.sql.functions import udtf

    pattern = emails.EMAIL

    @udtf(returnType="email string")
    class ExtractEmails:
        def eval(self, text: str):
            import re

            for m in dict.fromkeys(re.findall(pattern, text or "")):
                yield (m.lower(),)

    return ExtractEmails
