"""The queries of this subpackage, each one operator with production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import alignment, bpe, chains, licenses, packing, quality, rules, secretscan, simhash, suffix, topk, turns, urlfilter
from .common import table


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file; files are never part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.deduplicate(table(spark, sf_dir, "documents"))


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_policy(rules.ledger(table(spark, sf_dir, "documents")), max(rules.POLICIES))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_fuzzy_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.fuzzy_passages(table(spark, sf_dir, "documents"))


def op9_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_pages(table(spark, sf_dir, "pages"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(table(spark, sf_dir, "documents"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repaired_digests(table(spark, sf_dir, "conversations"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


RULES_SQL = """
WITH base AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM base),
pos AS (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5),
win AS (SELECT rid, i, list_slice(ws, i, i + 4) AS k FROM pos),
rep AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM win),
cov AS (SELECT rid, count(DISTINCT i + o) AS c FROM rep, (SELECT unnest(range(0, 5)) AS o) WHERE n >= 2 GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM base),
full_lines AS (SELECT rid, line, count(*) AS n FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid, line),
dup AS (SELECT rid, CAST(sum(n) AS BIGINT) AS n_lines, CAST(sum(n - 1) AS BIGINT) AS n_dup FROM full_lines GROUP BY rid),
m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(dup.n_dup, 0) AS n_dup_lines, coalesce(CAST(cov.c AS BIGINT), 0) AS n_repeat_words, coalesce(dup.n_lines, 0) AS n_lines,
    CAST(len(list_filter(ws, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS BIGINT) AS n_capital_words
  FROM w LEFT JOIN dup ON w.rid = dup.rid LEFT JOIN cov ON w.rid = cov.rid),
b AS (SELECT *, CAST({bits} AS BIGINT) AS rule_bits FROM m)
SELECT *, (rule_bits & {base}) <> 0 AS base_failed, (rule_bits & {policy}) = 0 AS kept FROM b
"""


def oracle_sql() -> dict[str, str]:
    bits = " + ".join(f"CASE WHEN {cond} THEN {1 << bit} ELSE 0 END" for bit, _, cond in rules.RULES)
    return {
        "op3_exact_topk": topk.TOP_K_SQL,
        "op4_quality_rules": RULES_SQL.format(bits=bits, base=rules.BASE, policy=rules.POLICIES[max(rules.POLICIES)]),
        "op10_url_filter": urlfilter.judge_sql(),
        "op13_turn_repair": turns.REPAIR_SQL,
    }
