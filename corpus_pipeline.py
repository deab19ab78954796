"""A corpus pipeline of five stages over ``documents``.

Each stage works on the rows its predecessor kept.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from harrow.llm import neardup, packing, quality, secretscan, suffix
from harrow.llm.common import cut, table
from harrow.llm.queries import vocabulary

#: Passages of over 50 words are to go: 51 words of four letters, with the spaces between them, are 254 bytes.
PASSAGE_BYTES = 250


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.filter_documents(docs, table(spark, sf_dir, "labels"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: SimHash links and bands of minima, checked by a Jaccard similarity of 0.8."""
    return neardup.keep_one(docs)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of repeated passages go; documents that are nothing else go with them."""
    return suffix.strip_documents(docs, window=PASSAGE_BYTES)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    ratios = secretscan.train(docs, table(spark, sf_dir, "labels"))
    return secretscan.redact(secretscan.scan(docs, ratios), docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in training sequences."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_stage),
    ("simhash_neardup", simhash_stage),
    ("suffix_dedup", suffix_stage),
    ("secret_scan", secrets_stage),
    ("bestfit_packing", packing_stage),
]

#: The classifier and the fingerprints cannot be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
