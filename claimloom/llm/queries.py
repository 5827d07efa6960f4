"""Queries over the corpus operators, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import encode, leakage, truncation
from claimloom.session import read_table


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encoded(read_table(spark, d, "documents"))


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Every text, encoded and decoded again."""
    return encode.decoded(p8_ids(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(read_table(spark, d, "documents"), read_table(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


def p9_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Affected documents with the overlap of their words with question and answer."""
    return leakage.leaked(read_table(spark, d, "documents"), read_table(spark, d, "eval_items"))


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """Test items that leaked, with the number of documents."""
    return p9_overlap(spark, d).groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.assessed(read_table(spark, d, "documents")).filter("_truncated").select(F.col("_id").alias("doc_id"))


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.source_rates(read_table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p8_ids, p8_decoded, p9_found, p9_overlap, p9_items, p10_found, p10_rates)}

ORACLES = {"p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
