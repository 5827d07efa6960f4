"""Parsing of topic messages and the split into valid and quarantined rows."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.schemas import TOPIC_COLUMNS

REASON = "schema_validation_failed"


def parse_events(raw: DataFrame, schema: T.StructType, ingested_at: Column | None = None) -> DataFrame:
    """Topic columns (key, value, timestamp, partition, offset) to event_key, raw_value, payload and times.

    Text that is no JSON gives a payload of nulls; a null value gives a null payload.
    """
    columns = [F.col(c).cast(kind).alias(name) for c, (name, kind) in TOPIC_COLUMNS.items()]
    came = (F.current_timestamp() if ingested_at is None else ingested_at).alias("_ingested_at")
    return raw.select(*columns, came).withColumn("payload", F.from_json("raw_value", schema))


def malformed(required: list[str]) -> Column:
    """Never null: a missing payload or required field. Without required fields only a null payload counts."""
    return reduce(or_, [F.col(f"payload.{f}").isNull() for f in required], F.col("payload").isNull())


def valid_rows(parsed: DataFrame, required: list[str]) -> DataFrame:
    return parsed.filter(~malformed(required)).select("event_key", "payload.*", "kafka_timestamp", "_ingested_at", F.to_date("_ingested_at").alias("_ingested_date"))


def quarantined_rows(parsed: DataFrame, required: list[str]) -> DataFrame:
    return parsed.filter(malformed(required)).select(
        "event_key", "raw_value", "kafka_timestamp", "_ingested_at", F.lit(REASON).alias("_reason"), F.to_date("_ingested_at").alias("_ingested_date")
    )


def max_offsets(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("partition").agg(F.max("offset").alias("max_offset"))


def quarantine_rate(parsed: DataFrame, required: list[str]) -> DataFrame:
    bad = F.count_if(malformed(required))
    return parsed.agg((F.count(F.lit(1)) - bad).alias("valid_count"), bad.alias("quarantine_count"), (bad * 100.0 / F.count(F.lit(1))).alias("quarantine_pct"))


def latest_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key: the largest by ``order`` (nulls last), ties broken by the other columns. Null keys form a group.

    The rank filter is pushed below the shuffle, so a key with most of the rows sends one row per partition.
    """
    ranked = [F.col(c).desc_nulls_last() for c in [*order, *[c for c in df.columns if c not in (key, *order)]]]
    newest = F.row_number().over(Window.partitionBy(key).orderBy(*ranked))
    return df.withColumn("__n", newest).filter("__n = 1").drop("__n")
