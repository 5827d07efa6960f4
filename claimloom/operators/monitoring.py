"""Latency, throughput and review-time measures. ``as_of`` stands for the current time and is always passed in."""

from __future__ import annotations

import logging
from datetime import datetime, timedelta
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KAFKA_TO_BRONZE_SECONDS, SCORE_SECONDS = 120, 420
EVENTS_PER_MINUTE, LEAST_SHARE = 100, 0.8
REVIEW_HOURS = 24


def recent(df: DataFrame, at: str, as_of: datetime, span: timedelta) -> DataFrame:
    """Rows from ``as_of - span`` on. The bare column is compared, so the filter reaches the scan."""
    return df.filter(F.col(at) >= F.lit(as_of - span))


def latency(df: DataFrame, start: str, end: str, bound: int) -> DataFrame:
    """One row: sample, mean and largest difference in whole seconds, and whether the largest is within ``bound``; null
    where there is no sample."""
    seconds = F.unix_timestamp(end) - F.unix_timestamp(start)
    most = F.coalesce(F.max(seconds), F.lit(0))
    sized = F.count(F.lit(1))
    return df.agg(
        sized.alias("sample_size"), F.avg(seconds).alias("avg_seconds"), F.max(seconds).alias("max_seconds"),
        F.lit(bound).cast("long").alias("sla_seconds"), F.when(sized > 0, most <= bound).alias("within_sla"),
    )


def per_minute(df: DataFrame, at: str = "_ingested_at") -> DataFrame:
    return df.groupBy(F.date_trunc("minute", at).alias("minute")).agg(F.count(F.lit(1)).alias("events"))


def throughput(minutes: DataFrame, expected: int = EVENTS_PER_MINUTE, share: float = LEAST_SHARE) -> DataFrame:
    """Minutes observed and those below the bound. ``within_sla`` is null without any minute."""
    n, low = F.count(F.lit(1)), F.count_if(F.col("events") < share * expected)
    return minutes.agg(n.alias("minutes_observed"), low.alias("minutes_below"), F.when(n > 0, low == 0).alias("within_sla"))


def densified(minutes: DataFrame) -> DataFrame:
    """Minutes between the first and the last one that had no event appear with 0."""
    span = minutes.agg(F.min("minute").alias("a"), F.max("minute").alias("b")).filter("a is not null")
    every = span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 minute"))).alias("minute"))
    return every.join(minutes, "minute", "left").select("minute", F.coalesce("events", F.lit(0)).alias("events"))


def age_hours(at: str, as_of: datetime) -> Column:
    return (F.unix_timestamp(F.lit(as_of)) - F.unix_timestamp(at)) / 3600


def review_breaches(gold: DataFrame, as_of: datetime, hours: int = REVIEW_HOURS) -> DataFrame:
    """Claims not approved and waiting for more than ``hours``; an unknown approval is not a breach."""
    waiting = gold.filter(~F.col("auto_approved") & (F.col("event_timestamp") < F.lit(as_of - timedelta(hours=hours) + timedelta(seconds=1))))
    return waiting.withColumn("age_hours", age_hours("event_timestamp", as_of)).filter(F.col("age_hours") > hours)


def breach_ratio(gold: DataFrame, as_of: datetime, hours: int = REVIEW_HOURS) -> DataFrame:
    late = ~F.col("auto_approved") & (age_hours("event_timestamp", as_of) > hours)
    return gold.agg(F.count_if(late).alias("breaches"), F.count(F.lit(1)).alias("claims"), (F.count_if(late) / F.count(F.lit(1))).alias("breach_ratio"))


def latest_signal(results: DataFrame) -> DataFrame:
    """Whether the latest batch of drift results saw any drift; false for none. One pass, no second read."""
    return results.groupBy("_checked_at").agg(F.bool_or("drift_detected").alias("any")).agg(F.coalesce(F.max_by("any", "_checked_at"), F.lit(False)).alias("drift_detected"))


def report(metric: str, measures: DataFrame, checked_at: Column) -> DataFrame:
    """The measures of one row as JSON, in the layout of the results table."""
    return measures.select(F.lit(metric).alias("metric_name"), F.to_json(F.struct("*")).alias("details_json"), F.col("within_sla"), checked_at.alias("_checked_at"))


class AlertSink(Protocol):
    def send(self, text: str) -> None: ...


class LogSink:
    def send(self, text: str) -> None:
        logging.getLogger("claimloom.alerts").warning(text)


class WebhookSink:
    """Posts ``{"text": ...}``; without address it only logs."""

    def __init__(self, url: str | None, timeout: float = 10.0):
        self.url, self.timeout = url, timeout

    def send(self, text: str) -> None:
        if not self.url:
            return LogSink().send(text)
        import json
        import urllib.request

        request = urllib.request.Request(self.url, json.dumps({"text": text}).encode(), {"Content-Type": "application/json"})
        urllib.request.urlopen(request, timeout=self.timeout).close()


def alert_breaches(count: int, sink: AlertSink, hours: int = REVIEW_HOURS) -> bool:
    """Tells the sink about breaches; nothing to report, nothing sent."""
    if count:
        sink.send(f"{count} claims wait for review longer than {hours} h")
    return count > 0


def alert_drift(features: list[str], sink: AlertSink) -> bool:
    if features:
        sink.send(f"drift in {', '.join(features)}")
    return bool(features)


def alert_latency(results: dict[str, bool | None], sink: AlertSink) -> bool:
    late = [name for name, ok in results.items() if ok is False]
    if late:
        sink.send(f"outside the target: {', '.join(late)}")
    return bool(late)
