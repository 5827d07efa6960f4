"""Broker metrics from a hosted metrics service, as rows.

The request is built and the answer read here; how it is sent is passed in, so nothing depends on a network or a client.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from base64 import b64encode
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.sources.topics import secret

#: Sends a request body and gives the answer's text.
Transport = Callable[[dict], str]
# Names of the service's fields, of its only sum, and of its smallest step.
CLUSTER, SUM, STEP = "resource.kafka.id", "SUM", "PT1M"
LAG_BY = ("metric.consumer_group_id", "metric.topic", "metric.partition")
BYTES_BY = ("metric.topic", "metric.partition")


def request_body(metric: str, group_by: tuple[str, ...], cluster: str, as_of: datetime, span: timedelta = timedelta(minutes=15)) -> dict:
    """Sums of each minute of the last ``span``. The service takes whole minutes only."""
    end = as_of.replace(second=0, microsecond=0)
    interval = "/".join(f"{t:%Y-%m-%dT%H:%M:%S}Z" for t in (end - span, end))
    cluster_only = {"op": "AND", "filters": [{"field": CLUSTER, "op": "EQ", "value": cluster}]}
    return {"aggregations": [{"metric": metric, "agg": SUM}], "filter": cluster_only, "group_by": [*group_by], "granularity": STEP, "intervals": [interval]}


def http_transport(url: str, lookup: Callable[[str], str | None] = secret, timeout: float = 15.0) -> Transport:
    """Posts with the key and secret of the metrics service. An error names what the service answered."""

    def send(body: dict) -> str:
        login = b64encode(f"{lookup('METRICS_API_KEY')}:{lookup('METRICS_API_SECRET')}".encode()).decode()
        request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Basic {login}"})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return answer.read().decode()
        except urllib.error.HTTPError as e:
            raise RuntimeError(f"{e}: {e.read().decode(errors='replace')}") from e

    return send


def metric_rows(spark: SparkSession, send: Transport, metric: str, group_by: tuple[str, ...], cluster: str, as_of: datetime, span: timedelta = timedelta(minutes=15)) -> DataFrame:
    """``minute``, the columns of ``group_by`` without their prefix, and ``value``. No data gives no rows."""
    answer = spark.createDataFrame([(send(request_body(metric, group_by, cluster, as_of, span)),)], "answer string")
    point = T.StructType([T.StructField("timestamp", T.StringType()), T.StructField("value", T.DoubleType()), *[T.StructField(g, T.StringType()) for g in group_by]])
    read = F.from_json("answer", T.StructType([T.StructField("data", T.ArrayType(point))]))
    rows = answer.select(F.explode(read["data"]).alias("d"))
    names = [F.col(f"d.`{g}`").alias(g.rpartition(".")[2]) for g in group_by]
    return rows.select(F.try_to_timestamp("d.timestamp").alias("minute"), *names, F.col("d.value").alias("value"))


def partition_skew(rows: DataFrame) -> DataFrame:
    """Per topic: the largest partition's share of the value against an even share."""
    per = rows.groupBy("topic", "partition").agg(F.sum("value").alias("v"))
    return per.groupBy("topic").agg((F.max("v") * F.count(F.lit(1)) / F.nullif(F.sum("v"), F.lit(0.0))).alias("skew"))
