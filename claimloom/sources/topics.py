"""Topics as streams and sinks. A broker needs its connector on the class path; a folder per topic stands in for it.

Both give the columns key, value, timestamp, partition and offset, so everything behind a topic is the same.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path
from time import monotonic, sleep

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions.scalar import without_nan
from claimloom.session import stored

TOPIC_SCHEMA = "key string, value string, timestamp timestamp, partition int, offset long"
KEYS = ("claim_id", "policy_id", "customer_id", "external_reference_id")


def secret(name: str, required: bool = True) -> str | None:
    """A secret from the environment; a missing required one raises."""
    value = os.environ.get(name)
    if value is None and required:
        raise RuntimeError(f"{name} is not set")
    return value


def broker_options(topic: str, lookup: Callable[[str], str | None] = secret) -> dict[str, str]:
    login = f'username="{lookup("KAFKA_API_KEY")}" password="{lookup("KAFKA_API_SECRET")}"'
    return {
        "kafka.bootstrap.servers": lookup("KAFKA_BOOTSTRAP_SERVERS"),
        "kafka.security.protocol": "SASL_SSL",
        "kafka.sasl.mechanism": "PLAIN",
        "kafka.sasl.jaas.config": f"org.apache.kafka.common.security.plain.PlainLoginModule required {login};",
        "subscribe": topic,
        "startingOffsets": "earliest",
        "failOnDataLoss": "false",
    }


def broker_stream(spark: SparkSession, topic: str, **options: str) -> DataFrame:
    return spark.readStream.format("kafka").options(**(broker_options(topic) | options)).load()


def ensure_topic(root: str, topic: str) -> Path:
    """The folder of a topic; one that exists is left as it is."""
    folder = Path(root) / topic
    folder.mkdir(parents=True, exist_ok=True)
    return folder


def folder_stream(spark: SparkSession, root: str, topic: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(TOPIC_SCHEMA)
    reader = reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader
    return reader.parquet(str(ensure_topic(root, topic)))


def as_messages(events: DataFrame, partitions: int = 6) -> DataFrame:
    """Rows as messages: JSON without NaN, keyed by the first id that isn't null."""
    floats = {f.name for f in events.schema if f.dataType.typeName() in ("double", "float")}
    clean = events.select(*[(without_nan(F.col(c)) if c in floats else F.col(c)).alias(c) for c in events.columns])
    keys = [F.col(k).cast("string") for k in KEYS if k in events.columns]
    key = F.coalesce(*keys) if keys else F.lit(None).cast("string")
    return clean.select(key.alias("key"), F.to_json(F.struct("*")).alias("value")).withColumn("partition", F.pmod(F.xxhash64("key"), F.lit(partitions)).cast("int"))


def folder_sink(root: str, topic: str, at=None) -> Callable[[DataFrame], None]:
    """Appends messages to the topic's folder. Offsets grow within a partition by place in the input, and go on behind
    those that the topic has; one row, the largest of them, is read for that."""

    def send(messages: DataFrame) -> None:
        folder = ensure_topic(root, topic)
        held = any(folder.glob("*.parquet"))
        last = messages.sparkSession.read.schema(TOPIC_SCHEMA).parquet(str(folder)).agg(F.max("offset")).first()[0] if held else None
        first = 0 if last is None else last + 1
        timed = messages.withColumns({"timestamp": F.current_timestamp() if at is None else at, "offset": F.monotonically_increasing_id() + F.lit(first)})
        timed.select("key", "value", "timestamp", "partition", "offset").write.mode("append").parquet(str(folder))

    return send


def broker_sink(topic: str, lookup: Callable[[str], str | None] = secret) -> Callable[[DataFrame], None]:
    """Sends messages to the broker, which needs its connector on the class path. The broker places and numbers them."""
    options = {k: v for k, v in broker_options(topic, lookup).items() if k.startswith("kafka.")}
    return lambda messages: messages.select("key", "value").write.format("kafka").options(**options, topic=topic).save()


def publish(events: DataFrame, root: str, topic: str, at=None) -> None:
    """Sends the rows to the topic's folder. An empty input raises, as it hides a broken loader."""
    if events.isEmpty():
        raise ValueError("no events to publish")
    folder_sink(root, topic, at)(as_messages(events))


def publish_paced(events: DataFrame, send: Callable[[DataFrame], None], per_minute: int, most_seconds: float | None = None, loop: bool = False, clock=monotonic, wait=sleep) -> int:
    """Sends about ``per_minute`` rows a minute through ``send``, over and over with ``loop``, until ``most_seconds`` have
    passed; gives the number of parts sent. Rows are dealt to the minutes by a hash, so nothing is ordered or collected."""
    rows = events.count()
    if not rows:
        raise ValueError("no events to publish")
    minutes = -(-rows // per_minute)
    dealt = stored(as_messages(events).withColumn("_minute", F.pmod(F.xxhash64("key", "value"), F.lit(minutes))))
    began, sent = clock(), 0
    while True:
        for minute in range(minutes):
            if most_seconds is not None and clock() - began >= most_seconds:
                return sent
            send(dealt.filter(F.col("_minute") == minute).drop("_minute"))
            sent += 1
            wait(60.0)
        if not loop:
            return sent


def paced(events: Iterable[dict], per_minute: float, most_seconds: float | None = None, loop: bool = False, clock=monotonic, wait=sleep) -> Iterator[dict]:
    """Yields events at a steady rate, over and over with ``loop``, until ``most_seconds`` have passed."""
    rows = list(events)
    if not rows:
        raise ValueError("no events to publish")
    began = clock()
    while True:
        for row in rows:
            if most_seconds is not None and clock() - began >= most_seconds:
                return
            yield row
            wait(60.0 / per_minute)
        if not loop:
            return
