"""Structured Streaming runners over topics and the table store.

Each runner takes what is available, commits it batch by batch and stops; a second run starts where the first ended.
Batches are kept for the time of their several writes. Appends are named after the batch, so a replayed batch replaces
itself. Tables are read through their commits, so a stream never sees files that no version lists.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from claimloom.operators import bronze, lateness, quality, scoring
from claimloom.operators.lateness import Slack
from claimloom.schemas import required_of, schema_of
from claimloom.store import TableStore


def _run(stream: DataFrame, each, checkpoint: str) -> None:
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def run_bronze(spark: SparkSession, stream: DataFrame, topic: str, store: TableStore, table: str, checkpoint: str, required: list[str] | None = None, on_offsets=None) -> None:
    """A topic to its table and quarantine. ``on_offsets`` is told the largest offset of each partition of a batch."""
    schema, needed = schema_of(topic), required_of(topic) if required is None else required

    def each(batch: DataFrame, batch_id: int) -> None:
        parsed = bronze.parse_events(batch, schema).persist()
        try:
            for name, rows in ((table, bronze.valid_rows(parsed, needed)), (f"{table}_quarantine", bronze.quarantined_rows(parsed, needed))):
                if not rows.isEmpty():
                    store.append(name, rows, partition_by="_ingested_date", batch_id=batch_id)
            if on_offsets:
                on_offsets({r["partition"]: r["max_offset"] for r in bronze.max_offsets(parsed).collect()})
        finally:
            parsed.unpersist()

    _run(stream, each, checkpoint)


def run_silver(spark: SparkSession, store: TableStore, source: str, target: str, key: str, checkpoint: str, results: str = "monitoring.dq_results") -> None:
    """Newest row per key of each batch, checked and merged into ``target`` by key."""

    def each(commits: DataFrame, batch_id: int) -> None:
        batch = store.added(source, commits)
        if batch.isEmpty():
            return
        rows = bronze.latest_per_key(batch, key, ["_ingested_at"]).withColumn("event_date", F.to_date("event_timestamp")).persist()
        try:
            checks = [quality.not_null(key), quality.not_null("event_type"), quality.unique(key)]
            quality.persist_results(store, results, quality.run_checks(rows, target, checks), F.current_timestamp())
            store.upsert(target, rows, key, "event_date")
            store.append(f"{target}_changes", rows, batch_id=batch_id)
        finally:
            rows.unpersist()

    _run(store.commits(source), each, checkpoint)


def run_scoring(spark: SparkSession, store: TableStore, source: str, target: str, checkpoint: str, model=None, results: str = "monitoring.dq_results") -> None:
    """Scores the change feed of a merged table. Rows that come again are merged again, which changes nothing."""

    def each(commits: DataFrame, batch_id: int) -> None:
        batch = store.added(f"{source}_changes", commits)
        if batch.isEmpty():
            return
        newest = bronze.latest_per_key(batch, "claim_id", ["_ingested_at"])
        gold = scoring.claims_gold(newest, F.current_timestamp(), model).persist()
        try:
            checks = [*[quality.not_null(c) for c in ("claim_id", "policy_id", "customer_id")], quality.unique("claim_id")]
            quality.persist_results(store, results, quality.run_checks(gold, target, checks), F.current_timestamp())
            store.upsert(target, gold, "claim_id", "event_date")
        finally:
            gold.unpersist()

    _run(store.commits(f"{source}_changes"), each, checkpoint)


_HOLDING = "stage int, at array<long>, tie array<long>, came array<long>, cents array<long>"
_TOLD = "period date, slot int, what string, row long, n long, cents long, lo struct<_at:long,_tie:long,_came:long>, hi struct<_at:long,_tie:long,_came:long>, gap long, inv long"


def _told(period, slot, what, row=None, n=None, cents=None, lo=None, hi=None, gap=None, inv=None) -> tuple:
    return period, slot, what, row, n, cents, lo, hi, gap, inv


def _summary(rows: list[tuple]) -> dict:
    """What merging needs of released rows (event time, tie, arrival, cents), in order of event time."""
    rows = sorted(rows)
    pairs = list(zip(rows, rows[1:]))
    place = lambda r: {"_at": r[0], "_tie": r[1], "_came": r[2]}
    return {
        "n": len(rows), "cents": sum(r[3] for r in rows), "lo": place(rows[0]), "hi": place(rows[-1]),
        "gap": max((b[0] - a[0] for a, b in pairs), default=0), "inv": sum(b[2] < a[2] for a, b in pairs),
    }


def _slack_step(slack: Slack):
    """One step of the buffer of one slot: new rows, or a timer. Publication and closing happen when the clock of arrivals
    has passed them."""
    import pandas as pd

    names = [f.split()[0] for f in _TOLD.replace("struct<_at:long,_tie:long,_came:long>", "struct").split(", ")]

    def step(key, batches, state) -> Iterator[pd.DataFrame]:
        start_us, slot = (int(k) for k in key)
        published, closed = (start_us + 86_400_000_000 + after // timedelta(microseconds=1) for after in (slack.publish_after, slack.close_after))
        clock = state.getCurrentWatermarkMs() * 1000
        period = (datetime(1970, 1, 1) + timedelta(microseconds=start_us)).date()
        if state.exists:
            stage, *columns = state.get
            held = list(zip(*columns))
        else:
            # The buffer of a slot without state is new, or closed and gone.
            stage, held = (2 if clock > closed else 1 if clock > published else 0), []
        out = []

        def come(rows: list[tuple]) -> list[tuple]:
            """Tells the fates of rows that come after publication; those that come in time to be released stay."""
            for at, tie, came, cents in rows:
                if came > published:
                    out.append(_told(period, slot, "dropped" if came > closed else "correction", row=tie, n=1, cents=cents))
            return [r for r in rows if r[2] <= closed]

        new = [] if state.hasTimedOut else [tuple(map(int, r)) for b in batches for r in b[["at", "tie", "came", "cents"]].itertuples(index=False, name=None)]
        if stage == 0:
            held += new
        else:
            held += come(new)
        if stage == 0 and clock > published:
            stage, early = 1, [r for r in held if r[2] <= published]
            if early:
                out.append(_told(period, slot, "provisional", n=len(early), cents=sum(r[3] for r in early)))
            held = early + come([r for r in held if r[2] > published])
        if stage >= 1 and clock > closed:
            if stage == 1 and held:
                out.append(_told(period, slot, "final", **_summary(held)))
            if state.exists:
                state.remove()
        else:
            state.update((stage, *(map(list, zip(*held)) if held else ([], [], [], []))))
            state.setTimeoutTimestamp((published if stage == 0 else closed) // 1000 + 1)
        if out:
            yield pd.DataFrame(out, columns=names)

    return step


def k_slack_stream(events: DataFrame, event_time: str = "event_timestamp", arrival: str = "_ingested_at", tie: str = "record_id", amount: str = "amount", slack: Slack = Slack(), disorder: str = "10 minutes", slots: int = 288) -> DataFrame:
    """The buffers of ``lateness.replayed`` as a stream with state and timers.

    Rows wait in the buffer of their slot, a part of their period's event times. The clock is the latest arrival less
    ``disorder``, by which arrivals may come out of order. When it passes publication, a slot tells its ``provisional``
    count and amount; each later row is told as ``correction`` or ``dropped``; when it passes closing, the buffer is sorted
    by event time and released as the ``final`` summary of the slot. ``lateness.merged_slots`` merges the final rows of a
    period. Rows without event time or arrival are left out. Rows that come more than ``disorder`` behind the latest
    arrival are late for the stream itself and dropped by its watermark; the replay of the table still counts them.
    """
    at, came = F.unix_micros(F.col(event_time)), F.unix_micros(F.col(arrival))
    start = lateness.period_us(at)
    cents = F.coalesce((F.col(amount) * 100).cast("long"), F.lit(0))
    slot = F.floor((at - start) * slots / F.lit(86_400_000_000)).cast("int")
    rows = events.select(start.alias("start_us"), slot.alias("slot"), at.alias("at"), F.col(tie).cast("long").alias("tie"), came.alias("came"), cents.alias("cents"), F.col(arrival).alias("clock"))
    rows = rows.filter(F.col("at").isNotNull() & F.col("came").isNotNull()).withWatermark("clock", disorder)
    return rows.groupBy("start_us", "slot").applyInPandasWithState(_slack_step(slack), _TOLD, _HOLDING, "append", GroupStateTimeout.EventTimeTimeout)


class OffsetReporter:
    """Commits the next offset of each partition of a topic to a table, for those who watch how far consumers lag. It
    never raises: a report that fails must not stop a stream."""

    def __init__(self, topic: str, group: str, store: TableStore | None = None, table: str = "monitoring.consumer_offsets"):
        self.topic, self.group, self.store, self.table = topic, group, store, table
        self.next: dict[int, int] = {}

    def __call__(self, offsets: dict[int, int]) -> None:
        for partition, offset in offsets.items():
            self.next[partition] = max(self.next.get(partition, 0), offset + 1)
        if self.store and offsets:
            try:
                rows = [(self.topic, self.group, p, self.next[p]) for p in offsets]
                df = self.store.spark.createDataFrame(rows, "topic string, consumer_group string, partition int, next_offset long")
                self.store.append(self.table, df.withColumn("_reported_at", F.current_timestamp()))
            except Exception as e:
                logging.getLogger("claimloom").warning("offsets not reported: %s", e)
