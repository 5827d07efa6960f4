"""Late and out-of-order events: K-slack buffering per event-time period.

A row waits in the buffer of its period. When the period has been over for ``publish_after``, the buffer is read once
and the result is published as provisional. Rows that come later correct it until the period has been over for
``close_after``; then the buffer is released in event-time order to the final, order-sensitive aggregation. Rows that
come after that are dropped.

The batch form replays the buffers: the rows of a period are put in order of arrival together with two marks, its
publication and its closing, and what marks a row finds before it is its fate. What stands before the first mark is the
provisional value, what stands before the second is released. Buffers are cut into parts whose number follows the rows of
the period, and the released rows into ranges of even size, so a period that holds most of the rows is never in one task.
``claimloom.streaming.runners.k_slack_stream`` is the same with state and timers.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.session import row_hash

_DAY_US = 86_400_000_000
#: Rows of one part of a buffer.
PART_ROWS = 200_000
#: Periods on the broadcast list of those with several parts; each takes a few bytes. Of N rows, a period that isn't on it
#: has no more than ``PART_ROWS`` or N / ``HOT_PERIODS`` of them.
HOT_PERIODS = 100_000


@dataclass(frozen=True)
class Slack:
    """Bounds of the buffer, counted from the end of the period."""

    publish_after: timedelta = timedelta(hours=1)
    close_after: timedelta = timedelta(hours=72)

    def __post_init__(self) -> None:
        if not timedelta(0) <= self.publish_after <= self.close_after:
            raise ValueError("0 <= publish_after <= close_after is required")


def _us(span: timedelta) -> int:
    return span // timedelta(microseconds=1)


def period_us(at: Column) -> Column:
    """The start of the UTC day of a time in microseconds."""
    return at - F.pmod(at, F.lit(_DAY_US))


_STARTED, _PUBLISHED, _CLOSED = 0, 1, 2


def replayed(df: DataFrame, event_time: str = "event_timestamp", arrival: str = "_ingested_at", amount: str | None = None, slack: Slack = Slack(), sizes: DataFrame | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """The buffers in order of arrival: rows, and two marks of each part of each buffer.

    ``_row`` has the input row (null for marks), ``_mark`` is 0 for rows, 1 at publication and 2 at closing, ``_passed`` is
    the last mark before the row, and ``_held`` and ``_sum`` are the rows that have come so far and their amounts.
    ``_start`` is the period. A row that comes at the instant of a mark comes before it. Rows without event time or arrival
    are in no buffer. ``sizes`` may be any frame with the event times of at least these rows, where it is cheaper to count.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    value = F.lit(0) if amount is None else F.coalesce(F.col(amount), F.lit(0))
    start = lambda: period_us(F.unix_micros(F.col(event_time))).alias("_start")
    rows = df.select(row.alias("_row"), row_hash(df).alias("_place"), start(), F.unix_micros(F.col(arrival)).alias("_time"), value.cast("decimal(38,2)").alias("_value"))
    rows = rows.filter(F.col("_start").isNotNull() & F.col("_time").isNotNull())
    counted = (df if sizes is None else sizes).select(start()).filter(F.col("_start").isNotNull()).groupBy("_start").agg(F.count(F.lit(1)).alias("n"))
    hot = counted.filter(F.col("n") > part_rows).orderBy(F.col("n").desc(), "_start").limit(HOT_PERIODS)
    hot = F.broadcast(hot.select("_start", F.ceil(F.col("n") / part_rows).cast("int").alias("_parts")))
    parts = counted.join(hot, "_start", "left").select("_start", F.coalesce("_parts", F.lit(1)).alias("_parts"))
    part = F.pmod(F.col("_place"), F.coalesce("_parts", F.lit(1))).cast("int").alias("_part")
    placed = rows.join(hot, "_start", "left").select("_row", "_start", part, "_time", F.lit(_STARTED).alias("_mark"), "_value")
    end = F.col("_start") + F.lit(_DAY_US)
    both = F.array(*[F.struct((end + F.lit(_us(after))).alias("_time"), F.lit(mark).alias("_mark")) for mark, after in ((_PUBLISHED, slack.publish_after), (_CLOSED, slack.close_after))])
    every_part = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part")
    marks = parts.select("_start", every_part, both.alias("both")).select("_start", "_part", F.explode("both").alias("m"))
    marks = marks.select(F.lit(None).cast(placed.schema["_row"].dataType).alias("_row"), "_start", "_part", "m._time", "m._mark", F.lit(0).cast("decimal(38,2)").alias("_value"))
    arrived = Window.partitionBy("_start", "_part").orderBy("_time", "_mark").rowsBetween(Window.unboundedPreceding, 0)
    running = {"_passed": F.max("_mark").over(arrived), "_held": F.count("_row").over(arrived), "_sum": F.sum("_value").over(arrived)}
    return placed.unionByName(marks).withColumns(running)


def buffered(df: DataFrame, event_time: str = "event_timestamp", arrival: str = "_ingested_at", slack: Slack = Slack(), **options) -> DataFrame:
    """Adds ``_period`` (UTC day), ``_published_us``, ``_closed_us`` and ``_fate`` to each row.

    ``_fate`` is ``on_time``, ``correction`` or ``dropped``: whether the buffer was not yet published, published or closed
    when the row came. Rows without event time or arrival are left out; no aggregate counts them. Input columns of these
    names are replaced.
    """
    rows = replayed(df, event_time, arrival, slack=slack, **options).filter(F.col("_row").isNotNull())
    fate = F.when(F.col("_passed") == _STARTED, "on_time").when(F.col("_passed") == _PUBLISHED, "correction").otherwise("dropped")
    end = F.col("_start") + F.lit(_DAY_US)
    added = {
        "_period": F.date_from_unix_date((F.col("_start") / F.lit(_DAY_US)).cast("int")),
        "_published_us": end + F.lit(_us(slack.publish_after)),
        "_closed_us": end + F.lit(_us(slack.close_after)),
        "_fate": fate,
    }
    kept = [F.col(f"_row.`{c}`").alias(c) for c in df.columns if c.lower() not in added]
    return rows.select(*kept, *[c.alias(n) for n, c in added.items()])


def late_rows(df: DataFrame, **options) -> DataFrame:
    """The rows that correct a published period or miss its closing."""
    return buffered(df, **options).filter(F.col("_fate").isin("correction", "dropped"))


def period_totals(df: DataFrame, amount: str = "amount", **options) -> DataFrame:
    """Per period: first published, corrected and final counts and amounts, and what came too late.

    The first values are what the buffers held at the mark of publication, the final ones what they held at closing, summed
    over the parts of a period. Null amounts count as rows and add nothing.
    """
    marked = lambda mark, c: F.sum(F.when(F.col("_mark") == mark, F.col(c)))
    total = (
        replayed(df, amount=amount, **options)
        .groupBy("_start")
        .agg(
            F.count("_row").alias("n"), F.sum("_value").alias("a"), marked(_PUBLISHED, "_held").alias("p_n"), marked(_PUBLISHED, "_sum").alias("p_a"),
            marked(_CLOSED, "_held").alias("c_n"), marked(_CLOSED, "_sum").alias("c_a"),
        )
        .filter(F.col("n") > 0)
    )
    money = lambda c: c.cast("decimal(38,2)")
    return total.select(
        F.date_from_unix_date((F.col("_start") / F.lit(_DAY_US)).cast("int")).alias("_period"),
        F.col("p_n").alias("published_count"),
        money(F.col("p_a")).alias("published_amount"),
        (F.col("c_n") - F.col("p_n")).alias("correction_count"),
        F.col("c_n").alias("final_count"),
        money(F.col("c_a")).alias("final_amount"),
        (F.col("n") - F.col("c_n")).alias("dropped_count"),
        money(F.col("a") - F.col("c_a")).alias("dropped_amount"),
    )


def publications(df: DataFrame, amount: str = "amount", every: timedelta = timedelta(hours=1), arrival: str = "_ingested_at", **options) -> DataFrame:
    """Every value a period is published with: version 0 at publication, then one for each ``every`` in which late
    rows arrived, until the closing.

    Rows are reduced to one per period and publication step before the running totals, so the window sees at most
    ``close_after / every`` rows of a period, however many rows the period has.
    """
    step_us = _us(every)
    rows = buffered(df, arrival=arrival, **options).filter(F.col("_fate").isin("on_time", "correction"))
    over = F.unix_micros(F.col(arrival)) - F.col("_published_us")
    step = F.when(F.col("_fate") == "on_time", F.lit(0)).otherwise(F.ceil(over / F.lit(step_us))).cast("long")
    steps = (
        rows.groupBy("_period", "_published_us", "_closed_us", step.alias("_step"))
        .agg(F.count(F.lit(1)).alias("new_rows"), F.coalesce(F.sum(amount), F.lit(0)).cast("decimal(38,2)").alias("new_amount"))
    )
    running = Window.partitionBy("_period").orderBy("_step").rowsBetween(Window.unboundedPreceding, 0)
    return steps.select(
        "_period",
        F.least(F.col("_published_us") + F.col("_step") * F.lit(step_us), F.col("_closed_us")).alias("published_us"),
        (F.row_number().over(Window.partitionBy("_period").orderBy("_step")) - 1).cast("long").alias("version"),
        F.sum("new_rows").over(running).alias("row_count"),
        F.sum("new_amount").over(running).cast("decimal(38,2)").alias("amount"),
    )


def slot_summaries(rows: DataFrame, *slot: str) -> DataFrame:
    """Released rows (``_at``, ``_tie``, ``_came``) of each slot, a range of event times, reduced to what merging needs."""
    order = Window.partitionBy(*slot).orderBy("_at", "_tie")
    marked = rows.withColumns({"_gap": F.col("_at") - F.lag("_at").over(order), "_inverted": (F.col("_came") < F.lag("_came").over(order)).cast("long")})
    return marked.groupBy(*slot).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct("_at", "_tie", "_came")).alias("lo"),
        F.max(F.struct("_at", "_tie", "_came")).alias("hi"),
        F.coalesce(F.max("_gap"), F.lit(0)).alias("gap"),
        F.coalesce(F.sum("_inverted"), F.lit(0)).alias("inv"),
    )


def merged_slots(slots: DataFrame) -> DataFrame:
    """Order-sensitive aggregates of each ``_period`` from the summaries of its slots (``n``, ``lo``, ``hi``, ``gap``, ``inv``)."""
    before = F.lag("hi").over(Window.partitionBy("_period").orderBy("lo"))
    return (
        slots.withColumns({"_gap": F.col("lo._at") - before["_at"], "_inv": (F.col("lo._came") < before["_came"]).cast("long")})
        .groupBy("_period")
        .agg(
            F.sum("n").alias("row_count"),
            F.min("lo")["_tie"].alias("first_row"),
            F.max("hi")["_tie"].alias("last_row"),
            F.greatest(F.max("gap"), F.coalesce(F.max("_gap"), F.lit(0))).alias("longest_gap_us"),
            (F.sum("inv") + F.coalesce(F.sum("_inv"), F.lit(0))).alias("inversions"),
        )
    )


def released_in_order(df: DataFrame, event_time: str = "event_timestamp", tie: str = "record_id", slots: int | None = None, **options) -> DataFrame:
    """Final order-sensitive aggregates of each period over its released rows, in order of event time.

    Gives the first and last row, the longest silence between successive rows and how often a row arrived before one
    that happened earlier (``inversions`` between neighbours in event-time order). Rows are released in ranges of even
    size (``slots`` of them, or as many as the session and the data ask for), which are ordered apart and merged.
    """
    arrival = options.get("arrival", "_ingested_at")
    rows = buffered(df, event_time=event_time, **options).filter(F.col("_fate").isin("on_time", "correction"))
    rows = rows.select("_period", F.unix_micros(F.col(event_time)).alias("_at"), F.col(tie).alias("_tie"), F.unix_micros(F.col(arrival)).alias("_came"))
    order = ("_period", "_at", "_tie")
    ranged = rows.repartitionByRange(*order) if slots is None else rows.repartitionByRange(slots, *order)
    return merged_slots(slot_summaries(ranged.withColumn("_slot", F.spark_partition_id()), "_period", "_slot"))
