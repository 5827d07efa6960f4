from collections import Counter
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from claimloom.operators import lateness
from claimloom.plans import data_queries
from claimloom.streaming import runners

SCHEMA = "record_id long, event_timestamp timestamp, _ingested_at timestamp, amount decimal(18,2)"
DAY = datetime(2024, 1, 1)


def frame(spark, *specs):
    """(id, hours of the event, hours of arrival, amount), both from the start of the day"""
    at = lambda h: None if h is None else DAY + timedelta(hours=h)
    from decimal import Decimal

    return spark.createDataFrame([(i, at(e), at(a), None if x is None else Decimal(x)) for i, e, a, x in specs], SCHEMA)


def test_fates_at_the_borders(spark):
    df = frame(spark, (1, 0, 25, 1), (2, 0, 25.0001, 1), (3, 23.9, 96, 1), (4, 23.9, 96.0001, 1), (5, 24, 49, 1), (6, None, 1, 1), (7, 1, None, 1))
    got = {r.record_id: r._fate for r in lateness.buffered(df).collect()}
    assert got == {1: "on_time", 2: "correction", 3: "correction", 4: "dropped", 5: "on_time"}
    assert {r.record_id for r in lateness.late_rows(df).collect()} == {2, 3, 4}


def test_totals_and_publications(spark):
    df = frame(spark, (1, 1, 2, 10), (2, 2, 3, None), (3, 3, 26, 5), (4, 3, 26.5, 7), (5, 4, 90, 1), (6, 4, 500, 100))
    t = lateness.period_totals(df).collect()[0]
    assert (t._period, t.published_count, t.correction_count, t.final_count, t.dropped_count) == (date(2024, 1, 1), 2, 3, 5, 1)
    assert (float(t.published_amount), float(t.final_amount), float(t.dropped_amount)) == (10.0, 23.0, 100.0)
    versions = [(r.version, r.row_count, float(r.amount)) for r in lateness.publications(df).orderBy("version").collect()]
    assert versions == [(0, 2, 10.0), (1, 3, 15.0), (2, 4, 22.0), (3, 5, 23.0)]


@pytest.mark.parametrize("slots", [1, 4, 50, None])
def test_ordered_release_is_the_same_for_any_slots(spark, slots):
    df = frame(spark, (1, 1, 5, 1), (2, 2, 4, 1), (3, 9, 9.5, 1), (4, 9, 9.1, 1), (5, 23, 200, 1), (6, 25, 26, 1))
    got = {str(r._period): tuple(r)[1:] for r in lateness.released_in_order(df, slots=slots).collect()}
    hour = 3_600_000_000
    assert got == {"2024-01-01": (4, 1, 4, 7 * hour, 2), "2024-01-02": (1, 6, 6, 0, 0)}


def test_parts_of_a_buffer_change_nothing(spark):
    df = spark.range(2000).selectExpr(
        "id record_id", "timestamp_seconds(1704067200 + if(id % 3 = 0, 3600, id * 97 % 259200)) event_timestamp", "timestamp_seconds(1704067200 + if(id % 3 = 0, 3600, id * 97 % 259200) + id * id % 400000) _ingested_at",
        "cast(id % 11 as decimal(18,2)) amount",
    )
    fates = lambda **o: {(r.record_id, r._fate) for r in lateness.buffered(df, **o).collect()}
    plain = fates()
    assert fates(part_rows=50) == fates(part_rows=7, sizes=df.union(df)) == plain and len({f for _, f in plain}) == 3
    assert {tuple(r) for r in lateness.period_totals(df, part_rows=50).collect()} == {tuple(r) for r in lateness.period_totals(df).collect()}
    sizes = [r["count"] for r in lateness.replayed(df, part_rows=50).filter("_row is not null").groupBy("_start", "_part").count().collect()]
    assert max(sizes) < 100


def test_stream_and_batch_agree(spark, tmp_path):
    """Arrivals in order, in several batches: provisional, corrected and final values are those of the replay."""
    df = spark.range(900).selectExpr(
        "id record_id", "timestamp_seconds(1704067200 + id * 97 % 200000) event_timestamp", "timestamp_seconds(1704067200 + id * 97 % 200000 + id * id % 500000) _ingested_at",
        "cast(id % 11 as decimal(18,2)) amount",
    )
    rows = sorted(df.collect(), key=lambda r: r._ingested_at)
    # A last arrival moves the clock beyond all closings.
    rows.append((9999, DAY + timedelta(days=40), DAY + timedelta(days=40), None))
    for k in range(0, len(rows), 180):
        spark.createDataFrame(rows[k : k + 180], df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"b={k:05d}"))
    folder = str(tmp_path / "in")
    events = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    told = runners.k_slack_stream(events, slots=6)
    query = told.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    fates = {(r.row, r.what) for r in out.filter("row is not null").collect()}
    assert fates == {(r.record_id, r._fate) for r in lateness.late_rows(df).collect()} and {w for _, w in fates} == {"correction", "dropped"}
    totals = {r._period: r for r in lateness.period_totals(df).collect()}
    provisional = {r.period: (r.n, r.c) for r in out.filter("what = 'provisional'").groupBy("period").agg(F.sum("n").alias("n"), F.sum("cents").alias("c")).collect()}
    assert provisional == {p: (t.published_count, int(t.published_amount * 100)) for p, t in totals.items() if t.published_count}
    final = out.filter("what = 'final'").withColumnRenamed("period", "_period")
    assert {tuple(r) for r in lateness.merged_slots(final).collect()} == {tuple(r) for r in lateness.released_in_order(df).collect()}


def test_empty_and_clashing_columns(spark):
    empty = frame(spark)
    assert lateness.period_totals(empty).count() == lateness.publications(empty).count() == lateness.released_in_order(empty).count() == 0
    df = frame(spark, (1, 1, 2, 10)).withColumn("_period", F.lit("x")).withColumn("_start", F.create_map(F.lit("k"), F.lit(1))).withColumn("_fate", F.lit("x")).withColumn("_slot", F.lit(1))
    assert lateness.buffered(df).first()._fate == "on_time" and lateness.released_in_order(df).first().row_count == 1


def test_bounds_are_checked():
    with pytest.raises(ValueError):
        lateness.Slack(timedelta(hours=2), timedelta(hours=1))


def test_fates_equal_what_is_published_and_released(spark, small):
    """``p6_found`` classifies rows; per period its fates are what the publications add and what the release lacks."""
    day = F.date_from_unix_date(F.floor(F.unix_micros("event_timestamp") / F.lit(86_400_000_000)).cast("int")).alias("event_day")
    kept = data_queries._kept_claims(spark, small).select("record_id", day)
    count = lambda df: Counter({r.event_day: r["count"] for r in df.groupBy("event_day").count().collect()})
    found = kept.join(data_queries.p6_found(spark, small), "record_id")
    first, last = Counter(), {}
    for r in data_queries.p6_publications(spark, small).orderBy("version").collect():
        end_us = ((r.event_day - date(1970, 1, 1)).days + 1) * 86_400_000_000
        if r.published_us == end_us + 3_600_000_000:
            first[r.event_day] = r.row_count
        last[r.event_day] = r.row_count
    released = Counter({r.event_day: r.row_count for r in data_queries.p6_ordered(spark, small).collect()})
    corrections, dropped = count(found.filter("fate = 'correction'")), count(found.filter("fate = 'dropped'"))
    assert corrections and dropped and +corrections == Counter(last) - first
    assert +dropped == count(kept.filter("event_day is not null")) - released and released == Counter(last)
