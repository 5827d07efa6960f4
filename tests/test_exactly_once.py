from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimloom.operators import exactly_once as once
from claimloom.operators.exactly_once import exactly_once, redundant_copies

SCHEMA = "record_id long, claim_id string, event_type string, event_timestamp timestamp, _ingested_at timestamp"
T0 = datetime(2024, 1, 1)


def rows(*specs):
    """(record_id, claim_id, type, minute of the event, minute of ingestion)"""
    at = lambda m: None if m is None else T0 + timedelta(minutes=m)
    return [(r, c, t, at(e), at(i)) for r, c, t, e, i in specs]


def expected(data):
    seen, out = {}, set()
    for r in sorted(data, key=lambda r: (r[4] is None, r[4] or T0, r[0] is None, r[0] or 0)):
        key = (r[1] or "").strip(" ").lower()
        if key and (key, r[2], r[3]) in seen:
            out.add(r[0])
        seen[(key, r[2], r[3])] = r
    return out


@pytest.mark.parametrize("hot", [1, 2, 1000])
def test_first_ingested_copy_stays(spark, hot):
    data = rows(
        (1, "A", "o", 0, 5), (2, " a ", "o", 0, 3), (3, "a", "o", 0, 3), (4, "a", "u", 0, 1), (5, "b", "o", 0, 1), (6, "a", "o", 1, 1),
        (7, None, "o", 0, 1), (8, None, "o", 0, 1), (9, "  ", "o", 0, 1), (10, "  ", "o", 0, 2), (11, "c", None, None, 2), (12, "c", None, None, None),
    )
    df = spark.createDataFrame(data, SCHEMA)
    assert {r.record_id for r in redundant_copies(df, hot_rows=hot).collect()} == {1, 3, 12} == expected(data)
    kept = [r.record_id for r in exactly_once(df, hot_rows=hot).collect()]
    assert sorted(kept) == [2, 4, 5, 6, 7, 8, 9, 10, 11]


def test_stored_and_new_rows_together(spark):
    stored = spark.createDataFrame(rows((1, "a", "o", 0, 1), (2, "b", "o", 0, 1)), SCHEMA)
    new = spark.createDataFrame(rows((3, "A", "o", 0, 9), (4, "c", "o", 0, 9)), SCHEMA).withColumn("extra", F.lit(1))
    out = exactly_once(stored, new)
    assert {(r.record_id, r.extra) for r in out.collect()} == {(1, None), (2, None), (4, 1)}


def test_equal_rows_count_as_copies_and_one_stays(spark):
    df = spark.createDataFrame(rows((1, "a", "o", 0, 1)) * 3, SCHEMA)
    assert exactly_once(df).count() == 1 and redundant_copies(df).count() == 2


def test_empty_table_and_clashing_names(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exactly_once(empty).count() == 0 and redundant_copies(empty).count() == 0
    df = spark.createDataFrame(rows((1, "a", "o", 0, 1), (2, "a", "o", 0, 2)), SCHEMA)
    for name in ("__wdigest", "__wrank", "__digest", "a.b", "__w_part"):
        df = df.withColumn(name, F.lit(7))
    out = exactly_once(df)
    assert out.columns == df.columns and [r.record_id for r in out.collect()] == [1]


def test_one_identifier_with_most_rows(spark):
    df = spark.range(5000).selectExpr(
        "id record_id", "if(id % 3 = 0, 'hot', cast(id as string)) claim_id", "'o' event_type", "timestamp '2024-01-01' event_timestamp",
        "timestamp_seconds(1e9 - id) _ingested_at",
    )
    kept = exactly_once(df, hot_rows=100)
    assert kept.count() == 5000 - 1667 + 1
    assert kept.filter("claim_id = 'hot'").first().record_id == 4998


def test_groups_beyond_the_list_of_hot_ones_are_ranked_too(spark, monkeypatch):
    monkeypatch.setattr(once, "HOT_GROUPS", 1)
    df = spark.range(300).selectExpr("id record_id", "concat('c', id % 3) claim_id", "'o' event_type", "timestamp '2024-01-01' event_timestamp", "timestamp_seconds(id) _ingested_at")
    assert {r.record_id for r in exactly_once(df, hot_rows=10).collect()} == {0, 1, 2} and redundant_copies(df, hot_rows=10).count() == 297


def test_no_task_holds_a_hot_group(spark):
    """The plan meets a hot group only behind the broadcast list and in its salted parts."""
    df = spark.range(40_000).selectExpr("id record_id", "if(id % 3 = 0, 'hot', cast(id as string)) claim_id", "'o' event_type", "timestamp '2024-01-01' event_timestamp", "timestamp_seconds(id) _ingested_at")
    parts = once.split_by_frequency(df, once.claim_message_key(), hot_rows=500)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [n for n in parts.redundant.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 13_333 and max(sizes) < 13_333 * 0.6


CELL = st.tuples(st.sampled_from(["a", "A ", "b", "", None]), st.sampled_from(["o", None]), st.integers(0, 1), st.integers(0, 3))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(CELL, max_size=12), st.integers(1, 3))
def test_against_a_plain_model(spark, cells, hot):
    data = rows(*[(i, *c) for i, c in enumerate(cells)])
    found = {r.record_id for r in redundant_copies(spark.createDataFrame(data, SCHEMA), hot_rows=hot).collect()}
    assert found == expected(data)
