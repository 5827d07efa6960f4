from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from claimloom.operators import history, table_diff

T0 = datetime(2024, 1, 1)
EVENTS = "event_no long, policy_id string, consent_status string, target_institution string, scope string, event_timestamp timestamp"


def events(spark, *specs):
    return spark.createDataFrame([(n, p, s, i, "x", None if m is None else T0 + timedelta(minutes=m)) for n, p, s, i, m in specs], EVENTS)


def minutes(rows):
    zero = int(T0.timestamp()) * 1_000_000
    at = lambda us: None if us is None else (us - zero) // 60_000_000
    return sorted((r._entity, r.consent_status, at(r._valid_from), at(r._valid_to)) for r in rows)


@pytest.mark.parametrize("chunks", [1, 2, 9, None])
def test_versions_of_late_repeated_and_equal_events(spark, chunks):
    df = events(
        spark,
        (3, "p", "REVOKED", "a", 20), (1, "p", "GRANTED", "a", 0), (2, "p", " granted", "A ", 10), (1, "p", "GRANTED", "a", 0), (4, "p", "GRANTED", "a", 20),
        (5, "p", "GRANTED", "b", 30), (6, "p", "GRANTED", "b", 40), (7, "p", None, "b", 50), (8, "p", "REVOKED", None, 50), (9, "p", "REVOKED", "b", None),
        (10, None, "GRANTED", "a", 0), (11, "q", "GRANTED", "a", 5),
    )
    got = minutes(history.consent_versions(df, chunks).collect())
    # Of the two events at minute 20 the one with the larger number counts and changes nothing.
    assert got == [("p", "GRANTED", 0, 30), ("p", "GRANTED", 30, None), ("q", "GRANTED", 5, None)]


def steps(spark, same):
    """A third of the rows belongs to one entity, which keeps its state for ``same`` events."""
    return spark.range(3000).selectExpr(
        "id event_no", "if(id % 3 = 0, 'hot', concat('p', id % 50)) policy_id", f"if(floor(id / {same}) % 2 = 0, 'GRANTED', 'REVOKED') consent_status", "'a' target_institution",
        "'' scope", "timestamp_seconds(1704067200 + id * 61) event_timestamp",
    )


@pytest.mark.parametrize("same", [7, 400, 100_000])
def test_any_number_of_chunks_gives_the_same_versions(spark, same):
    df = steps(spark, same)
    plain = {tuple(r) for r in history.consent_versions(df, 1).drop("_events").collect()}
    for chunks in (2, 13, 60):
        assert {tuple(r) for r in history.consent_versions(df, chunks).drop("_events").collect()} == plain


def test_a_hot_entity_is_cut_into_even_chunks(spark):
    attributes = {n: history.normalised(n) for n in ("consent_status", "target_institution")}
    rows = history.latest_event_per_instant(steps(spark, 7), "policy_id", "event_timestamp", "event_no", attributes)
    sizes = [r["count"] for r in history._in_chunks(rows, 20).groupBy("_chunk").count().collect()]
    assert len(sizes) > 15 and max(sizes) < 2 * 3000 / 20


def test_empty_and_null_attributes(spark):
    assert history.consent_versions(events(spark)).count() == 0
    snaps = spark.createDataFrame([("e", T0, None), ("e", T0 + timedelta(1), "x"), ("e", T0 + timedelta(2), None), ("e", T0 + timedelta(3), None)], "k string, at timestamp, _at string")
    out = history.snapshot_versions(snaps, "k", "at", ["_at"]).orderBy("_valid_from").collect()
    assert [r["_at"] for r in out] == [None, "x", None] and out[-1]._valid_to is None


RECON = "external_reference_id string, discrepancy_type string, sources_reporting array<string>, min_amount double, max_amount double, resolved_amount double, detected_at timestamp"


def recon(spark, *rows):
    return spark.createDataFrame([(*r, T0) for r in rows], RECON)


def test_differences_field_by_field(spark):
    left = recon(
        spark,
        (" K1 ", "m", ["a", "b"], 1.001, 2.0, 3.0), ("k1", "M ", ["b", "a", "a"], 1.0, 2.0, 3.0), ("k2", "m", ["a"], 1.0, None, 3.0), ("k3", "m", None, 1.0, 2.0, 3.0),
        ("k4", "m", ["a"], 1.0, 2.0, 3.0), (None, "m", ["a"], 1.0, 2.0, 3.0),
    )
    right = recon(spark, ("k1", "m", ["a", "b"], 1.0, 2.004, 3.0), ("k2", "x", ["a"], 1.0, 0.0, 3.004), ("k3", "m", [], 1.0, 2.0, 3.01), ("k5", "m", ["a"], 1.0, 2.0, 3.0))
    got = {tuple(r) for r in table_diff.reconciliation_differences(left, right).collect()}
    assert got == {
        ("k2", "discrepancy_type"), ("k2", "max_amount"), ("k3", "sources_reporting"), ("k3", "resolved_amount"),
        ("k4", "missing_in_replica"), ("k5", "missing_in_primary"), (None, "missing_in_replica"),
    }


def test_empty_sides_and_large_numbers(spark):
    one = recon(spark, ("k", "m", ["a"], 1e300, float("nan"), -0.0))
    none = recon(spark)
    assert [tuple(r) for r in table_diff.reconciliation_differences(one, none).collect()] == [("k", "missing_in_replica")]
    assert [tuple(r) for r in table_diff.reconciliation_differences(none, one).collect()] == [("k", "missing_in_primary")]
    same = recon(spark, ("k", "m", ["a"], 1e300, float("nan"), 0.0)).withColumn("field", F.lit("extra"))
    assert table_diff.reconciliation_differences(one, same).count() == 0
