from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimloom.store import TableStore, scd2_merged

T0 = datetime(2024, 1, 1)
EVENT = "policy_id string, consent_status string, event_timestamp timestamp"


@pytest.fixture
def store(spark, tmp_path):
    return TableStore(spark, str(tmp_path))


def claims(spark, *rows):
    return spark.createDataFrame(list(rows), "claim_id string, event_date string, amount long")


def test_upsert(spark, store):
    store.upsert("silver.claims", claims(spark, ("c1", "d1", 1), ("c2", "d1", 20)), "claim_id", "event_date")
    store.upsert("silver.claims", claims(spark, ("c1", "d2", 99), ("c3", "d2", 30), (None, "d2", 5)), "claim_id", "event_date")
    got = sorted((str(r.claim_id), r.event_date, r.amount) for r in store.read("silver.claims").collect())
    assert got == [("None", "d2", 5), ("c1", "d2", 99), ("c2", "d1", 20), ("c3", "d2", 30)]
    with pytest.raises(ValueError):
        store.upsert("silver.claims", claims(spark, ("c1", "d", 1), ("c1", "d", 2)), "claim_id")
    assert store.version("silver.claims") == 2 and store.vacuum("silver.claims") == 1 and store.read("silver.claims").count() == 4


def rewritten(store, name, change):
    parts = lambda: {p["path"] for p in store._state(name)["parts"]}
    before = parts()
    change()
    return before - parts()


def test_only_touched_partitions_are_rewritten(spark, store):
    store.upsert("t", claims(spark, *[(f"c{i}", f"d {i % 5}", i) for i in range(50)]), "claim_id", "event_date")
    gone = rewritten(store, "t", lambda: store.upsert("t", claims(spark, ("c6", "d 1", 99), ("new", "d 4", 1)), "claim_id", "event_date"))
    assert [g.rpartition("=")[2] for g in gone] == ["d 1"] and store.read("t").count() == 51
    assert {r.amount for r in store.read("t").filter("claim_id = 'c6'").collect()} == {99}
    gone = rewritten(store, "t", lambda: store.replace_partition("t", claims(spark, ("x", "d 2", 7)), "event_date", "d 2"))
    assert len(gone) == 1 and store.read("t").filter("event_date = 'd 2'").count() == 1
    store.scd2_merge("h", events(spark, *[(f"p{i}", "G", 1) for i in range(60)]), "policy_id", "event_timestamp")
    assert len(rewritten(store, "h", lambda: store.scd2_merge("h", events(spark, ("p7", "R", 2)), "policy_id", "event_timestamp"))) == 1
    assert store.read("h").columns == ["policy_id", "consent_status", "event_timestamp", "is_current", "valid_from", "valid_to"] and store.read("h").count() == 61


def test_no_writer_loses_the_work_of_another(spark, store, monkeypatch):
    """Between reading a version and committing the next one, another writer commits."""
    other, write, turns = TableStore(spark, store.files.root), TableStore._write, [1, 1]

    def slow(self, name, *args):
        parts = write(self, name, *args)
        if self is store and turns:
            turns.pop()
            other.append(name, claims(spark, (f"o{len(turns)}", "d1", 1)), "event_date")
        return parts

    store.append("t", claims(spark, ("a", "d1", 1)), "event_date")
    monkeypatch.setattr(TableStore, "_write", slow)
    turns[:] = [1]
    store.append("t", claims(spark, ("b", "d1", 2)), "event_date")
    turns[:] = [1, 1]
    store.upsert("t", claims(spark, ("a", "d1", 9)), "claim_id", "event_date")
    assert {(r.claim_id, r.amount) for r in store.read("t").collect()} == {("a", 9), ("b", 2), ("o0", 1), ("o1", 1)}
    assert {tuple(r) for r in store.read("t").select("claim_id").collect()} and store.read("t").count() == 5


def test_a_replay_leaves_readers_alone_and_folders_are_joined(spark, store):
    for i in range(6):
        store.append("t", claims(spark, (f"a{i}", "d", i)), "event_date", batch_id=i)
    reader = store.read("t")
    store.append("t", claims(spark, ("a5", "d", 50)), batch_id=5)
    assert reader.agg({"amount": "sum"}).first()[0] == 15 and store.read("t").agg({"amount": "sum"}).first()[0] == 60
    assert store.compact("t", most=4) == 1 and store.compact("t", most=4) == 0
    assert len(store._state("t")["parts"]) == 1 and store.read("t").count() == 6
    assert store.vacuum("t", keep=2) == 1 and store.vacuum("t") == 6 and store.read("t").count() == 6


def test_append_evolves_and_replays(spark, store):
    store.append("t", claims(spark, ("a", "d", 1)), "event_date", batch_id=0)
    store.append("t", claims(spark, ("b", "d", 2)).withColumn("more", F.lit("x")), batch_id=1)
    store.append("t", claims(spark, ("b", "d", 2)).withColumn("more", F.lit("x")), batch_id=1)
    got = {(r.claim_id, r.more) for r in store.read("t").collect()}
    assert got == {("a", None), ("b", "x")} and store.read("t").count() == 2


def test_replace_partition_may_empty_it(spark, store):
    store.overwrite("agg", claims(spark, ("a", "d1", 1), ("b", "d2", 2)), "event_date")
    store.replace_partition("agg", claims(spark, ("c", "d1", 3)), "event_date", "d1")
    assert {r.claim_id for r in store.read("agg").collect()} == {"b", "c"}
    store.replace_partition("agg", claims(spark), "event_date", "d1")
    assert {r.claim_id for r in store.read("agg").collect()} == {"b"}


def test_missing_table(spark, store):
    assert not store.exists("nope") and store.read_or_empty("nope", claims(spark).schema).count() == 0
    with pytest.raises(FileNotFoundError):
        store.read("nope")


def events(spark, *rows):
    return spark.createDataFrame([(p, s, T0 + timedelta(hours=h)) for p, s, h in rows], EVENT)


def state(rows):
    at = lambda t: None if t is None else int((t - T0).total_seconds() // 3600)
    return sorted((r.policy_id, r.consent_status, r.is_current, at(r.valid_from), at(r.valid_to)) for r in rows)


def test_scd2(spark, store):
    store.scd2_merge("h", events(spark, ("p", "G", 1), ("p", "R", 3), ("q", "G", 2)), "policy_id", "event_timestamp")
    assert state(store.read("h").collect()) == [("p", "R", True, 3, None), ("q", "G", True, 2, None)]
    for _ in range(2):  # a replay changes nothing
        store.scd2_merge("h", events(spark, ("p", "G", 5), ("q", "R", 1), ("r", "G", 9)), "policy_id", "event_timestamp")
        assert sorted(map(str, state(store.read("h").collect()))) == sorted(map(str, [("p", "R", False, 3, 5), ("p", "G", True, 5, None), ("q", "G", True, 2, None), ("r", "G", True, 9, None)]))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.sampled_from("pq"), st.sampled_from("GR"), st.integers(0, 5)), max_size=4), max_size=3))
def test_scd2_against_a_model(spark, batches):
    """One current row per key, the newest seen; a batch counts by its newest row only."""
    target, current, closed = None, {}, []
    for batch in batches:
        target = scd2_merged(target, events(spark, *batch), "policy_id", "event_timestamp")
        for key in {b[0] for b in batch}:
            newest = max((b for b in batch if b[0] == key), key=lambda b: (b[2], b[1]))
            if key not in current or current[key][2] < newest[2]:
                if key in current:
                    closed.append((key, current[key][1], False, current[key][2], newest[2]))
                current[key] = newest
    if target is not None:
        want = closed + [(k, s, True, h, None) for k, (_, s, h) in current.items()]
        assert sorted(map(str, state(target.collect()))) == sorted(map(str, want))
