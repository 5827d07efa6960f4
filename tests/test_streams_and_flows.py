import json
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from claimloom.operators import model, quality, regulatory, scoring
from claimloom.plans import pipelines, schedule
from claimloom.schemas import REGULATORY_RAW
from claimloom.sources import files, topics
from claimloom.store import TableStore
from claimloom.streaming import runners

T0 = datetime(2024, 1, 10)


def claims(spark, *rows):
    return spark.createDataFrame(
        [(c, "p" + c, None, "claim-opened", T0 + timedelta(hours=h), float(a), "SP", "furto", "s") for c, h, a in rows],
        "claim_id string, policy_id string, customer_id string, event_type string, event_timestamp timestamp, amount double, region string, vehicle_type string, source string",
    )


def put(spark, root, *values, batch=0):
    rows = [("k", v, T0 + timedelta(seconds=batch), 0, batch * 100 + i) for i, v in enumerate(values)]
    spark.createDataFrame(rows, topics.TOPIC_SCHEMA).coalesce(1).write.mode("append").parquet(str(topics.ensure_topic(root, "claim-opened")))


def event(c, amount, day=1):
    return json.dumps({"claim_id": c, "policy_id": "p", "event_type": "claim-opened", "event_timestamp": f"2024-01-{day:02d}T03:00:00Z", "amount": amount, "region": "SP"})


def test_claims_from_topic_to_gold_with_restart(spark, tmp_path):
    root, store = str(tmp_path / "topics"), TableStore(spark, str(tmp_path / "tables"))
    put(spark, root, event("a", 10), event("b", 20), "broken", event("a", 11))
    for _ in range(2):  # the second run finds nothing new
        pipelines.claims_flow(spark, store, topics.folder_stream(spark, root, "claim-opened"), str(tmp_path / "cp"))
        assert store.read("bronze.claims").count() == 3 and store.read("bronze.claims_quarantine").count() == 1
        assert store.read("silver.claims").count() == 2 and store.read("gold.claims").count() == 2
    put(spark, root, event("b", 30, 2), event("c", 5, 2), batch=1)
    pipelines.claims_flow(spark, store, topics.folder_stream(spark, root, "claim-opened"), str(tmp_path / "cp"))
    gold = {r.claim_id: (float(r.amount), str(r.event_date)) for r in store.read("gold.claims").collect()}
    assert set(gold) == {"a", "b", "c"} and gold["b"] == (30.0, "2024-01-02")
    assert {(str(r.event_date), r.claim_count) for r in store.read("gold.claims_region_agg").collect()} == {("2024-01-01", 1), ("2024-01-02", 2)}
    pipelines.region_flow(store, "2024-01-02")
    assert store.read("gold.claims_region_agg").count() == 2
    assert store.read("monitoring.dq_results").filter("check_name = 'not_null:customer_id' and not passed").count() >= 1
    assert store.read("bronze.claims").filter("_ingested_date is null").count() == 0


def test_the_champion_gives_shadow_scores(spark, tmp_path):
    root, store, registry = str(tmp_path / "t"), TableStore(spark, str(tmp_path / "s")), model.Registry(str(tmp_path / "m"))
    features = spark.range(100).selectExpr("concat('c', id) claim_id", "cast(id % 2 as double) night_claim", "0.3D high_frequency", "id / 100 amount_outlier", "cast(id > 80 as int) label")
    registry.record(*model.train(features, trees=3))
    put(spark, root, event("a", 10), event("b", 20))
    pipelines.claims_flow(spark, store, topics.folder_stream(spark, root, "claim-opened"), str(tmp_path / "cp"), registry)
    scores = [r.model_fraud_score for r in store.read("gold.claims").collect()]
    assert len(scores) == 2 and all(0 <= s <= 1 for s in scores)
    assert {(r.partition, r.next_offset) for r in store.read("monitoring.consumer_offsets").collect()} == {(0, 2)}
    views = pipelines.governance_flow(store, spark, {"gold.claims": "gold_claims_secured", "no.table": "x"}, {"insurance-region-sp"}, "pii", "admin")
    assert views == ["gold_claims_secured"] and {len(r.policy_id) for r in spark.table("gold_claims_secured").collect()} == {64}


def test_steps_run_when_due_and_in_order(caplog):
    ran, broken = [], set()

    def step(name, **options):
        def run():
            ran.append(name)
            if name in broken:
                raise RuntimeError(name)

        return schedule.Step(run, **options)

    plan = schedule.Schedule({"sla": step("sla", after=("gold",)), "gold": step("gold", every=timedelta(minutes=10)), "drift": step("drift", every=timedelta(hours=6))})
    assert plan.tick(T0) == {"gold": True, "sla": True, "drift": True} and ran.index("gold") < ran.index("sla")
    assert plan.tick(T0 + timedelta(minutes=9)) == {}
    broken.add("gold")
    assert plan.tick(T0 + timedelta(minutes=10)) == {"gold": False, "sla": False}
    with pytest.raises(ValueError):
        schedule.order_of({"a": step("a", after=("b",))})
    assert schedule.INTERVALS["silver"] == timedelta(minutes=5)


def test_offsets_are_reported(spark, tmp_path):
    root, store, seen = str(tmp_path / "t"), TableStore(spark, str(tmp_path / "s")), runners.OffsetReporter("claim-opened", "g")
    put(spark, root, event("a", 1), event("b", 2))
    runners.run_bronze(spark, topics.folder_stream(spark, root, "claim-opened"), "claim-opened", store, "bronze.x", str(tmp_path / "cp"), on_offsets=seen)
    assert seen.next == {0: 2}


def test_publishing(spark, tmp_path):
    root = str(tmp_path)
    df = claims(spark, ("a", 0, 1), ("b", 0, float("nan")))
    topics.publish(df, root, "claim-opened", F.lit(T0))
    rows = {r.key: json.loads(r.value) for r in spark.read.parquet(f"{root}/claim-opened").collect()}
    assert rows["a"]["amount"] == 1.0 and "amount" not in rows["b"]
    with pytest.raises(ValueError):
        topics.publish(df.limit(0), root, "claim-opened")
    with pytest.raises(ValueError):
        next(topics.paced([], 60))
    ticks = iter(range(100))
    assert len(list(topics.paced([{}], 60, most_seconds=3, loop=True, clock=lambda: next(ticks), wait=lambda s: None))) == 2
    assert topics.broker_options("t", lambda name: "x")["subscribe"] == "t"
    with pytest.raises(RuntimeError):
        topics.secret("CLAIMLOOM_NO_SUCH_SECRET")
    topics.publish(df, root, "claim-opened", F.lit(T0))
    offsets = [(r.partition, r.offset) for r in spark.read.parquet(f"{root}/claim-opened").collect()]
    assert len(offsets) == len(set(offsets)) == 4
    sent, waits = [], []
    many = claims(spark, *[(f"c{i}", 0, i) for i in range(90)])
    assert topics.publish_paced(many, lambda m: sent.append(m.count()), 30, wait=waits.append) == 3 and sum(sent) == 90 and waits == [60.0] * 3
    ticks = iter(range(0, 10_000, 60))
    assert topics.publish_paced(many, lambda m: None, 30, most_seconds=300, loop=True, clock=lambda: next(ticks), wait=waits.append) == 4


def test_source_files(spark, tmp_path):
    path = tmp_path / "claims.csv"
    path.write_bytes("COD_APO;D_OCORR;INDENIZ;REGIAO;CAUSA;X\np1;20200504;10.5;S\xe3o;4;x\n;00000000;abc;RJ;;y\n".encode("latin-1"))
    raw = files.read_delimited(spark, str(path))
    got = {r.region: r for r in files.claim_events(raw).collect()}
    assert got["São"].policy_id == "p1" and got["São"].event_timestamp == datetime(2020, 5, 4) and got["São"].vehicle_type == "colisao_parcial"
    assert got["RJ"].event_timestamp is None and got["RJ"].amount is None and len(got["RJ"].policy_id) == 64
    assert files.read_delimited(spark, str(path), sample_rows=1).count() == 1
    with pytest.raises(FileNotFoundError):
        files.read_delimited(spark, str(tmp_path / "none.csv"))
    policies = spark.createDataFrame([("o", None, "s1", "2020-03", "11", "SP"), ("o", "p", "s2", "x", "44", "RJ")], "REGISTRO_OPERADORA string, CD_PLANO_RPS string, CD_PLANO_SCPA string, DT_INCLUSAO string, ID_MOTIVO_MOVIMENTO string, SG_UF string")
    rows = {r.region: (r.event_type, r.event_timestamp) for r in files.policy_events(policies).collect()}
    assert rows == {"SP": ("policy-created", datetime(2020, 3, 1)), "RJ": ("policy-cancelled", None)}
    sent = []
    assert files.replay(spark, {"a": {"loader": "susep", "path": str(path), "topic": "t"}, "b": {"loader": "none", "path": "", "topic": "t"}}, lambda df, topic: sent.append((df.count(), topic))) == 1
    assert sent == [(2, "t")]
    with pytest.raises(RuntimeError):
        files.replay(spark, {}, lambda df, topic: None)


def test_archives_are_fetched_once(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("readme.txt", "no")
        z.writestr("data/claims.CSV", "COD_APO;CAUSA\n1;2\n")
    (tmp_path / "plain.csv").write_text("a;b\n")
    to = str(tmp_path / "got" / "claims.csv")
    assert files.fetch_csv((tmp_path / "a.zip").as_uri(), to) == to and open(to).read() == "COD_APO;CAUSA\n1;2\n"
    assert files.fetch_csv("file:///no/such/file", to) == to  # it is there already
    assert open(files.fetch_csv((tmp_path / "plain.csv").as_uri(), str(tmp_path / "got" / "p.csv"))).read() == "a;b\n"
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("readme.txt", "no")
    with pytest.raises(ValueError):
        files.fetch_csv((tmp_path / "b.zip").as_uri(), str(tmp_path / "got" / "b.csv"))


def test_simulated_feeds_reconcile(spark, tmp_path):
    base = spark.range(400).selectExpr("cast(id as string) COD_APO", "'20200504' D_OCORR", "cast(100 + id as string) INDENIZ", "'SP' REGIAO", "'4' CAUSA")
    feeds = [files.simulated_feed(base, s) for s in ("insurer_a", "insurer_b", "insurer_c")]
    raw = feeds[0].unionByName(feeds[1], allowMissingColumns=True).unionByName(feeds[2], allowMissingColumns=True).select(*REGULATORY_RAW.names)
    store = TableStore(spark, str(tmp_path))
    sent = []
    sink = type("S", (), {"send": lambda self, text: sent.append(text)})()
    for _ in range(2):
        assert pipelines.regulatory_flow(store, raw, T0, sink)
    assert len(sent) == 2 and "checks failed" in sent[0]
    regions = store.read("monitoring.dq_results").filter("check_name = 'allowed_values:region'").collect()
    trusted = {r.region for r in regulatory.trusted_regions(store.read("silver.regulatory_claims")).collect()}
    assert [r.failed_rows for r in regions] == [store.read("silver.regulatory_claims").filter(~F.col("region").isin(*trusted)).count()] * 2
    silver = spark.createDataFrame([("SP",), ("ZZ",), (None,), ("ZZ",)], "region string")
    assert tuple(quality.allowed_by(silver, "t", "region", silver.limit(1)).first()) == ("allowed_values:region", "t", False, 2)
    silver = store.read("silver.regulatory_claims")
    assert 1100 < silver.count() < 1200 and silver.filter("amount is null").count() > 0 and silver.filter("cause_code = 99").count() > 0
    kinds = {r.discrepancy_type: r["count"] for r in store.read("monitoring.reconciliation").groupBy("discrepancy_type").count().collect()}
    assert kinds["missing_in_source"] > 5 and kinds["amount_mismatch"] > 20
    assert store.read("gold.regulatory_claims").count() == 400


def test_consents(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    events = files.simulated_consents(claims(spark, *[(str(i), 0, 1) for i in range(50)]), T0)
    pipelines.consent_flow(store, events.limit(0), T0)
    assert not store.exists("silver.consent_current")
    for _ in range(2):
        pipelines.consent_flow(store, events, T0)
        history = store.read("silver.consent_current")
        assert history.filter("is_current").count() == 50 == history.select("policy_id").distinct().count()


def test_training_and_watching(spark, tmp_path):
    store, registry, sent = TableStore(spark, str(tmp_path / "tables")), model.Registry(str(tmp_path / "models")), []
    sink = type("S", (), {"send": lambda self, text: sent.append(text)})()
    day = claims(spark, *[(f"c{i}", 10 + i % 3, 100 + i) for i in range(40)], *[(f"n{i}", 23, 10**6) for i in range(4)])
    gold = scoring.claims_gold(day.withColumn("_ingested_at", F.lit(T0)), F.lit(T0 + timedelta(seconds=421)))
    store.overwrite("gold.claims", gold)
    store.overwrite("bronze.claims", day.withColumns({"kafka_timestamp": F.lit(T0), "_ingested_at": F.lit(T0 + timedelta(seconds=60))}))
    now = T0 + timedelta(days=1)
    assert pipelines.drift_flow(store, now, sink) == [] and not store.exists("monitoring.drift_results")

    run = pipelines.training_flow(store, registry, now, trees=3)
    base = {r.feature_name: r for r in store.read("monitoring.feature_baseline").collect()}
    fit, _ = model.stratified_split(model.training_features(gold))
    assert run["state"] == "champion" == registry.champion()["state"] and {r.champion_run_id for r in base.values()} == {run["id"]} and base["night_claim"]._computed_at == now
    want = {r.feature_name: (r["mean"], r.stddev) for r in scoring.feature_baseline(fit).collect()}
    assert base.keys() == want.keys() and all(base[n]["mean"] == pytest.approx(m) and base[n].stddev == pytest.approx(s) for n, (m, s) in want.items())

    for _ in range(2):  # the same check again replaces itself
        assert [r.drift_detected for r in pipelines.drift_flow(store, now, sink)] == [False] * 3 and sent == []
        assert store.read("monitoring.drift_results").count() == 3
    assert pipelines.training_flow(store, registry, now) is None and len(registry.runs()) == 1
    assert pipelines.drift_flow(store, now + timedelta(days=9), sink) == [] and store.read("monitoring.drift_results").count() == 3

    store.overwrite("gold.claims", gold.withColumn("event_timestamp", F.col("event_timestamp") + F.expr("interval 13 hours")))
    later = now + timedelta(hours=13)
    found = {r.feature_name for r in pipelines.drift_flow(store, later, sink) if r.drift_detected}
    assert "night_claim" in found and len(sent) == 1 and "night_claim" in sent[0] and store.read("monitoring.drift_results").count() == 6
    again = pipelines.training_flow(store, registry, later, trees=3)
    assert again is not None and len(registry.runs()) == 2
    assert {r.champion_run_id for r in store.read("monitoring.feature_baseline").collect()} == {registry.champion()["id"]}

    # A run that ended between the registry and the table is made good.
    store.overwrite("monitoring.feature_baseline", store.read("monitoring.feature_baseline").withColumn("champion_run_id", F.lit("old")))
    store.append("monitoring.drift_results", store.read("monitoring.drift_results").limit(1).withColumns({"drift_detected": F.lit(False), "_checked_at": F.lit(later + timedelta(days=1))}))
    assert pipelines.training_flow(store, registry, later) is None
    assert {r.champion_run_id for r in store.read("monitoring.feature_baseline").collect()} == {registry.champion()["id"]}

    sent.clear()
    for _ in range(2):
        assert pipelines.latency_flow(store, T0 + timedelta(minutes=8), sink) == {"kafka_to_bronze": True, "score_visible": False, "throughput": False}
        assert store.read("monitoring.latency_results").count() == 3
    assert sent == ["outside the target: score_visible, throughput"] * 2
    waiting = store.read("gold.claims").filter("not auto_approved").count()
    assert pipelines.review_flow(store, T0 + timedelta(days=9), sink) == waiting > 0 and len(sent) == 3
    assert pipelines.review_flow(store, T0, sink) == 0 and len(sent) == 3
