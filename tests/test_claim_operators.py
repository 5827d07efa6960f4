from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from claimloom.functions import scalar
from claimloom.operators import bronze, consent, governance, health, model, monitoring, quality, regulatory, scoring
from claimloom.plans import core_queries, sql_catalog
from claimloom.schemas import CLAIM, REGULATORY_RAW, REGULATORY_SILVER, schema_of

T0 = datetime(2024, 1, 10)


def test_parse_and_quarantine(spark):
    raw = spark.createDataFrame(
        [("k1", '{"claim_id": "c", "event_type": "claim-opened", "event_timestamp": "2024-01-01T00:00:00", "amount": 12.5}', 1, 0), ("k2", "no json", 1, 5), ("k3", '{"claim_id": null}', 0, 3), (None, None, 0, 4)],
        "key string, value string, partition int, offset long",
    ).withColumn("timestamp", F.lit(T0))
    parsed = bronze.parse_events(raw, CLAIM)
    valid, bad = bronze.valid_rows(parsed, ["event_type", "event_timestamp"]), bronze.quarantined_rows(parsed, ["event_type", "event_timestamp"])
    assert [(r.event_key, r.claim_id, r.amount) for r in valid.collect()] == [("k1", "c", Decimal("12.50"))]
    assert {r.event_key for r in bad.collect()} == {"k2", "k3", None} and bad.first()._reason == bronze.REASON
    assert {(r.partition, r.max_offset) for r in bronze.max_offsets(parsed).collect()} == {(1, 5), (0, 4)}
    assert bronze.quarantined_rows(parsed, []).count() == 1
    with pytest.raises(ValueError):
        schema_of("unknown")


def test_latest_per_key(spark):
    df = spark.createDataFrame([("c1", 1), ("c1", 3), ("c1", 2), ("c2", 5), (None, 1), (None, 2)], "claim_id string, _ingested_at long")
    assert {tuple(r) for r in bronze.latest_per_key(df, "claim_id", ["_ingested_at"]).collect()} == {("c1", 3), ("c2", 5), (None, 2)}


def test_scores(spark):
    at = lambda h: T0 + timedelta(hours=h)
    rows = [("a", "u", at(2), Decimal(100), "SP"), ("b", "u", at(3), Decimal(100), "SP"), ("c", "u", at(4), Decimal(9000), "SP"), ("d", None, at(30), None, None), ("e", None, at(14), None, None), ("f", "u", at(28), Decimal(1), "RJ"), ("g", "u", None, Decimal(1), "RJ")]
    df = spark.createDataFrame(rows, "claim_id string, customer_id string, event_timestamp timestamp, amount decimal(18,2), region string")
    got = {r.claim_id: r for r in scoring.scored(df).collect()}
    assert {k: r.night_claim for k, r in got.items()} == {"a": 1.0, "b": 1.0, "c": 1.0, "d": 0.0, "e": 0.0, "f": 1.0, "g": 0.0}
    assert {k: r.claims_last_24h for k, r in got.items()} == {"a": 1, "b": 2, "c": 3, "d": 2, "e": 1, "f": 2, "g": 1}
    assert got["d"].amount_outlier == got["e"].amount_outlier == 0.0 and got["c"].amount_outlier > 0.3
    assert all(0 <= r.fraud_score <= 1 for r in got.values())
    flags = spark.createDataFrame([(100.0, 0.1), (9000.0, 0.1), (None, 0.1), (None, 0.9)], "amount double, fraud_score double").select(scoring.approved(5000.0).alias("ok"))
    assert [r.ok for r in flags.collect()] == [True, False, None, False]


def test_recent_count_equals_the_window(spark):
    from pyspark.sql import Window

    df = spark.range(2000).selectExpr("id claim_id", "if(id % 5 = 0, null, id % 3) customer_id", "timestamp_seconds(1700000000 + (id * 7919) % 900000) event_timestamp")
    window = Window.partitionBy("customer_id").orderBy(F.unix_seconds("event_timestamp")).rangeBetween(-86400, 0)
    plain = {(r.claim_id, r.n) for r in df.withColumn("n", F.count("claim_id").over(window)).select("claim_id", "n").collect()}
    assert {(r.claim_id, r.claims_last_24h) for r in scoring.with_recent_count(df).collect()} == plain


def test_quality(spark):
    df = spark.createDataFrame([("c1", 10, "SP"), ("c1", -5, "RJ"), (None, 999_999, "ZZ"), (None, None, None)], "claim_id string, amount int, region string").withColumn("at", F.lit(T0))
    checks = [quality.not_null("claim_id"), quality.unique("claim_id"), quality.in_range("amount", 0, 100), quality.allowed("region", ["SP", "RJ"]), quality.fresh("at", timedelta(hours=1), T0 + timedelta(hours=1))]
    got = {r.check_name: (r.failed_rows, r.passed) for r in quality.run_checks(df, "t.x", checks).collect()}
    assert got == {"not_null:claim_id": (2, False), "unique:claim_id": (2, False), "range:amount": (2, False), "allowed_values:region": (1, False), "freshness:at": (0, True)}
    empty = {r.check_name: r.passed for r in quality.run_checks(df.limit(0), "t.x", checks).collect()}
    assert empty["freshness:at"] is False and empty["unique:claim_id"]
    rates = quality.pass_rate_by_layer(quality.run_checks(df, "t.x", checks)).first()
    assert (rates.layer, rates.passed_checks, rates.checks) == ("t", 1, 5)


def raw(spark, *rows):
    names = REGULATORY_RAW.names
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ", ".join(f"{n} string" for n in names))


def test_three_layouts(spark):
    df = raw(
        spark,
        dict(external_reference_id="r", source_system="insurer_a", numero_apolice="p", data_ocorrencia="04/05/2020", valor_indenizacao="R$ 1.234,56", regiao_sinistro="SP", codigo_causa="4"),
        dict(external_reference_id="r", source_system="insurer_b", POLICY_NUM="p", EVENT_DATE="2020-05-04", CLAIM_AMOUNT="1234.56", REGION_CODE="SP", CAUSE_CD="x"),
        dict(external_reference_id="r", source_system="insurer_c", policyId="p", occurrenceDate="1.5885504E12", amountCents="1.500000000000E+05", regionCode="SP", causeCode="4"),
        dict(external_reference_id="s", source_system="insurer_c", occurrenceDate="NaN", amountCents="NaN"),
        dict(external_reference_id="t", source_system="insurer_a", data_ocorrencia="garbage", valor_indenizacao="NaN"),
        dict(external_reference_id="u", source_system="unknown"),
    )
    got = [(r.source_system, r.event_timestamp and r.event_timestamp.date().isoformat(), r.amount and float(r.amount), r.cause_code) for r in regulatory.standardized(df).orderBy("external_reference_id", "source_system").collect()]
    assert got == [("insurer_a", "2020-05-04", 1234.56, 4), ("insurer_b", "2020-05-04", 1234.56, None), ("insurer_c", "2020-05-04", 1500.0, 4), ("insurer_c", None, None, None), ("insurer_a", None, None, None)]
    one = regulatory.standardized_source(df, "insurer_b").union(regulatory.standardized_source(df, "insurer_a")).union(regulatory.standardized_source(df, "insurer_c"))
    assert one.exceptAll(regulatory.standardized(df)).count() == 0
    assert [r.region for r in regulatory.trusted_regions(regulatory.standardized(df)).collect()] == ["SP"]


def silver(spark, *rows):
    return spark.createDataFrame([(ref, s, p, T0, None if a is None else Decimal(a), "SP", c) for ref, s, p, a, c in rows], REGULATORY_SILVER)


def test_reconcile_and_export(spark):
    sources = ["insurer_a", "insurer_b", "insurer_c"]
    df = silver(
        spark,
        *[("same", s, "p", a, 4) for s, a in zip(sources, (1000, 1010, 1020))],
        *[("apart", s, "p", a, 4) for s, a in zip(sources, (1000, 1200, 1100))],
        ("lacks", "insurer_a", "p", 10, 99), ("lacks", "insurer_b", None, None, 99),
        *[("none", s, None, None, None) for s in sources],
    )
    found = regulatory.reconciled(df)
    got = {(r.external_reference_id, r.discrepancy_type): (r.sources_reporting, r.min_amount, r.max_amount, r.resolved_amount) for r in found.collect()}
    assert got == {("apart", "amount_mismatch"): (sources, 1000.0, 1200.0, 1100.0), ("lacks", "missing_in_source"): (sources[:2], 10.0, 10.0, 10.0)}
    assert regulatory.reconciled(df, sources + ["insurer_d"]).filter("discrepancy_type = 'missing_in_source'").count() == 4
    issues = {r.COD_APO or "-": (r.compliance_issues, r.susep_compliant, r.INDENIZ) for r in regulatory.export_claims(df.filter("external_reference_id != 'same'"), found).filter("CAUSA is null or CAUSA = 99 or true").collect() if r.CAUSA != 4}
    assert issues["-"] == ("policy_id_ausente,valor_ausente", False, None) and issues["p"] == ("causa_invalida,reconciliacao:missing_in_source", False, 10.0)
    assert regulatory.export_claims(df.filter("external_reference_id = 'same'"), found).first().susep_compliant
    assert regulatory.alert_due(100, 6, 0, 10) and not regulatory.alert_due(100, 5, 1, 10) and not regulatory.alert_due(0, 0, 0, 0)
    assert regulatory.reconciled(df.limit(0)).count() == 0
    summary = quality.dq_summary(spark.createDataFrame([(True,), (False,)], "passed boolean"), found).first()
    assert tuple(summary) == (2, 1, 1, 1)


def test_profiles_and_views(spark):
    assert consent.profile("1000014339") == consent.profile("1000014339") and 18 <= consent.profile("x")[1] <= 80
    claims = spark.createDataFrame([("p1", "c1", "claim-opened", 5.0, "SP"), ("p3", "c3", "o", 1.0, "RJ"), (None, "c4", "o", 1.0, "RJ")], "policy_id string, claim_id string, event_type string, amount double, region string")
    people = consent.profiles(claims.select("policy_id").union(spark.sql("select 'p2'")))
    history = spark.createDataFrame([("p1", "GRANTED", "a", "s", True), ("p2", "GRANTED", "a", "s", True), ("p3", "REVOKED", "a", "s", True), ("p1", "REVOKED", "a", "s", False)], "policy_id string, consent_status string, target_institution string, scope string, is_current boolean").withColumn("valid_from", F.lit(T0))
    current = consent.current_consents(history)
    assert {(r.policy_id, r.claim_id) for r in consent.shareable(current, people, claims).collect()} == {("p1", "c1"), ("p2", None)}
    assert people.count() == 3 and consent.by_institution(current).count() == 2


def test_monitoring(spark):
    df = spark.createDataFrame([(T0, T0 + timedelta(seconds=100)), (T0, T0 + timedelta(seconds=121, milliseconds=900))], "a timestamp, _ingested_at timestamp")
    one = monitoring.latency(df, "a", "_ingested_at", 120).first()
    assert (one.sample_size, one.avg_seconds, one.max_seconds, one.within_sla) == (2, 110.5, 121, False)
    assert monitoring.latency(df.limit(0), "a", "_ingested_at", 120).first().within_sla is None
    minutes = monitoring.per_minute(df)
    assert monitoring.throughput(minutes).first().within_sla is False and monitoring.throughput(minutes.limit(0)).first().within_sla is None
    assert monitoring.densified(spark.createDataFrame([(T0, 1), (T0 + timedelta(minutes=3), 1)], "minute timestamp, events long")).count() == 4
    gold = spark.createDataFrame([("a", False, T0), ("b", True, T0), ("c", None, T0), ("d", False, T0 + timedelta(hours=23))], "claim_id string, auto_approved boolean, event_timestamp timestamp")
    now = T0 + timedelta(hours=24, seconds=1)
    assert [r.claim_id for r in monitoring.review_breaches(gold, now).collect()] == ["a"] and monitoring.review_breaches(gold, T0 + timedelta(hours=24)).count() == 0
    results = spark.createDataFrame([(True, T0), (False, now)], "drift_detected boolean, _checked_at timestamp")
    assert not monitoring.latest_signal(results).first()[0] and monitoring.latest_signal(results.limit(1)).first()[0] and not monitoring.latest_signal(results.limit(0)).first()[0]
    sent = []
    sink = type("S", (), {"send": lambda self, t: sent.append(t)})()
    assert monitoring.alert_breaches(2, sink) and not monitoring.alert_breaches(0, sink) and monitoring.alert_latency({"x": False, "y": None}, sink) and not monitoring.alert_drift([], sink)
    assert len(sent) == 2 and '"within_sla":false' in monitoring.report("m", monitoring.throughput(minutes), F.lit(T0)).first().details_json


def test_drift(spark):
    base = spark.createDataFrame([("a", 0.5, 0.1), ("b", 0.5, 0.0), ("c", 0.5, 0.1)], "feature_name string, mean double, stddev double")
    now = spark.createDataFrame([("a", 0.71), ("b", 0.55), ("d", 0.1)], "feature_name string, mean double")
    assert {r.feature_name: (round(r.drift_ratio, 6), r.drift_detected) for r in scoring.drift(base, now).collect()} == {"a": (2.1, True), "b": (1.0, False)}


def test_governance(spark):
    df = spark.createDataFrame([("c1", "p1", "SP"), (None, "p2", "RJ"), ("c3", "p3", None)], "customer_id string, policy_id string, region string")
    seen = governance.secured(df, {"insurance-region-sp"}, "readers", "admins").collect()
    assert len(seen) == 1 and len(seen[0].policy_id) == 64
    assert governance.secured(df, {"admins", "readers"}, "readers", "admins").count() == 3 and governance.secured(df, set(), "readers", "admins").count() == 0


def test_health():
    assert health.freshness(None, T0) == "unknown" and health.freshness(T0, T0 + timedelta(minutes=29)) == "green" and health.freshness(T0, T0 + timedelta(minutes=30)) == "red"
    assert [health.compliance(*x) for x in ((0, 0), (95, 5), (80, 20), (79, 21))] == ["unknown", "green", "yellow", "red"]
    assert [health.count_state(n) for n in (0, 1, 10)] == ["green", "yellow", "red"] and health.drift_state([True]) == "yellow" and health.target_state(None) == "unknown"
    assert '"a" -> "b"' in health.lineage_dot([("a", "b")]) and "x -> y;" in health.graph_dot({"x": ("X", "c", []), "y": ("Y", "c", ["x"])}, {"x": "green"})


def test_scalars(spark):
    df = spark.sql("select 1234567.891D as n, cast('NaN' as double) as q, '1.234,5' as a, 4.0D as c, cast(null as string) as z")
    row = df.select(scalar.currency_ptbr(df.n), scalar.without_nan(df.q), scalar.decimal_comma(df.a), scalar.decode_cause(df.c), scalar.decode_cause(df.z), scalar.movement_event(F.lit(44)), scalar.natural_key(df.c, df.z)).first()
    assert tuple(row) == ("R$ 1.234.567,89", None, Decimal("1234.50"), "colisao_parcial", "outros", "policy-cancelled", None)


def test_reports_on_missing_tables(spark):
    assert sql_catalog.run_or_none(spark, sql_catalog.table_count("no_such_table_here")) is None


def test_model_lifecycle(spark, tmp_path):
    df = spark.range(400).selectExpr("cast(id as string) claim_id", "id % 2 * 1.0D night_claim", "id % 3 / 2.0D high_frequency", "0.0D amount_outlier", "cast(id % 2 as int) label")
    trained, metrics = model.train(df, trees=5)
    assert metrics["f1"] == 1.0 and model.should_promote(0.9, None) and not model.should_promote(0.9, 0.9)
    registry = model.Registry(str(tmp_path))
    assert registry.load_champion() is None
    first, second = registry.record(trained, {"f1": 0.5}), registry.record(trained, {"f1": 0.4})
    assert (first["state"], second["state"]) == ("champion", "rejected") and registry.champion()["id"] == first["id"]
    registry.record(trained, {"f1": 0.6})
    assert [r["state"] for r in registry.runs()] == ["superseded", "rejected", "champion"]
    scores = model.with_shadow_score(df, registry.load_champion())
    assert scores.filter("model_fraud_score between 0 and 1").count() == 400 and model.with_shadow_score(df, None).first().model_fraud_score is None
    assert model.should_retrain(False, True, True) == (True, "bootstrap") and model.should_retrain(False, False, False)[0] is False


def test_shadow_scores_come_from_the_whole_forest(spark, small, monkeypatch):
    seen, scores = [], model.with_shadow_score
    monkeypatch.setattr(model, "with_shadow_score", lambda df, trained: seen.append(trained.stages[-1]) or scores(df, trained))
    core_queries.shadow_scores(spark, small)
    assert [(forest.getNumTrees, forest.getOrDefault("maxDepth")) for forest in seen] == [(100, 6)]
