"""The four flows from end to end over a table store, and those that train and watch. Each may be repeated and ends in
the same tables; only a training that is due adds a run."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.operators import consent, governance, model, monitoring, quality, regulatory, scoring
from claimloom.session import stored
from claimloom.store import TableStore
from claimloom.streaming import runners


def claims_flow(spark: SparkSession, store: TableStore, stream: DataFrame, checkpoints: str, registry: model.Registry | None = None, topic: str = "claim-opened", group: str = "bronze") -> None:
    """Topic to bronze, silver, scores and region aggregates. The champion of the registry gives shadow scores."""
    runners.run_bronze(spark, stream, topic, store, "bronze.claims", f"{checkpoints}/bronze", on_offsets=runners.OffsetReporter(topic, group, store))
    if store.exists("bronze.claims"):
        runners.run_silver(spark, store, "bronze.claims", "silver.claims", "claim_id", f"{checkpoints}/silver")
        runners.run_scoring(spark, store, "silver.claims", "gold.claims", f"{checkpoints}/gold", registry and registry.load_champion())
        region_flow(store)


def region_flow(store: TableStore, day: str | None = None) -> None:
    """Region aggregates of one day, or of all days that the claims touch."""
    if not store.exists("gold.claims"):
        return
    gold = store.read("gold.claims")
    if day is None:
        store.overwrite("gold.claims_region_agg", scoring.region_aggregates(gold), "event_date")
    else:
        rows = scoring.region_aggregates(gold.filter(F.col("event_date") == F.to_date(F.lit(day))))
        store.replace_partition("gold.claims_region_agg", rows, "event_date", day)


def regulatory_flow(store: TableStore, raw: DataFrame, as_of: datetime, sink: monitoring.AlertSink | None = None) -> bool:
    """Standardise, check, reconcile and export; tells whether an alert is due, and the sink if so. Results replace those
    of the last run. Regions must be ones on which several reports of a claim agree."""
    silver = regulatory.standardized(raw)
    store.overwrite("silver.regulatory_claims", silver)
    silver = store.read("silver.regulatory_claims")
    regions = quality.allowed_by(silver, "silver.regulatory_claims", "region", regulatory.trusted_regions(silver))
    checks = [*[quality.not_null(c) for c in ("external_reference_id", "policy_id", "event_timestamp", "amount")], quality.allowed("cause_code", regulatory.VALID_CAUSES)]
    results = stored(quality.run_checks(silver, "silver.regulatory_claims", checks).unionByName(regions))
    quality.persist_results(store, "monitoring.dq_results", results, F.lit(as_of))
    store.overwrite("monitoring.reconciliation", regulatory.reconciled(silver).withColumn("detected_at", F.lit(as_of)))
    found = store.read("monitoring.reconciliation")
    store.overwrite("gold.regulatory_claims", regulatory.export_claims(silver, found))
    store.append("gold.dq_summary", quality.dq_summary(results, found).withColumn("_generated_at", F.lit(as_of)))
    n = quality.dq_summary(results, found).first()
    claims = store.read("gold.regulatory_claims").count()
    found = n["amount_mismatch_count"] + n["missing_in_source_count"]
    due = regulatory.alert_due(n["dq_checks_total"], n["dq_checks_failed"], found, claims)
    if due and sink:
        sink.send(f"{n['dq_checks_failed']} of {n['dq_checks_total']} checks failed, {found} discrepancies in {claims} claims")
    return due


def consent_flow(store: TableStore, events: DataFrame, as_of: datetime) -> None:
    """History, profiles and, where claims exist, the shareable view."""
    if events.isEmpty():
        return
    checks = [quality.not_null("policy_id"), quality.not_null("consent_status"), quality.unique("policy_id", "event_timestamp")]
    quality.persist_results(store, "monitoring.dq_results", quality.run_checks(events, "silver.consent_current", checks), F.lit(as_of))
    store.scd2_merge("silver.consent_current", events, "policy_id", "event_timestamp")
    if store.exists("gold.claims"):
        claims = store.read("gold.claims")
        store.overwrite("gold.open_insurance_profile", consent.profiles(claims))
        current = consent.current_consents(store.read("silver.consent_current"))
        consent.shareable(current, store.read("gold.open_insurance_profile"), claims).createOrReplaceTempView("gold_shareable")


def _store_baseline(store: TableStore, champion: dict | None) -> None:
    """The table holds the features that the champion was trained on; a run that ended before writing it is made good."""
    name = "monitoring.feature_baseline"
    if not champion or store.exists(name) and store.read(name).first()["champion_run_id"] == champion["id"]:
        return
    rows = [(champion["id"], *r, datetime.fromisoformat(champion["trained_at"])) for r in champion["baseline"]]
    store.overwrite(name, store.spark.createDataFrame(rows, "champion_run_id string, feature_name string, mean double, stddev double, _computed_at timestamp"))


def training_flow(store: TableStore, registry: model.Registry, as_of: datetime, force: bool = False, **options) -> dict | None:
    """Trains where asked to, at the start or after drift, and gives the run. A better model becomes champion, and the
    features it was trained on the baseline. ``options`` go to the training."""
    _store_baseline(store, registry.champion())
    results = "monitoring.drift_results"
    bootstrap = not (store.exists("monitoring.feature_baseline") and store.exists(results))
    drifted = store.exists(results) and monitoring.latest_signal(store.read(results)).first()["drift_detected"]
    if not model.should_retrain(force, bootstrap, drifted)[0]:
        return None
    features = stored(model.training_features(store.read("gold.claims")))
    trained, metrics = model.train(features, **options)
    fit, _ = model.stratified_split(features)
    baseline = [tuple(r) for r in scoring.feature_baseline(fit).collect()]
    run = registry.record(trained, metrics | {"baseline": baseline, "trained_at": as_of.isoformat()})
    _store_baseline(store, registry.champion())
    return run


def drift_flow(store: TableStore, as_of: datetime, sink: monitoring.AlertSink, hours: int = 24, threshold: float = 2.0) -> list:
    """Features of the last hours against the baseline: appended, told to the sink where they drift, and given back.
    Without baseline or without claims in these hours there is nothing to compare."""
    if not store.exists("monitoring.feature_baseline"):
        return []
    window = monitoring.recent(store.read("gold.claims"), "event_timestamp", as_of.replace(microsecond=0), timedelta(hours=hours))
    found = scoring.drift(store.read("monitoring.feature_baseline"), scoring.feature_baseline(scoring.scored(window)), threshold)
    found = stored(found.withColumns({"window_hours": F.lit(hours), "_checked_at": F.lit(as_of)}))
    rows = found.orderBy("feature_name").collect()
    if rows:
        store.append("monitoring.drift_results", found, batch_id=f"{as_of:%Y%m%d%H%M%S%f}")
    monitoring.alert_drift([r["feature_name"] for r in rows if r["drift_detected"]], sink)
    return rows


def latency_flow(store: TableStore, as_of: datetime, sink: monitoring.AlertSink, span: timedelta = timedelta(minutes=15)) -> dict[str, bool | None]:
    """Latencies and throughput of the last minutes: appended, and told to the sink where they miss their targets."""
    bronze = monitoring.recent(store.read("bronze.claims"), "_ingested_at", as_of, span)
    gold = monitoring.recent(store.read("gold.claims"), "_scored_at", as_of, span)
    measures = {
        "kafka_to_bronze": monitoring.latency(bronze, "kafka_timestamp", "_ingested_at", monitoring.KAFKA_TO_BRONZE_SECONDS),
        "score_visible": monitoring.latency(gold, "_ingested_at", "_scored_at", monitoring.SCORE_SECONDS),
        "throughput": monitoring.throughput(monitoring.per_minute(bronze)),
    }
    reports = [monitoring.report(name, m, F.lit(as_of)) for name, m in measures.items()]
    found = stored(reports[0].unionByName(reports[1]).unionByName(reports[2]))
    store.append("monitoring.latency_results", found, batch_id=f"{as_of:%Y%m%d%H%M%S%f}")
    states = {r["metric_name"]: r["within_sla"] for r in found.collect()}
    monitoring.alert_latency(states, sink)
    return states


def review_flow(store: TableStore, as_of: datetime, sink: monitoring.AlertSink, hours: int = monitoring.REVIEW_HOURS) -> int:
    """Number of claims that wait for review too long; the sink is told."""
    n = monitoring.review_breaches(store.read("gold.claims"), as_of, hours).count()
    monitoring.alert_breaches(n, sink, hours)
    return n


def governance_flow(store: TableStore, spark: SparkSession, views: dict[str, str], groups: set[str], reader: str, admin: str) -> list[str]:
    """Registers the secured view of each table that exists (table to view); gives the views. May be repeated."""
    return [view for table, view in views.items() if governance.secured_view(store, spark, table, view, groups, reader, admin)]
