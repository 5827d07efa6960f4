"""Queries that run table mutations, streams and file sources on the test tables, with independent SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions import scalar
from claimloom.operators import bronze, health, quality, regulatory, scoring
from claimloom.plans import core_queries as core
from claimloom.plans import pipelines
from claimloom.session import ensure_checkpoint_dir, read_table, stored
from claimloom.sources import files, topics
from claimloom.store import TableStore
from claimloom.streaming import runners

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/claimloom/{uuid.uuid4().hex}"


# --- table mutation ---------------------------------------------------------------------------------------------------


@query(core.ORACLES["upsert_result"])
def store_upsert(spark, d):
    """Two batches merged into a partitioned table by key."""
    store, older_newer = TableStore(spark, _folder(spark)), core._halves(spark, d)
    for batch in older_newer:
        store.upsert("silver.claims", batch.withColumn("event_date", F.to_date("event_timestamp")), "claim_id", "event_date")
    return store.read("silver.claims").select("record_id", "claim_id")


@query(core.ORACLES["scd2_history"])
def store_scd2(spark, d):
    store = TableStore(spark, _folder(spark))
    for batch in core._consent_batches(spark, d):
        store.scd2_merge("silver.consents", batch, "policy_id", "event_timestamp")
    return store.read("silver.consents").select("policy_id", "record_id", "consent_status", "target_institution", "scope", "is_current", core._us("valid_from"), core._us("valid_to"))


_DAY = "2024-02-10"


@query(f"SELECT region, event_date, claim_count + CASE WHEN event_date = DATE '{_DAY}' THEN 1000 ELSE 0 END AS claim_count FROM ({core.ORACLES['region_agg']})")
def store_replace_partition(spark, d):
    """The aggregates of one day replaced by others, those of all other days left alone."""
    store, agg = TableStore(spark, _folder(spark)), scoring.region_aggregates(core._gold(spark, d))
    store.overwrite("gold.agg", agg, "event_date")
    day = store.read("gold.agg").filter(F.col("event_date") == F.lit(_DAY).cast("date"))
    store.replace_partition("gold.agg", stored(day.withColumn("claim_count", F.col("claim_count") + 1000)), "event_date", _DAY)
    return store.read("gold.agg").select("region", "event_date", "claim_count")


@query("SELECT record_id, claim_id, CASE WHEN record_id % 2 = 1 THEN source END AS source FROM bronze_claims")
def store_append_evolved(spark, d):
    """A batch, and one with a further column that is sent twice."""
    store, rows = TableStore(spark, _folder(spark)), core._bronze(spark, d).select("record_id", "claim_id", "source")
    even = F.col("record_id") % 2 == 0
    store.append("t", rows.filter(even).drop("source"), batch_id=0)
    for _ in range(2):
        store.append("t", rows.filter(~even), batch_id=1)
    return store.read("t")


# --- streams ----------------------------------------------------------------------------------------------------------


def _streamed(spark, d) -> tuple[TableStore, str]:
    """The claims as messages of a topic, run to their table and quarantine."""
    folder = _folder(spark)
    core._messages(spark, d).drop("_ingested_at").write.parquet(f"{folder}/topics/claim-opened")
    store = TableStore(spark, f"{folder}/tables")
    stream = spark.readStream.schema(topics.TOPIC_SCHEMA).parquet(f"{folder}/topics/claim-opened")
    runners.run_bronze(spark, stream, "claim-opened", store, "bronze.claims", f"{folder}/checkpoint", core._REQUIRED)
    return store, folder


@query(f"SELECT event_key, claim_id, policy_id, event_type, epoch_us(event_timestamp) AS event_timestamp_us, amount::DOUBLE AS amount, epoch_us(kafka_timestamp) AS kafka_timestamp_us FROM bronze_claims WHERE NOT {core._BAD}")
def stream_bronze(spark, d):
    store, _ = _streamed(spark, d)
    return store.read("bronze.claims").select("event_key", "claim_id", "policy_id", "event_type", core._us("event_timestamp"), core._num("amount", 2), core._us("kafka_timestamp"))


@query(f"SELECT event_key, epoch_us(kafka_timestamp) AS kafka_timestamp_us, '{bronze.REASON}' AS _reason FROM bronze_claims WHERE {core._BAD}")
def stream_quarantine(spark, d):
    store, _ = _streamed(spark, d)
    return store.read("bronze.claims_quarantine").select("event_key", core._us("kafka_timestamp"), "_reason")


@query(f"SELECT claim_id, count(*)::BIGINT AS copies FROM (SELECT DISTINCT claim_id FROM bronze_claims WHERE NOT {core._BAD}) GROUP BY 1")
def stream_silver(spark, d):
    """From the topic to the merged table: one row per claim."""
    store, folder = _streamed(spark, d)
    runners.run_silver(spark, store, "bronze.claims", "silver.claims", "claim_id", f"{folder}/checkpoint2")
    return store.read("silver.claims").groupBy("claim_id").agg(F.count(F.lit(1)).alias("copies"))


@query(f"SELECT region, event_date, claim_count FROM ({core.ORACLES['region_agg']}) WHERE event_date = DATE '{_DAY}'")
def region_agg_of_day(spark, d):
    """The aggregates of one run date; the filter reaches the claims."""
    gold = core._gold(spark, d).filter(F.col("event_date") == F.lit(_DAY).cast("date"))
    return scoring.region_aggregates(gold).select("region", "event_date", "claim_count")


@query("SELECT event_id::VARCHAR AS event_id, event_id % 19 <> 0 AS has_value FROM events")
def messages_without_nan(spark, d):
    """Rows as JSON messages: what is no number leaves no trace in the text."""
    value = F.when(F.col("event_id") % 19 != 0, F.col("value")).otherwise(F.lit(float("nan")))
    sent = topics.as_messages(read_table(spark, d, "events").select("event_id", value.alias("value")))
    return sent.select(F.get_json_object("value", "$.event_id").alias("event_id"), F.get_json_object("value", "$.value").isNotNull().alias("has_value"))


# --- file sources -----------------------------------------------------------------------------------------------------


@query("SELECT record_id::VARCHAR AS record_id, claim_id, region, vehicle_type FROM bronze_claims")
def delimited_source(spark, d):
    """The claims as a delimited Latin-1 file, read as text."""
    folder = _folder(spark)
    rows = core._bronze(spark, d).select("record_id", "claim_id", "region", "vehicle_type")
    rows.write.csv(folder, sep=";", encoding="ISO-8859-1", header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return files.read_delimited(spark, folder)


def _claim_file(spark, d) -> DataFrame:
    """The orders in the layout of the public claims file."""
    day = F.date_format("o_orderdate", "yyyyMMdd")
    return read_table(spark, d, "orders").select(
        F.col("o_custkey").cast("string").alias("COD_APO"), F.when(F.col("o_orderkey") % 13 == 0, "00000000").otherwise(day).alias("D_OCORR"),
        F.when(F.col("o_orderkey") % 7 == 0, "n/a").otherwise(F.col("o_orderkey").cast("string")).alias("INDENIZ"),
        F.substring("o_orderpriority", 1, 1).alias("REGIAO"), (F.col("o_orderkey") % 11).cast("string").alias("CAUSA"),
    )


_CLAIM_FILE = """(SELECT o_custkey::VARCHAR AS p, CASE WHEN o_orderkey % 13 = 0 THEN '00000000' ELSE strftime(o_orderdate, '%Y%m%d') END AS t, CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' ELSE o_orderkey::VARCHAR END AS a,
    substr(o_orderpriority, 1, 1) AS r, (o_orderkey % 11)::VARCHAR AS c, * FROM orders)"""
_CAUSES = "CASE {} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in scalar.CAUSES.items()) + f" ELSE '{scalar.OTHER_CAUSE}' END"


@query(f"""SELECT sha256('{{"policy_id":"' || p || '","event_timestamp":"' || t || '","amount":"' || a || '","region":"' || r || '","cause_code":"' || c || '"}}') AS claim_id, p AS policy_id,
    CASE WHEN o_orderkey % 13 <> 0 THEN epoch_us(o_orderdate) END AS event_timestamp_us, try_cast(a AS DOUBLE) AS amount, r AS region, {_CAUSES.format("c::INT")} AS vehicle_type FROM {_CLAIM_FILE}""")
def source_claim_events(spark, d):
    out = files.claim_events(_claim_file(spark, d))
    return out.select("claim_id", "policy_id", core._us("event_timestamp"), "amount", "region", "vehicle_type")


@query(f"""SELECT o_orderkey::VARCHAR AS policy_id, CASE WHEN o_orderkey % 80 IN {scalar.INCLUSIONS} THEN 'policy-created' WHEN o_orderkey % 80 IN {scalar.CANCELLATIONS} THEN 'policy-cancelled' ELSE 'policy-updated' END AS event_type,
    CASE WHEN o_orderkey % 13 <> 0 THEN epoch_us(date_trunc('month', o_orderdate)) END AS event_timestamp_us, o_orderstatus AS region FROM orders""")
def source_policy_events(spark, d):
    month = F.when(F.col("o_orderkey") % 13 == 0, "none").otherwise(F.date_format("o_orderdate", "yyyy-MM"))
    raw = read_table(spark, d, "orders").select(
        F.lit("op").alias("REGISTRO_OPERADORA"), F.col("o_orderkey").cast("string").alias("CD_PLANO_RPS"), month.alias("DT_INCLUSAO"),
        (F.col("o_orderkey") % 80).cast("string").alias("ID_MOTIVO_MOVIMENTO"), F.col("o_orderstatus").alias("SG_UF"),
    )
    return files.policy_events(raw).select("policy_id", "event_type", core._us("event_timestamp"), "region")


@query("SELECT record_id, 'R$ ' || translate(format('{:,.2f}', amount), ',.', '.,') AS amount FROM (SELECT record_id, amount::DOUBLE AS amount FROM bronze_claims)")
def currency_format(spark, d):
    return core._bronze(spark, d).select("record_id", scalar.currency_ptbr(F.col("amount").cast("double")).alias("amount"))


@query(f"SELECT record_id, {_CAUSES.format('code')} AS cause FROM (SELECT record_id, CASE WHEN regexp_full_match(CAUSE_CD, '\\s*[+-]?[0-9]+\\s*') THEN try_cast(CAUSE_CD AS INT) END AS code FROM regulatory_claims_raw)")
def decode_reported_cause(spark, d):
    return read_table(spark, d, "regulatory_claims_raw").select("record_id", scalar.decode_cause(F.col("CAUSE_CD")).alias("cause"))


# --- checks and states ------------------------------------------------------------------------------------------------


@query(f"""SELECT 'freshness:_ingested_at' AS check_name, 'bronze.claims' AS table_name, (max(epoch_us(_ingested_at)) < {core._AS_OF_US} - 86400000000)::BIGINT AS failed_rows FROM bronze_claims
    UNION ALL SELECT 'freshness:_ingested_at', 'silver.consents', (max(epoch_us(_ingested_at)) < {core._AS_OF_US} - 86400000000)::BIGINT FROM consent_events""")
def freshness_checks(spark, d):
    day = core.timedelta(days=1)
    tables = (("bronze.claims", "bronze_claims"), ("silver.consents", "consent_events"))
    found = [quality.run_checks(read_table(spark, d, t), name, [quality.fresh("_ingested_at", day, core.AS_OF)]) for name, t in tables]
    return found[0].unionByName(found[1]).drop("passed")


@query(f"""SELECT 'allowed_values:region' AS check_name, 'silver.regulatory_claims' AS table_name, count(*) AS failed_rows, count(*) = 0 AS passed FROM {core._REG}
    WHERE region IS NOT NULL AND region NOT IN ({core.ORACLES["region_allowlist"]})""")
def region_check(spark, d):
    silver = core._regulatory_silver(spark, d)
    return quality.allowed_by(silver, "silver.regulatory_claims", "region", regulatory.trusted_regions(silver))


@query(f"""SELECT source, CASE WHEN latest IS NULL THEN 'unknown' WHEN {core._AS_OF_US} - latest < 172800000000 THEN 'green' ELSE 'red' END AS freshness,
    CASE WHEN n >= 100 THEN 'red' WHEN n >= 10 THEN 'yellow' ELSE 'green' END AS malformed, CASE WHEN within IS NULL THEN 'unknown' WHEN within THEN 'green' ELSE 'red' END AS latency
    FROM (SELECT source, max(epoch_us(_ingested_at)) AS latest, count(*) FILTER (event_timestamp IS NULL OR policy_id IS NULL) AS n, max(epoch_us(_ingested_at) - epoch_us(kafka_timestamp)) <= 120000000 AS within FROM bronze_claims GROUP BY 1)""")
def health_states(spark, d):
    """Traffic lights of each source: freshness, malformed rows and latency."""
    late = F.max(F.unix_micros("_ingested_at") - F.unix_micros("kafka_timestamp")) <= 120_000_000
    bad = F.count_if(F.col("event_timestamp").isNull() | F.col("policy_id").isNull())
    rows = core._bronze(spark, d).groupBy("source").agg(F.max("_ingested_at").alias("latest"), bad.alias("n"), late.alias("within"))
    return rows.select(
        "source", health.freshness_column(F.col("latest"), core.AS_OF, core.timedelta(days=2)).alias("freshness"), health.count_column(F.col("n"), 10, 100).alias("malformed"),
        health.target_column(F.col("within")).alias("latency"),
    )


@query(f"SELECT CASE WHEN count(*) = 0 THEN 'unknown' WHEN bool_or(drift_detected) THEN 'yellow' ELSE 'green' END AS state FROM ({core.ORACLES['model_drift']})")
def drift_health(spark, d):
    return core._drift(spark, d).agg(health.drift_column(F.col("drift_detected")).alias("state"))


# --- flows ------------------------------------------------------------------------------------------------------------


class _Silent:
    def send(self, text: str) -> None:
        pass


@query(f"SELECT claim_id, count(*)::BIGINT AS copies FROM (SELECT DISTINCT claim_id FROM bronze_claims WHERE NOT {core._BAD}) GROUP BY 1")
def stream_gold(spark, d):
    """From the topic over the merged table's changes to the scores: one row per claim."""
    store, folder = _streamed(spark, d)
    runners.run_silver(spark, store, "bronze.claims", "silver.claims", "claim_id", f"{folder}/checkpoint2")
    runners.run_scoring(spark, store, "silver.claims", "gold.claims", f"{folder}/checkpoint3")
    return store.read("gold.claims").filter(F.col("fraud_score").between(0, 1)).groupBy("claim_id").agg(F.count(F.lit(1)).alias("copies"))


@query("""SELECT policy_id, consent_status, target_institution, epoch_us(event_timestamp) AS valid_from_us
    FROM (SELECT *, row_number() OVER (PARTITION BY policy_id ORDER BY event_timestamp DESC, record_id DESC) AS rn FROM consent_events) WHERE rn = 1""")
def flow_consents(spark, d):
    """The consent flow over one batch: the newest row of each policy is current."""
    store, events = TableStore(spark, _folder(spark)), read_table(spark, d, "consent_events").drop("kafka_timestamp", "_ingested_at")
    pipelines.consent_flow(store, events, core.AS_OF)
    return store.read("silver.consent_current").filter("is_current").select("policy_id", "consent_status", "target_institution", core._us("valid_from"))


@query(f"SELECT *, compliance_issues = '' AS susep_compliant FROM {core._EXPORT}")
def flow_regulatory(spark, d):
    """The regulatory flow from raw reports to the export."""
    store = TableStore(spark, _folder(spark))
    pipelines.regulatory_flow(store, read_table(spark, d, "regulatory_claims_raw"), core.AS_OF)
    far = F.when(F.length("D_OCORR") > 8, "far").otherwise(F.col("D_OCORR"))
    return store.read("gold.regulatory_claims").withColumns({"INDENIZ": F.round("INDENIZ", 2), "D_OCORR": far})


_WINDOW_US = f"{core._AS_OF_US} - 60 * {core._DAY_US}"
_WINDOWED = core._SCORED.replace(core._SILVER, f"(SELECT * FROM {core._SILVER} WHERE epoch_us(event_timestamp) >= {_WINDOW_US})")


@query(" UNION ALL ".join(
    f"SELECT '{f}' AS feature_name, round(abs(avg({f}) - 0.5) / 0.25, 6) AS drift_ratio, abs(avg({f}) - 0.5) / 0.25 > 2.0 AS drift_detected, 1440 AS window_hours FROM {_WINDOWED}" for f in scoring.FEATURES
))
def flow_drift(spark, d):
    """The drift flow over the claims of 60 days, whose features are computed anew, against a given baseline."""
    store = TableStore(spark, _folder(spark))
    store.overwrite("gold.claims", core._gold(spark, d))
    baseline = spark.createDataFrame([("r", f, 0.5, 0.25, core.AS_OF) for f in scoring.FEATURES], "champion_run_id string, feature_name string, mean double, stddev double, _computed_at timestamp")
    store.overwrite("monitoring.feature_baseline", baseline)
    pipelines.drift_flow(store, core.AS_OF, _Silent(), hours=60 * 24)
    return store.read("monitoring.drift_results").select("feature_name", core._num("drift_ratio"), "drift_detected", "window_hours")


def _seconds_sql(metric: str, source: str, seconds: str, bound: int, at: str) -> str:
    return f"SELECT '{metric}' AS metric_name, count(*) AS sample_size, max({seconds}) AS max_seconds, CASE WHEN count(*) > 0 THEN max({seconds}) <= {bound} END AS within_sla FROM {source} WHERE {at} >= {_WINDOW_US}"


@query(
    _seconds_sql("kafka_to_bronze", "bronze_claims", "epoch_us(_ingested_at) // 1000000 - epoch_us(kafka_timestamp) // 1000000", 120, "epoch_us(_ingested_at)")
    + " UNION ALL " + _seconds_sql("score_visible", core._GOLD, "scored_us // 1000000 - epoch_us(_ingested_at) // 1000000", 420, "scored_us")
    + f" UNION ALL SELECT 'throughput', NULL, NULL, CASE WHEN count(*) > 0 THEN count(*) FILTER (n < 80) = 0 END FROM (SELECT count(*) AS n FROM bronze_claims WHERE epoch_us(_ingested_at) >= {_WINDOW_US} GROUP BY epoch_us(_ingested_at) // 60000000)"
)
def flow_latency(spark, d):
    """The latency flow over 60 days, as it is appended to the table of reports."""
    store = TableStore(spark, _folder(spark))
    store.overwrite("bronze.claims", core._bronze(spark, d))
    store.overwrite("gold.claims", core._gold(spark, d))
    pipelines.latency_flow(store, core.AS_OF, _Silent(), core.timedelta(days=60))
    details = [F.get_json_object("details_json", f"$.{n}").cast("long").alias(n) for n in ("sample_size", "max_seconds")]
    return store.read("monitoring.latency_results").select("metric_name", *details, "within_sla")
