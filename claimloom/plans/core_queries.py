"""Queries over the claim, regulatory, consent and monitoring operators, with independent SQL.

Instants leave as microseconds since 1970 and decimals as doubles, so that both engines compare them alike.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom import store
from claimloom.functions import scalar
from claimloom.operators import bronze, consent, governance, health, model, monitoring, quality, regulatory, scoring
from claimloom.plans import sql_catalog as sc
from claimloom.schemas import CLAIM
from claimloom.session import read_table, stored

#: Stands for the current time: all claims have arrived by then.
AS_OF = datetime(2024, 4, 21)
_AS_OF_US = 1713657600 * 1_000_000
_DAY_US = 86_400_000_000
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _us(c: str):
    return F.unix_micros(c).alias(f"{c}_us")


def _num(c: str, digits: int = 6):
    return F.round(F.col(c).cast("double"), digits).alias(c)


# --- inputs -------------------------------------------------------------------------------------------------------------


def _bronze(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "bronze_claims")


def _silver(spark: SparkSession, d: str) -> DataFrame:
    return bronze.latest_per_key(_bronze(spark, d), "claim_id", ["_ingested_at"])


def _gold(spark: SparkSession, d: str, shadow: bool = False) -> DataFrame:
    """Scored claims, as of a score written up to 500 s after ingestion. ``shadow`` puts a stand-in for a model score."""
    scored_at = F.timestamp_micros(F.unix_micros("_ingested_at") + F.col("record_id") % 500 * 1_000_000)
    stand_in = (lambda night, often, far: (night + often + far) / 3.0) if shadow else None
    return scoring.claims_gold(_silver(spark, d), scored_at, stand_in)


def _regulatory_silver(spark: SparkSession, d: str) -> DataFrame:
    return regulatory.standardized(read_table(spark, d, "regulatory_claims_raw"))


_SILVER = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY _ingested_at DESC, record_id DESC) AS rn FROM bronze_claims) WHERE rn = 1)"
_FEATURES = f"""(SELECT *, CASE WHEN (epoch_us(event_timestamp) // 3600000000) % 24 >= 22 OR (epoch_us(event_timestamp) // 3600000000) % 24 < 6 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS night_claim,
    least(claims_last_24h / 3.0::DOUBLE, 1.0::DOUBLE) AS high_frequency,
    coalesce(least(greatest((amount::DOUBLE - m) / greatest(s, 1.0::DOUBLE) / 3.0::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE), 0.0::DOUBLE) AS amount_outlier
  FROM (SELECT *, count(claim_id) OVER (PARTITION BY customer_id ORDER BY epoch_us(event_timestamp) // 1000000 RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS claims_last_24h,
      avg(amount::DOUBLE) OVER (PARTITION BY region) AS m, stddev_samp(amount::DOUBLE) OVER (PARTITION BY region) AS s FROM {_SILVER}))"""
_SCORED = f"(SELECT *, 0.0::DOUBLE + 0.25::DOUBLE * night_claim + 0.35::DOUBLE * high_frequency + 0.4::DOUBLE * amount_outlier AS fraud_score FROM {_FEATURES})"
_GOLD = f"""(SELECT *, fraud_score >= 0.7 AS fraud_flag, (amount::DOUBLE <= 5000 AND fraud_score < 0.7) AS auto_approved,
    DATE '1970-01-01' + (epoch_us(event_timestamp) // {_DAY_US})::INT AS event_date, epoch_us(_ingested_at) + record_id % 500 * 1000000 AS scored_us,
    (night_claim + high_frequency + amount_outlier) / 3.0::DOUBLE AS stand_in FROM {_SCORED})"""

# --- bronze -------------------------------------------------------------------------------------------------------------


def _messages(spark: SparkSession, d: str) -> DataFrame:
    """The claims as topic messages; every 13th is no JSON, every 17th lacks its type."""
    rows = _bronze(spark, d)
    fields = [F.when(F.col("record_id") % 17 != 0, F.col("event_type")).alias("event_type") if c == "event_type" else F.col(c) for c in CLAIM.names]
    body = F.to_json(F.struct(*fields), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    return rows.select(
        F.col("event_key").alias("key"), F.when(F.col("record_id") % 13 == 0, "not json").otherwise(body).alias("value"), F.col("kafka_timestamp").alias("timestamp"),
        (F.col("record_id") % 6).cast("int").alias("partition"), F.floor(F.col("record_id") / 6).alias("offset"), "_ingested_at",
    )


_REQUIRED = ["event_type", "event_timestamp"]
_BAD = "(record_id % 13 = 0 OR record_id % 17 = 0 OR event_timestamp IS NULL)"


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return bronze.parse_events(_messages(spark, d), CLAIM, F.col("_ingested_at"))


@query(f"SELECT event_key, claim_id, policy_id, event_type, epoch_us(event_timestamp) AS event_timestamp_us, amount::DOUBLE AS amount, region, vehicle_type, source, _ingested_date FROM (SELECT * REPLACE (DATE '1970-01-01' + (epoch_us(_ingested_at) // {_DAY_US})::INT AS _ingested_date) FROM bronze_claims) WHERE NOT {_BAD}")
def bronze_parse_valid(spark, d):
    valid = bronze.valid_rows(_parsed(spark, d), _REQUIRED)
    return valid.select("event_key", "claim_id", "policy_id", "event_type", _us("event_timestamp"), _num("amount", 2), "region", "vehicle_type", "source", "_ingested_date")


@query(f"SELECT event_key, epoch_us(kafka_timestamp) AS kafka_timestamp_us, record_id % 13 = 0 AS no_json, '{bronze.REASON}' AS _reason FROM bronze_claims WHERE {_BAD}")
def bronze_quarantine_split(spark, d):
    bad = bronze.quarantined_rows(_parsed(spark, d), _REQUIRED)
    return bad.select("event_key", _us("kafka_timestamp"), (F.col("raw_value") == "not json").alias("no_json"), "_reason")


@query('SELECT (record_id % 6)::INT AS "partition", max(record_id // 6) AS max_offset FROM bronze_claims GROUP BY 1')
def bronze_max_offsets(spark, d):
    return bronze.max_offsets(_parsed(spark, d))


@query(f"SELECT count(*) FILTER (NOT {_BAD}) AS valid_count, count(*) FILTER ({_BAD}) AS quarantine_count, round(count(*) FILTER ({_BAD}) * 100.0 / count(*), 6)::DOUBLE AS quarantine_pct FROM bronze_claims")
def quarantine_rate(spark, d):
    return bronze.quarantine_rate(_parsed(spark, d), _REQUIRED).select("valid_count", "quarantine_count", _num("quarantine_pct"))


# --- silver, scores, gold ---------------------------------------------------------------------------------------------


@query(f"SELECT record_id, claim_id, event_type, epoch_us(_ingested_at) AS _ingested_at_us FROM {_SILVER}")
def silver_dedup(spark, d):
    return _silver(spark, d).select("record_id", "claim_id", "event_type", _us("_ingested_at"))


@query(f"SELECT record_id, night_claim FROM {_FEATURES}")
def night_feature(spark, d):
    return _silver(spark, d).select("record_id", scoring.night_claim(F.col("event_timestamp")).alias("night_claim"))


@query(f"SELECT record_id, claims_last_24h, round(high_frequency, 6) AS high_frequency FROM {_FEATURES}")
def frequency_feature(spark, d):
    counted = scoring.with_recent_count(_silver(spark, d))
    return counted.select("record_id", "claims_last_24h", F.round(F.least(F.col("claims_last_24h") / 3.0, F.lit(1.0)), 6).alias("high_frequency"))


@query(f"SELECT record_id, round(amount_outlier, 6) AS amount_outlier FROM {_FEATURES}")
def amount_outlier_feature(spark, d):
    return scoring.with_group_statistics(_silver(spark, d)).select("record_id", F.round(scoring.amount_outlier(F.col("amount")), 6).alias("amount_outlier"))


@query(f"SELECT record_id, claim_id, round(fraud_score, 6) AS fraud_score, fraud_score >= 0.7 AS fraud_flag FROM {_SCORED}")
def fraud_score(spark, d):
    return scoring.scored(_silver(spark, d)).select("record_id", "claim_id", _num("fraud_score"), "fraud_flag")


@query(f"SELECT record_id, auto_approved FROM {_GOLD}")
def auto_approval(spark, d):
    return scoring.scored(_silver(spark, d)).select("record_id", scoring.approved(5000.0).alias("auto_approved"))


@query(f"""SELECT claim_id, policy_id, customer_id, event_type, epoch_us(event_timestamp) AS event_timestamp_us, amount::DOUBLE AS amount, region, vehicle_type,
    round(fraud_score, 6) AS fraud_score, fraud_flag, auto_approved, event_date, scored_us AS _scored_at_us FROM {_GOLD}""")
def claims_gold(spark, d):
    return _gold(spark, d).select(
        "claim_id", "policy_id", "customer_id", "event_type", _us("event_timestamp"), _num("amount", 2), "region", "vehicle_type", _num("fraud_score"),
        "fraud_flag", "auto_approved", "event_date", _us("_scored_at"),
    )


@query(f"""SELECT region, event_date, count(claim_id) AS claim_count, sum(amount)::DOUBLE / count(amount) AS avg_claim_amount,
    count(*) FILTER (fraud_flag) AS flagged_fraud_count, count(*) FILTER (auto_approved) AS auto_approved_count FROM {_GOLD} GROUP BY region, event_date""")
def region_agg(spark, d):
    return scoring.region_aggregates(_gold(spark, d)).select("region", "event_date", "claim_count", "avg_claim_amount", "flagged_fraud_count", "auto_approved_count")


@query(f"SELECT record_id, round(night_claim, 6) AS night_claim, round(high_frequency, 6) AS high_frequency, round(amount_outlier, 6) AS amount_outlier, (fraud_score >= 0.7)::INT AS label FROM {_SCORED}")
def training_features(spark, d):
    out = scoring.scored(_silver(spark, d))
    return out.select("record_id", *[_num(f) for f in scoring.FEATURES], F.col("fraud_flag").cast("int").alias("label"))


@query(f"SELECT round(avg(night_claim), 6) AS night_claim, round(avg(high_frequency), 6) AS high_frequency, round(avg(amount_outlier), 6) AS amount_outlier FROM {_SCORED} WHERE epoch_us(event_timestamp) >= {_AS_OF_US} - 30 * {_DAY_US}")
def feature_means(spark, d):
    recent = monitoring.recent(scoring.scored(_silver(spark, d)), "event_timestamp", AS_OF, timedelta(days=30))
    return scoring.feature_means(recent).select(*[_num(f) for f in scoring.FEATURES])


def _stats(where: str) -> str:
    return " UNION ALL ".join(f"SELECT '{f}' AS feature_name, avg({f}) AS mean, stddev_samp({f}) AS stddev FROM {_SCORED} WHERE {where}" for f in scoring.FEATURES)


@query(f"SELECT feature_name, round(mean, 6) AS mean, round(stddev, 6) AS stddev FROM ({_stats('true')})")
def feature_baseline(spark, d):
    return scoring.feature_baseline(scoring.scored(_silver(spark, d))).select("feature_name", _num("mean"), _num("stddev"))


_SPLIT = datetime(2024, 3, 1)
_SPLIT_US = 1709251200 * 1_000_000
_DRIFT = f"""(SELECT b.feature_name, b.mean AS baseline_mean, b.stddev AS baseline_stddev, c.mean AS current_mean, abs(c.mean - b.mean) / greatest(coalesce(b.stddev, 0), 0.05) AS drift_ratio
    FROM ({_stats(f"epoch_us(event_timestamp) < {_SPLIT_US}")}) b JOIN ({_stats(f"epoch_us(event_timestamp) >= {_SPLIT_US}")}) c USING (feature_name))"""


def _drift(spark, d):
    scored = scoring.scored(_silver(spark, d))
    older, newer = (scoring.feature_baseline(scored.filter(c)) for c in (F.col("event_timestamp") < F.lit(_SPLIT), F.col("event_timestamp") >= F.lit(_SPLIT)))
    return scoring.drift(older, newer)


@query(f"SELECT feature_name, round(baseline_mean, 6) AS baseline_mean, round(current_mean, 6) AS current_mean, round(drift_ratio, 6) AS drift_ratio, drift_ratio > 2.0 AS drift_detected FROM {_DRIFT}")
def model_drift(spark, d):
    return _drift(spark, d).select("feature_name", _num("baseline_mean"), _num("current_mean"), _num("drift_ratio"), "drift_detected")


@query(f"SELECT coalesce(bool_or(drift_ratio > 2.0), false) AS drift_detected FROM {_DRIFT}")
def latest_drift_signal(spark, d):
    old = _drift(spark, d).select(F.lit(True).alias("drift_detected"), F.lit(_SPLIT).alias("_checked_at"))
    return monitoring.latest_signal(_drift(spark, d).select("drift_detected", F.lit(AS_OF).alias("_checked_at")).unionByName(old))


@query(f"SELECT feature_name, round(drift_ratio, 6) AS drift_ratio FROM {_DRIFT}")
def latest_drift_ratio(spark, d):
    return _drift(spark, d).select("feature_name", _num("drift_ratio"))


@query()
def shadow_scores(spark, d):
    """Scores of a forest trained on these claims; not comparable with SQL."""
    scored = scoring.scored(_silver(spark, d)).select("record_id", "claim_id", *scoring.FEATURES, F.col("fraud_flag").cast("int").alias("label"))
    scored = stored(scored)  # training reads it many times
    trained, _ = model.train(scored.drop("record_id"))
    return model.with_shadow_score(scored, trained).select("record_id", "model_fraud_score")


# --- quality ----------------------------------------------------------------------------------------------------------


def _check_list():
    return [quality.not_null("claim_id"), quality.not_null("customer_id"), quality.unique("claim_id"), quality.in_range("amount", 0, 100_000), quality.allowed("region", _REGIONS)]


_REGIONS = ("SP", "RJ", "MG", "BA", "RS", "PR", "SC", "PE", "CE", "GO", "DF", "AM")


def _dq(spark, d):
    claims = quality.run_checks(_bronze(spark, d), "bronze.claims", _check_list())
    reg = quality.run_checks(_regulatory_silver(spark, d), "silver.regulatory_claims", [quality.not_null("policy_id"), quality.not_null("amount"), quality.allowed("cause_code", regulatory.VALID_CAUSES)])
    return claims.unionByName(reg)


def _count_sql(table: str, source: str, checks: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS check_name, '{table}' AS table_name, ({e})::BIGINT AS failed_rows FROM {source}" for n, e in checks.items())


def _reg_sql(source: str) -> str:
    """One insurer's rows in the common layout, from the definitions of its fields."""
    whole = lambda c: f"CASE WHEN regexp_full_match({c}, '\\s*[+-]?[0-9]+\\s*') THEN try_cast({c} AS INT) END"
    number = lambda c: f"CASE WHEN isnan(try_cast({c} AS DOUBLE)) THEN NULL ELSE trunc(try_cast({c} AS DOUBLE)) END"
    fields = {
        "insurer_a": (
            "numero_apolice", "CASE WHEN regexp_full_match(data_ocorrencia, '[0-9]{2}/[0-9]{2}/[0-9]{4}') THEN epoch(try_strptime(data_ocorrencia, '%d/%m/%Y')) END",
            "try_cast(replace(regexp_replace(valor_indenizacao, 'R\\$\\s*|\\.', '', 'g'), ',', '.') AS DECIMAL(18, 2))", "regiao_sinistro", whole("codigo_causa"),
        ),
        "insurer_b": (
            "POLICY_NUM", "CASE WHEN regexp_full_match(EVENT_DATE, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN epoch(try_strptime(EVENT_DATE, '%Y-%m-%d')) END",
            "try_cast(CLAIM_AMOUNT AS DECIMAL(18, 2))", "REGION_CODE", whole("CAUSE_CD"),
        ),
        "insurer_c": ("policyId", f"floor({number('occurrenceDate')} / 1000)", f"({number('amountCents')} / 100)::DECIMAL(18, 2)", "regionCode", whole("causeCode")),
    }[source]
    policy, at, amount, region, cause = fields
    return f"""SELECT record_id, external_reference_id, source_system, {policy} AS policy_id, ({at})::BIGINT AS event_s, {amount} AS amount, {region} AS region, {cause} AS cause_code
      FROM regulatory_claims_raw WHERE source_system = '{source}'"""


_REG = "(" + " UNION ALL ".join(_reg_sql(s) for s in regulatory.LAYOUTS) + ")"
_CAUSES = ", ".join(map(str, regulatory.VALID_CAUSES))
_DQ = "({} UNION ALL {})".format(
    _count_sql("bronze.claims", "bronze_claims", {
        "not_null:claim_id": "count(*) FILTER (claim_id IS NULL)", "not_null:customer_id": "count(*) FILTER (customer_id IS NULL)",
        "unique:claim_id": "count(*) - count(DISTINCT claim_id)", "range:amount": "count(*) FILTER (amount < 0 OR amount > 100000)",
        "allowed_values:region": "count(*) FILTER (region NOT IN ('" + "', '".join(_REGIONS) + "'))",
    }),
    _count_sql("silver.regulatory_claims", _REG, {
        "not_null:policy_id": "count(*) FILTER (policy_id IS NULL)", "not_null:amount": "count(*) FILTER (amount IS NULL)",
        "allowed_values:cause_code": f"count(*) FILTER (cause_code NOT IN ({_CAUSES}))",
    }),
)


@query(f"SELECT check_name, table_name, failed_rows, failed_rows = 0 AS passed FROM {_DQ}")
def dq_checks(spark, d):
    return _dq(spark, d)


@query(f"SELECT split_part(table_name, '.', 1) AS layer, count(*) FILTER (failed_rows = 0) AS passed_checks, count(*) AS checks, round(count(*) FILTER (failed_rows = 0) / count(*), 6) AS pass_rate FROM {_DQ} GROUP BY 1")
def dq_pass_rate_by_layer(spark, d):
    return quality.pass_rate_by_layer(_dq(spark, d)).select("layer", "passed_checks", "checks", _num("pass_rate"))


# --- regulatory -------------------------------------------------------------------------------------------------------


def _standard(df: DataFrame) -> DataFrame:
    return df.select("external_reference_id", "source_system", "policy_id", F.unix_seconds("event_timestamp").alias("event_s"), _num("amount", 2), "region", "cause_code")


_COMMON = "external_reference_id, source_system, policy_id, event_s, amount::DOUBLE AS amount, region, cause_code"


def _one_source(name: str):
    def run(spark, d):
        return _standard(regulatory.standardized_source(read_table(spark, d, "regulatory_claims_raw"), name))

    run.__name__ = f"std_{name}"
    return query(f"SELECT {_COMMON} FROM ({_reg_sql(name)})")(run)


for _name in regulatory.LAYOUTS:
    _one_source(_name)


@query(f"SELECT {_COMMON} FROM {_REG}")
def standardize_union(spark, d):
    return _standard(_regulatory_silver(spark, d))


@query(f"SELECT DISTINCT region FROM (SELECT region FROM {_REG} WHERE region IS NOT NULL GROUP BY external_reference_id, region HAVING count(*) >= 2)")
def region_allowlist(spark, d):
    return regulatory.trusted_regions(_regulatory_silver(spark, d))


_PER_CLAIM = f"""(SELECT external_reference_id, list_sort(list_distinct(list(source_system))) AS sources, count(amount) AS n, coalesce(min(amount::DOUBLE), 0) AS lo,
    coalesce(max(amount::DOUBLE), 0) AS hi, coalesce(median(amount::DOUBLE), 0) AS mid FROM {_REG} GROUP BY external_reference_id)"""
_IS_MISMATCH = "n > 0 AND hi - lo > greatest(lo * 0.02, 5.0)"
_IS_MISSING = "len(sources) < 3"
_RECON = f"(SELECT *, 'amount_mismatch' AS kind FROM {_PER_CLAIM} WHERE {_IS_MISMATCH} UNION ALL SELECT *, 'missing_in_source' FROM {_PER_CLAIM} WHERE {_IS_MISSING})"


def _recon_query(kind: str, name: str):
    def run(spark, d):
        found = regulatory.reconciled(_regulatory_silver(spark, d)).filter(F.col("discrepancy_type") == kind)
        return found.select("external_reference_id", F.array_join("sources_reporting", ",").alias("sources"), _num("min_amount"), _num("max_amount"), _num("resolved_amount"))

    run.__name__ = name
    return query(f"SELECT external_reference_id, array_to_string(sources, ',') AS sources, round(lo, 6) AS min_amount, round(hi, 6) AS max_amount, round(mid, 6) AS resolved_amount FROM {_RECON} WHERE kind = '{kind}'")(run)


_recon_query("amount_mismatch", "reconcile_mismatch")
_recon_query("missing_in_source", "reconcile_missing")


def _first(c: str) -> str:
    return f"arg_min({c}, (source_system, {c})) FILTER ({c} IS NOT NULL)"


_BASE = f"""(SELECT external_reference_id, {_first("policy_id")} AS COD_APO, strftime(make_timestamp(({_first("event_s")}) * 1000000), '%Y%m%d') AS D_OCORR,
    quantile_disc(amount::DOUBLE, 0.5) AS INDENIZ, {_first("region")} AS REGIAO, {_first("cause_code")} AS CAUSA, {_first("event_s")} AS at_s FROM {_REG} GROUP BY external_reference_id)"""


@query(f"SELECT external_reference_id, COD_APO, INDENIZ, REGIAO, CAUSA, at_s FROM {_BASE}")
def susep_base(spark, d):
    return regulatory.claim_base(_regulatory_silver(spark, d)).select("external_reference_id", "COD_APO", _num("INDENIZ", 2), "REGIAO", "CAUSA", F.unix_seconds("_at").alias("at_s"))


_EXPORT = f"""(SELECT COD_APO, CASE WHEN at_s >= 253402300800 THEN 'far' ELSE D_OCORR END AS D_OCORR, INDENIZ, REGIAO, CAUSA, concat_ws(',', CASE WHEN COD_APO IS NULL THEN 'policy_id_ausente' END, CASE WHEN at_s IS NULL THEN 'data_ausente' END,
    CASE WHEN INDENIZ IS NULL THEN 'valor_ausente' END, CASE WHEN CAUSA NOT IN ({_CAUSES}) THEN 'causa_invalida' END, 'reconciliacao:' || kinds) AS compliance_issues
  FROM {_BASE} LEFT JOIN (SELECT external_reference_id AS r, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM {_RECON} GROUP BY 1) ON external_reference_id = r)"""


def _export(spark, d):
    silver = _regulatory_silver(spark, d)
    return regulatory.export_claims(silver, regulatory.reconciled(silver)).withColumn("INDENIZ", F.round("INDENIZ", 2)).withColumn("D_OCORR", F.when(F.length("D_OCORR") > 8, "far").otherwise(F.col("D_OCORR")))


@query(f"SELECT *, compliance_issues = '' AS susep_compliant FROM {_EXPORT}")
def susep_claims(spark, d):
    return _export(spark, d)


@query(f"""SELECT (SELECT count(*) FROM {_DQ}) AS dq_checks_total, (SELECT count(*) FROM {_DQ} WHERE failed_rows > 0) AS dq_checks_failed,
    (SELECT count(*) FROM {_RECON} WHERE kind = 'amount_mismatch') AS amount_mismatch_count, (SELECT count(*) FROM {_RECON} WHERE kind = 'missing_in_source') AS missing_in_source_count""")
def dq_summary(spark, d):
    return quality.dq_summary(_dq(spark, d), regulatory.reconciled(_regulatory_silver(spark, d)))


@query(f"SELECT CASE WHEN share >= 0.95 THEN 'green' WHEN share >= 0.8 THEN 'yellow' ELSE 'red' END AS status, compliant, total FROM (SELECT count(*) FILTER (compliance_issues = '') / count(*) AS share, count(*) FILTER (compliance_issues = '') AS compliant, count(*) AS total FROM {_EXPORT})")
def compliance_status(spark, d):
    n = _export(spark, d).agg(F.count_if("susep_compliant").alias("compliant"), F.count(F.lit(1)).alias("total"))
    return n.select(health.compliance_column(F.col("compliant"), F.col("total")).alias("status"), "compliant", "total")


@query("SELECT record_id, substr(sha256(policy_id || '|' || event_type || '|' || region || '|' || vehicle_type || '|' || source), 1, 24) AS external_reference_id FROM bronze_claims")
def external_reference_id(spark, d):
    return _bronze(spark, d).select("record_id", scalar.natural_key(*map(F.col, ("policy_id", "event_type", "region", "vehicle_type", "source"))).alias("external_reference_id"))


@query("SELECT record_id, CASE record_id % 11 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in scalar.CAUSES.items()) + " ELSE 'outros' END AS cause FROM bronze_claims")
def decode_cause(spark, d):
    return _bronze(spark, d).select("record_id", scalar.decode_cause(F.col("record_id") % 11).alias("cause"))


@query(f"SELECT record_id, CASE WHEN record_id % 80 IN {scalar.INCLUSIONS} THEN 'policy-created' WHEN record_id % 80 IN {scalar.CANCELLATIONS} THEN 'policy-cancelled' ELSE 'policy-updated' END AS event FROM bronze_claims")
def infer_event_type(spark, d):
    return _bronze(spark, d).select("record_id", scalar.movement_event(F.col("record_id") % 80).alias("event"))


# --- table mutation and consent ---------------------------------------------------------------------------------------


def _halves(spark, d):
    rows = _bronze(spark, d)
    older = F.col("_ingested_at") < F.lit(_SPLIT)
    return [bronze.latest_per_key(rows.filter(c), "claim_id", ["_ingested_at"]) for c in (older, ~older)]


_HALF = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY _ingested_at DESC, record_id DESC) AS rn FROM bronze_claims WHERE epoch_us(_ingested_at) {} {}) WHERE rn = 1)"
_OLD, _NEW = _HALF.format("<", _SPLIT_US), _HALF.format(">=", _SPLIT_US)


@query(f"SELECT record_id, claim_id FROM {_NEW} UNION ALL SELECT record_id, claim_id FROM {_OLD} WHERE claim_id NOT IN (SELECT claim_id FROM {_NEW})")
def upsert_result(spark, d):
    return store.upserted(*_halves(spark, d), "claim_id").select("record_id", "claim_id")


def _consent_batches(spark, d):
    """The events as two batches that overlap in time: those of even and of odd record numbers."""
    events = read_table(spark, d, "consent_events").drop("kafka_timestamp", "_ingested_at")
    even = F.col("record_id") % 2 == 0
    return events.filter(even), events.filter(~even)


def _history(spark, d):
    return consent.consent_history(*_consent_batches(spark, d))


def _latest_sql(odd: int) -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY policy_id ORDER BY event_timestamp DESC, record_id DESC) AS rn FROM consent_events WHERE record_id % 2 = {odd}) WHERE rn = 1)"


_T, _S = _latest_sql(0), _latest_sql(1)
_HISTORY = f"""(SELECT t.policy_id, t.record_id, t.consent_status, t.target_institution, t.scope, coalesce(s.event_timestamp > t.event_timestamp, false) IS FALSE AS is_current,
      epoch_us(t.event_timestamp) AS valid_from_us, CASE WHEN s.event_timestamp > t.event_timestamp THEN epoch_us(s.event_timestamp) END AS valid_to_us
    FROM {_T} t LEFT JOIN {_S} s USING (policy_id)
  UNION ALL SELECT s.policy_id, s.record_id, s.consent_status, s.target_institution, s.scope, true, epoch_us(s.event_timestamp), NULL
    FROM {_S} s LEFT JOIN {_T} t USING (policy_id) WHERE t.policy_id IS NULL OR t.event_timestamp < s.event_timestamp)"""


@query("SELECT policy_id, record_id FROM (SELECT *, row_number() OVER (PARTITION BY policy_id ORDER BY event_timestamp DESC, record_id DESC) AS rn FROM consent_events) WHERE rn = 1")
def scd2_latest(spark, d):
    events = read_table(spark, d, "consent_events").drop("kafka_timestamp", "_ingested_at")
    return store.scd2_latest(events, "policy_id", "event_timestamp").select("policy_id", "record_id")


def _target_and_latest(spark, d):
    first, second = _consent_batches(spark, d)
    return store.scd2_merged(None, first, "policy_id", "event_timestamp"), store.scd2_latest(second, "policy_id", "event_timestamp")


@query(f"SELECT policy_id FROM {_T} t JOIN {_S} s USING (policy_id) WHERE t.event_timestamp >= s.event_timestamp")
def scd2_blockers(spark, d):
    return store.scd2_blockers(*_target_and_latest(spark, d), "policy_id", "event_timestamp")


@query(f"SELECT s.policy_id, s.record_id FROM {_S} s LEFT JOIN {_T} t USING (policy_id) WHERE t.policy_id IS NULL OR t.event_timestamp < s.event_timestamp")
def scd2_to_insert(spark, d):
    return store.scd2_to_insert(*_target_and_latest(spark, d), "policy_id", "event_timestamp").select("policy_id", "record_id")


@query(f"SELECT * FROM {_HISTORY}")
def scd2_history(spark, d):
    return _history(spark, d).select("policy_id", "record_id", "consent_status", "target_institution", "scope", "is_current", _us("valid_from"), _us("valid_to"))


@query(f"SELECT policy_id, consent_status, target_institution, scope, valid_from_us FROM {_HISTORY} WHERE is_current")
def consent_current_view(spark, d):
    return consent.current_consents(_history(spark, d)).select("policy_id", "consent_status", "target_institution", "scope", _us("valid_from"))


@query(f"SELECT target_institution, consent_status, count(*) AS total FROM {_HISTORY} WHERE is_current GROUP BY ALL")
def consent_by_institution(spark, d):
    return consent.by_institution(consent.current_consents(_history(spark, d)))


@query()
def profiles(spark, d):
    """Draws of a seeded generator without counterpart in SQL."""
    return consent.profiles(_bronze(spark, d))


def _shareable(spark, d):
    """The view over stand-in profiles that SQL can compute too; ``profiles`` covers the drawn ones."""
    people = _bronze(spark, d).select("policy_id").filter(F.col("policy_id").isNotNull()).distinct()
    people = people.select("policy_id", F.concat(F.lit("P "), F.col("policy_id")).alias("synthetic_name"), F.length("policy_id").cast("long").alias("synthetic_age"), F.lit(0.5).alias("risk_score"))
    shared = consent.shareable(consent.current_consents(_history(spark, d)), people, _silver(spark, d))
    return shared.select("policy_id", "target_institution", "scope", "synthetic_name", "synthetic_age", "risk_score", "claim_id", "event_type", _num("amount", 2), "region")


_SHAREABLE = f"""(SELECT h.policy_id, h.target_institution, h.scope, 'P ' || h.policy_id AS synthetic_name, length(h.policy_id)::BIGINT AS synthetic_age, 0.5::DOUBLE AS risk_score,
    c.claim_id, c.event_type, c.amount::DOUBLE AS amount, c.region FROM {_HISTORY} h LEFT JOIN {_SILVER} c USING (policy_id)
    WHERE h.is_current AND h.consent_status = 'GRANTED' AND h.policy_id IN (SELECT policy_id FROM bronze_claims))"""


@query(f"SELECT * FROM {_SHAREABLE}")
def shareable_view(spark, d):
    return _shareable(spark, d)


# --- monitoring and governance ----------------------------------------------------------------------------------------


@query("""SELECT count(*) AS sample_size, round(avg(s), 6) AS avg_seconds, max(s) AS max_seconds, 120::BIGINT AS sla_seconds, max(s) <= 120 AS within_sla
    FROM (SELECT epoch_us(_ingested_at) // 1000000 - epoch_us(kafka_timestamp) // 1000000 AS s FROM bronze_claims)""")
def latency_bronze(spark, d):
    out = monitoring.latency(_bronze(spark, d), "kafka_timestamp", "_ingested_at", monitoring.KAFKA_TO_BRONZE_SECONDS)
    return out.withColumn("avg_seconds", F.round("avg_seconds", 6))


@query(f"SELECT count(*) AS sample_size, round(avg(s), 6) AS avg_seconds, max(s) AS max_seconds, 420::BIGINT AS sla_seconds, max(s) <= 420 AS within_sla FROM (SELECT scored_us // 1000000 - epoch_us(_ingested_at) // 1000000 AS s FROM {_GOLD})")
def latency_gold(spark, d):
    out = monitoring.latency(_gold(spark, d), "_ingested_at", "_scored_at", monitoring.SCORE_SECONDS)
    return out.withColumn("avg_seconds", F.round("avg_seconds", 6))


@query("SELECT epoch_us(_ingested_at) // 60000000 * 60000000 AS minute_us, count(*) AS events FROM bronze_claims GROUP BY 1")
def throughput_per_minute(spark, d):
    return monitoring.per_minute(_bronze(spark, d)).select(_us("minute"), "events")


@query("SELECT count(*) AS minutes_observed, count(*) FILTER (events < 80) AS minutes_below, count(*) FILTER (events < 80) = 0 AS within_sla FROM (SELECT count(*) AS events FROM bronze_claims GROUP BY epoch_us(_ingested_at) // 60000000)")
def throughput_summary(spark, d):
    return monitoring.throughput(monitoring.per_minute(_bronze(spark, d)))


_AGE = f"(({_AS_OF_US} // 1000000 - epoch_us(event_timestamp) // 1000000) / 3600.0::DOUBLE)"


@query(f"SELECT claim_id, round({_AGE}, 6) AS age_hours FROM {_GOLD} WHERE NOT auto_approved AND {_AGE} > 24")
def sla_breaches(spark, d):
    return monitoring.review_breaches(_gold(spark, d), AS_OF).select("claim_id", _num("age_hours"))


@query(f"SELECT count(*) FILTER (NOT auto_approved AND {_AGE} > 24) AS breaches, count(*) AS claims, round(count(*) FILTER (NOT auto_approved AND {_AGE} > 24) / count(*), 6) AS breach_ratio FROM {_GOLD}")
def sla_breach_ratio(spark, d):
    return monitoring.breach_ratio(_gold(spark, d), AS_OF).select("breaches", "claims", _num("breach_ratio"))


@query("SELECT record_id, sha256(customer_id) AS customer_id, sha256(policy_id) AS policy_id, region FROM bronze_claims")
def masked_claims(spark, d):
    return governance.mask_columns(_bronze(spark, d), {"analysts"}, "pii_readers").select("record_id", "customer_id", "policy_id", "region")


@query("SELECT record_id, customer_id, region FROM bronze_claims WHERE lower(region) IN ('sp', 'rj')")
def row_filtered_claims(spark, d):
    groups = {"insurance-region-sp", "insurance-region-rj", "pii_readers"}
    return governance.secured(_bronze(spark, d), groups, "pii_readers", "admins").select("record_id", "customer_id", "region")


# --- reports ----------------------------------------------------------------------------------------------------------


def _view(df: DataFrame, name: str) -> None:
    df.createOrReplaceTempView(name)


def _claims_view(spark, d):
    gold = _gold(spark, d, shadow=True)
    # Scores are rounded before ranking, so that ties fall to the key in every engine.
    _view(gold.withColumns({"fraud_score": F.round("fraud_score", 6), "model_fraud_score": F.round("model_fraud_score", 6)}), sc.CLAIMS)


_CLAIM_ROWS = f"(SELECT claim_id, policy_id, region, amount::DOUBLE AS amount, round(fraud_score, 6) AS fraud_score, fraud_flag, round(stand_in, 6) AS model_fraud_score, auto_approved, epoch_us(event_timestamp) AS event_timestamp_us, event_timestamp FROM {_GOLD})"


def _claim_rows(df: DataFrame) -> DataFrame:
    return df.withColumn("amount", F.col("amount").cast("double")).withColumn("event_timestamp_us", F.unix_micros("event_timestamp")).drop("event_timestamp")


def _top(columns: str, order: str, limit: int, where: str = "true") -> str:
    return f"SELECT * EXCLUDE (event_timestamp) FROM (SELECT {columns} FROM {_CLAIM_ROWS} WHERE {where}) ORDER BY {order} LIMIT {limit}"


def _export_report(compliant: bool, name: str):
    def run(spark, d):
        _view(_export(spark, d), sc.EXPORT)
        return sc.run(spark, sc.export_claims(compliant))

    run.__name__ = name
    word = "= ''" if compliant else "<> ''"
    return query(f"""SELECT * FROM {_EXPORT} WHERE compliance_issues {word}
      ORDER BY D_OCORR DESC NULLS LAST, COD_APO NULLS FIRST, INDENIZ NULLS FIRST, REGIAO NULLS FIRST, CAUSA NULLS FIRST, compliance_issues LIMIT 200""")(run)


_export_report(True, "v01_susep_claims")
_export_report(False, "v01_susep_claims_open")


@query(f"SELECT compliance_issues = '' AS susep_compliant, count(*) AS total FROM {_EXPORT} GROUP BY 1")
def v02_compliance_summary(spark, d):
    _view(_export(spark, d), sc.EXPORT)
    return sc.run(spark, sc.export_summary())


@query(f"SELECT source_system, count(*) AS total_sinistros FROM {_REG} GROUP BY 1")
def v03_source_volume(spark, d):
    _view(_regulatory_silver(spark, d), sc.SILVER_REG)
    return sc.run(spark, sc.source_volume())


@query(f"SELECT consent_status, target_institution, count(*) AS total FROM {_HISTORY} WHERE is_current GROUP BY ALL")
def v04_consent_summary(spark, d):
    _view(consent.current_consents(_history(spark, d)), sc.CONSENTS)
    return sc.run(spark, sc.consent_summary())


@query(f"SELECT * FROM {_SHAREABLE} ORDER BY policy_id, claim_id NULLS FIRST, event_type NULLS FIRST, amount NULLS FIRST, region NULLS FIRST LIMIT 100")
def v05_shareable(spark, d):
    _view(_shareable(spark, d), sc.SHAREABLE)
    return sc.run(spark, sc.shareable())


@query(f"SELECT policy_id, consent_status, target_institution, scope, is_current, valid_from_us, valid_to_us FROM {_HISTORY} ORDER BY valid_from_us DESC, policy_id LIMIT 200")
def v06_consent_history(spark, d):
    _view(_history(spark, d), sc.HISTORY)
    return sc.run(spark, sc.consent_history()).select("policy_id", "consent_status", "target_institution", "scope", "is_current", _us("valid_from"), _us("valid_to"))


@query(_top("*", "fraud_score DESC, claim_id, event_timestamp_us", 100))
def v07_fraud_probability(spark, d):
    _claims_view(spark, d)
    return _claim_rows(sc.run(spark, sc.top_scores()))


@query(f"SELECT claim_id, policy_id, region, amount, event_timestamp_us, round(age_hours, 6) AS age_hours FROM (SELECT *, {_AGE} AS age_hours FROM {_CLAIM_ROWS}) WHERE NOT auto_approved AND age_hours > 24 ORDER BY age_hours DESC, claim_id LIMIT 100")
def v08_sla_breach(spark, d):
    _claims_view(spark, d)
    return _claim_rows(sc.run(spark, sc.review_breaches(str(AS_OF)))).withColumn("age_hours", F.round("age_hours", 6))


@query(f"""SELECT count(*) AS total_claims, count(*) FILTER (fraud_flag) AS flagged_fraud, count(*) FILTER (auto_approved) AS auto_approved, count(model_fraud_score) AS model_scored,
    round(avg(fraud_score), 6) AS avg_fraud_score, round(avg(model_fraud_score), 6) AS avg_model_fraud_score FROM {_CLAIM_ROWS}""")
def v09_fraud_summary(spark, d):
    _claims_view(spark, d)
    return sc.run(spark, sc.score_summary()).withColumns({c: F.round(c, 6) for c in ("avg_fraud_score", "avg_model_fraud_score")})


@query(f"SELECT * EXCLUDE (event_timestamp) REPLACE (round(score_diff, 6) AS score_diff) FROM (SELECT *, abs(fraud_score - model_fraud_score) AS score_diff FROM {_CLAIM_ROWS}) ORDER BY score_diff DESC, claim_id, event_timestamp_us LIMIT 50")
def v10_model_divergence(spark, d):
    _claims_view(spark, d)
    return _claim_rows(sc.run(spark, sc.score_divergence())).withColumn("score_diff", F.round("score_diff", 6))


@query(ORACLES["dq_summary"])
def v11_dq_summary(spark, d):
    _view(dq_summary(spark, d).withColumn("_generated_at", F.lit(AS_OF)), "gold_dq_summary")
    return sc.run(spark, sc.dq_summaries()).drop("_generated_at")


@query(f"""SELECT external_reference_id, kind AS discrepancy_type, array_to_string(sources, ',') AS sources, round(lo, 2) AS min_amount, round(hi, 2) AS max_amount
    FROM {_RECON} ORDER BY external_reference_id, kind, lo, hi LIMIT 50""")
def v12_reconciliation(spark, d):
    _view(regulatory.reconciled(_regulatory_silver(spark, d)).withColumn("detected_at", F.lit(AS_OF)), "reconciliation_results")
    out = sc.run(spark, sc.discrepancies())
    return out.select("external_reference_id", "discrepancy_type", F.array_join("sources_reporting", ",").alias("sources"), _num("min_amount", 2), _num("max_amount", 2))


@query(f"SELECT check_name, table_name, failed_rows = 0 AS passed, failed_rows FROM {_DQ}")
def v13_dq_results(spark, d):
    _view(_dq(spark, d).withColumn("_checked_at", F.lit(AS_OF)), "dq_results")
    return sc.run(spark, sc.dq_results()).drop("_checked_at")


@query(f"SELECT feature_name, round(baseline_mean, 6) AS baseline_mean, round(current_mean, 6) AS current_mean, round(drift_ratio, 6) AS drift_ratio, drift_ratio > 2.0 AS drift_detected, 24 AS window_hours FROM {_DRIFT}")
def v14_model_drift(spark, d):
    _view(_drift(spark, d).withColumns({"window_hours": F.lit(24), "_checked_at": F.lit(AS_OF)}), "drift_results")
    return sc.run(spark, sc.drift_results()).select("feature_name", _num("baseline_mean"), _num("current_mean"), _num("drift_ratio"), "drift_detected", "window_hours")


@query(f"SELECT 'kafka_to_bronze' AS metric_name, within_sla, sample_size, max_seconds, sla_seconds FROM ({ORACLES['latency_bronze']}) UNION ALL SELECT 'score_visible', within_sla, sample_size, max_seconds, sla_seconds FROM ({ORACLES['latency_gold']})")
def v15_pipeline_latency(spark, d):
    rows = [monitoring.report(n, q(spark, d), F.lit(AS_OF)) for n, q in (("kafka_to_bronze", latency_bronze), ("score_visible", latency_gold))]
    _view(rows[0].unionByName(rows[1]), "latency_results")
    details = [F.get_json_object("details_json", f"$.{n}").cast("long").alias(n) for n in ("sample_size", "max_seconds", "sla_seconds")]
    return sc.run(spark, sc.latency_results()).select("metric_name", "within_sla", *details)


def _usage_view(spark, d):
    """Usage records from the events table: product, day, quantity and, but for every 19th, a job."""
    events = read_table(spark, d, "events")
    job = F.when(F.col("event_id") % 19 != 0, F.col("user_id").cast("string"))
    _view(events.select(F.col("event_type").alias("billing_origin_product"), F.to_date("ts").alias("usage_date"), F.col("value").alias("usage_quantity"), F.struct(job.alias("job_id")).alias("usage_metadata")), sc.USAGE)


_TODAY = "2024-01-31"


@query(f"SELECT event_type AS billing_origin_product, ts::DATE AS usage_date, round(sum(value), 4) AS usage_quantity FROM events WHERE ts::DATE >= DATE '{_TODAY}' - 30 GROUP BY ALL")
def v16_usage_by_product(spark, d):
    _usage_view(spark, d)
    return sc.run(spark, sc.usage_by_product(_TODAY)).withColumn("usage_quantity", F.round("usage_quantity", 4))


@query(f"SELECT user_id::VARCHAR AS job_id, round(sum(value), 4) AS usage_quantity FROM events WHERE ts::DATE >= DATE '{_TODAY}' - 30 AND event_id % 19 <> 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def v17_usage_by_job(spark, d):
    _usage_view(spark, d)
    return sc.run(spark, sc.usage_by_job(_TODAY)).withColumn("usage_quantity", F.round("usage_quantity", 4))


@query("SELECT max(epoch_us(_ingested_at)) AS latest_us FROM bronze_claims")
def v18_table_freshness(spark, d):
    _view(_bronze(spark, d), "bronze_claims_view")
    return sc.run(spark, sc.table_freshness("bronze_claims_view", "_ingested_at")).select(F.unix_micros("latest_ts").alias("latest_us"))


@query("SELECT count(*) AS total FROM bronze_claims")
def v19_table_count(spark, d):
    _view(_bronze(spark, d), "bronze_claims_view")
    return sc.run(spark, sc.table_count("bronze_claims_view"))
