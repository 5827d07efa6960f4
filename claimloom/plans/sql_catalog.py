"""Parameterised reports: SQL text with named parameters over registered tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

CLAIMS, EXPORT, SILVER_REG = "gold_claims", "gold_regulatory_claims", "silver_regulatory_claims"
CONSENTS, HISTORY, SHAREABLE, USAGE = "gold_customer_consent", "silver_consent_history", "gold_shareable", "usage"


@dataclass(frozen=True)
class Report:
    """``rank`` orders the rows and ends in a unique key, so that a limit always keeps the same rows."""

    sql: str
    params: dict = field(default_factory=dict)


_SCORES = "claim_id, policy_id, region, amount, fraud_score, fraud_flag, model_fraud_score, auto_approved, event_timestamp"


def _latest(table: str, columns: str, at: str, ties: str, limit: int) -> Report:
    return Report(f"SELECT {columns} FROM {table} ORDER BY {at} DESC, {ties} LIMIT :row_limit", {"row_limit": limit})


def export_claims(compliant: bool, limit: int = 200) -> Report:
    sql = f"""SELECT COD_APO, D_OCORR, INDENIZ, REGIAO, CAUSA, compliance_issues FROM {EXPORT}
      WHERE susep_compliant = :compliant ORDER BY D_OCORR DESC NULLS LAST, COD_APO, INDENIZ, REGIAO, CAUSA, compliance_issues LIMIT :row_limit"""
    return Report(sql, {"compliant": compliant, "row_limit": limit})


def export_summary() -> Report:
    return Report(f"SELECT susep_compliant, count(*) AS total FROM {EXPORT} GROUP BY susep_compliant")


def source_volume() -> Report:
    return Report(f"SELECT source_system, count(*) AS total_sinistros FROM {SILVER_REG} GROUP BY source_system ORDER BY total_sinistros DESC, source_system")


def consent_summary() -> Report:
    return Report(f"SELECT consent_status, target_institution, count(*) AS total FROM {CONSENTS} GROUP BY consent_status, target_institution ORDER BY total DESC, consent_status, target_institution")


def shareable(limit: int = 100) -> Report:
    return Report(f"SELECT * FROM {SHAREABLE} ORDER BY policy_id, claim_id, event_type, amount, region LIMIT :row_limit", {"row_limit": limit})


def consent_history(limit: int = 200) -> Report:
    return _latest(HISTORY, "policy_id, consent_status, target_institution, scope, event_timestamp, is_current, valid_from, valid_to", "valid_from", "policy_id", limit)


def top_scores(limit: int = 100) -> Report:
    return _latest(CLAIMS, _SCORES, "fraud_score", "claim_id, event_timestamp", limit)


def review_breaches(as_of: str, hours: int = 24, limit: int = 100) -> Report:
    age = "(unix_timestamp(CAST(:as_of AS TIMESTAMP)) - unix_timestamp(event_timestamp)) / 3600"
    sql = f"""SELECT claim_id, policy_id, region, amount, event_timestamp, {age} AS age_hours FROM {CLAIMS}
      WHERE NOT auto_approved AND {age} > :sla_hours ORDER BY age_hours DESC, claim_id, event_timestamp LIMIT :row_limit"""
    return Report(sql, {"as_of": as_of, "sla_hours": hours, "row_limit": limit})


def score_summary() -> Report:
    return Report(
        f"""SELECT count(*) AS total_claims, count_if(fraud_flag) AS flagged_fraud, count_if(auto_approved) AS auto_approved,
        count(model_fraud_score) AS model_scored, avg(fraud_score) AS avg_fraud_score, avg(model_fraud_score) AS avg_model_fraud_score FROM {CLAIMS}"""
    )


def score_divergence(limit: int = 50) -> Report:
    sql = f"""SELECT {_SCORES}, abs(fraud_score - model_fraud_score) AS score_diff FROM {CLAIMS} WHERE model_fraud_score IS NOT NULL
      ORDER BY score_diff DESC, claim_id, event_timestamp LIMIT :row_limit"""
    return Report(sql, {"row_limit": limit})


def dq_summaries(limit: int = 50) -> Report:
    return _latest("gold_dq_summary", "*", "_generated_at", "dq_checks_total", limit)


def discrepancies(limit: int = 50) -> Report:
    return _latest("reconciliation_results", "*", "detected_at", "external_reference_id, discrepancy_type, min_amount, max_amount", limit)


def dq_results(limit: int = 100) -> Report:
    return _latest("dq_results", "check_name, table_name, passed, failed_rows, _checked_at", "_checked_at", "table_name, check_name", limit)


def drift_results(limit: int = 50) -> Report:
    return _latest("drift_results", "feature_name, baseline_mean, current_mean, drift_ratio, drift_detected, window_hours, _checked_at", "_checked_at", "feature_name", limit)


def latency_results(limit: int = 50) -> Report:
    return _latest("latency_results", "metric_name, details_json, within_sla, _checked_at", "_checked_at", "metric_name", limit)


_SINCE = "usage_date >= date_sub(CAST(:today AS DATE), :lookback_days)"


def usage_by_product(today: str, days: int = 30) -> Report:
    sql = f"""SELECT billing_origin_product, usage_date, sum(usage_quantity) AS usage_quantity FROM {USAGE} WHERE {_SINCE}
      GROUP BY billing_origin_product, usage_date ORDER BY usage_date DESC, usage_quantity DESC, billing_origin_product"""
    return Report(sql, {"today": today, "lookback_days": days})


def usage_by_job(today: str, days: int = 30, limit: int = 20) -> Report:
    sql = f"""SELECT usage_metadata.job_id AS job_id, sum(usage_quantity) AS usage_quantity FROM {USAGE} WHERE {_SINCE} AND usage_metadata.job_id IS NOT NULL
      GROUP BY usage_metadata.job_id ORDER BY usage_quantity DESC, job_id LIMIT :row_limit"""
    return Report(sql, {"today": today, "lookback_days": days, "row_limit": limit})


def table_freshness(table: str, column: str) -> Report:
    return Report("SELECT max(IDENTIFIER(:column)) AS latest_ts FROM IDENTIFIER(:table)", {"table": table, "column": column})


def table_count(table: str) -> Report:
    return Report("SELECT count(*) AS total FROM IDENTIFIER(:table)", {"table": table})


def run(spark: SparkSession, report: Report) -> DataFrame:
    return spark.sql(report.sql, args=report.params)


#: Rows of a report that the driver takes.
MAX_ROWS = 10_000


def run_or_none(spark: SparkSession, report: Report, most: int = MAX_ROWS) -> list[dict] | None:
    """Rows of a report; None where a table isn't there yet. A report of more than ``most`` rows raises and is to be read
    through ``run``."""
    from pyspark.errors import AnalysisException

    try:
        rows = [r.asDict() for r in run(spark, report).limit(most + 1).collect()]
        if len(rows) > most:
            raise ValueError(f"the report has more than {most} rows")
        return rows
    except AnalysisException as e:
        if "TABLE_OR_VIEW_NOT_FOUND" in str(e):
            return None
        raise
