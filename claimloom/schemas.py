"""Event schemas by topic. The layouts are contracts with the producers."""

from __future__ import annotations

from pyspark.sql import types as T

_STRING, _TIME, _MONEY = T.StringType(), T.TimestampType(), T.DecimalType(18, 2)


# The layouts of the topics.
CLAIM = T.StructType(
    [
        T.StructField("claim_id", _STRING, nullable=False),
        T.StructField("policy_id", _STRING),
        T.StructField("customer_id", _STRING),
        T.StructField("event_type", _STRING, nullable=False),
        T.StructField("event_timestamp", _TIME, nullable=False),
        T.StructField("amount", _MONEY),
        T.StructField("region", _STRING),
        T.StructField("vehicle_type", _STRING),
        T.StructField("source", _STRING),
    ]
)

POLICY = T.StructType(
    [
        T.StructField("policy_id", _STRING, nullable=False),
        T.StructField("customer_id", _STRING),
        T.StructField("event_type", _STRING, nullable=False),
        T.StructField("event_timestamp", _TIME, nullable=False),
        T.StructField("premium_amount", _MONEY),
        T.StructField("coverage_type", _STRING),
        T.StructField("region", _STRING),
        T.StructField("source", _STRING),
    ]
)

CUSTOMER = T.StructType(
    [
        T.StructField("customer_id", _STRING, nullable=False),
        T.StructField("event_type", _STRING, nullable=False),
        T.StructField("event_timestamp", _TIME, nullable=False),
        T.StructField("region", _STRING),
        T.StructField("source", _STRING),
    ]
)

CONSENT = T.StructType(
    [
        T.StructField("policy_id", _STRING, nullable=False),
        T.StructField("consent_status", _STRING, nullable=False),
        T.StructField("target_institution", _STRING, nullable=False),
        T.StructField("scope", _STRING),
        T.StructField("event_timestamp", _TIME, nullable=False),
    ]
)

REGULATORY_RAW = T.StructType(
    [
        T.StructField("external_reference_id", _STRING, nullable=False),
        T.StructField("source_system", _STRING, nullable=False),
        T.StructField("numero_apolice", _STRING),
        T.StructField("data_ocorrencia", _STRING),
        T.StructField("valor_indenizacao", _STRING),
        T.StructField("regiao_sinistro", _STRING),
        T.StructField("codigo_causa", _STRING),
        T.StructField("POLICY_NUM", _STRING),
        T.StructField("EVENT_DATE", _STRING),
        T.StructField("CLAIM_AMOUNT", _STRING),
        T.StructField("REGION_CODE", _STRING),
        T.StructField("CAUSE_CD", _STRING),
        T.StructField("policyId", _STRING),
        T.StructField("occurrenceDate", _STRING),
        T.StructField("amountCents", _STRING),
        T.StructField("regionCode", _STRING),
        T.StructField("causeCode", _STRING),
    ]
)

#: Columns of any topic, with the names and types that they have in bronze.
TOPIC_COLUMNS = {
    "key": ("event_key", "string"),
    "value": ("raw_value", "string"),
    "timestamp": ("kafka_timestamp", "timestamp"),
    "partition": ("partition", "int"),
    "offset": ("offset", "bigint"),
}

TOPICS = {
    "claim-opened": CLAIM,
    "claim-updated": CLAIM,
    "policy-created": POLICY,
    "customer-updated": CUSTOMER,
    "consent-updated": CONSENT,
    "regulatory-claim-report": REGULATORY_RAW,
}

#: Fields without which an event of a topic goes to quarantine.
REQUIRED = {
    "consent-updated": ["policy_id", "consent_status", "target_institution"],
    "regulatory-claim-report": ["external_reference_id"],
}
DEFAULT_REQUIRED = ["event_type", "event_timestamp"]


def schema_of(topic: str) -> T.StructType:
    if topic not in TOPICS:
        raise ValueError(f"no schema for topic {topic!r}")
    return TOPICS[topic]


def required_of(topic: str) -> list[str]:
    return REQUIRED.get(topic, DEFAULT_REQUIRED)


REGULATORY_SILVER = T.StructType(
    [
        T.StructField("external_reference_id", _STRING),
        T.StructField("source_system", _STRING),
        T.StructField("policy_id", _STRING),
        T.StructField("event_timestamp", _TIME),
        T.StructField("amount", _MONEY),
        T.StructField("region", _STRING),
        T.StructField("cause_code", T.IntegerType()),
    ]
)

RECONCILIATION = T.StructType(
    [
        T.StructField("external_reference_id", _STRING),
        T.StructField("discrepancy_type", _STRING),
        T.StructField("sources_reporting", T.ArrayType(_STRING)),
        T.StructField("min_amount", T.DoubleType()),
        T.StructField("max_amount", T.DoubleType()),
        T.StructField("resolved_amount", T.DoubleType()),
    ]
)
