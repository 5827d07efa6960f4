"""Three insurer layouts standardised, reconciled and exported in the regulator's layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import scalar

# The columns of each layout, by what they hold.
LAYOUTS = {
    "insurer_a": ("numero_apolice", "data_ocorrencia", "valor_indenizacao", "regiao_sinistro", "codigo_causa"),
    "insurer_b": ("POLICY_NUM", "EVENT_DATE", "CLAIM_AMOUNT", "REGION_CODE", "CAUSE_CD"),
    "insurer_c": ("policyId", "occurrenceDate", "amountCents", "regionCode", "causeCode"),
}
SILVER = ("external_reference_id", "source_system", "policy_id", "event_timestamp", "amount", "region", "cause_code")
VALID_CAUSES = tuple(scalar.CAUSES)


def _typed(source: str) -> list[Column]:
    policy, date, amount, region, cause = (F.col(c) for c in LAYOUTS[source])
    when = {
        "insurer_a": lambda: F.try_to_timestamp(date, F.lit("dd/MM/yyyy")),
        "insurer_b": lambda: F.try_to_timestamp(date, F.lit("yyyy-MM-dd")),
        "insurer_c": lambda: scalar.epoch_millis(date),
    }[source]()
    money = {"insurer_a": scalar.decimal_comma, "insurer_b": lambda c: c.try_cast("decimal(18,2)"), "insurer_c": scalar.cents}[source](amount)
    return [policy, when, money, region, cause.try_cast("int")]


def standardized_source(raw: DataFrame, source: str) -> DataFrame:
    """Rows of one source in the common layout; unreadable dates, amounts and codes are null."""
    columns = ["external_reference_id", "source_system", *[c.alias(n) for c, n in zip(_typed(source), SILVER[2:])]]
    return raw.filter(F.col("source_system") == source).select(*columns)


def standardized(raw: DataFrame) -> DataFrame:
    """All known sources in the common layout, in one scan; rows of other sources are left out."""
    typed = {s: _typed(s) for s in LAYOUTS}
    source = F.col("source_system")

    def pick(i: int) -> Column:
        out = F.when(source == "insurer_a", typed["insurer_a"][i])
        for s in ("insurer_b", "insurer_c"):
            out = out.when(source == s, typed[s][i])
        return out

    return raw.filter(source.isin(*LAYOUTS)).select("external_reference_id", "source_system", *[pick(i).alias(n) for i, n in enumerate(SILVER[2:])])


def trusted_regions(silver: DataFrame, least: int = 2) -> DataFrame:
    """Regions on which at least ``least`` rows of a claim agree."""
    known = silver.filter(F.col("region").isNotNull())
    return known.groupBy("external_reference_id", "region").count().filter(F.col("count") >= least).select("region").distinct()


def amount_mismatch(low: Column, high: Column, relative: float = 0.02, absolute: float = 5.0) -> Column:
    return (high - low) > F.greatest(low * relative, F.lit(absolute))


def reconciled(silver: DataFrame, active_sources: list[str] | None = None) -> DataFrame:
    """Discrepancies between the reports of each claim: amounts apart beyond tolerance, and active sources missing.

    Sums, sets and extremes combine before the shuffle. The sources of a claim are among the active ones, so it lacks one
    if it has fewer than there are; their number comes from a scalar subquery over one column, not from a join.
    """
    amount = F.col("amount").cast("double")
    per_claim = silver.groupBy("external_reference_id").agg(
        F.sort_array(F.collect_set("source_system")).alias("sources_reporting"),
        F.count("amount").alias("_n"),
        F.coalesce(F.min(amount), F.lit(0.0)).alias("min_amount"),
        F.coalesce(F.max(amount), F.lit(0.0)).alias("max_amount"),
        F.coalesce(F.median(amount), F.lit(0.0)).alias("resolved_amount"),
    )
    if active_sources is None:
        lacking = F.size("sources_reporting") < silver.agg(F.count_distinct("source_system")).scalar()
    else:
        lacking = F.size(F.array_except(F.array(*[F.lit(s) for s in active_sources]), "sources_reporting")) > 0
    kinds = F.array_compact(
        F.array(
            F.when((F.col("_n") > 0) & amount_mismatch(F.col("min_amount"), F.col("max_amount")), "amount_mismatch"),
            F.when(lacking, "missing_in_source"),
        )
    )
    return per_claim.withColumn("discrepancy_type", F.explode(kinds)).select(
        "external_reference_id", "discrepancy_type", "sources_reporting", "min_amount", "max_amount", "resolved_amount"
    )


def claim_base(silver: DataFrame) -> DataFrame:
    """One row per claim: of each attribute the value of the first source by name that states it (then the smallest), of
    the amounts the lower median."""
    stated = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("source_system", c)))[c]
    return silver.groupBy("external_reference_id").agg(
        stated("policy_id").alias("COD_APO"),
        stated("event_timestamp").alias("_at"),
        F.percentile_approx(F.col("amount").cast("double"), 0.5, 10_000).alias("INDENIZ"),
        stated("region").alias("REGIAO"),
        stated("cause_code").alias("CAUSA"),
    )


def export_claims(silver: DataFrame, reconciliation: DataFrame) -> DataFrame:
    """The regulator's layout with the issues of each claim; a claim without issues is compliant."""
    kinds = reconciliation.groupBy("external_reference_id").agg(F.array_join(F.sort_array(F.collect_set("discrepancy_type")), ",").alias("_kinds"))
    rows = claim_base(silver).withColumn("D_OCORR", F.date_format("_at", "yyyyMMdd")).join(kinds, "external_reference_id", "left")
    missing = {"policy_id_ausente": "COD_APO", "data_ausente": "D_OCORR", "valor_ausente": "INDENIZ"}
    issues = F.concat_ws(
        ",",
        *[F.when(F.col(c).isNull(), F.lit(issue)) for issue, c in missing.items()],
        F.when(~F.col("CAUSA").isin(*VALID_CAUSES), F.lit("causa_invalida")),
        F.when(F.col("_kinds").isNotNull(), F.concat(F.lit("reconciliacao:"), F.col("_kinds"))),
    )
    return rows.withColumn("compliance_issues", issues).select(
        "COD_APO", "D_OCORR", "INDENIZ", "REGIAO", "CAUSA", (F.col("compliance_issues") == "").alias("susep_compliant"), "compliance_issues"
    )


def alert_due(dq_total: int, dq_failed: int, discrepancies: int, claims: int, most_failed: float = 0.05, most_discrepant: float = 0.10) -> bool:
    """Whether the share of failed checks or of discrepancies is above its bound; nothing counted means no share."""
    share = lambda n, total: n / total if total else 0.0
    return share(dq_failed, dq_total) > most_failed or share(discrepancies, claims) > most_discrepant
