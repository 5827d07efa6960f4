"""Window features of claims and the weighted score over them.

Hot groups: the entity of the frequency feature is null for almost every claim, so all claims may form one group. The
count over the last 24 hours is therefore taken on counts per entity and second, in time buckets that carry their
predecessor's seconds along, and joined back by entity and second. Region statistics are aggregated and joined back
instead of being computed over a whole region in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.session import row_hash, salted_join

DAY = 86_400
# Weights and threshold of the score.
WEIGHTS = {"night_claim": 0.25, "high_frequency": 0.35, "amount_outlier": 0.40}
THRESHOLD = 0.7
FEATURES = tuple(WEIGHTS)


def night_claim(at: Column) -> Column:
    """1.0 from 22 to 6 o'clock, else 0.0; also 0.0 without time."""
    return F.when((F.hour(at) >= 22) | (F.hour(at) < 6), 1.0).otherwise(0.0)


def with_recent_count(df: DataFrame, entity: str = "customer_id", at: str = "event_timestamp", counted: str = "claim_id", into: str = "claims_last_24h", span: int = DAY) -> DataFrame:
    """Adds the rows of the same entity (null is one) within ``span`` seconds up to and including the row's own second.

    Rows with a null ``counted`` are not counted; rows without time count the rows without time.
    """
    second = F.unix_seconds(F.col(at))
    per_second = df.groupBy(F.col(entity).alias("__e"), second.alias("__s")).agg(F.count(counted).alias("__n"))
    timed = per_second.filter(F.col("__s").isNotNull())
    # A second adds its rows in its own bucket, is carried into the next one at its start, and is taken off there when
    # it falls out of the span. A running total over these steps is linear, which a sliding frame is not.
    s, n = F.col("__s"), F.col("__n")
    bucket, gone = F.floor(s / span), s + span + 1
    step = lambda b, at, by, own: F.struct(b.alias("b"), at.alias("at"), by.alias("by"), F.lit(own).alias("own"))
    steps = F.array_compact(F.array(step(bucket, s, n, True), step(bucket + 1, (bucket + 1) * span, n, False), F.when(F.floor(gone / span) == bucket + 1, step(bucket + 1, gone, -n, False))))
    total = F.sum("__x.by").over(Window.partitionBy("__e", "__x.b").orderBy("__x.at").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    recent = timed.withColumn("__x", F.explode(steps)).withColumn(into, total).filter("__x.own").select("__e", "__s", into)
    untimed = per_second.filter(F.col("__s").isNull()).select("__e", "__s", F.col("__n").alias(into))
    same = F.col(entity).eqNullSafe(F.col("__e")) & second.eqNullSafe(F.col("__s"))
    return df.join(recent.unionByName(untimed), same, "left").drop("__e", "__s")


def with_group_statistics(df: DataFrame, group: str = "region", value: str = "amount") -> DataFrame:
    """Adds ``__avg`` and ``__std`` (sample) of the row's group; null is a group. Few groups have nearly all rows, so where
    their statistics are too many to be broadcast, each group is spread over several parts of the join."""
    amount, named = F.col(value).cast("double"), F.struct(F.col(group).alias("g"))
    stats = df.groupBy(named.alias("__g")).agg(F.avg(amount).alias("__avg"), F.stddev_samp(amount).alias("__std"))
    return salted_join(df.withColumn("__g", named), stats, "__g", row_hash(df)).drop("__g")


def amount_outlier(amount: Column) -> Column:
    """A third of the z-score, between 0 and 1; 0 without amount. Deviations below 1 count as 1."""
    z = (amount.cast("double") - F.col("__avg")) / F.greatest(F.col("__std"), F.lit(1.0))
    return F.coalesce(F.least(F.greatest(z / 3.0, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def with_features(claims: DataFrame, entity: str = "customer_id", expected: int = 3) -> DataFrame:
    counted = with_group_statistics(with_recent_count(claims, entity))
    features = {
        "night_claim": night_claim(F.col("event_timestamp")),
        "high_frequency": F.least(F.col("claims_last_24h") / float(expected), F.lit(1.0)),
        "amount_outlier": amount_outlier(F.col("amount")),
    }
    return counted.withColumns(features).drop("__avg", "__std")


def score(weights: dict[str, float] = WEIGHTS) -> Column:
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.lit(weight) * F.col(name)
    return total


def scored(claims: DataFrame, entity: str = "customer_id", threshold: float = THRESHOLD) -> DataFrame:
    """Adds the features, ``fraud_score`` in [0, 1] and ``fraud_flag``."""
    return with_features(claims, entity).withColumn("fraud_score", score()).withColumn("fraud_flag", F.col("fraud_score") >= threshold)


def approved(limit: float, threshold: float = THRESHOLD) -> Column:
    """Small and unsuspicious; without amount null unless the score alone decides."""
    return (F.col("amount") <= limit) & (F.col("fraud_score") < threshold)


GOLD_COLUMNS = [
    "claim_id", "policy_id", "customer_id", "event_type", "event_timestamp", "amount", "region", "vehicle_type", "fraud_score", "fraud_flag",
    "model_fraud_score", "auto_approved", "event_date", "_ingested_at", "_scored_at",
]


def claims_gold(claims: DataFrame, scored_at: Column, model=None, limit: float = 5000.0) -> DataFrame:
    """Claims with scores in the gold layout. ``model`` gives a shadow score that decides nothing: a trained pipeline, or a
    function of the feature columns; without one the score is null."""
    out = scored(claims)
    if hasattr(model, "transform"):
        from claimloom.operators.model import with_shadow_score

        out = with_shadow_score(out, model)
    else:
        out = out.withColumn("model_fraud_score", (model(*[F.col(f) for f in FEATURES]) if model else F.lit(None)).cast("double"))
    out = out.withColumns({"auto_approved": approved(limit), "_scored_at": scored_at})
    return out.withColumn("event_date", F.to_date("event_timestamp")).select(*[c for c in GOLD_COLUMNS if c in out.columns or c == "event_date"])


def region_aggregates(gold: DataFrame) -> DataFrame:
    yes = lambda c: F.coalesce(F.sum(F.when(F.col(c), 1).otherwise(0)), F.lit(0)).cast("long")
    return gold.groupBy("region", "event_date").agg(
        F.count("claim_id").alias("claim_count"), (F.sum("amount").cast("double") / F.nullif(F.count("amount"), F.lit(0))).alias("avg_claim_amount"),
        yes("fraud_flag").alias("flagged_fraud_count"), yes("auto_approved").alias("auto_approved_count"),
    )


def feature_means(scored_df: DataFrame) -> DataFrame:
    return scored_df.agg(*[F.avg(f).alias(f) for f in FEATURES])


def feature_baseline(scored_df: DataFrame) -> DataFrame:
    """``feature_name``, ``mean``, ``stddev`` (sample), in one pass."""
    stats = scored_df.agg(*[x for f in FEATURES for x in (F.avg(f).alias(f"{f}_m"), F.stddev_samp(f).alias(f"{f}_s"))])
    return stats.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature_name"), F.col(f"{f}_m").alias("mean"), F.col(f"{f}_s").alias("stddev")) for f in FEATURES])).alias("x")).select("x.*")


def drift(baseline: DataFrame, current: DataFrame, threshold: float = 2.0, least_stddev: float = 0.05) -> DataFrame:
    """Distance of current means (``feature_name``, ``mean``) from the baseline, in baseline deviations; features that
    one side lacks are left out."""
    now = current.select("feature_name", F.col("mean").alias("current_mean"))
    ratio = F.abs(F.col("current_mean") - F.col("mean")) / F.greatest(F.coalesce("stddev", F.lit(0.0)), F.lit(least_stddev))
    joined = baseline.join(now, "feature_name").filter(F.col("current_mean").isNotNull())
    return joined.select(
        "feature_name", F.col("mean").alias("baseline_mean"), F.col("stddev").alias("baseline_stddev"), "current_mean", ratio.alias("drift_ratio"), (ratio > threshold).alias("drift_detected")
    )
